"""Files in shared folders by URI, for code that runs in Python workers: local folders and the stores pyarrow knows."""

from __future__ import annotations

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def make_dir(uri: str) -> None:
    store, path = opened(uri)
    store.create_dir(path, recursive=True)


def write_bytes(uri: str, *parts) -> None:
    """A whole file. Readers learn of a file by a manifest only, after its task has ended well, so a lost task's file is never read."""
    store, path = opened(uri)
    with store.open_output_stream(path, compression=None) as out:
        for part in parts:
            out.write(part)


def read_bytes(uri: str) -> bytes:
    store, path = opened(uri)
    with store.open_input_file(path) as f:
        return f.read()

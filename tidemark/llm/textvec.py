"""Words and shingles of whole columns of texts as flat numpy arrays, for code in Python workers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Odd multipliers of the places in a shingle.
PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def word_codes(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Each word as an index into the distinct words, those words, and where each text's words begin (one more than texts)."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    at = split.offsets.to_numpy().astype(np.int64)
    values = split.values.slice(at[0], at[-1] - at[0])
    full = pc.not_equal(values, "")
    if not pc.all(full).as_py():  # white space at an end makes an empty piece
        held = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False))))
        at, values = held[at - at[0]], values.filter(full)
    coded = values.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary, at - at[0]


def hashed(words: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    codes, each, at = word_codes(texts)
    return hashed(each)[codes] if len(each) else np.empty(0, np.uint64), at


def shingles(texts: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of each text's runs of ``size`` words, and where each text's begin; a text of fewer words has one run of them all."""
    words, at = word_hashes(texts)
    count = np.diff(at)
    runs = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    out_at = np.concatenate(([0], np.cumsum(runs)))
    first = np.repeat(at[:-1] - out_at[:-1], runs) + np.arange(out_at[-1])
    padded = np.concatenate((words, np.zeros(size, np.uint64)))
    out = np.zeros(len(first), np.uint64)
    length = np.repeat(np.minimum(count, size), runs)
    for k in range(size):
        part = mixed(padded[first + k] + np.uint64(k + 1)) * PLACE[k % len(PLACE)]
        out += part if (length > k).all() else np.where(length > k, part, np.uint64(0))
    return mixed(out), out_at

"""Identifiers and content hashes of records."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The canonical form of a random UUID, and the name space of synthetic record ids where the caller has none of its own.
UUID4 = r"^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
RECORD_SPACE = "urn:catalogrecord:"


def is_uuid4(text: Column) -> Column:
    return F.coalesce(text.rlike(UUID4), F.lit(False))


def identifier(raw: Column) -> Column:
    """The usable identifier in a JSON value: a string that isn't blank as it stands, an object's @id, else null."""
    value = F.try_parse_json(raw)
    kind = F.schema_of_variant(value)
    text = F.when(kind == "STRING", F.try_variant_get(value, "$", "string")).when(kind.startswith("OBJECT"), F.try_variant_get(value, "$['@id']", "string"))
    return F.when(F.trim(text) != "", text)


def identifier_error(raw: Column) -> Column:
    """Why a JSON value is no identifier; null for one that is."""
    kind = F.schema_of_variant(F.try_parse_json(raw))
    return F.when(identifier(raw).isNotNull(), F.lit(None).cast("string")).when(kind.startswith("OBJECT"), "identifier object has no usable '@id'").when(raw.isNull() | kind.isin("VOID", "STRING") | kind.isNull(), "identifier is missing").otherwise("identifier is invalid")


def synthetic_record_id(topic: Column, modified: Column, space: str = RECORD_SPACE) -> Column:
    """A stable @id for a catalog record without one."""
    basis = F.concat(F.coalesce(topic, F.lit("None")), F.lit("|"), F.coalesce(modified, F.lit("None")))
    return F.concat(F.lit(space), F.sha2(basis, 256))


def text_hash(text: Column) -> Column:
    """SHA-256 of an ASCII text as a JSON string: the hash of an XML payload without characters to escape beyond quotes and backslashes."""
    quoted = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.sha2(F.concat(F.lit('"'), quoted, F.lit('"')), 256)


def canonical(value, sort_arrays: bool = True):
    """A JSON value with keys in order at every level, and arrays too if so asked."""
    if isinstance(value, dict):
        return {k: canonical(value[k], sort_arrays) for k in sorted(value)}
    if isinstance(value, list):
        items = [canonical(v, sort_arrays) for v in value]
        return sorted(items, key=lambda v: json.dumps(v, sort_keys=True)) if sort_arrays else items
    return value


def content_hash(sort_arrays: bool = True):
    """A column function: the content hash of a JSON payload, SHA-256 over the canonical text as a JSON string. Numbers keep their spelling."""

    @F.pandas_udf("string")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(raw):
            if raw is None:
                return None
            text = json.dumps(canonical(json.loads(raw), sort_arrays))
            return hashlib.sha256(json.dumps(text).encode()).hexdigest()

        for batch in batches:
            yield batch.map(one, na_action=None)

    return digest

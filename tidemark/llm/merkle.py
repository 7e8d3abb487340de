"""Merkle dataset manifest: a hash tree over the rows of each source, one over the sources, and a proof for every row.

A leaf is the hash of a document's columns. The leaves of a source stand in order of doc_id; every ``ARITY`` consecutive nodes of a level
become one node of the next, until one remains, the source's subroot. The subroots in order of their sources are the leaves of the
dataset's own tree, whose last node is the root.

The tree is built in blocks of ``ARITY ** BLOCK_LEVELS`` consecutive nodes, each an ordered array in one row. Higher-order functions collapse a
block level by level (sequence, transform, slice, aggregate), and the roots of the blocks are the nodes of the next round, until every tree has one
block. A row meets ``BLOCK_LEVELS`` levels at once, no task sees more than whole blocks, and a source that holds most rows is as many blocks as it
fills. Proofs go the way back: a block's row takes the path above it from the round after, and gives each of its nodes the path from there.

Places in the order come from range partitions: rows are dealt by source, doc_id and leaf, and sorted; counts of each partition's sources, added up
over the partitions before, tell where its rows begin.

Defined cases: a null column counts as ``-``, an empty text as a value of no bytes; a null source is a source of its own, before all others; a null
doc_id stands before all others and its document is never tampered with; rows that tie in doc_id stand in order of their leaves, and rows that repeat
have equal leaves and places of their own; very long texts are hashed whole; an empty table gives no rows; extra columns stay out. The only leaf of a source
is its subroot, the only subroot the root, and a proof without siblings is the hash of nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small, written
from tidemark.llm.mixing import running

ARITY, BLOCK_LEVELS = 3, 6
#: The documents' columns that make a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of a range partition.
PART_ROWS = 200_000


def hashed(nodes: Column) -> Column:
    """The hash of an array of strings, one after another."""
    return F.sha2(F.array_join(nodes, ""), 256)


def leaf(**changed: Column) -> Column:
    """A document's leaf; a column may be given in place of its own."""
    values = [changed.get(c, F.col(c)).cast("string") for c in FIELDS]
    return hashed(F.array(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]))


def numbered(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """rows with ``pos``, from 0 in the order within the key, and ``n``, the key's rows; rows is a written table."""
    parts = max(1, -(-rows.count() // PART_ROWS))
    by = [F.col(key), *(F.col(c).asc_nulls_first() for c in order), F.col("_tie")]
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("_tie")
    dealt = written(dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), "ordered")
    spans = written(dealt.groupBy(key, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows")), "spans")
    last = spans.agg(F.max("_part")).first()[0] or 0
    ahead = running(spans, key, "_part", "_rows", "_ahead", last).select(key, "_part", "_first", "_ahead")
    starts = written(ahead.join(small(written(spans.groupBy(key).agg(F.sum("_rows").alias("n")), "sizes")), key), "starts")
    return dealt.join(small(starts), [key, "_part"]).withColumn("pos", F.col("_at") - F.col("_first") + F.col("_ahead")).drop("_at", "_part", "_first", "_ahead")


def _widths(n: Column, levels: int) -> Column:
    """The widths, in nodes of a block, of the levels that a tree of n nodes has in its block; one for each level that is collapsed."""
    return F.filter(F.array(*[F.lit(ARITY**k) for k in range(levels)]), lambda w: w < n)


def collapsed(nodes: Column, widths: Column) -> Column:
    """All levels of a block, its nodes first."""
    above = lambda level: F.transform(F.sequence(F.lit(0), F.floor((F.size(level) - 1) / ARITY).cast("int")), lambda j: hashed(F.slice(level, j * ARITY + 1, ARITY)))
    return F.aggregate(widths, F.array(nodes), lambda levels, _: F.concat(levels, F.array(above(F.element_at(levels, -1)))))


def siblings(levels: Column, widths: Column, place: Column) -> Column:
    """The path of a block's node: at each level the digests on its left and on its right within their run."""

    def beside(width: Column, k: Column) -> Column:
        at = F.floor(place / width).cast("int")
        own = F.pmod(at, F.lit(ARITY))
        run = F.slice(F.get(levels, k), at - own + 1, ARITY)
        return F.struct(F.array_join(F.slice(run, 1, own), "").alias("left"), F.array_join(F.slice(run, own + 2, ARITY), "").alias("right"))

    return F.transform(widths, beside)


def blocks(nodes: DataFrame, key: str, levels: int) -> DataFrame:
    """Each block of nodes (key, n, pos, digest and more): key, block, n, its nodes in order, and the levels above them."""
    rest = [F.col(c) for c in nodes.columns if c not in (key, "n", "pos")]
    own = nodes.groupBy(key, "n", F.floor(F.col("pos") / ARITY**levels).alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", *rest))).alias("nodes"))
    return own.withColumn("levels", collapsed(F.transform("nodes", lambda x: x["digest"]), _widths(F.col("n"), levels)))


def grown(nodes: DataFrame, key: str, levels: int = BLOCK_LEVELS) -> tuple[list[DataFrame], DataFrame]:
    """The trees over nodes (key, n, pos, digest and more), a tree for each key: the rounds' blocks, and the roots (key, digest)."""
    rounds = []
    while True:
        rounds.append(written(blocks(nodes, key, levels), "blocks"))
        more = F.ceil(F.col("n") / ARITY**levels)
        nodes = rounds[-1].select(key, more.alias("n"), F.col("block").alias("pos"), F.get(F.element_at("levels", -1), F.lit(0)).alias("digest"))
        if (rounds[-1].agg(F.max(more)).first()[0] or 1) == 1:
            return rounds, nodes.select(key, "digest")


def proved(rounds: list[DataFrame], key: str, above: DataFrame, levels: int = BLOCK_LEVELS) -> DataFrame:
    """The nodes of the first round, each with above's columns and its path, up to where above's paths end. above: (key, path and more), a row per key."""
    more = [c for c in above.columns if c not in (key, "path")]
    upper = above.withColumn("pos", F.lit(0).cast("long"))
    for k, own in reversed(list(enumerate(rounds))):
        met = own.join(upper.withColumnRenamed("pos", "block").withColumnRenamed("path", "_above"), [key, "block"])
        widths, before = _widths(F.col("n"), levels), F.col("block") * ARITY**levels
        path = lambda x: F.concat(siblings(F.col("levels"), widths, (x["pos"] - before)), F.col("_above"))  # noqa: B023, E731
        each = met.select(key, *more, F.explode(F.transform("nodes", lambda x: F.struct(x.alias("node"), path(x).alias("path")))).alias("e"))
        upper = each.select(key, *more, "e.node.*", "e.path")
        if k:
            upper = written(upper.drop("digest"), "paths")
    return upper


def manifest(docs: DataFrame, levels: int = BLOCK_LEVELS, **also: Column) -> DataFrame:
    """doc_id, source, leaf, path, subroot and root of every document, and further columns of its own by their names."""
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    leaves = written(docs.select("doc_id", key.alias("_key"), leaf().alias("digest"), *[c.alias(name) for name, c in also.items()]), "leaves")
    rounds, subroots = grown(numbered(leaves, "_key", "doc_id", "digest"), "_key", levels)
    sources = numbered(written(subroots.select(F.lit(0).alias("_all"), "_key", F.col("digest")), "subroots"), "_all", "_key")
    top, roots = grown(sources, "_all", levels)
    above = proved(top, "_all", roots.select("_all", F.col("digest").alias("root"), F.array().cast("array<struct<left:string,right:string>>").alias("path")), levels)
    above = written(above.select("_key", "path", "root", F.col("digest").alias("subroot")), "subroots")
    rows = proved(rounds, "_key", above, levels)
    source = F.when(F.col("_key") != "", F.substring("_key", 2, 1 << 30))
    return rows.select("doc_id", source.alias("source"), F.col("digest").alias("leaf"), "path", "subroot", "root", *also)


def proof(path: Column) -> Column:
    """The hash of all siblings of a path, level by level, left to right."""
    return hashed(F.transform(path, lambda p: F.concat(p["left"], p["right"])))


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, digest, lambda below, p: F.sha2(F.concat(p["left"], below, p["right"]), 256))


def without_line_feeds(docs: DataFrame) -> Column:
    """The leaf of a document whose text lost its line feeds, if 2 divides the crc32 of its doc_id; null for the others."""
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, leaf(text=F.replace(F.col("text"), F.lit("\n"), F.lit(""))))


def verify_tampered(docs: DataFrame) -> DataFrame:
    """Each document's leaf, subroot, root and proof, and the root that its leaf gives after half of the documents were tampered with."""
    rows = manifest(docs, tampered=without_line_feeds(docs))
    out = rows.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), folded(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _field(value: str) -> str:
    return f"coalesce(strlen({value})::VARCHAR || ':' || {value}, '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_field(f"({text})" if c == "text" else f"({c}::VARCHAR)") for c in FIELDS) + ")"


_ABOVE = f"list_transform(range(0, len(nodes), {ARITY}), lambda i: sha256(array_to_string(nodes[i + 1:i + {ARITY}], '')))"
#: DuckDB SQL for verify_tampered() over ``documents``. It has no crc32: bytes are folded through the polynomial's table.
SQL = rf"""
WITH RECURSIVE
crc AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
docs AS (
  SELECT doc_id, source, {_leaf_sql("text")} AS leaf,
         CASE WHEN doc_id IS NOT NULL AND xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
           lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295) % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql("text")} END AS changed
  FROM documents, crc),
placed AS (
  SELECT *, row_number() OVER () AS rid, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS src FROM docs),
trees AS (
  SELECT src, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM placed GROUP BY src
  UNION ALL SELECT src, level + 1, {_ABOVE} FROM trees WHERE len(nodes) > 1),
subroots AS (SELECT src, level AS height, nodes[1] AS subroot FROM trees WHERE len(nodes) = 1),
top AS (
  SELECT 0 AS level, list(subroot ORDER BY src) AS nodes FROM subroots
  UNION ALL SELECT level + 1, {_ABOVE} FROM top WHERE len(nodes) > 1),
steps AS (
  SELECT rid, level, pos // ({ARITY} ** level)::BIGINT AS p, nodes FROM placed JOIN trees USING (src) WHERE len(nodes) > 1
  UNION ALL SELECT rid, height + level, src // ({ARITY} ** level)::BIGINT AS p, nodes FROM placed JOIN subroots USING (src), top WHERE len(nodes) > 1),
beside AS (
  SELECT rid, level, array_to_string(nodes[p - p % {ARITY} + 1:p], '') AS l, array_to_string(nodes[p + 2:p - p % {ARITY} + {ARITY}], '') AS r
  FROM (SELECT rid, level, p::BIGINT AS p, nodes FROM steps)),
fold AS (
  SELECT rid, 0 AS level, changed AS digest FROM placed
  UNION ALL SELECT rid, level + 1, sha256(l || digest || r) FROM fold JOIN beside USING (rid, level)),
proofs AS (SELECT rid, sha256(string_agg(l || r, '' ORDER BY level)) AS proof FROM beside GROUP BY rid)
SELECT doc_id, leaf, subroot, nodes[1] AS root, coalesce(proof, sha256('')) AS proof_sha256, last_one AS folded_root, last_one = nodes[1] AS verified
FROM placed JOIN subroots USING (src) JOIN (SELECT rid, arg_max(digest, level) AS last_one FROM fold GROUP BY rid) USING (rid) LEFT JOIN proofs USING (rid), top
WHERE len(nodes) = 1
"""

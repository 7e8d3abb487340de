"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

A text's set is its runs of five words. Its signature is a path in each of ``TREES`` prefix tries: ``DEPTH`` labels, a byte of a minhash
value each, packed into one number whose order is the trie's. Texts are sorted by tree and prefix, and those that share a
prefix meet. Prefixes have the full depth at first. The pairs that met tell, by their estimated similarities, how many of the pairs at the threshold
the forest has missed so far; prefixes are shortened by ``STRIDE`` levels, and only texts whose paths part within these levels are compared anew, until the
recall so measured reaches ``RECALL``, or, where fewer than ``MEASURED`` pairs tell, until a pair right at the threshold meets with that probability.

Meeting texts are compared by a sketch of ``SKETCH`` labels, and the pairs that may be similar link into candidate clusters. Every pair within a cluster is
then verified on the whole sets, in blocks, so an answer never rests on a hash estimate and a dense cluster costs no row per pair: a block tells each
text's number of links and a forest that spans them. A cluster of n different texts is as many sets as n * ceil(n / ``CLUSTER_TEXTS``).

Equal texts are one text to all of this and count once. Nodes of a trie and clusters of any size are split into pairs of
bounded blocks; nothing is capped. Clusters and groups are connected components over written tables.

Defined cases: null is as an empty text; texts without words link to nothing, and equal ones are copies of each other; a text with one to four
words has one run of all its words; very long texts are taken whole; rows may repeat doc_ids; of documents that tie the smallest doc_id is a group's
class, null if all are null; an empty table gives no rows; extra columns stay out of the join. Texts are held equal if their 64-bit hashes are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import boxed, mapped, release, small, written
from tidemark.llm.graph import connected_components
from tidemark.llm.token_ids import slices

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.9999
TREES, DEPTH, STRIDE, SKETCH = 32, 8, 2, 128
#: Sketch labels that similar texts share: five standard deviations under the threshold's mean, rounded down. Of pairs at the threshold about one in a
#: million shares fewer and is not verified; the measured recall counts met pairs only, so that loss comes on top of it.
LEAST_SHARED = 80
#: Pairs at the threshold or above that a measured recall needs.
MEASURED = 1000
#: A text with so large a share of all rows as copies is looked up from a broadcast of such texts: there are no more than 1 / HOT of them.
HOT = 1 / 1000
#: Texts per block of a trie node; texts and set members per block of a cluster. They bound memory and leave the result as it is.
NODE_BLOCK, CLUSTER_TEXTS, CLUSTER_MEMBERS = 2048, 1024, 1_000_000


def missed(similarity: float | np.ndarray, depth: int) -> float | np.ndarray:
    """The share of pairs of that similarity that meet in no tree at that depth."""
    return (1 - similarity**depth) ** TREES


def recall_at(depth: int, met: np.ndarray, threshold: float) -> tuple[float, float]:
    """The measured recall of pairs at the threshold or above, and how many such pairs there are by this measure.

    met[k]: how often, over all trees, texts met that share k of SKETCH labels. A pair of similarity s meets TREES * s**depth times on the average,
    so each meeting stands for the inverse of that many pairs, those that never met included.
    """
    similarity = np.clip((np.arange(SKETCH + 1) / SKETCH - 1 / 256) / (1 - 1 / 256), 0, 1)
    least = similarity >= threshold
    pairs = met[least] / (TREES * similarity[least] ** depth)
    total = pairs.sum()
    return (1 - (pairs * missed(similarity[least], depth)).sum() / total if total else 0.0), total


def minhashes(values: np.ndarray, at: np.ndarray, count: int, seed: int = 77) -> np.ndarray:
    """count minhash values of each text that has a shingle; the others' rows are zero."""
    rng = np.random.default_rng(seed)
    factors, shifts = rng.integers(0, 1 << 31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, count, dtype=np.uint32)
    full = np.flatnonzero(np.diff(at))
    out = np.zeros((len(at) - 1, count), np.uint32)
    low = (values >> np.uint64(32)).astype(np.uint32)
    if len(full):
        turned = np.empty_like(low)
        for k in range(count):
            np.multiply(low, factors[k], out=turned)
            np.add(turned, shifts[k], out=turned)
            turned ^= turned >> np.uint32(15)
            out[full, k] = np.minimum.reduceat(turned, at[full])
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, node, size, paths, sketch) of docs; texts without words have no paths."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tidemark.llm.textvec import shingles

        for batch in batches:
            texts = batch["text"]
            for a, b in slices(texts):
                values, at = shingles(texts.slice(a, b - a), SHINGLE)
                labels = (minhashes(values, at, TREES * DEPTH) & 0xFF).astype(np.uint8).reshape(-1, TREES, DEPTH)
                paths = labels.reshape(-1, TREES * DEPTH).view(">i8").astype(np.int64)
                sketch = np.ascontiguousarray(labels[:, :, : SKETCH // TREES]).reshape(-1, SKETCH)
                n = np.diff(at)
                held = np.where(n > 0, TREES, 0)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(a, b - a), batch["node"].slice(a, b - a), pa.array(n.astype(np.int64)),
                     pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(held))).astype(np.int32)), pa.array(paths[n > 0].ravel())),
                     pa.array([s.tobytes() for s in sketch], pa.binary())],
                    ["doc_id", "node", "size", "paths", "sketch"])

    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("node"), F.coalesce("text", F.lit("")).alias("text"))
    return mapped(rows, sign, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, node long, size long, paths array<long>, sketch binary")


def forest(pairs_a: np.ndarray, pairs_b: np.ndarray, count: int) -> np.ndarray:
    """The root of each of count members once the pairs are joined."""
    root = np.arange(count)
    while len(pairs_a):
        low = np.minimum(root[pairs_a], root[pairs_b])
        for side in (pairs_a, pairs_b):
            np.minimum.at(root, root[side], low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        apart = root[pairs_a] != root[pairs_b]
        pairs_a, pairs_b = pairs_a[apart], pairs_b[apart]
    return root


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by keys; a group that batches split is put together again."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        change = np.zeros(len(batch) - 1, bool)
        for k in keys:
            v = batch[k].to_numpy(zero_copy_only=False)
            change |= v[1:] != v[:-1]
        last = int(np.flatnonzero(change)[-1]) + 1 if change.any() else 0
        same = held and all(held[-1][k][len(held[-1]) - 1] == batch[k][0] for k in keys)
        if held and not same:
            yield pa.Table.from_batches(held)
            held = []
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    change = np.zeros(len(table), bool)
    change[0] = True
    for k in keys:
        v = table[k].to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(change), len(table))


def alike(sketch: np.ndarray, child: np.ndarray, side: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of one trie node's texts, and what they share, whose sketches agree enough and whose paths part below the node. side: 0 and 1 for a pair of blocks, 2 where all pairs count."""
    found, place = [], np.arange(len(sketch))
    for i in range(0, len(sketch), 128):
        here = slice(i, i + 128)
        equal = np.zeros((len(sketch[here]), len(sketch)), np.int16)
        for j in range(0, len(sketch), 512):
            equal[:, j : j + 512] = (sketch[here, None, :] == sketch[None, j : j + 512, :]).sum(axis=2, dtype=np.int16)
        ok = (equal >= least) & (child[here, None] != child[None, :])
        ok &= ((side[here, None] == 2) & (place[here, None] < place[None, :])) | ((side[here, None] == 0) & (side[None, :] == 1))
        a, b = np.nonzero(ok)
        found.append((a + i, b, equal[a, b]))
    return tuple(np.concatenate([f[k] for f in found]) for k in range(3))


def meetings(texts: DataFrame, depth: int) -> DataFrame:
    """What texts tell that meet at that depth and not STRIDE levels deeper: edges (a, b) that span those whose sketches agree enough, and how many pairs share so many labels (shared, n).

    texts: (node, paths, sketch), a row per node.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = np.zeros(SKETCH + 1, np.int64)
        for table in runs(batches, ["tree", "prefix", "unit"]):
            node, side, child = (table[c].to_numpy() for c in ("node", "side", "child"))
            sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(-1, SKETCH)
            start = group_starts(table, ["tree", "prefix", "unit"])
            size = np.diff(start)
            own = np.repeat(np.arange(len(size)), size)
            left, right = [], []
            few = size[own] <= 24
            for step in range(1, int(min(24, size[size <= 24].max(initial=1)))):  # all pairs of small nodes at once
                i = np.flatnonzero(few[:-step] & (own[:-step] == own[step:]) & (child[:-step] != child[step:]) & ((side[:-step] == 2) | (side[:-step] != side[step:])))
                for j in range(0, len(i), 100_000):
                    some = i[j : j + 100_000]
                    shared = (sketch[some] == sketch[some + step]).sum(axis=1)
                    hit = shared >= LEAST_SHARED
                    tally += np.bincount(shared[hit], minlength=SKETCH + 1)
                    left.append(some[hit])
                    right.append(some[hit] + step)
            for g in np.flatnonzero(size > 24):
                s, e = start[g], start[g + 1]
                a, b, shared = alike(sketch[s:e], child[s:e], side[s:e], LEAST_SHARED)
                tally += np.bincount(shared, minlength=SKETCH + 1)
                left.append(a + s)
                right.append(b + s)
            if left:
                root = forest(np.concatenate(left), np.concatenate(right), len(node))
                kept = np.flatnonzero(root != np.arange(len(node)))
                none = pa.nulls(len(kept), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(node[kept]), pa.array(node[root[kept]]), none, none], ["a", "b", "shared", "n"])
        kept = np.flatnonzero(tally)
        none = pa.nulls(len(kept), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, pa.array(kept), pa.array(tally[kept])], ["a", "b", "shared", "n"])

    full, places = depth == DEPTH, texts.select("node", F.posexplode("paths").alias("tree", "path"))
    places = places.select("node", "tree", F.shiftrightunsigned("path", 8 * (DEPTH - depth)).alias("prefix"), F.col("node").alias("child") if full else F.shiftrightunsigned("path", 8 * (DEPTH - depth - STRIDE)).alias("child"))
    shared = places.groupBy("tree", "prefix").agg(F.count("*").alias("n"), F.min("child").alias("low"), F.max("child").alias("high")).where("low <> high").drop("low", "high")
    met = places.join(shared.hint("merge"), ["tree", "prefix"]).join(texts.select("node", "sketch").hint("merge"), "node")
    blocks = F.ceil(F.col("n") / NODE_BLOCK)
    own = F.pmod(F.xxhash64("node"), blocks)
    # a node of one block is one unit, where all pairs count; else a unit is a pair of blocks, and with itself a block has all its pairs
    units = F.when(blocks == 1, F.array(F.struct(F.lit(0).cast("long").alias("unit"), F.lit(2).alias("side")))).otherwise(
        F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda o: F.struct((F.least(o, own) * blocks + F.greatest(o, own)).alias("unit"), F.when(o == own, 2).when(own < o, 0).otherwise(1).alias("side"))))
    dealt = met.withColumn("u", F.explode(units)).select("tree", "prefix", "u.unit", "u.side", "child", "node", "sketch")
    return mapped(dealt.repartition("tree", "prefix", "unit").sortWithinPartitions("tree", "prefix", "unit", "node"), compare, "a long, b long, shared long, n long")


def candidate_edges(texts: DataFrame, threshold: float, recall: float) -> tuple[DataFrame, int, float | None]:
    """Edges (a, b) that span the texts that may be similar, the depth to which prefixes were shortened, and the recall measured there (None if too few pairs tell)."""
    met, edges, depth = np.zeros(SKETCH + 1), None, DEPTH
    while True:
        level = written(meetings(texts, depth), f"depth-{depth}")
        for shared, n in level.where("a is null").groupBy("shared").agg(F.sum("n")).collect():  # SKETCH + 1 rows at most
            met[shared] += n
        found = level.where("a is not null").select("a", "b")
        edges = found if edges is None else edges.union(found)
        measured, pairs = recall_at(depth, met, threshold)
        enough = measured >= recall if pairs >= MEASURED else missed(threshold, depth) <= 1 - recall
        if enough or depth <= STRIDE:
            return edges.distinct(), depth, measured if pairs >= MEASURED else None
        depth -= STRIDE


def verify_unit(sets: list[np.ndarray], side: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a unit's texts whose sets have at least the wanted Jaccard similarity, by exact intersections."""
    size = np.array([len(s) for s in sets], np.int64)
    member, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(member, kind="stable")
    member, owner = member[order], owner[order]
    first = np.append(True, member[1:] != member[:-1])
    column = np.cumsum(first) - 1
    often = np.bincount(column)[column] > 1  # what one text alone has is in no intersection
    column, owner = column[often], owner[often]
    if not len(column):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    column = np.cumsum(np.append(True, column[1:] != column[:-1])) - 1
    both = np.zeros((len(sets), len(sets)), np.float32)  # exact: counts stay far below 2**24
    width = max(1, 4_000_000 // len(sets))
    for lo in range(0, int(column[-1]) + 1, width):
        a, b = np.searchsorted(column, (lo, lo + width))
        part = np.zeros((len(sets), int(column[b - 1]) - lo + 1), np.float32)
        part[owner[a:b], column[a:b] - lo] = 1
        both += part @ part.T
    union = size[:, None] + size[None, :] - both
    ok = both >= threshold * union - 1e-6
    ok &= (side[:, None] == 2) & (np.arange(len(sets))[:, None] < np.arange(len(sets))[None, :]) | (side[:, None] == 0) & (side[None, :] == 1)
    return np.nonzero(ok)


def verified(docs: DataFrame, clusters: DataFrame, threshold: float) -> DataFrame:
    """(node, links, root): in each unit of a cluster a text's number of links and the root of its links. clusters: (node, rep, component, blocks)."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tidemark.llm.textvec import shingles

        for batch in batches:
            for a, b in slices(batch["text"]):
                values, at = shingles(batch["text"].slice(a, b - a), SHINGLE)
                sets = [np.unique(values[s:e]).tobytes() for s, e in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch[c].slice(a, b - a) for c in ("component", "blocks", "node")), pa.array(sets, pa.binary())], ["component", "blocks", "node", "members"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["component", "unit"]):
            node, side = table["node"].to_numpy(), table["side"].to_numpy()
            start = group_starts(table, ["component", "unit"])
            sets = [np.frombuffer(m, np.uint64) for m in table["members"].to_pylist()]
            links, root = np.zeros(len(node), np.int64), np.arange(len(node))
            for s, e in zip(start[:-1], start[1:], strict=True):
                pick = np.arange(s, e)
                pick = pick[np.append(True, node[pick][1:] != node[pick][:-1])]  # rows that repeat a doc_id and text
                a, b = verify_unit([sets[k] for k in pick], side[pick], threshold)
                links[pick] = np.bincount(a, minlength=len(pick)) + np.bincount(b, minlength=len(pick))
                root[pick] = pick[forest(a, b, len(pick))]
            kept = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(node[kept]), pa.array(links[kept]), pa.array(node[root[kept]])], ["node", "links", "root"])

    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("node"), F.coalesce("text", F.lit("")).alias("text"))
    want = clusters.select(F.col("node").alias("_node"), F.col("rep").alias("_rep"), "component", "blocks")
    texts = rows.join(small(want), (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("_rep"))).select("component", "blocks", "node", "text")
    sets = mapped(texts, gather, "component long, blocks long, node long, members binary")
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    units = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.struct((F.least(o, own) * F.col("blocks") + F.greatest(o, own)).alias("unit"), F.when(o == own, 2).when(own < o, 0).otherwise(1).alias("side")))
    dealt = sets.withColumn("u", F.explode(units)).select("component", "u.unit", "u.side", "node", "members")
    return mapped(dealt.repartition("component", "unit").sortWithinPartitions("component", "unit", "node"), compare, "node long, links long, root long")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Per document of docs (doc_id, text): doc_id, class_id, copy_id, n_links, n_copies.

    copy_id is the smallest doc_id with the very same text, n_copies how many documents have that text, n_links with how many other
    texts it is similar, and class_id the smallest doc_id of all that copies and links tie together.
    """
    signed = written(signatures(docs), "signatures")
    texts = signed.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies"), F.first("size").alias("size"), F.first("paths").alias("paths"), F.first("sketch").alias("sketch"))
    texts = written(texts, "texts")
    component = connected_components(candidate_edges(texts.where("size > 0"), threshold, recall)[0], "candidates")
    sized = written(component.join(texts.select("node", "rep", "size"), "node"), "clusters")
    blocks = F.greatest(F.ceil(F.count("*") / CLUSTER_TEXTS), F.ceil(F.sum("size") / CLUSTER_MEMBERS))
    clusters = written(sized.join(sized.groupBy("component").agg(blocks.alias("blocks")), "component"), "cluster-blocks")
    found = written(verified(docs, clusters, threshold), "links")
    groups = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), "groups")
    links = found.groupBy("node").agg(F.sum("links").alias("n_links"))
    # a class's id is the smallest doc_id of its texts
    ids = written(groups.join(texts.select("node", "rep"), "node"), "group-ids")
    least = ids.groupBy("component").agg(F.min("rep").alias("class_id"))
    tied = ids.join(least, "component").select("node", "class_id").join(links, "node", "left")
    table = texts.select("node", "rep", "n_copies").join(tied, "node", "left").select("node", F.coalesce("class_id", "rep").alias("class_id"), F.col("rep").alias("copy_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    table = written(table, "classes")
    hot = F.col("n_copies") >= max(2, HOT * signed.count())
    often, ids = F.broadcast(table.where(hot)), signed.select("doc_id", "node")
    out = ids.join(often, "node").unionByName(ids.join(often.select("node"), "node", "left_anti").join(table.where(~hot), "node"))
    release(sized)
    return out.select("doc_id", "class_id", "copy_id", "n_links", "n_copies", "node")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each class: that of the smallest doc_id, rows without doc_id last."""
    marked = written(near_duplicates(docs, **options), "marked")
    # texts that stay: with their class's smallest doc_id; of several such texts under one id the least node
    stay = marked.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("class_id", F.when(F.col("class_id").isNull(), F.col("node")).alias("_own")).agg(F.min("node").alias("_keep"), F.count_if(F.lit(True)).alias("_rows"))
    stay = written(stay.select(F.col("class_id").alias("_id"), "_keep", "_rows"), "kept-texts")
    node = F.xxhash64(F.coalesce("text", F.lit(""))).alias("_node")
    rows = boxed(docs, node).join(small(stay, 1_000_000), F.col("_doc.doc_id").eqNullSafe(F.col("_id")) & (F.col("_node") == F.col("_keep")))
    if stay.where("_rows > 1").limit(1).count():  # only where whole rows repeat are texts gathered by id
        rows = rows.where("_rows = 1").unionByName(rows.where("_rows > 1").dropDuplicates(["_id", "_keep"]))
    return rows.select("_doc.*")


#: DuckDB SQL of near_duplicates() without ``node``: every pair of texts that share a run of words, compared on whole sets.
SQL = """WITH RECURSIVE t AS (SELECT coalesce(text, '') AS text, min(doc_id) AS copy_id, count(*)::BIGINT AS n_copies FROM documents GROUP BY 1), w AS (SELECT copy_id, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM t),
s AS (SELECT DISTINCT copy_id, array_to_string(ws[i:i + 4], ' ') AS run FROM (SELECT copy_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)), n AS (SELECT copy_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.copy_id AS a, b.copy_id AS b, count(*) AS shared FROM s a JOIN s b ON b.run = a.run AND b.copy_id > a.copy_id GROUP BY 1, 2), l AS (SELECT a, b FROM c JOIN n x ON x.copy_id = a JOIN n y ON y.copy_id = b WHERE 5 * shared >= 4 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b), k AS (SELECT a, least(a, min(b)) AS class_id FROM r GROUP BY a), d AS (SELECT a, count(*)::BIGINT AS n_links FROM e GROUP BY a)
SELECT doc_id, coalesce(class_id, t.copy_id) AS class_id, t.copy_id, coalesce(n_links, 0) AS n_links, n_copies FROM documents JOIN t ON t.text = coalesce(documents.text, '') LEFT JOIN k ON k.a = t.copy_id LEFT JOIN d ON d.a = t.copy_id"""

"""The Merkle manifest against a plain tree in Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tests.llm.test_llm_small import KIND, ODD
from tidemark.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    i, _, lang, source, n = row
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)])


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k : k + 3]) for k in range(0, len(levels[-1]), 3)])
    return levels


def path(levels, place):
    out = []
    for level in levels[:-1]:
        run = place - place % 3
        out.append((level[run:place], level[place + 1 : run + 3]))
        place //= 3
    return out


def plain(rows):
    own = {}
    for r in rows:
        own.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    order = sorted(own, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(own[s], key=lambda x: x[:3])]) for s in order}
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for s in order:
        for place, (_, _, digest, r) in enumerate(sorted(own[s], key=lambda x: x[:3])):
            steps = path(trees[s], place) + path(top, order.index(s))
            changed = r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            now = leaf(r, r[1].replace("\n", "") if changed else r[1])
            for left, right in steps:
                now = h(*left, now, *right)
            out.append((r[0], digest, trees[s][-1][0], top[-1][0], h(*[x for a, b in steps for x in (*a, *b)]), now, now == top[-1][0]))
    return sorted(out, key=str)


def many():
    rng = random.Random(5)
    sizes = [1, 2, 3, 4, 9, 10, 27, 28, 82]
    return [(rng.randrange(10**6), rng.choice([None, "", "a\nb", "c", "é\n\n"]), rng.choice(["en", None]), f"s{k}", rng.choice([None, 3])) for k, n in enumerate(sizes) for _ in range(n)]


@pytest.mark.parametrize(("rows", "levels"), [(ODD, 6), (ODD, 1), (many(), 6), (many(), 1), (many(), 2), (ODD[:1], 6), ([ODD[5]] * 5, 1)])
def test_tree_proofs_and_tampering(spark, rows, levels, monkeypatch):
    monkeypatch.setattr(merkle, "PART_ROWS", 40)
    docs = spark.createDataFrame(rows, KIND).repartition(3)
    for name in ("leaf", "pos", "n", "digest", "_key", "path", "a.b"):
        docs = docs.withColumn(name, F.lit(1))
    found = merkle.manifest(docs, levels, tampered=merkle.without_line_feeds(docs))
    found = found.withColumn("folded", merkle.folded(F.coalesce("tampered", "leaf"), F.col("path"))).select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")), "folded", F.expr("folded = root"))
    assert sorted(map(tuple, found.collect()), key=str) == plain(rows)


def test_no_rows(spark):
    assert merkle.verify_tampered(spark.createDataFrame([], KIND)).count() == 0


def test_manifest_names_its_sources(spark):
    found = merkle.manifest(spark.createDataFrame(ODD, KIND)).groupBy("source").count().collect()
    assert {(r["source"], r["count"]) for r in found} == {(s, sum(r[3] == s for r in ODD)) for s in {r[3] for r in ODD}}

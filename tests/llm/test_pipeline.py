"""The corpus pipeline over planted documents, each stage held against a plain version of what it should do with its own input."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_llm_small import brute_links, brute_targets
from tidemark.llm.queries import tokenizer_path

RUDE = ["glorx", "glorxen", "glorxish"]


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = np.random.default_rng(12)
    plain = [f"w{i}ord" for i in range(4000)]
    bench = [" ".join(f"q{i}" for i in rng.integers(0, 10**6, 30)) for _ in range(4)]
    docs, labels, kind = [], [], {}
    for k in range(300):
        words, what = list(rng.choice(plain, 60)), "clean"
        if k % 4 == 0:
            words[5], words[20], words[30] = rng.choice(RUDE, 3)
            what = "toxic"
        elif k % 25 == 1:
            words, what = words[:10] + bench[k % 4].split() + words[10:], "leak"
        docs.append((k, " ".join(words), "en", f"s{k % 5}", 0))
        kind[k] = what
        if k % 3:
            labels.append((k, 1, int(what == "toxic")))
    for k in range(300, 330):  # copies, and copies with one word changed
        base = docs[4 * (k - 300) + 3][1].split()
        if k % 2:
            base[-1] = "changed"
        docs.append((k, " ".join(base), "en", "s0", 0))
        kind[k] = "copy"
    docs += [(400, None, None, None, None), (401, "", "en", "s1", 0)]
    root = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, kind


def test_pipeline(spark, planted, tmp_path):
    root, kind = planted
    docs = spark.read.parquet(f"{root}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, root)
        out.write.parquet(f"{tmp_path}/{k}")
        seen[name], docs = docs.toPandas(), spark.read.parquet(f"{tmp_path}/{k}")
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns

    left = set(seen["near-duplicates"]["doc_id"])
    assert not any(kind.get(i) == "toxic" for i in left) and all(i in left for i, w in kind.items() if w != "toxic")

    before, after = seen["near-duplicates"], set(seen["decontamination"]["doc_id"])
    texts = list(before["text"])
    drop = {max(before["doc_id"].iloc[i], before["doc_id"].iloc[j]) for i, j in brute_links(texts)}
    first = {}
    for i, t in sorted(zip(before["doc_id"], texts, strict=True)):
        if first.setdefault(t or "", i) != i:
            drop.add(i)
    assert after == set(before["doc_id"]) - drop

    clean = set(seen["mixing"]["doc_id"])
    assert clean == {i for i in after if kind.get(i) != "leak"}

    mixed, source = seen["token-ids"], seen["mixing"]
    size = lambda t: len((t or "").split())
    sizes = {}
    for s, t in zip(source["source"], source["text"], strict=True):
        key = "~" if s is None else f"={s}"
        sizes[key] = sizes.get(key, 0) + size(t)
    for key, target in brute_targets(sizes).items():
        got = sum(size(t) for s, t in zip(mixed["source"], mixed["text"], strict=True) if ("~" if s is None else f"={s}") == key)
        assert got == pytest.approx(target, abs=1)
    assert (mixed["n_chars"] == mixed["text"].map(len)).all()

    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    want = []
    for i, t in zip(mixed["doc_id"], mixed["text"], strict=True):
        ids = [*plain.encode(t, add_special_tokens=False).ids, 1]
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got = docs.orderBy("start").collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == sorted(want)
    assert [r.start for r in got] == np.concatenate(([0], np.cumsum([r.n_tokens for r in got])))[:-1].tolist() and [r.doc_id for r in got] == sorted(r.doc_id for r in got)


def test_pipeline_of_nothing(spark, planted, tmp_path):
    root, _ = planted
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{root}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and out.select(F.col("ids_crc32")).columns == ["ids_crc32"]

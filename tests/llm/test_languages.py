"""Language identification against a plain Kneser-Ney model, and on held-out texts."""

import math
import unicodedata
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.llm.test_llm_small import KIND, ODD
from tidemark.llm import languages


def run(text):
    signs, out = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower()), " " * 3
    for c in signs:
        if c != " " or (out[-1] != " "):
            out += c
    return out


class Plain:
    """An interpolated Kneser-Ney model with dictionaries."""

    def __init__(self, texts):
        self.n = {4: Counter(r[k - 3 : k + 1] for r in map(run, texts) for k in range(3, len(r)))}
        for k in (3, 2, 1):
            self.n[k] = Counter(g[1:] for g in self.n[k + 1])
        self.after = {k: defaultdict(list) for k in self.n}
        for k, n in self.n.items():
            for g, c in n.items():
                self.after[k][g[:-1]].append(c)

    def p(self, gram, k=4):
        if k == 0:
            return 2.0**-16
        gram = gram[-k:]
        seen = self.after[k].get(gram[:-1])
        if not seen:
            return self.p(gram, k - 1)
        return max(self.n[k].get(gram, 0) - 0.75, 0) / sum(seen) + 0.75 * len(seen) / sum(seen) * self.p(gram, k - 1)

    def entropy(self, text):
        r = run(text)
        return -sum(math.log(self.p(r[k - 3 : k + 1])) for k in range(3, len(r))) / (len(r) - 3)


TEXTS = [("the cat sat on the mat", "en"), ("And then... THE dog!", "en"), ("le chat est là", "fr"), ("où est le chien? là", "fr"), ("κάτι άλλο", "el"), ("ein Hund", "de"), ("123", "xx")]


@pytest.fixture
def docs(spark):
    rows = [(k, t, lang, "s", 1) for k, (t, lang) in enumerate(TEXTS * 3)]
    return spark.createDataFrame(rows, KIND)


@pytest.mark.parametrize("entries", [languages.MODEL_ENTRIES, 10])
def test_entropies_are_those_of_plain_models(spark, docs, entries, monkeypatch):
    monkeypatch.setattr(languages, "MODEL_ENTRIES", entries)
    monkeypatch.setattr(languages, "HELD", 7)
    monkeypatch.setattr(languages, "BLOCK_BYTES", 30)
    model, _ = languages.fit(docs, F.lit(0))
    assert model.langs == ["de", "el", "en", "fr"]  # xx has no letter
    assert (model.shared is None) == (entries == 10)
    plain = [Plain([t for t, x in TEXTS * 3 if x == lang]) for lang in model.langs]
    new = spark.createDataFrame([(k, t) for k, t in enumerate([t for t, _ in TEXTS] + ["the chat", "q", "𝔘x", "  Ω. là ", "ein", "1"])], "doc_id int, text string")
    got = {r["_0"]: (r["n"], r["entropy"]) for r in languages.measured(new, model, F.col("doc_id")).collect()}
    for r in new.collect():
        n, entropy = got[r["doc_id"]]
        assert n == (len(run(r["text"])) - 3 or None)
        if n and "𝔘" not in r["text"]:
            assert entropy == pytest.approx([m.entropy(r["text"]) for m in plain], rel=1e-5)


def test_edges(spark):
    docs = spark.createDataFrame([*ODD, (20, "5 !", "en", "a", 3), (21, "lone", None, "a", 4)], KIND)
    for name in ("lang_pred", "n", "entropy", "_0", "key", "a.b"):
        docs = docs.withColumn(name, F.lit(1))
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in languages.judge(docs).collect()]
    assert sorted(g[0] or -1 for g in got) == sorted([r[0] or -1 for r in ODD] + [20, 21])
    assert all((lang == "und") == (score == 0.0) == (i in (1, 2, 6, 20)) for i, lang, score in got)
    assert all(0 <= g[2] <= 1 for g in got)
    assert languages.judge(docs.limit(0)).count() == 0
    nobody = [(r["lang_pred"], r["score"], r["accepted"]) for r in languages.judge(docs.withColumn("lang", F.lit(None).cast("string"))).collect()]
    assert set(nobody) == {("und", 0.0, False)}


def test_held_out_and_rejection(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = [(10**6 + k, t, None, "x", 1) for k, t in enumerate(["Это совсем другой язык, которого никто не видел", "zxqj kqxz wvvk qqzx jjxk zzqw", "これは日本語の文章です"])]
    got = languages.judge(docs.unionByName(spark.createDataFrame(more, docs.schema))).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id", how="left")
    known = got[got["lang"].notna()]
    assert (known["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in known["doc_id"]]).all()
    assert (known["lang_pred"] == known["lang"])[known["held_out"]].mean() >= 0.98
    assert known["accepted"].mean() > 0.9 and not got[got["doc_id"] >= 10**6]["accepted"].any()


def test_symbols():
    values, at, has = languages.symbols(pa.array(["Ab, c!", None, " é-9", "7"]))
    assert ["".join(map(chr, values[a:b])) for a, b in zip(at[:-1], at[1:], strict=True)] == ["   ab c ", "   ", "   é ", "   "]
    assert has.tolist() == [True, False, True, False]

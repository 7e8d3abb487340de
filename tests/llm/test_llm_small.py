"""Edge cases of every training-data operator: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing extra columns."""

import hashlib
import io
import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, graph, mixing, near_duplicates, pii, quality_model, quality_rules, textvec, token_ids, toxicity, url_filters, warc

KIND = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}" for i in range(20_000))
ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "one", "en", "a", 3), (3, "one", "en", "a", 3), (None, "no id here", "en", "b", 10), (5, LONG, "en", "b", len(LONG)), (6, " \t\n ", "en", None, 4), (7, "x " * 60, "en", "c", 120), (8, "one", "fr", "c", 3)]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with extra columns by names that the operators use themselves."""
    df = spark.createDataFrame(ODD, KIND)
    for name in ("score", "node", "_row", "_copies", "bucket", "size", "copy", "a.b", "label", "part"):
        df = df.withColumn(name, F.lit(1))
    return df


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KIND)


# 1


def test_mixing(spark, odd, none):
    got = mixing.taken(odd, block=16).toPandas()
    assert len(got) == len(ODD) and (got["taken"] <= 2 * got["size"]).all()
    assert got["taken"].sum() == pytest.approx(1.5 * got["size"].sum(), abs=5)
    again = mixing.taken(odd, block=16).toPandas()
    assert sorted(map(tuple, got.fillna(-1).values)) == sorted(map(tuple, again.fillna(-1).values))
    assert mixing.taken(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    rows = mixing.mixed_documents(odd, block=16)
    assert rows.columns == odd.columns
    words = rows.select(F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("n")).agg(F.sum("n")).first()[0]
    assert words == got["taken"].sum()


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    names = sorted(sizes)
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        left = sum(max(0.0, target[s] - cap * sizes[s]) for s in open_)
        full = {s for s in open_ if target[s] >= cap * sizes[s] - 1e-12}
        for s in full:
            target[s] = cap * sizes[s]
        open_ -= full
    return target


def test_targets_and_permutation(spark):
    rng = np.random.default_rng(1)
    for _ in range(4):
        sizes = {f"={chr(97 + k)}": int(rng.integers(0, 1000)) for k in range(rng.integers(1, 9))}
        got = {r.skey: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "skey string, source_size long")).collect()}
        for s, t in brute_targets(sizes).items():
            assert got[s] == pytest.approx(t, abs=1e-6)
    for n in (1, 2, 7, 100):
        image = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit("k"))).collect()]
        assert sorted(image) == list(range(n))


def test_running_sums(spark):
    rows = [(k, i, (i * 7 + len(k)) % 5) for k in ("a", "bb") for i in range(60) if i % 7]
    got = mixing.running(spark.createDataFrame(rows, "k string, i long, v long"), "k", "i", "v", "before", 59, width=3).collect()
    assert sorted((r.k, r.i, r.before) for r in got) == sorted((k, i, sum(w for m, j, w in rows if m == k and j < i)) for k, i, _ in rows)


def test_mixing_against_brute_force(spark):
    """Draw, slots, blocks and pieces made anew in Python; only the permutations' images are Spark's."""
    block, shard_blocks = 16, 8
    docs = spark.createDataFrame([(i, f"d{i} " * (i * 37 % 90), "en", (None, "b", "c", "c", "c")[i % 5], 0) for i in range(60)] + [(7, "same row", "en", "b", 1)] * 5, KIND)

    def image(n, *key, seed):
        return [r[0] for r in spark.range(n).select("id", mixing.permuted(F.col("id"), F.lit(n).cast("long"), *key, seed=seed).alias("to")).orderBy("id").select("to").collect()]

    stream = {n: sorted((r.skey, r.start, r.size, r.doc_id) for r in mixing.stream(docs, bucket_docs=n).collect()) for n in (4, mixing.BUCKET_DOCS)}
    placed = stream[mixing.BUCKET_DOCS]
    for rows in stream.values():  # a stream has no gaps
        size = {}
        for skey, start, n, _ in rows:
            assert start == size.get(skey, 0)
            size[skey] = start + n
    wanted = {r.skey: r.target for r in mixing.targets(spark.createDataFrame(list(size.items()), "skey string, source_size long")).collect()}
    pool = []
    for skey in sorted(size):
        epochs, left = divmod(int(wanted[skey]), size[skey])
        pool += [skey] * (epochs * -(-size[skey] // block) + -(-left // block))
    deal = image(len(pool), F.lit("draw"), seed=mixing.SEED + 2)
    drawn = {}
    for at, skey in enumerate(pool):
        drawn[skey, deal[at] // shard_blocks] = drawn.get((skey, deal[at] // shard_blocks), 0) + 1
    assert all(sum(n for (_, k), n in drawn.items() if k == shard) == min(shard_blocks, len(pool) - shard * shard_blocks) for shard in range(-(-len(pool) // shard_blocks)))
    want, number = [], dict.fromkeys(size, 0)
    for skey, shard in sorted(drawn):
        for _ in range(drawn[skey, shard]):
            blocks = -(-size[skey] // block)
            epoch, slot = divmod(number[skey], blocks)
            number[skey] += 1
            full = size[skey] // block
            at = image(full, F.lit(skey), F.lit(epoch).cast("long"), seed=mixing.SEED)[slot] if slot < full else slot
            length = min(block, min(size[skey], int(wanted[skey]) - epoch * size[skey]) - slot * block)
            for other, start, n, doc in placed:  # the words of the slot's block
                a, b = max(start, at * block), min(start + n, at * block + length)
                if other == skey and a < b:
                    want.append((shard, skey, epoch, slot, doc, start, a - start, b - a))
    parts, _, _ = mixing.mix(docs, block=block, shard_blocks=shard_blocks)
    assert sorted((r.shard, r.skey, r.epoch, r.slot, r.doc_id, r.start, r.first_word, r.n_words) for r in parts.collect()) == sorted(want)
    plan = mixing.taken(docs, block=block)._jdf.queryExecution().optimizedPlan().toString()
    assert "draws" in plan or "shard" in plan  # the draw decides which slots there are


# 2


def brute_quality(text):
    ws = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    tri = [tuple(ws[k : k + 3]) for k in range(len(ws) - 2)]
    seen = {}
    for t in tri:
        seen[t] = seen.get(t, 0) + 1
    rep = len({k + j for k, t in enumerate(tri) if seen[t] > 1 for j in range(3)})
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), rep


def test_quality_rules(spark, odd, none):
    extra = spark.createDataFrame([(20, "a b c a b c\nq\nq\n \nq#%é", "en", "z", 1), (21, "a a a a", "en", "z", 1)], KIND)
    docs = odd.select(*extra.columns).union(extra)
    got = sorted((tuple(r)[:6] for r in quality_rules.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()), key=str)
    want = sorted(((r.doc_id, *brute_quality(r.text)) for r in docs.collect()), key=str)
    assert got == want
    assert quality_rules.judge(odd).count() == len(ODD) and quality_rules.judge(none).count() == 0


def test_bad_host_takes_its_documents_along(spark):
    good = " ".join(f"w{i}" for i in range(80))
    rows = [(k, "short" if k % 10 else good, "en", "bad", 0) for k in range(100)] + [(1000 + k, good if k % 10 else "short", "en", f"ok{k % 5}", 0) for k in range(100)]
    got = {r.doc_id: r.kept for r in quality_rules.judge(spark.createDataFrame(rows, KIND)).collect()}
    assert not any(got[k] for k in range(100)) and all(got[1000 + k] for k in range(100) if k % 10)


def test_verdict_on_a_rule_falls_by_host(spark):
    """Documents full of symbols go where the host has the usual share of them or more, and stay where it hardly has any; each rule has a prior of its own."""
    good = " ".join(f"w{i}" for i in range(80))
    odd, lines = good + " " + "#" * 60, good + "\n" + "x\n" * 9
    rows = [(h * 1000 + k, odd if k < n else lines if k == 999 and h == 0 else good, "en", f"h{h}", 0) for h, n in enumerate([1, 100, 120, 80, 90]) for k in range(1000)]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, KIND)).collect()}
    assert got[0].kept and not any(got[h * 1000 + k].kept for h, n in enumerate([1, 100, 120, 80, 90]) for k in range(n) if h)
    assert not got[999].kept and all(r.kept for i, r in got.items() if i % 1000 >= 120 and i != 999)
    rate, n = [n / 1000 for n in (1, 100, 120, 80, 90)], 1000
    m = sum(rate) / 5
    w = m * (1 - m) / (sum((x - m) ** 2 for x in rate) / 4) - 1
    assert got[1500].rate_symbols == pytest.approx((100 + m * w) / (n + w), abs=1e-8)


# 3 and 6


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(2)
    plain, rude = [f"w{i}ord" for i in range(300)], ["glorx", "glorxen", "glorxish"]
    rows, labels = [], []
    for k in range(400):
        words = list(rng.choice(plain, 40))
        bad = k % 4 == 0
        if bad:
            words[5], words[20], words[30] = rng.choice(rude, 3)
        rows.append((k, " ".join(words) if k % 5 else " ".join(f"{w}%%%" for w in words), "en", "s", 0))
        labels.append((k, int(k % 5 > 0), int(bad)))
    return spark.createDataFrame(rows, KIND), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(got, labels, name, learned):
    both = got.join(labels, "doc_id").toPandas()
    both = both[both["held_out"] != learned]
    return (both["predicted"] == both[name]).mean()


def test_toxicity(spark, labelled, odd, none):
    docs, labels = labelled
    got = toxicity.judge(docs, labels)
    assert accuracy(got, labels, "toxic", False) > 0.95
    for r in got.select("doc_id", "held_out").collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    kept = toxicity.clean(docs, docs, labels)
    assert kept.columns == docs.columns and 280 <= kept.count() <= 310
    scores = toxicity.judge(odd, labels).collect()
    assert len(scores) == len(ODD) and all(0 <= r.score <= 1 for r in scores)
    assert toxicity.judge(none, labels).count() == 0
    assert toxicity.clean(odd, docs, labels).columns == odd.columns


def test_toxicity_symbols():
    texts = pa.array(["Ab, c!", None, "", "é-é", "中" * 3])
    values, at = toxicity.symbols(texts)
    runs = ["".join(map(chr, values[a:b])) for a, b in zip(at[:-1], at[1:], strict=True)]
    assert runs[0] == " ab c " and runs[3] == " é é " and [len(r) for r in runs[1:3]] == [1, 1] and len(runs[4]) == 5
    key = np.array([5, 1 << 61, 123456789123], np.int64)
    assert ((toxicity.place(key) >= 0) & (toxicity.place(key) < toxicity.BUCKETS)).all()


def test_clean_drops_what_judge_predicts(spark, labelled, monkeypatch):
    docs, labels = labelled
    spread = docs.select("doc_id", (F.col("doc_id") / 300).alias("score"))  # scores all over, those between 0.3 and 0.5 too
    monkeypatch.setattr(toxicity, "fit", lambda docs, labels: None)
    monkeypatch.setattr(toxicity, "score", lambda docs, model, keep, name="score": docs.join(spread.withColumnRenamed("score", name), "doc_id").select(*keep, name))
    predicted = {r.doc_id for r in toxicity.judge(docs, labels).where("predicted = 1").collect()}
    kept = {r.doc_id for r in toxicity.clean(docs, docs, labels).collect()}
    assert predicted and kept and not predicted & kept and predicted | kept == {r.doc_id for r in docs.collect()}


def brute_kneser_ney(texts, labels):
    """log P(1) - log P(0) of a symbol after its history, by plain interpolated Kneser-Ney models."""
    size, less = toxicity.ORDER, toxicity.DISCOUNT
    level = {size: {}}
    for t, y in zip(texts, labels, strict=True):
        t = f" {t} "
        for k in range(len(t) - size + 1):
            level[size].setdefault(t[k : k + size], [0, 0])[y] += 1
    for k in range(size - 1, 0, -1):
        level[k] = {}
        for g, n in level[k + 1].items():
            own = level[k].setdefault(g[1:], [0, 0])
            for i in (0, 1):
                own[i] += n[i] > 0
    shared = {g: sum(n) + 0.5 for g, n in level[1].items()}
    after = {}
    for k in range(2, size + 1):
        for g, n in level[k].items():
            for i in (0, 1):
                s = after.setdefault((g[:-1], i), [0, 0])
                s[0], s[1] = s[0] + n[i], s[1] + (n[i] > 0)

    def p(g, i):
        if len(g) == 1:
            return shared.get(g, 0.5) / sum(shared.values())
        s, kinds = after.get((g[:-1], i), (0, 0))
        return (max(level[len(g)].get(g, (0, 0))[i] - less, 0) + less * kinds * p(g[1:], i)) / s if s else p(g[1:], i)

    return lambda g: np.log(p(g, 1)) - np.log(p(g, 0))


def test_toxicity_is_the_kneser_ney_ratio(spark):
    rng = np.random.default_rng(31)
    text = lambda n: " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 7))) for _ in range(n))
    texts, labels = [text(60) for _ in range(160)], [int(k % 3 == 0) for k in range(160)]
    seen = toxicity.counts(spark.createDataFrame([(t, y, 0) for t, y in zip(texts, labels, strict=True)], "text string, label int, part int"))
    table = toxicity.packed(toxicity.weights(seen, F.col("a0"), F.col("a1")))
    ratio, size = brute_kneser_ney(texts, labels), toxicity.ORDER
    tried = [*texts[:30], *(text(40) for _ in range(30)), "zqzqzqzqzq"]  # of texts not learned from, most n-grams are new
    for t, mean in zip(tried, toxicity.evidence(pa.array(tried), *table)[:, 0], strict=True):
        own = f" {t} "
        assert mean == pytest.approx(np.mean([ratio(own[k : k + size]) for k in range(len(own) - size + 1)]), abs=1e-5)


def test_toxicity_of_a_model_too_large_for_a_worker(spark, labelled, odd, none, monkeypatch):
    docs, labels = labelled
    both = {}
    for entries in (toxicity.MODEL_ENTRIES, 0):
        monkeypatch.setattr(toxicity, "MODEL_ENTRIES", entries)
        monkeypatch.setattr(toxicity, "BLOCK_BYTES", 2000)  # many blocks
        model = toxicity.fit(docs, labels.selectExpr("doc_id", "toxic label", "int(doc_id % 2) part"))
        assert isinstance(model[0], tuple) == (entries > 0)
        both[entries] = [sorted(tuple(r) for r in toxicity.score(df, model, ["doc_id"]).collect()) for df in (docs, odd.where("doc_id is not null"), none)]
    table, joined = both.values()
    for a, b in zip(table, joined, strict=True):
        assert [r[0] for r in a] == [r[0] for r in b] and [r[1] for r in a] == pytest.approx([r[1] for r in b], abs=1e-9)
    assert len(table[0]) == docs.count() and len(table[1]) == len(ODD) - 1 and table[2] == []
    kept = toxicity.clean(odd, docs, labels)
    assert kept.columns == odd.columns and 0 < kept.count() <= len(ODD)


def test_quality_classifier(spark, labelled, odd, none):
    docs, labels = labelled
    assert accuracy(quality_model.judge(docs, labels), labels, "quality", False) > 0.95
    got = quality_model.judge(odd, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert quality_model.judge(none, labels).count() == 0
    assert {r.score for r in quality_model.judge(odd, labels.limit(0)).collect()} == {0.5}


def test_quality_features_stay_within_their_text():
    a, b = "abc de", "fgh"
    joint, alone = quality_model.counted(pa.array([a, None, b])), quality_model.counted(pa.array([b]))
    places, share = quality_model.unpacked(quality_model.packed(*joint[0]))
    assert (places == joint[0][0]).all() and share == pytest.approx(joint[0][1] / joint[0][1].sum())
    assert (joint[2][0] == alone[0][0]).all() and len(joint[1][0]) == 1
    # n-grams are of characters and never cross a word's ends
    for text in ("日本 語", "aé\tb  c", "", "x" * 50):
        words = [f" {w} " for w in text.split()]
        grams = [w[k : k + n] for n in quality_model.GRAMS for w in words for k in range(len(w) - n + 1)]
        got = list(quality_model.features(pa.array([text, "z"])))
        assert got[0][1][1] == len(words) and sum(at[1] for _, at in got[1:]) == len(grams)


# 4


def brute_links(texts, size=5, threshold=0.8):
    sets = []
    for t in texts:
        w = (t or "").split()
        sets.append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    return {(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and texts[i] != texts[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])}


def test_near_duplicates_against_brute_force(spark):
    rng = np.random.default_rng(4)
    texts = []
    for base in range(12):
        words = [f"b{base}w{i}" for i in rng.integers(0, 5000, 120)]
        for _ in range(8):
            own = list(words)
            for k in rng.integers(0, 120, rng.integers(0, 6)):
                own[k] = f"n{rng.integers(0, 10**6)}"
            texts.append(" ".join(own))
    texts += ["a b", "a b", "a b c", "", None, "one two three four five six"] + [f"many {i} " + " ".join(f"m{k}" for k in range(60)) for i in range(40)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in near_duplicates.near_duplicates(docs).collect()}
    distinct = list(dict.fromkeys(t or "" for t in texts))
    links = brute_links(distinct)
    n = dict.fromkeys(range(len(distinct)), 0)
    root = list(range(len(distinct)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in links:
        n[i] += 1
        n[j] += 1
        root[max(find(i), find(j))] = min(find(i), find(j))
    first = {t: min(k for k, x in enumerate(texts) if (x or "") == t) for t in distinct}
    for k, t in enumerate(texts):
        at = distinct.index(t or "")
        assert (got[k].n_links, got[k].copy_id, got[k].class_id) == (n[at], first[t or ""], first[distinct[find(at)]])


def test_near_duplicates_blocks_agree(spark, monkeypatch):
    texts = [f"{i} " + " ".join(f"m{k}" for k in range(40 + i % 3)) + f" z{i % 7}" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = sorted(map(tuple, near_duplicates.near_duplicates(docs).collect()))
    for name, value in (("NODE_BLOCK", 16), ("CLUSTER_TEXTS", 9), ("CLUSTER_MEMBERS", 500)):
        monkeypatch.setattr(near_duplicates, name, value)
    assert sorted(map(tuple, near_duplicates.near_duplicates(docs).collect())) == whole and len(whole) == 60


def test_forest_shortens_prefixes_to_the_recall(spark, monkeypatch):
    rng = np.random.default_rng(8)
    texts = []
    for base in range(150):
        words = [f"b{base}w{i}" for i in rng.integers(0, 5000, 100)]
        for _ in range(4):
            own = list(words)
            for k in rng.integers(0, 100, rng.integers(0, 3)):
                own[k] = f"n{rng.integers(0, 10**6)}"
            texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    signed = near_duplicates.signatures(docs)
    # few pairs tell: down to where a pair at the threshold meets almost surely
    _, depth, recall = near_duplicates.candidate_edges(signed, 0.8, 0.9999)
    assert depth == 6 and recall is None
    # enough do: a low target is met at full depth, a high one by shorter prefixes; the measure agrees with brute force
    monkeypatch.setattr(near_duplicates, "MEASURED", 100)
    edges, depth, recall = near_duplicates.candidate_edges(signed, 0.8, 0.9)
    assert depth == 8 and recall > 0.9
    assert near_duplicates.candidate_edges(signed, 0.8, 1 - 1e-9)[1] < 8
    distinct = list(dict.fromkeys(texts))
    links = brute_links(distinct)
    hashes = [r[0] for r in spark.createDataFrame(list(enumerate(distinct)), "k long, t string").orderBy("k").select(F.xxhash64("t")).collect()]
    group = {r.node: r.component for r in graph.connected_components(edges).collect()}
    found = sum(group.get(hashes[i], i) == group.get(hashes[j], -j - 1) for i, j in links)
    assert found / len(links) >= recall - 0.01
    assert near_duplicates.missed(0.8, 6) < 1e-4 < near_duplicates.missed(0.8, 8)


def test_near_duplicates_hot_copies(spark):
    docs = spark.createDataFrame([(k, "the same words in every copy" if k % 3 else f"other {k} text of its own") for k in range(300)], "doc_id long, text string")
    got = {r.doc_id: r for r in near_duplicates.near_duplicates(docs).collect()}
    assert len(got) == 300 and {(r.class_id, r.n_copies) for k, r in got.items() if k % 3} == {(1, 200)}
    assert all((r.class_id, r.n_copies) == (k, 1) for k, r in got.items() if k % 3 == 0)


def test_near_duplicates_odd(spark, odd, none):
    got = near_duplicates.near_duplicates(odd).collect()
    assert len(got) == len(ODD) and {r.class_id for r in got if r.doc_id in (3, 8)} == {3} and {r.class_id for r in got if r.doc_id in (1, 2)} == {1}
    kept = near_duplicates.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 3, 5, 6, 7, None]
    assert near_duplicates.near_duplicates(none).count() == 0 and near_duplicates.one_of_each(none).count() == 0


@pytest.mark.parametrize("hub", [2, 1000])
def test_components_with_hubs(spark, monkeypatch, hub):
    monkeypatch.setattr(graph, "HUB", hub)
    edges = [(0, k) for k in range(1, 1500)] + [(k, k + 1) for k in range(2000, 2040)] + [(3000 + k, 3100) for k in range(50)] + [(3100, 5), (7, 7), (None, 3)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys([*range(1500), *range(3000, 3050), 3100], 0), **dict.fromkeys(range(2000, 2041), 2000)}


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(500, 500), (600, 601)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{100 + k: 100 for k in range(30)}, 600: 600, 601: 600}


def test_components_by_small_plans(spark, monkeypatch):
    """Of a round of stars no query may have dozens of exchanges: the driver plans it anew whenever one of them ends."""
    exchanges, write = [], graph.written

    def counted(df, tag):
        exchanges.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange "))
        return write(df, tag)

    monkeypatch.setattr(graph, "written", counted)
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")
    assert {r.component for r in graph.connected_components(edges).collect()} == {0}
    assert max(exchanges) <= 8, exchanges


def test_shingles():
    values, at = textvec.shingles(pa.array(["a b c d e f", "a b c d e", None, " a ", "a  b\tc d e f"]))
    assert np.diff(at).tolist() == [2, 1, 0, 1, 2] and values[0] == values[2] and (values[:2] == values[-2:]).all()


# 5


def test_url_filters(spark):
    rules = url_filters.rule_table(spark, [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "bad.org", "")])
    html = '<link rel="canonical" href="https://bad.org/x"/>'
    rows = [
        (1, "https://A.example.COM/en/7?x#y", None), (2, "https://a.example.com/en/8", None), (3, None, None), (4, "no scheme", None), (5, "x://", None), (6, "https://ok.io/1", html), (7, "http://ok.io/1/#top", ""),
        (8, "https://sub.bad.org", None), (9, "https://notbad.org/", None), (10, "https://a.net/de/1", '<link href="https://bad.org/y" rel=canonical>'), (11, "https://alias.io/p?utm_source=a", '<meta http-equiv="refresh" content="0; url=https://a.net/de/2">'),
        (12, "https://alias.io/p", html.replace("/x", "/z")), (6, "https://ok.io/1", html),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("rule", F.lit(1))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(pages, rules).collect()}
    assert url_filters.judge(pages, rules).count() == len(rows)
    assert got[1] == ("a.example.com", "/en/7", "example.com/en/7", "allow") and got[2] == ("a.example.com", "/en/8", "com/en/", "block")
    assert got[3] == got[4] == ("", "", None, "allow") and got[5] == ("", "", None, "allow")
    assert got[6][3] == got[7][3] == "block" and got[6][2] is None  # canonical to a blocked url, and its own alias
    assert got[8][3] == "block" and got[9][3] == "allow" and got[10] == ("a.net", "/de/1", "net/de/", "allow")
    assert got[11][3] == got[12][3] == "allow"  # an allowed alias goes before a blocked one
    assert url_filters.judge(pages.limit(0), rules).count() == 0 and url_filters.judge(pages, rules.limit(0)).where("verdict = 'block'").count() == 0


def test_url_filters_relative_links(spark):
    """Targets are read against their own page, in Spark and in the SQL, so hosts that share a relative link stay apart."""
    import duckdb

    rules = [("block", "evil.com", "/"), ("block", "spam.org", "/a/x")]
    link = lambda href: f'<link rel=canonical href="{href}">'
    rows = [
        (1, "https://evil.com/a", link("/home")), (2, "https://good.org/b", link("/home")), (3, "https://ok.net/1", link("//evil.com/z")), (4, "https://spam.org/a/b/c?q#f", link("../x")), (5, "https://ok.net/2", link("HTTPS://spam.org/a/./q/../x?a=1&amp;b=2")),
        (6, "https://ok.net/3", link("mailto:me@evil.com")), (7, "https://ok.net/4", link("javascript:void(0)")), (8, "https://ok.net/5", link("#evil.com")), (9, "https://spam.org", link("a/x/")), (10, "https://ok.net/6?p=//evil.com", link("?p=1")),
        (11, "https://" + "a." * 30 + "net/" + "p/" * 2000, link("../" * 3000 + "a/x")), (12, "https://spam.org/a/y", '<meta http-equiv=refresh content="1;url=x">'), (13, "https://other.org/a/y", '<meta http-equiv=refresh content="1;url=x">'), (14, "https://ok.net/7", link("https:")),
        (15, "no scheme", link("/home")), (16, None, link("/home")), (17, "https://good.org/home", None),
    ]
    got = {r.page_id: r.verdict for r in url_filters.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), url_filters.rule_table(spark, rules)).collect()}
    assert {k for k, v in got.items() if v == "block"} == {1, 3, 4, 5, 9, 12}
    db = duckdb.connect()
    db.execute("create table pages(page_id bigint, url varchar, html varchar)")
    db.executemany("insert into pages values (?, ?, ?)", rows)
    assert {r[0]: r[-1] for r in db.execute(url_filters.sql(rules)).fetchall()} == got
    base = spark.createDataFrame([("http://h/a/b/c", t) for t in ("x", "./x", "../x", "../../../x", "/x/./y/../z", "", "?q", "//o/p", "x://h", "..", ".")], "u string, t string")
    assert [r[0] for r in base.select(url_filters.resolved(F.col("u"), F.col("t"))).collect()] == ["http://h/a/b/x", "http://h/a/b/x", "http://h/a/x", "http://h/x", "http://h/x/z", None, "http://h/a/b/c?q", "http://o/p", "x://h", "http://h/a/", "http://h/a/b/"]


# 7


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "u\r\nX: y", None), (2, None, "a" * 100), (3, "u", "a" * 100), (None, "u", "a" * 100), (4, "v", "é" * 30), (5, "v", "é" * 30), (2, None, "a" * 100), (9, "w", "<p>" + "z" * 500_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    folder = warc.archive(pages, str(tmp_path / "w"))
    got = sorted((tuple(r) for r in warc.page_index(spark, folder).collect()), key=str)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = i == 3
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", 2 if again else None))
    assert got == sorted(want, key=str)
    only = spark.read.format("warc").schema("record_id string, record_type string").load(folder).where("record_type = 'revisit'")
    assert [r.record_id for r in only.collect()] == ["urn:page:3"]
    assert warc.page_index(spark, warc.archive(pages.limit(0), str(tmp_path / "e"))).count() == 0


def test_warc_reads_plain_and_whole_gzip():
    import gzip

    one = warc.record_bytes({"record_id": "r1", "record_type": "response", "payload": b"hello"})
    two = warc.record_bytes({"record_id": "r2", "record_type": "revisit", "refers_to": "r1", "payload_length": 5})
    columns = {"record_id", "payload", "payload_length"}
    for data in (one + two, gzip.compress(one + two), warc.member(one) + warc.member(two), gzip.compress(one) + gzip.compress(two), warc.member(one + two)):
        got = list(warc.records(io.BytesIO(data), len(data), warc.Wanted(), columns))
        assert [(r["record_id"], r["payload_length"], r["payload"]) for r in got] == [("r1", 5, b"hello"), ("r2", 5, b"")]


def foreign(name, block, kind="resource"):
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{name}>\r\nContent-Type: text/plain\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


@pytest.mark.parametrize("piece", [7, 1000, 1 << 16])
def test_warc_lengths_of_blocks_that_are_not_read(monkeypatch, piece):
    import gzip

    monkeypatch.setattr(warc, "PIECE", piece)
    noise = np.random.default_rng(0).integers(0, 256, 20_000, np.uint8).tobytes()
    many = [foreign("a", noise), foreign("b", b"WARC/1.0\r\n\r\n" + noise), foreign("c", b""), warc.record_bytes({"record_id": "d", "record_type": "response", "payload": noise})]
    for data in (b"".join(many), gzip.compress(b"".join(many)), b"".join(map(warc.member, many)), b"".join(map(gzip.compress, many))):
        got = list(warc.records(io.BytesIO(data), len(data), warc.Wanted(), {"record_id", "payload_length"}))
        assert [(r["record_id"], r["payload_length"], r["payload"]) for r in got] == [("a", 20_000, None), ("b", 20_012, None), ("c", 0, None), ("d", 20_000, None)]
        got = list(warc.records(io.BytesIO(data), len(data), warc.Wanted(), {"payload"}))
        assert [r["payload"] for r in got] == [noise, b"WARC/1.0\r\n\r\n" + noise, b"", noise]
        assert [r["record_id"] for r in warc.records(io.BytesIO(data), len(data), warc.Wanted([warc.EqualTo(("record_type",), "response")]), {"record_id"})] == ["d"]


def test_warc_headers_cannot_be_injected(spark, tmp_path):
    ends = ["\r\n", "\n", "\r", "\x0b", "\x0c", "\x1c", "\x1e", "\x85", "\u2028", "\u2029", "\r\n\r\n"]
    rows = [(k, f"http://h/{end}WARC-Type:metadata{end}WARC-Record-ID:<urn:page:99>{end}Content-Length: 1: 2", "p" * k) for k, end in enumerate(ends)]
    folder = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"))
    got = sorted(warc.page_index(spark, folder).collect())
    assert [(r.page_id, r.payload_bytes, r.record_type) for r in got] == [(k, k, "response") for k in range(len(ends))]
    urls = {r.target_uri for r in spark.read.format("warc").schema("target_uri string").load(folder).collect()}
    assert len(urls) == len(ends) and "http://h/%E2%80%A8WARC-Type:metadata%E2%80%A8WARC-Record-ID:<urn:page:99>%E2%80%A8Content-Length:%201:%202" in urls
    assert warc.fields(b"WARC/1.1\r\nA: 1\x85B: 2\r\na: 3\r\nC: x\r\n  y") == {"a": "1\ufffdB: 2", "c": "x y"}


# 8


def test_decontamination(spark, odd, none):
    rng = np.random.default_rng(8)
    w = lambda n, p: [f"{p}{i}" for i in rng.integers(0, 10**6, n)]
    bench = [w(40, "q"), w(15, "r"), w(4, "s"), w(60, "t")]
    swapped = list(bench[0])
    for k in (6, 15, 24, 33):
        swapped[k] = "other"
    docs = {1: w(50, "a") + bench[0] + w(20, "a"), 2: w(5, "a") + swapped, 3: bench[1], 4: w(9, "a") + bench[2] + w(9, "a"), 5: w(300, "a"), 6: bench[3][10:40] + w(30, "b"), 7: bench[3][:9] + w(40, "c"), 8: [x.upper() + "," for x in bench[1]]}
    table = spark.createDataFrame([(k, " ".join(v)) for k, v in docs.items()] + [(1, " ".join(docs[1])), (90, None), (91, "")], "doc_id long, text string").withColumn("h", F.lit(0)).withColumn("item_id", F.lit(5))
    tests = spark.createDataFrame([(k, " ".join(v)) for k, v in enumerate(bench)] + [(9, None), (10, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.doc_from, r.n_places, r.n_equal) for r in decontaminate.overlaps(table, tests).collect()}
    assert got == {(1, 0): (50, 40, 40), (2, 0): (5, 40, 36), (3, 1): (0, 15, 15), (4, 2): (9, 4, 4), (6, 3): (0, 30, 30), (8, 1): (0, 15, 15)}
    left = decontaminate.clean(table, tests)
    assert sorted(r.doc_id for r in left.collect()) == [5, 7, 90, 91] and left.columns == table.columns
    assert decontaminate.clean(odd, tests).count() == len(ODD) and decontaminate.overlaps(none, tests).count() == 0 and decontaminate.overlaps(table, tests.limit(0)).count() == 0


def brute_overlap(doc, item, least_words=13, least_equal=0.8):
    """(n_places, n_equal, doc_from) of the best run over all shifts, None without one that is long enough."""
    best, least_equal = None, least_equal if len(item) >= decontaminate.SPAN else 1  # a text shorter than a seed counts as it is only
    for shift in range(-len(item) + 1, len(doc)):
        equal = [p for p in range(len(item)) if 0 <= p + shift < len(doc) and doc[p + shift] == item[p]]
        runs = [(equal[k] - equal[j] + 1, -equal[j], k - j + 1) for j in range(len(equal)) for k in range(j, len(equal)) if k - j + 1 >= least_equal * (equal[k] - equal[j] + 1) - 1e-9]
        if runs and max(runs)[0] >= min(least_words, len(item)):
            n, back, same = max(runs)
            key = (same, n, -(shift - back))
            best = max(best or key, key)
    return best and (best[1], best[0], -best[2])


def test_decontamination_against_brute_force(spark):
    rng = np.random.default_rng(3)
    items = [[f"w{k}" for k in rng.integers(0, vocabulary, n)] for n, vocabulary in ((30, 400), (18, 3), (40, 2), (25, 400), (6, 400), (60, 5))]
    docs = []
    for _ in range(120):
        own = [f"w{k}" for k in rng.integers(0, (400, 3)[rng.integers(0, 2)], rng.integers(1, 60))]
        item = list(items[rng.integers(0, len(items))])
        for k in rng.integers(0, len(item), rng.integers(0, 1 + len(item) // 4)):
            item[k] = f"x{k}"
        a = rng.integers(0, max(1, len(item) - 8))
        at = rng.integers(0, len(own) + 1)
        docs.append(own[:at] + item[a:] + own[at:])
    bench = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string")
    frame = spark.createDataFrame([(k, " ".join(d)) for k, d in enumerate(docs)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_places, r.n_equal, r.doc_from) for r in decontaminate.overlaps(frame, bench).collect()}
    want = {(d, i): found for d, doc in enumerate(docs) for i, item in enumerate(items) if (found := brute_overlap(doc, item))}
    assert {k for k in want if k not in got} == set() and {k for k in got if k not in want} == set() and len(want) > 60
    assert got == want


def test_decontamination_of_repeated_words(spark):
    """Hits of texts that repeat a word stay in proportion to their lengths."""
    docs = spark.createDataFrame([(1, "again " * 3000, 1), (2, "again and " * 1500, 2)], "doc_id long, text string, copy long")
    bench = spark.createDataFrame([(1, "again " * 300, 1), (2, "and again " * 200, 2)], "item_id long, text string, item long")
    assert decontaminate.hits(docs, bench).count() < 10_000
    got = {(r.doc_id, r.item_id): (r.n_places, r.n_equal) for r in decontaminate.overlaps(docs.drop("copy"), bench.drop("item")).collect()}
    assert got == {(1, 1): (300, 300), (2, 2): (400, 400)}


def test_masks_survive_any_one_substitution():
    assert all(any(k not in mask for mask in decontaminate.MASKS) for k in range(decontaminate.SPAN))


def test_masks_hit_every_placement():
    """No placement of substitutions inside an accepted run goes without a hit: tried one by one to 20 places, and beyond by the least substitutions that avoid all hits."""
    masks = [(m[-1], sum(1 << k for k in m)) for m in decontaminate.MASKS]
    for n in range(decontaminate.SPAN, 21):
        for many in range(n // 5 + 1):
            swapped = np.array([sum(1 << k for k in c) for c in itertools.combinations(range(1, n - 1), many)])
            hit = np.zeros(len(swapped), bool)
            for last, bits in masks:
                for at in range(n - last):
                    hit |= swapped >> at & bits == 0
            assert hit.all(), (n, many, int((~hit).sum()))
    size = 1 << decontaminate.SPAN - 1  # states: the last SPAN - 1 places, a bit for each equal one
    least, state = np.full(size, 10**6), np.arange(size)
    least[1] = 0
    equal = state << 1 | 1
    for n in range(2, 201):
        hit = np.zeros(size, bool)
        for m in decontaminate.MASKS:
            back = sum(1 << m[-1] - k for k in m)
            hit |= (m[-1] < n) & (equal & back == back)
        after = np.full(size, 10**6)
        np.minimum.at(after, state << 1 & size - 1, least + 1)
        np.minimum.at(after, equal[~hit] & size - 1, least[~hit])
        least = after
        assert n < decontaminate.SPAN or 5 * least[1::2].min() > n


def test_decontamination_finds_every_placement(spark):
    places = list(itertools.combinations(range(1, 14), 3))
    text = [f"q{k}" for k in range(15)]
    docs = [(i, " ".join([*(f"a{i}x{k}" for k in range(12)), *("other" if k in own else w for k, w in enumerate(text)), *(f"b{i}x{k}" for k in range(12))])) for i, own in enumerate(places)]
    got = decontaminate.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(text))], "item_id long, text string")).collect()
    assert len(places) == 286 and {(r.doc_id, r.doc_from, r.n_places, r.n_equal) for r in got} == {(i, 12, 15, 12) for i in range(286)}


# 9


@pytest.fixture(scope="module")
def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    return public.path("word_bpe_49k.json")


def test_token_ids(spark, odd, none, tokenizer, tmp_path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer)
    got = sorted((tuple(r) for r in token_ids.encode_and_read(odd, tokenizer, f"file://{tmp_path}/ids").collect()), key=lambda r: r[1])
    start, want = 0, []
    for i, text, *_ in sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert token_ids.encode_and_read(none, tokenizer, f"file://{tmp_path}/none").count() == 0


def test_encoder_is_the_tokenizer(tokenizer):
    from tokenizers import Tokenizer

    plain, own = Tokenizer.from_file(tokenizer), token_ids.Encoder(tokenizer)
    texts = ["a\x0bb\x0cc\x1cd\x85e\u00a0f", "<|endoftext|>hi <|startoftext|> X <|ENDOFTEXT|>", "İstanbul ΣΑΣ ﬁ é e\u0301 .\u0301", "don't it's 12345 a1b2 中文字 \u200bx", "Word, word. A.b ... a.. ,", ""]
    ids, lengths = own(pa.array(texts))
    at = np.concatenate(([0], np.cumsum(lengths)))
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == [*plain.encode(t, add_special_tokens=False).ids, 1]


def test_codes_give_any_token():
    rng = np.random.default_rng(9)
    ids = rng.integers(0, 2 ** rng.integers(1, 23, 3000), 3000).astype(np.uint32)
    codes = token_ids.Codes(b"".join(token_ids.packed([4, None], np.array([1000, 2000]), ids)))
    assert (codes.ids() == ids).all() and all(codes[k] == ids[k] for k in range(3000))
    with pytest.raises(IndexError):
        codes[3000]
    assert len(token_ids.Codes(b"".join(token_ids.packed([], np.array([], int), np.array([], np.uint32)))).ids()) == 0


# 10


def brute_spans(text):
    import re

    forms = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, form in forms.items():
        for m in re.finditer(form, text):
            digits = re.sub(r"\D", "", m[0])
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 16 <= len(digits) <= 19 and pii.luhn(digits) or kind == "phone" and 8 <= len(digits) <= 15:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_against_the_forms():
    rng = np.random.default_rng(10)
    parts = list("0123456789..@@+ab- ()é%") + ["4111 1111 1111 1111", "+1 (5", "25", "@a.b", "x@", "10.0.0.1"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts, rng.integers(0, 20)))
        assert pii.base_spans(text) == brute_spans(text)
    assert pii.base_spans("1" * 200_000 + "." + "a" * 200_000 + "@") == []


def test_contexts_discover_secrets_on_both_sides(spark):
    hexes = [hashlib.sha256(str(k).encode()).hexdigest() for k in range(40)]
    rows = [(k, f'set token = "{hexes[k]}" here now') for k in range(6)]
    rows += [(10 + k, f'then token = "short-{k}9{k}83" here') for k in range(3)]  # no seed's form, the seeds' context
    rows += [(20 + k, f"lorem w{k} {hexes[20 + k]} ipsum v{k}") for k in range(6)]  # a seed's form, no context of its own
    rows += [(30 + k, f"mail x{k} user{k}@example.com replied at once") for k in range(5)] + [(40 + k, f"mail y{k} handle-{k}{k}{k}{k} replied at once") for k in range(2)]
    rows += [(50, "pad " * 2000 + f"{'w' * 400} {'v' * 400} 1234{'5' * 300} " + "pad " * 2000), (51, f'set token = "{"a1" * 200}" end')]
    got = {r.doc_id: r for r in pii.extract(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, text in rows:
        if k < 20 or k == 51:
            at = text.index('"') + 1
            assert got[k].spans == f"secret:{at}:{text.index('"', at)}" and got[k].base_sha256 == hashlib.sha256(b"").hexdigest()
        elif k < 30 or k == 50:
            assert got[k].spans == ""
        elif k >= 40:
            assert got[k].spans == f"email:8:{text.index(' replied')}" and got[k].n_email == 0  # what stands behind tells


def test_contexts_discover(spark, odd, none):
    rows = [(k, f"the contact phone is: +1 (555) 555-{1000 + k} ok") for k in range(6)] + [(10 + k, f"the contact phone is: 555-{3000 + 3 * k} ok") for k in range(4)] + [(20 + k, f"item the {1000 + k} of many the words") for k in range(9)]
    got = {r.doc_id: r for r in pii.extract(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[10 + k].spans == "phone:22:30" and got[10 + k].n_phone == 0 for k in range(4)) and all(got[20 + k].spans == "" for k in range(9))
    assert got[0].base_sha256 == hashlib.sha256(b"phone:22:39").hexdigest() and got[0].spans == "phone:22:39"
    assert pii.extract(odd).count() == len(ODD) and pii.extract(none).count() == 0


def plain_features(text):
    """A text's places by the definitions, one feature at a time."""
    import xxhash

    def bucket(key, salt):
        turned = (key + salt) * 0x9E3779B97F4A7C15 % 2**64
        turned ^= turned >> 29
        return max(turned * 0xBF58476D1CE4E5B9 % 2**64 >> 64 - quality_model.BUCKETS_LOG, 1)

    out = [0] + [bucket(xxhash.xxh3_64_intdigest(w), 7) for w in text.split()]
    for word in text.split():
        padded = f" {word} "
        for n in quality_model.GRAMS:
            for k in range(len(padded) - n + 1):
                key = 0
                for c in padded[k : k + n]:
                    key = (key * 0x9E3779B97F4A7C15 + ord(c)) % 2**64
                out.append(bucket(key, n))
    return out


def test_quality_model_against_plain_descent(spark):
    texts, labels = ["good words here", "bad bad stuff", "good enough words", "awful stuff", "é good"], [1, 0, 1, 0, 1]
    got = quality_model.train([quality_model.unpacked(quality_model.packed(*x)) for x in quality_model.counted(pa.array(texts))], np.array(labels), epochs=3)
    rng, size = np.random.default_rng(quality_model.SEED), quality_model.DIMENSIONS
    vectors = rng.uniform(-1 / size, 1 / size, (quality_model.BUCKETS, size)).astype(np.float32)
    each, layer, step = [plain_features(t) for t in texts], np.zeros((size, 2)), 0
    rows = {p: vectors[p].astype(float) for f in each for p in f}
    for _ in range(3):
        for k in rng.permutation(len(texts)):
            share = {p: each[k].count(p) / len(each[k]) for p in each[k]}
            mean = sum(s * rows[p] for p, s in share.items())
            odds = np.exp(mean @ layer)
            loss = odds / odds.sum() - np.eye(2)[labels[k]]
            now, back = quality_model.RATE * (1 - step / 15), layer @ loss
            layer = layer - now * np.outer(mean, loss)
            for p, s in share.items():
                rows[p] = rows[p] - now * s * len(share) ** 0.5 * back
            step += 1
    assert {p: got[p] for p in rows} == pytest.approx({p: rows[p] @ (layer[:, 1] - layer[:, 0]) for p in rows}, abs=1e-4)
    new = [*texts, "good stuff", "", None]
    scored = quality_model.score(spark.createDataFrame(list(enumerate(new)), "doc_id long, text string"), got)
    want = [1 / (1 + np.exp(-np.mean([float(got[p]) for p in plain_features(t or "")]))) for t in new]
    assert [r["score"] for r in scored.orderBy("doc_id").collect()] == pytest.approx(want, abs=1e-6)


def test_a_label_of_many_documents_is_bounded(spark, monkeypatch):
    rows = [(1, "good words here", "en", "a", 1)] * 40 + [(k, "bad stuff" if k % 2 else "good words", "en", "a", 1) for k in range(2, 40)]
    docs, labels = spark.createDataFrame(rows, KIND), spark.createDataFrame([(k, k % 2, k % 2) for k in range(1, 40)], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(toxicity, "CURVE_ROWS", 5)
    monkeypatch.setattr(quality_model, "TRAIN_BYTES", 2000)
    for got in (toxicity.judge(docs, labels), quality_model.judge(docs, labels)):
        assert got.count() == len(rows) and got.where("score between 0 and 1").count() == len(rows)

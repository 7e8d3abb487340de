"""Bootstrapping of identifiers against a plain graph, over generations that only discovered instances lead to."""

import math
import random
from collections import Counter, defaultdict

import pytest

from tidemark.llm import pii


def card(rng):
    body = [rng.randrange(10) for _ in range(15)]
    total = sum(d if k % 2 else d * 2 - 9 * (d > 4) for k, d in enumerate(body))
    return "".join(map(str, [*body, -total % 10]))


def corpus(rng, generations, words):
    """Lines of words; ids of generation g stand after the context of g and again after that of g + 1, cards after the first."""
    lines, fill = [], lambda n: [rng.choice(words) for _ in range(n)]
    ids = [card(rng) for _ in range(40)]
    for g in range(generations):
        known, context = ids, ["my", f"context{'abcdefgh'[g]}"]
        ids = [f"{rng.choice('abc')}{rng.randrange(10**5, 10**6)}x{g}" for _ in range(int(len(known) * rng.uniform(0.5, 0.8)))]
        lines += [[*fill(rng.randrange(3)), *context, one, *fill(rng.randrange(3))] for one in known + ids]
        lines += [[*context, *fill(2)] for _ in range(rng.randrange(3))]
    return lines + [fill(6) for _ in range(30)]


def plain(lines):
    """The instances that bootstrapping finds, by the definitions."""
    edges, total = Counter(), Counter()
    for line in lines:
        n = len(line)
        for i, w in enumerate(line):
            sides = ([("l", line[i - 1])] if i else []) + ([("l", line[i - 2], line[i - 1])] if i > 1 else []) + ([("r", line[i + 1])] if i < n - 1 else []) + ([("r", line[i + 1], line[i + 2])] if i < n - 2 else [])
            total.update(sides)
            if sum(c.isdigit() for c in w) >= 4:
                edges.update((p, w) for p in sides)
    fixed = {w: "card" for _, w in edges if w.isdigit()}
    known = {}
    while True:
        best = {}
        by = defaultdict(lambda: defaultdict(dict))
        for (p, w), n in edges.items():
            if kind := known.get(w) or fixed.get(w):
                by[p][kind][w] = n
        for p, kinds in by.items():
            good = [(min(sum(ws.values()), total[p]) / total[p], k) for k, ws in kinds.items() if len(ws) >= pii.LEAST_INSTANCES and sum(ws.values()) / total[p] >= pii.LEAST_PATTERN]
            if good:
                best[p] = max(good)
        score = defaultdict(list)
        for p, w in edges:
            if p in best and w not in fixed and w not in known:
                score[w].append(best[p])
        new = {w: max(s)[1] for w, s in score.items() if 1 - math.prod(1 - min(c, 1 - 1e-9) for c, _ in s) >= pii.LEAST_INSTANCE}
        if not new:
            return known
        known |= new


@pytest.mark.parametrize("seed", range(4))
def test_generations_against_a_plain_graph(spark, seed):
    rng = random.Random(seed)
    lines = corpus(rng, 5, [f"{a}{b}word" for a in "klmnop" for b in "qrstuv"])
    want = plain(lines)
    assert {w[-1] for w in want} >= set("01")
    got = pii.extract(spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(lines)], "doc_id long, text string").repartition(3))
    found = set()
    for r in got.collect():
        text = " ".join(lines[r["doc_id"]])
        found |= {text[int(a) : int(b)] for kind, a, b in (s.split(":") for s in r["spans"].split(",") if s) if not text[int(a) : int(b)].isdigit()}
    assert found == set(want)


def test_a_pattern_that_only_discovered_instances_share(spark):
    rows = [f"alpha user{k}@mail.example" for k in range(108)] + [f"alpha x{k}y{10**5 + k}" for k in range(24)]
    rows += [f"bravo x{k}y{10**5 + k}" for k in range(24)] + [f"bravo z{k}q{10**5 + k}" for k in range(5)]
    rows += [f"charlie z{k}q{10**5 + k}" for k in range(5)] + ["charlie v77w31337"]
    got = pii.extract(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    assert all(r["spans"] for r in got)


def test_counts_need_no_room_in_the_bitmap(spark, monkeypatch):
    monkeypatch.setattr(pii, "MASK_BITS", 15)
    monkeypatch.setattr(pii, "HELD", 3)
    rows = [f"w{k % 40} token{k % 7} behind" for k in range(200)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    import pyarrow as pa

    keys = {int(k): w for w in ("token1", "token2") for k in [pii.pattern_keys(pii.context_words(pa.array([w]))[0])[0][0]]}
    got = pii.occurrences(docs, spark.createDataFrame([(k,) for k in keys], "pattern long")).collect()
    assert {keys[r["pattern"]]: r["total"] for r in got} == {w: sum(w in r.split() for r in rows) for w in keys.values()}

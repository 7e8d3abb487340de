"""Token alignment against whole texts, tokens held against each other one by one."""

import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.test_llm_small import KIND, ODD
from tidemark.llm import alignment
from tidemark.llm.queries import tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
a = Tokenizer.from_file(A)
a.encode_special_tokens = True
b = sentencepiece.SentencePieceProcessor(model_file=B)
alphabet = {v: k for k, v in alignment.byte_alphabet().items()}


def spans(parts):
    at, out = 0, []
    for p in parts:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def tokens(text):
    """A's and B's ids and byte ranges; None where they don't give the text back."""
    want = (" " + text).encode()
    signs = {c: n for n, c in alphabet.items()}
    left, right = a.encode(" " + text, add_special_tokens=False), b.encode(text)
    lp = [bytes(signs[c] for c in t) for t in left.tokens]
    rp = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in right]
    return (left.ids, spans(lp), right, spans(rp)) if b"".join(lp) == want == b"".join(rp) else None


def plain(texts):
    rows, counts = [], Counter()
    for text in texts:
        got = tokens(text) if text else None
        if got is None:
            rows.append(None)
            continue
        ai, asp, bi, bsp = got
        links = [(ai[x], bi[y]) for x in range(len(ai)) for y in range(len(bi)) if asp[x][0] < bsp[y][1] and bsp[y][0] < asp[x][1]] if len(ai) < 2000 else None
        if links is None:  # long: only neighbours can meet
            links, y = [], 0
            for x in range(len(ai)):
                while bsp[y][1] <= asp[x][0]:
                    y += 1
                k = y
                while k < len(bi) and bsp[k][0] < asp[x][1]:
                    links.append((ai[x], bi[k]))
                    k += 1
        ends = sorted({e for _, e in asp} & {e for _, e in bsp})
        groups, x, y = [], 0, 0
        for e in ends:
            i, j = x, y
            while i < len(asp) and asp[i][1] <= e:
                i += 1
            while j < len(bsp) and bsp[j][1] <= e:
                j += 1
            groups.append(",".join(map(str, ai[x:i])) + "|" + ",".join(map(str, bi[y:j])))
            x, y = i, j
        counts.update(links)
        rows.append((len(ai), len(bi), len(groups), len(links), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return [(0,) * 6 + ("",) if r is None else (*r[:4], sum(counts[p] == best[p[1]] for p in r[4]), sum(counts[p] for p in r[4]), r[5]) for r in rows]


SIGNS = ["a", "the", " ", "  ", "\n", "\n\n", "\t", "▁", "<|endoftext|>", "<s>", "é", "ﬁ", "中", "𝔘", "12", "'s", "’", " ", "\x1c", "\x85", ".", "--", "​", "᠎", "x" * 70, "\r\n", "\x00", "é", "　"]


def test_units_give_what_whole_texts_give():
    own = alignment.Aligner(A, B)
    assert own.cuts

    @settings(max_examples=400, deadline=None)
    @given(st.lists(st.sampled_from(SIGNS), max_size=14).map("".join))
    def check(text):
        tallies, digests, _, _, n = own.block([None, text, text])
        (want,) = plain([text])
        assert [(*t, d) for t, d in zip(tallies.tolist(), digests, strict=True)] == [(0, 0, 0, 0, "")] + [(*want[:4], want[6])] * 2
        assert n.sum() == 2 * want[3]
        assert "".join(alignment.UNIT.findall(" " + text)) == " " + text

    check()


def test_whole_corpus(spark, monkeypatch):
    rng = random.Random(3)
    texts = [r[1] for r in ODD] + ["".join(rng.choice(SIGNS) + " " * rng.randrange(2) for _ in range(rng.randrange(60))) for _ in range(60)] + ["the cat"] * 4
    docs = spark.createDataFrame([(k if k else None, t, "en", "s", 1) for k, t in enumerate(texts)], KIND).repartition(4)
    for name in ("row", "b", "n", "block", "kind", "a.b"):
        docs = docs.withColumn(name, F.lit(1))
    monkeypatch.setattr(alignment, "HELD", 20)
    for split in (alignment.SPLIT_ENTRIES, 3):
        rows, counts = alignment.align(docs, A, B, split)
        got = sorted((tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in rows.collect()), key=lambda r: r[0] or 0)
        assert got == [(k if k else None, *w) for k, w in enumerate(plain(texts))]
        assert sum(r["n"] for r in counts.collect()) == sum(r[4] for r in got)


def test_long_texts_come_in_runs(monkeypatch):
    monkeypatch.setattr(alignment, "LONG_TEXT", 10)
    monkeypatch.setattr(alignment, "RUN_UNITS", 3)
    monkeypatch.setattr(alignment, "CACHE_UNITS", 5)
    own = alignment.Aligner(A, B)
    text = " ".join(f"word{k % 7}.\nand" for k in range(50)) + "  "
    tallies, digests, _, _, n = own.block([text])
    assert (*tallies[0].tolist(), digests[0], n.sum()) == (lambda w: (*w[:4], w[6], w[3]))(plain([text])[0])


def test_no_rows(spark):
    assert alignment.align(spark.createDataFrame([], KIND), A, B)[0].count() == 0


@pytest.mark.parametrize("path", [A])
def test_other_tokenizers_take_whole_texts(path):
    own = alignment.Aligner(path, B)
    own.cuts = False
    assert own.block(["two  words\nhere"])[1][0] == plain(["two  words\nhere"])[0][6]

"""A quality classifier of supervised subword embeddings.

A text's features are its words and its words' character n-grams of ``GRAMS`` lengths, with a space at either end of a word, hashed into ``BUCKETS`` vectors, and one
feature that every text has. The vectors are averaged per document and a softmax layer over the average gives the class; vectors and layer are
learned together by stochastic gradient descent in numpy, on at most ``TRAIN_ROWS`` labelled documents (those of the least hashes of
doc_id), each with its whole text. Case and punctuation are kept: they tell junk from prose.

Because average and layer are linear, a feature's vector times the layer is one number, so scoring looks up one float
per feature. That table of BUCKETS floats is all that goes to the workers, whatever the corpus.

Defined cases: null and empty texts have the common feature only; without labelled rows of both classes the score is 0.5; rows that repeat are
scored each; of rows whose doc_id's hashes tie the smallest ids are learned from; null labels are left out; very long texts are taken whole, and the
labelled rows go to the driver a part at a time, as features; an empty table gives no rows; extra columns stay out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import mapped, written
from tidemark.llm.textvec import word_codes, hashed
from tidemark.llm.token_ids import slices

GRAMS, BUCKETS_LOG, DIMENSIONS = (3, 4, 5), 18, 10
BUCKETS = 1 << BUCKETS_LOG
#: Labelled rows to learn from, passes over them, and the first step's rate.
TRAIN_ROWS, EPOCHS, RATE, SEED = 5000, 10, 0.5, 11
#: Bytes of packed features that the learner holds at most: of texts with more together, those first in order are learned from.
TRAIN_BYTES = 64 << 20
#: Bytes of text that a worker takes apart at once.
PIECE_BYTES = 1 << 19


def bucket(key: np.ndarray, salt: int) -> np.ndarray:
    """Places 1 to BUCKETS - 1; place 0 is the feature that every text has."""
    turned = (key + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    turned ^= turned >> np.uint64(29)
    turned *= np.uint64(0xBF58476D1CE4E5B9)
    return np.maximum(turned >> np.uint64(64 - BUCKETS_LOG), np.uint64(1)).astype(np.int64)


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind of feature the places of all texts' features and where each text's begin."""
    texts = pc.fill_null(texts, "")
    codes, words, word_at = word_codes(texts)
    yield (bucket(hashed(words), 7)[codes] if len(words) else np.empty(0, np.int64)), word_at
    at = np.concatenate(([0], np.cumsum(pc.utf8_length(texts).to_numpy().astype(np.int64) + 2)))
    points = np.frombuffer("".join(f" {t} " for t in texts.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    space = (points == 32) | (points >= 9) & (points <= 13)
    points[space] = 32
    before = np.concatenate(([0], np.cumsum(space)))
    for n in GRAMS:
        key = np.zeros(max(0, len(points) - n + 1), np.uint64)
        for k in range(n):
            key = key * np.uint64(0x9E3779B97F4A7C15) + points[k : k + len(key)]
        own = np.flatnonzero(before[n - 1 : len(before) - 1] == before[1 : len(before) - n + 1])  # no space but at its ends
        yield bucket(key[own], n), np.searchsorted(own, at)


def counted(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's distinct places, in order, and how often it has each."""
    kinds = list(features(texts))
    return [np.unique(np.concatenate([np.zeros(1, np.int64), *(p[a[row] : a[row + 1]] for p, a in kinds)]), return_counts=True) for row in range(len(texts))]


def packed(places: np.ndarray, n: np.ndarray) -> bytes:
    """counted()'s arrays of a text: steps between places and counts, byte planes apart, deflated."""
    both = np.concatenate((np.diff(places, prepend=0), n)).astype("<u4")
    return zlib.compress(both.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A text's distinct places with their shares of the average."""
    both = np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()
    steps, n = np.split(both, 2)
    return np.cumsum(steps, dtype=np.int32), (n / n.sum()).astype(np.float32)


def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, label) with the text's features packed: at most BUCKETS places, however long it is."""
    for batch in batches:
        for a, b in slices(batch["text"], PIECE_BYTES):
            each = [packed(p, n) for p, n in counted(batch["text"].slice(a, b - a))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a).cast(pa.string()), pa.array(each, pa.binary()), batch["label"].slice(a, b - a)], ["doc_id", "packed", "label"])


def train(examples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> np.ndarray:
    """The log odds of class 1 that each place adds for a whole share of the average."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    layer, step, steps = np.zeros((DIMENSIONS, 2), np.float32), 0, epochs * len(examples)
    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            own, share = examples[k]
            rows = vectors[own]
            mean = share @ rows
            z = mean @ layer
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[k]] -= 1  # the loss's gradient in the logits
            now = np.float32(rate * (1 - step / steps))
            back = layer @ p
            layer -= now * np.outer(mean, p)
            vectors[own] = rows - now * np.outer(share * np.float32(len(own) ** 0.5), back)
            step += 1
    return (vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> np.ndarray:
    """The table of a classifier. labels: (doc_id, label)."""
    known = labels.where("label in (0, 1) and doc_id is not null").select("doc_id", F.col("label").cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    got = mapped(texts, shares, "doc_id string, packed binary, label int").orderBy("doc_id", F.xxhash64("packed"), "label").limit(rows)
    so_far = F.sum(F.octet_length("packed")).over(Window.orderBy("doc_id", F.xxhash64("packed"), "label").rowsBetween(Window.unboundedPreceding, 0))
    got = written(got, "examples").withColumn("_bytes", so_far).where(f"_bytes <= {TRAIN_BYTES}").toArrow()  # a window over rows at most
    y = got["label"].to_numpy()
    if not len(y) or y.min() == y.max():
        return np.zeros(BUCKETS, np.float32)
    return train([unpacked(x.as_py()) for x in got["packed"]], y)


def score(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """(doc_id, score) of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odds = shared.value
        for batch in batches:
            for a, b in slices(batch["text"], PIECE_BYTES):
                total, n = np.full(b - a, odds[0], np.float64), np.ones(b - a)
                for places, at in features(batch["text"].slice(a, b - a)):
                    sums = np.concatenate(([0], np.cumsum(odds[places], dtype=np.float64)))
                    total += sums[at[1:]] - sums[at[:-1]]
                    n += np.diff(at)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), pa.array(1 / (1 + np.exp(-np.clip(total / n, -700, 700))))], ["doc_id", "score"])

    return mapped(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), measure, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; rows whose crc32(doc_id) leaves 1 by 3 are held out."""
    left = F.crc32(F.col("doc_id").cast("string")) % 3
    table = fit(docs, labels.where(left != 1).select("doc_id", F.col("quality").alias("label")))
    return score(docs, table).select("doc_id", F.coalesce(left == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

"""Mixing sources to target weights: fixed-length blocks drawn through index permutations.

The words of each source form one stream, its documents in a fixed order, and that stream is cut into blocks of
``block`` words. An epoch of a source is a pseudorandom permutation of its block indexes, and a source whose target is t
words has the first t words of its permuted epochs to give, a slot per block.

Output shards have ``shard_blocks`` slots each, the last one what is left. How many slots of a shard each source gets is a multinomial draw
at the target weights, conditioned on every source giving its target over all shards, no more and no less: the pool of
all sources' slots is dealt over the shards' places by a pseudorandom permutation, and the sources' counts in each shard are taken. Running sums of
a source's counts over the shards number its slots; a slot's number names its epoch and its index there, the permutation maps
that to a block, and slots and blocks meet in an equi-join on (source, block index).

No rows are collected but one sum. Running sums go over groups of bounded size whose own sums are added up the same way, so no task gets a hot
source's rows; a row per source is the most that one task sees (the targets are shared between all sources).

A permutation is a swap-or-not shuffle: every round pairs index i with (k - i) mod n and swaps the pair if a hash
of its larger member is odd. Each round is a bijection on 0..n-1 for any n, so the whole is one.

Defined cases: a null text has no words; a null source is a source of its own, last in order; documents without words
have taken 0; a text of any length is spread over its blocks; documents that tie in order (whole rows that repeat) are separate documents
of the stream, one behind the other; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import boxed, columns, small, word_count, words, written

WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2.0
BLOCK, SHARD_BLOCKS, ROUNDS, SEED = 512, 1024, 32, 20_011
#: Documents per bucket of a stream, slots per row before they are spread, and rows per group of a running sum.
BUCKET_DOCS, CHUNK_SLOTS, GROUP = 512, 256, 1024


def source_key(source: Column) -> Column:
    """A key without nulls that sorts as the source does by code point, null last."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("~"))


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(skey, source_size) to (skey, source_size, target): shares by weight of ``share`` times all words, none above ``cap`` times its source.

    Sharing the excess again until no source is above its cap gives min(cap, level * weight) for one common level.
    With sources in order of cap / weight, the level that follows from capping the first k is largest at the right k.
    """
    every = Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.row_number().over(Window.orderBy("skey")) - 1) % len(weights) + 1).cast("int"))
    order = Window.orderBy(F.col("limit") / F.col("weight"), "skey")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    return (
        sources.withColumn("weight", weight)
        .withColumn("limit", F.col("source_size") * F.lit(float(cap)))
        .withColumn("level", level)
        .select("skey", "source_size", F.least("limit", F.max("level").over(every) * F.col("weight")).alias("target"))
    )


def permuted(index: Column, n: Column, *key: Column, rounds: int = ROUNDS, seed: int = SEED) -> Column:
    """The image of index in a pseudorandom permutation of 0..n-1 that key and seed choose."""

    def turn(i: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit(seed), r, *key), n) + n - i, n)
        return F.when(F.xxhash64(F.lit(seed + 1), r, F.greatest(i, other), *key).bitwiseAND(F.lit(1)) == 1, other).otherwise(i)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), index, turn)


def running(rows: DataFrame, key: str, index: str, value: str, name: str, last: int, width: int = GROUP) -> DataFrame:
    """rows with the sum, by that name, of the values of the key's rows with a smaller index; index: 0 to last, once per key at most.

    A window goes over width indexes at most; what stands before them is a running sum over such groups.
    """
    own = lambda w: F.coalesce(F.sum(value).over(w.orderBy(index).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if last < width:
        return rows.withColumn(name, own(Window.partitionBy(key)))
    group, before = f"_{index}_group", f"_{index}_before"
    grouped = rows.withColumn(group, F.floor(F.col(index) / width))
    ahead = running(grouped.groupBy(key, group).agg(F.sum(value).alias("_sum")), key, group, "_sum", before, last // width, width)
    return grouped.withColumn(name, own(Window.partitionBy(key, group))).join(ahead.select(key, group, before), [key, group]).withColumn(name, F.col(name) + F.col(before)).drop(group, before)


def stream(docs: DataFrame, sizes: DataFrame | None = None, bucket_docs: int = BUCKET_DOCS) -> DataFrame:
    """(doc_id, skey, row_hash, size, start): each document's place in its source's stream of words.

    A window over all of a source would be one task, so documents are ordered within hashed buckets of bounded size
    and the buckets' sums are added up. Rows that repeat are one row with their number until they have their places.
    """
    sized = written(docs.select("doc_id", source_key(F.col("source")).alias("skey"), F.xxhash64(*columns(docs)).alias("row_hash"), word_count(F.col("text")).alias("size")), "sizes") if sizes is None else sizes
    buckets = max(1, -(-sized.count() // bucket_docs))
    rows = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "row_hash"), F.lit(buckets))).groupBy("skey", "bucket", "doc_id", "row_hash", "size").agg(F.count("*").alias("copies"))
    words = F.col("size") * F.col("copies")
    ahead = running(sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "row_hash"), F.lit(buckets))).groupBy("skey", "bucket").agg(F.sum("size").alias("in_bucket")), "skey", "bucket", "in_bucket", "ahead", buckets - 1)
    inside = Window.partitionBy("skey", "bucket").orderBy("doc_id", "row_hash").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.join(ahead.select("skey", "bucket", "ahead"), ["skey", "bucket"]).withColumn("first", F.col("ahead") + F.coalesce(F.sum(words).over(inside), F.lit(0)))
    return first.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).select("doc_id", "skey", "row_hash", "size", (F.col("first") + F.col("copy") * F.col("size")).alias("start"))


def giving(wanted: DataFrame, block: int) -> DataFrame:
    """wanted (skey, source_size, target) with what each source gives: whole epochs, words of a last one, blocks per epoch, and slots in all."""
    want = F.floor("target")
    return (
        wanted.where("source_size > 0")
        .withColumn("epochs", F.floor(want / F.col("source_size")))
        .withColumn("left", want - F.col("epochs") * F.col("source_size"))
        .withColumn("blocks", F.ceil(F.col("source_size") / block))
        .withColumn("slots", F.col("epochs") * F.col("blocks") + F.ceil(F.col("left") / block))
        .where("slots > 0")
    )


def draws(given: DataFrame, total: int, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED) -> DataFrame:
    """(skey, shard, n): the draw, how many of a shard's slots the source gets; given: giving()'s rows, total: their slots."""
    parts = max(given.sparkSession.sparkContext.defaultParallelism, total // CHUNK_SLOTS // 16)
    pool = given.withColumn("before", F.coalesce(F.sum("slots").over(Window.orderBy("skey").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    chunks = pool.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / CHUNK_SLOTS)))).repartition(parts, "skey", "chunk")
    each = chunks.select("skey", F.explode(F.sequence(F.col("before") + F.col("chunk") * CHUNK_SLOTS, F.col("before") + F.least(F.col("slots"), (F.col("chunk") + 1) * CHUNK_SLOTS) - 1)).alias("at"))
    place = permuted(F.col("at"), F.lit(total).cast("long"), F.lit("draw"), seed=seed + 2)
    return each.groupBy("skey", F.floor(place / shard_blocks).alias("shard")).agg(F.count("*").alias("n"))


def slots(wanted: DataFrame, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED) -> DataFrame:
    """(shard, skey, epoch, slot, block, length) of every slot; wanted: (skey, source_size, target)."""
    given = giving(wanted, block)
    total = given.agg(F.sum("slots")).first()[0] or 0
    drawn = written(draws(given, total, shard_blocks, seed), "draws")
    numbered = running(drawn, "skey", "shard", "n", "first", max(0, (total - 1) // shard_blocks)).repartition(max(given.sparkSession.sparkContext.defaultParallelism, total // CHUNK_SLOTS // 16), "skey", "shard")
    own = numbered.join(small(given), "skey").withColumn("number", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)))
    epoch = F.floor(F.col("number") / F.col("blocks"))
    own = own.withColumn("epoch", epoch).withColumn("slot", F.col("number") - epoch * F.col("blocks")).withColumn("full", F.floor(F.col("source_size") / block))
    where = F.when(F.col("slot") < F.col("full"), permuted(F.col("slot"), F.greatest("full", F.lit(1).cast("long")), F.col("skey"), F.col("epoch"), seed=seed)).otherwise(F.col("slot"))
    in_epoch = F.when(F.col("epoch") < F.col("epochs"), F.col("source_size")).otherwise(F.col("left"))
    return own.select("shard", "skey", "epoch", "slot", where.alias("block"), F.least(F.lit(block).cast("long"), in_epoch - F.col("slot") * block).alias("length"))


def pieces(placed: DataFrame, drawn: DataFrame, block: int = BLOCK) -> DataFrame:
    """Join blocks by index: a row for each run of a document's words in a slot: (doc_id, skey, row_hash, start, size, shard, epoch, slot, first_word, n_words)."""
    at = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))))
    head = F.greatest("start", F.col("block") * block)
    tail = F.least(F.col("start") + F.col("size"), F.col("block") * block + F.col("length"))
    # both sides grow with the corpus: neither may be broadcast, however small it looks before its rows are made
    return at.join(drawn.hint("merge"), ["skey", "block"]).withColumn("first_word", head - F.col("start")).withColumn("n_words", tail - head).where("n_words > 0").select("doc_id", "skey", "row_hash", "start", "size", "shard", "epoch", "slot", "first_word", "n_words")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix of docs (doc_id, source, text): its pieces, the documents' places, and the sources' targets."""
    placed = written(stream(docs), "places")
    wanted = targets(placed.groupBy("skey").agg(F.sum("size").alias("source_size")), weights, share, cap)
    return pieces(placed, slots(wanted, block, shard_blocks, seed), block), placed, wanted


def taken(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken."""
    parts, placed, wanted = mix(docs, **options)
    got = parts.groupBy("skey", "start").agg(F.sum("n_words").alias("got"))
    # A document's words begin at one place of its source's stream; those without words have no pieces.
    rows = placed.withColumn("at", F.when(F.col("size") > 0, F.col("start"))).join(got.withColumnRenamed("start", "at"), ["skey", "at"], "left")
    return rows.join(small(wanted), "skey").select("doc_id", "size", "source_size", "target", F.coalesce("got", F.lit(0)).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: for each document and epoch with words in the mix a row of docs' columns, its text cut to those words.

    A document that an epoch takes whole keeps its text as it is; else its words stand in order with single spaces. n_chars follows the text.
    """
    parts, _, _ = mix(docs, **options)
    own = parts.groupBy("doc_id", "row_hash", "start", "size", "epoch").agg(F.sum("n_words").alias("n"), F.array_sort(F.collect_list(F.struct("first_word", "n_words"))).alias("runs"))
    per_row = own.groupBy("doc_id", "row_hash", "start", "size").agg(F.array_sort(F.collect_list(F.struct("epoch", "n", "runs"))).alias("epochs"))
    places = per_row.select(F.col("doc_id").alias("_id"), F.col("row_hash").alias("_hash"), F.struct("size", "epochs").alias("_place"))
    # rows that repeat are one row until they meet their places; documents stand in a struct, so no column of theirs can clash
    rows = boxed(docs, F.xxhash64(*columns(docs)).alias("_row")).groupBy(F.col("_doc.doc_id").alias("_own"), "_row").agg(F.first("_doc").alias("_doc"))
    both = places.join(rows, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_hash"))).withColumn("_epoch", F.explode("_place.epochs"))
    both = both.withColumn("_words", words(F.col("_doc.text")))
    cut = F.array_join(F.flatten(F.transform("_epoch.runs", lambda r: F.slice(F.col("_words"), (r["first_word"] + 1).cast("int"), r["n_words"].cast("int")))), " ")
    both = both.withColumn("_text", F.when(F.col("_epoch.n") == F.col("_place.size"), F.col("_doc.text")).otherwise(cut))
    changed = {"text": F.col("_text"), "n_chars": F.length("_text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return both.select(*[changed.get(c, F.col("_doc").getField(c)).alias(c) for c in docs.columns])

"""The corpus pipeline: from raw documents to token-id files.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and is written and read again before the next. All but the last return
the columns of documents. No stage is SQL's to express as a whole (a learned model, a similarity join, pseudorandom draws, a
tokenizer), so ORACLE_SQL is None and the tests hold run() against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, mixing, near_duplicates, token_ids, toxicity
from tidemark.llm.common import made, release_since, table, written
from tidemark.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class-conditional models hold for toxic go."""
    return toxicity.clean(docs, docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of copies and near copies the document of the smallest doc_id stays."""
    return near_duplicates.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark text go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares: a row for each document and epoch, with the words that the mix takes."""
    return mixing.mixed_documents(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in files; per row where its ids begin, how many there are, and their checksum, as read back."""
    return token_ids.encode_and_read(docs, tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("near-duplicates", drop_near_copies), ("decontamination", drop_benchmark), ("mixing", mix_sources), ("token-ids", write_token_ids)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn. A stage's own tables, and those of the stage before, go when its result is written."""
    docs, begun = table(spark, sf_dir, "documents"), made()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        release_since(spark, begun, docs)
    return STAGES[-1][1](spark, docs, sf_dir)

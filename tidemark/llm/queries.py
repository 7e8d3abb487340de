"""The opN_ queries: each applies its operator to the whole intended table and derives the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import alignment, decontaminate, languages, merkle, mixing, near_duplicates, pii, quality_model, quality_rules, token_ids, toxicity, url_filters, warc
from tidemark.llm.common import table

#: (verdict, host, path) of the contract's rules.
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents")).drop("node")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"), url_filters.rule_table(spark, URL_RULES))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_index(spark, warc.archive(table(spark, sf_dir, "pages")))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids.encode_and_read(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.extract(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify_tampered(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))[0]


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.judge(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_quality_rules, op3_toxicity, op4_jaccard_join, op5_url_filters, op6_quality_classifier, op7_warc, op8_decontaminate, op9_token_ids, op10_pii, op11_merkle_manifest, op12_token_alignment, op13_language_id)}
ORACLE_SQL: dict[str, str] = {
    "op2_quality_rules": quality_rules.SQL, "op4_jaccard_join": near_duplicates.SQL, "op5_url_filters": url_filters.sql(URL_RULES), "op7_warc": warc.SQL, "op8_decontaminate": decontaminate.sql(), "op11_merkle_manifest": merkle.SQL,
}

"""Queries of the problems of text and matching, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quadloom.llm.components import group_pairs
from quadloom.llm.lookalike import canonical_text, lookalike_classes, lookalike_pairs
from quadloom.llm.mixing import mix_sources
from quadloom.llm.quality import flag_tails, not_prose, text_statistics
from quadloom.llm.tokens import count_tokens, encode_corpus


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike_pairs(spark.read.parquet(f"{d}/label_literals.parquet"), "lit_id", "lex", "lang", "lit_a", "lit_b")


def p3_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every label with the canonical form of its text and its language tag."""
    t = spark.read.parquet(f"{d}/label_literals.parquet").select("lit_id", "lex", "lang")
    return canonical_text(t, {"lex": "lex_form", "lang": "lang_form"}).select("lit_id", "lex_form", "lang_form")


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every label's look, by its least label, and how many labels look the same but are spelt differently."""
    return lookalike_classes(spark.read.parquet(f"{d}/label_literals.parquet"), "lit_id", "lex", "lang")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return group_pairs(spark.read.parquet(f"{d}/same_links.parquet"), "s", "o")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", "text")


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    documents = count_tokens(spark.read.parquet(f"{d}/documents.parquet"), "text", keep=["doc_id", "source"])
    return mix_sources(documents, spark.read.parquet(f"{d}/source_mix.parquet"), "doc_id", "source", "n_tokens", "target_share", "max_repeats")


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """Every use of a document in the mix, with the slot of its block."""
    return _mix(spark, d)[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares that the mix reaches."""
    return _mix(spark, d)[1]


def _text_statistics(spark: SparkSession, d: str) -> DataFrame:
    words = [r["word"] for r in spark.read.parquet(f"{d}/common_words.parquet").select("word").distinct().collect()]  # a fixed list of 204
    return text_statistics(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", "text", "lang", words)


def p8_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Every document's statistics, their percentiles and robust z-scores in its language, and its tails."""
    return flag_tails(_text_statistics(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return not_prose(_text_statistics(spark, d), "doc_id")


P4_SQL = """
WITH RECURSIVE e AS (SELECT s AS a, o AS b FROM same_links WHERE s IS NOT NULL AND o IS NOT NULL UNION SELECT o, s FROM same_links WHERE s IS NOT NULL AND o IS NOT NULL),
r AS (SELECT a AS node, a AS g FROM e UNION SELECT e.b, r.g FROM r JOIN e ON e.a = r.node WHERE r.g < e.b OR r.g = e.b)
SELECT node, min(g) AS group_id FROM r GROUP BY node
"""

QUERIES = {"p3_found": p3_found, "p3_forms": p3_forms, "p3_classes": p3_classes, "p4_found": p4_found, "p6_ids": p6_ids, "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_found": p8_found, "p8_statistics": p8_statistics}
SQL: dict[str, str] = {"p4_found": P4_SQL}

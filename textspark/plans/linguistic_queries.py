"""Registered queries that need Arrow functions, or whose rules SQL does not have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textspark.functions import temporal
from textspark.functions import text as T
from textspark.operators import fuzzy, lexical, similarity
from textspark.plans.lexical_queries import _table


def simhashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = similarity.simhashes(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("simhash")), 16, "0").alias("simhash"))


def fuzzy_expansions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, asked = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    vocabulary = lexical.corpus_term_stats(docs).select("term", F.col("document_count").alias("df"))
    words = asked.select(F.explode(T.words_array("text")).alias("query_term"))
    return fuzzy.expand_terms(words, vocabulary)


def temporal_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents")
    return rows.select("doc_id", F.explode(temporal.dates_udf("text")).alias("d")).select("doc_id", "d.*")


QUERIES = {f.__name__: f for f in (simhashes, fuzzy_expansions, temporal_expressions)}

#: DuckDB measures edit distance in bytes and has no Unicode sentence rules; the tests hold these queries
#: against brute force instead.
ORACLE_SQL: dict[str, str] = {}

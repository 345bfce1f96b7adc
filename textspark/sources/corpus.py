"""Corpora as tables: constructors, validation, upsert, snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textspark.functions import text as T
from textspark.operators.lexical import corpus_term_stats


def from_texts(spark: SparkSession, texts: Sequence[str]) -> DataFrame:
    """(id, text) with ids doc-0, doc-1, ... of a driver's list."""
    return spark.createDataFrame([(f"doc-{i}", t) for i, t in enumerate(texts)], "id string, text string")


def validated(docs: DataFrame, id_col: str = "id") -> DataFrame:
    """docs, raising when read if an id is blank or borne by several rows; violations() finds the latter."""
    kind = docs.schema[id_col].dataType
    own = Window.partitionBy(id_col)
    rows = docs.withColumn("_rows", F.count(F.lit(1)).over(own))
    blank = F.col(id_col).isNull() | (F.trim(F.col(id_col).cast("string")) == "")
    fail = lambda why: F.raise_error(F.lit(why)).cast(kind)
    checked = F.when(blank, fail("a document id is blank")).when(F.col("_rows") > 1, fail("a document id is not unique")).otherwise(F.col(id_col))
    return rows.withColumn(id_col, checked).drop("_rows")


def violations(docs: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, n) of ids that several rows bear."""
    return docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def from_segments(segments: DataFrame) -> DataFrame:
    """Documents of timed segments: id stream:index (or the index), seconds as metadata."""
    seconds = lambda c: F.col(c).cast("string")
    meta = F.map_filter(F.create_map(F.lit("timestamp_seconds"), seconds("start_seconds"), F.lit("duration_seconds"), (F.col("end_seconds") - F.col("start_seconds")).cast("string")), lambda k, v: v.isNotNull())
    return segments.select(F.concat_ws(":", F.col("stream_id").cast("string"), F.col("segment_index").cast("string")).alias("id"), "text", meta.alias("metadata"))


def upsert(docs: DataFrame, changes: DataFrame, id_col: str = "id") -> DataFrame:
    """docs with changes' rows added or in place of those with their ids."""
    return docs.join(changes.select(id_col), id_col, "left_anti").unionByName(changes)


def added(docs: DataFrame, new: DataFrame, id_col: str = "id") -> DataFrame:
    """docs and new rows; raises if one's id is there already."""
    if new.join(docs, id_col, "left_semi").limit(1).count():
        raise ValueError("a document with that id is there already")
    return docs.unionByName(new)


def replaced(docs: DataFrame, changes: DataFrame, id_col: str = "id") -> DataFrame:
    """docs with changes' rows in place of those with their ids; raises if one is missing."""
    if changes.join(docs, id_col, "left_anti").limit(1).count():
        raise ValueError("a document to replace is not there")
    return upsert(docs, changes, id_col)


def removed(docs: DataFrame, ids: DataFrame, id_col: str = "id", strict: bool = False) -> DataFrame:
    """docs without those ids; with ``strict`` a missing one raises."""
    if strict and ids.join(docs, id_col, "left_anti").limit(1).count():
        raise ValueError("a document to remove is not there")
    return docs.join(ids.select(id_col), id_col, "left_anti")


def by_id(docs: DataFrame, value: str, id_col: str = "id") -> DataFrame:
    return docs.filter(F.col(id_col) == value)


def document_count(docs: DataFrame, term: str, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """One row: in how many documents a normalized term stands."""
    return docs.agg(F.count_if(F.array_contains(T.words_array(text_col), term)).alias("n"))


def is_empty(docs: DataFrame) -> bool:
    return docs.isEmpty()


def save_snapshot(docs: DataFrame, path: str, id_col: str = "id", text_col: str = "text") -> None:
    """Documents and their term statistics, as two tables under path."""
    docs.write.parquet(f"{path}/documents")
    corpus_term_stats(docs, id_col, text_col).write.parquet(f"{path}/terms")


def load_snapshot(spark: SparkSession, path: str, id_col: str = "id", text_col: str = "text", check: bool = True) -> DataFrame:
    """A snapshot's documents; raises if its statistics are not theirs."""
    docs = spark.read.parquet(f"{path}/documents")
    if check:
        columns = ["term", "collection_count", "document_count"]
        stored, own = spark.read.parquet(f"{path}/terms").select(*columns), corpus_term_stats(docs, id_col, text_col).select(*columns)
        if stored.exceptAll(own).limit(1).count() or own.exceptAll(stored).limit(1).count():
            raise ValueError("the snapshot's statistics do not fit its documents")
    return docs


def inspect(docs: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: documents, chunks, vectors."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return count(docs, "documents").join(F.broadcast(count(chunks, "chunks"))).join(F.broadcast(count(vectors, "vectors")))

"""Annotation layers: containment joins, entities from imported pieces, answer spans, citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textspark.operators.lexical import ranked


def contained_in(inner: DataFrame, outer: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """inner's rows with ``outer_id``, the first outer span (ids rise with the start) that holds theirs; null if
    none does. Spans are columns start and end; the join is on the document, with the range as its residue."""
    spans = outer.select(F.col(id_col).alias("_d"), F.col("id").alias("_o"), F.col("start").alias("_a"), F.col("end").alias("_b"))
    holds = (F.col(id_col) == F.col("_d")) & (F.col("start") >= F.col("_a")) & (F.col("end") <= F.col("_b"))
    columns = inner.columns
    return inner.join(spans, holds, "left").groupBy(*columns).agg(F.min("_o").alias("outer_id"))


def overlapping(left: DataFrame, right: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """left's rows with the first right span by (start, end) that overlaps theirs (``right_start``, ``right_end``)."""
    spans = right.select(F.col(id_col).alias("_d"), F.col("start").alias("right_start"), F.col("end").alias("right_end"))
    meets = (F.col(id_col) == F.col("_d")) & (F.col("start") < F.col("right_end")) & (F.col("right_start") < F.col("end"))
    pairs = left.join(spans, meets).drop("_d")
    first = F.row_number().over(Window.partitionBy(*left.columns).orderBy("right_start", "right_end"))
    return pairs.withColumn("_r", first).filter("_r = 1").drop("_r")


def decode_entities(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, entity_type, start, end, confidence) from BIO-labelled pieces (pos, label, start, end, score): a B, a
    change of type or a gap opens an entity; confidence is the mean score."""
    order = Window.partitionBy(id_col).orderBy("pos")
    rows = pieces.withColumns({"_type": F.regexp_replace("label", "^[BI]-", ""), "_in": F.col("label") != "O"})
    fresh = F.startswith("label", F.lit("B-")) | ~F.coalesce(F.lag("_in").over(order), F.lit(False)) | (F.coalesce(F.lag("_type").over(order), F.lit("")) != F.col("_type"))
    rows = rows.withColumn("_n", F.sum((F.col("_in") & fresh).cast("int")).over(order)).filter("_in")
    return rows.groupBy(id_col, "_n", F.col("_type").alias("entity_type")).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.avg("score").alias("confidence")).drop("_n")


def canonical_entities(mentions: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, entity_type, name, aliases, n): mentions grouped by type and lower-cased text; the first is the name."""
    groups = mentions.groupBy(id_col, "entity_type", F.lower("text").alias("_k"))
    return groups.agg(F.min_by("text", "start").alias("name"), F.array_sort(F.collect_set("text")).alias("aliases"), F.count(F.lit(1)).alias("n")).drop("_k")


def answer_spans(logits: DataFrame, k: int = 3, longest: int = 30, id_col: str = "question_id") -> DataFrame:
    """(id, first, last, score, rank) from per-token start and end logits (pos, start_logit, end_logit, in_context):
    the product of both softmaxes, spans of at most ``longest`` context tokens."""
    whole = Window.partitionBy(id_col)
    soft = lambda c: F.exp(F.col(c) - F.max(c).over(whole))
    rows = logits.withColumns({"_s": soft("start_logit"), "_e": soft("end_logit")})
    rows = rows.withColumns({"_s": F.col("_s") / F.sum("_s").over(whole), "_e": F.col("_e") / F.sum("_e").over(whole)}).filter("in_context")
    a = rows.select(id_col, F.col("pos").alias("first"), "_s")
    b = rows.select(id_col, F.col("pos").alias("last"), "_e")
    spans = a.join(b, id_col).filter((F.col("last") >= F.col("first")) & (F.col("last") < F.col("first") + longest))
    scored = spans.select(id_col, "first", "last", (F.col("_s") * F.col("_e")).alias("score"))
    return ranked(scored, [id_col], [F.desc("score"), F.asc("first"), F.asc("last")], max(1, k))


def citations(answers: DataFrame, chunks: DataFrame, id_col: str = "question_id") -> DataFrame:
    """(id, chunk_id): the retrieved chunks (id, rank, chunk_id, text) that hold the answer, else the first one."""
    both = answers.select(id_col, "answer").join(chunks, id_col).withColumn("_holds", F.contains("text", F.col("answer")))
    any_holds = F.max(F.col("_holds").cast("int")).over(Window.partitionBy(id_col)) == 1
    first = F.row_number().over(Window.partitionBy(id_col).orderBy("rank")) == 1
    return both.withColumns({"_any": any_holds, "_first": first}).filter(F.when(F.col("_any"), F.col("_holds")).otherwise(F.col("_first"))).select(id_col, "chunk_id")

"""Questions answered from imported spans, over given contexts or what an index retrieves. No model runs here."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textspark.operators import index
from textspark.operators.annotations import citations
from textspark.operators.predictions import MissingModel

SPAN_ATTRIBUTES = ("byte_start", "byte_end", "char_start", "char_end")


def imported_answers(questions: DataFrame, predictions: DataFrame | None, k: int = 3) -> DataFrame:
    """(question_id, answer, score, byte_start, byte_end, char_start, char_end, rank) from predictions (question_id, seq,
    text, score, attributes): those with a text, by score, then as they came. Blank questions or contexts raise."""
    if predictions is None:
        raise MissingModel("answers need imported predictions")
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    asked = questions.select(F.when(blank("question") | blank("context"), F.raise_error(F.lit("a question or its context is blank")).cast(questions.schema["question_id"].dataType)).otherwise(F.col("question_id")).alias("question_id"))
    rows = predictions.filter(F.col("text").isNotNull()).join(asked, "question_id", "left_semi")
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), F.asc("seq"))
    spans = [F.col("attributes")[a].try_cast("bigint").alias(a) for a in SPAN_ATTRIBUTES]
    placed = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max(1, k))
    return placed.select("question_id", F.col("text").alias("answer"), "score", *spans, "rank")


def answered_batch(questions: DataFrame, predictions: DataFrame, k: int = 1) -> DataFrame:
    """(question_id, status, error, answer, score): each question's best answer, or why it has none; no row raises."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    error = F.when(blank("question"), F.lit("question is blank")).when(blank("context"), F.lit("context is blank"))
    rows = questions.select("question_id", error.alias("_e"), "question", "context")
    best = imported_answers(rows.filter("_e IS NULL"), predictions, k).select("question_id", "answer", "score", "rank")
    both = rows.join(best, "question_id", "left").withColumn("error", F.when(F.col("_e").isNotNull(), F.col("_e")).when(F.col("answer").isNull(), F.lit("no imported prediction")))
    return both.select("question_id", F.when(F.col("error").isNull(), F.lit("ok")).otherwise(F.lit("error")).alias("status"), "error", "answer", "score")


def retrieved(chunks: DataFrame, questions: DataFrame, k: int = 5) -> DataFrame:
    """(question_id, chunk_id, document_id, snippet, text, score, rank): the chunks that a lexical search of an index
    finds for each question."""
    hits = index.index_search(chunks, questions.select(F.col("question_id").alias("query_id"), F.col("question").alias("query")), index.IndexQuery.lexical(max(1, k)))
    return hits.select(F.col("query_id").alias("question_id"), "chunk_id", "document_id", "snippet", "score", "rank").join(chunks.select("chunk_id", "text"), "chunk_id")


def contexts(found: DataFrame) -> DataFrame:
    """(question_id, context): a question's retrieved chunks by rank, blank lines between them; k chunks at most."""
    parts = F.array_sort(F.collect_list(F.struct("rank", "text")))
    return found.groupBy("question_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n").alias("context"))


def answer_with_index(chunks: DataFrame, questions: DataFrame, predictions: DataFrame | None, k_chunks: int = 5, k: int = 3) -> DataFrame:
    """(question_id, answer, score, rank, chunk_id, document_id): imported answers over what an index retrieves, each
    with the chunks whose snippet or text holds it, else the first. Questions that retrieve nothing have no row."""
    found = retrieved(chunks, questions, k_chunks)
    asked = questions.join(contexts(found), "question_id")
    answers = imported_answers(asked, predictions, k)
    keyed = answers.withColumn("_a", F.struct("question_id", "rank"))
    held = found.select("question_id", F.col("rank").alias("chunk_rank"), "chunk_id", "document_id", F.concat_ws("\n", "snippet", "text").alias("text"))
    pairs = keyed.select("_a", "question_id").join(held, "question_id").drop("question_id").withColumnRenamed("chunk_rank", "rank")
    cited = citations(keyed.select("_a", F.trim("answer").alias("answer")), pairs, "_a")
    return keyed.join(cited, "_a").join(held.select("chunk_id", "document_id").distinct(), "chunk_id").select("question_id", "answer", "score", "rank", "chunk_id", "document_id")


def answer_with_retrieval(chunks: DataFrame | None, questions: DataFrame, predictions: DataFrame | None, k_chunks: int = 5, k: int = 3) -> DataFrame:
    """answer_with_index on a retrieval index's chunks; raw documents have to be chunked first, None raises."""
    if chunks is None or "chunk_id" not in chunks.columns:
        raise ValueError("answers from retrieval need an index's chunks, not documents")
    return answer_with_index(chunks, questions, predictions, k_chunks, k)

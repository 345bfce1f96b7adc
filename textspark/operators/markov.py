"""Markov chains of order n over token sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textspark.functions import text as T
from textspark.operators.lexical import ranked, windows_of
from textspark.sources.scratch import cut


def transitions(docs: DataFrame, order: int = 2, text_col: str = "text") -> DataFrame:
    """(context, next, n): counts of each token after ``order`` tokens, the context joined by spaces."""
    grams = docs.select(T.words_array(text_col).alias("w")).select(F.explode(windows_of(F.col("w"), order + 1)).alias("g"))
    parts = grams.select(F.array_join(F.slice("g", 1, order), " ").alias("context"), F.element_at("g", order + 1).alias("next"))
    return parts.groupBy("context", "next").agg(F.count(F.lit(1)).alias("n"))


def starts(docs: DataFrame, order: int = 2, text_col: str = "text") -> DataFrame:
    """(context, n): counts of the texts' first contexts."""
    words = T.words_array(text_col)
    rows = docs.select(words.alias("w")).filter(F.size("w") > order)
    return rows.groupBy(F.array_join(F.slice("w", 1, order), " ").alias("context")).agg(F.count(F.lit(1)).alias("n"))


def counters(chain: DataFrame) -> DataFrame:
    """One row: transitions counted in all, and different contexts."""
    return chain.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("transitions"), F.count_distinct("context").alias("contexts"))


def predict(chain: DataFrame, k: int = 1) -> DataFrame:
    """The k likeliest next tokens of every context, with their probability; ties to the smaller token."""
    p = F.col("n") / F.sum("n").over(Window.partitionBy("context"))
    return ranked(chain.withColumn("probability", p), ["context"], [F.desc("n"), F.asc("next")], k)


def perplexity(docs: DataFrame, chain: DataFrame, order: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, perplexity) of texts of more than ``order`` tokens; infinite after an unseen transition."""
    total = F.sum("n").over(Window.partitionBy("context"))
    known = chain.withColumn("p", F.col("n") / total).select("context", "next", "p")
    rows = docs.select(F.col(id_col), T.words_array(text_col).alias("w"))
    grams = rows.select(id_col, F.explode(windows_of(F.col("w"), order + 1)).alias("g"))
    asked = grams.select(id_col, F.array_join(F.slice("g", 1, order), " ").alias("context"), F.element_at("g", order + 1).alias("next"))
    both = asked.join(known, ["context", "next"], "left")
    unseen = F.count_if(F.col("p").isNull())
    value = F.when(unseen > 0, F.lit(float("inf"))).otherwise(F.exp(-F.avg(F.log("p"))))
    return both.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"), value.alias("perplexity"))


def completed_seed(begin: DataFrame, seed: str, order: int = 2) -> str | None:
    """The most frequent start context that begins with the seed's tokens (ties to the smaller), for a seed shorter than
    ``order``; the last ``order`` tokens of a longer one; null if no start fits."""
    words = seed.lower().split()
    if len(words) >= order:
        return " ".join(words)
    fits = begin if not words else begin.filter((F.col("context") == " ".join(words)) | F.startswith("context", F.lit(" ".join(words) + " ")))
    row = fits.orderBy(F.desc("n"), F.asc("context")).select("context").first()
    return row.context if row else None


def generate(chain: DataFrame, seed: str, most: int = 50, order: int = 2) -> list[str]:
    """The argmax walk from a seed, to ``most`` tokens or a dead end. The best successors are written once; each step
    reads one row of them."""
    best = cut(predict(chain, 1).select("context", "next").repartitionByRange("context").sortWithinPartitions("context"), "successors")
    words = seed.split(" ")
    while len(words) < most:
        row = best.filter(F.col("context") == " ".join(words[-order:])).select("next").first()
        if row is None:
            break
        words.append(row.next)
    return words

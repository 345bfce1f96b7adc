"""Conversation dynamics over turns that carry a concept (cluster), a speaker and a sequence number.

Everything is a window or an aggregation within one conversation; concepts are whatever clustering gave."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _order(by: Sequence[str], seq: str) -> Window:
    return Window.partitionBy(*by).orderBy(seq)


def threads(turns: DataFrame, by: str = "conv_id", seq: str = "turn", cluster: str = "concept") -> DataFrame:
    """(by, cluster, segments, re_entries, units): maximal runs of adjacent turns of one concept."""
    place = F.row_number().over(_order([by], seq))
    rows = turns.withColumn("_p", place).withColumn("_island", F.col("_p") - F.row_number().over(Window.partitionBy(by, cluster).orderBy("_p")))
    return rows.groupBy(by, cluster).agg(
        F.count_distinct("_island").alias("segments"), (F.count_distinct("_island") - 1).alias("re_entries"), F.count(F.lit(1)).alias("units")
    )


def introductions(turns: DataFrame, by: str = "conv_id", seq: str = "turn", cluster: str = "concept", speaker: str = "role") -> DataFrame:
    """The first turn of each concept that names a speaker."""
    named = turns.filter(F.col(speaker).isNotNull())
    first = F.min(F.struct(seq, speaker)).alias("_f")
    return named.groupBy(by, cluster).agg(first).select(by, cluster, F.col(f"_f.{seq}").alias("introduced_at"), F.col(f"_f.{speaker}").alias("introduced_by"))


def adoptions(turns: DataFrame, by: str = "conv_id", seq: str = "turn", cluster: str = "concept", speaker: str = "role") -> DataFrame:
    """Each other speaker's first use of a concept after its introduction."""
    first = introductions(turns, by, seq, cluster, speaker)
    later = turns.join(first, [by, cluster]).filter((F.col(speaker) != F.col("introduced_by")) & (F.col(seq) > F.col("introduced_at")))
    return later.groupBy(by, cluster, speaker).agg(F.min(seq).alias("adopted_at"))


def hand_offs(turns: DataFrame, by: str = "conv_id", seq: str = "turn", cluster: str = "concept", speaker: str = "role") -> DataFrame:
    """Adjacent turns that change both speaker and concept."""
    order = _order([by], seq)
    rows = turns.withColumns({"from_speaker": F.lag(speaker).over(order), "from_concept": F.lag(cluster).over(order)})
    rows = rows.filter((F.col("from_speaker") != F.col(speaker)) & (F.col("from_concept") != F.col(cluster)))
    return rows.select(by, seq, "from_speaker", F.col(speaker).alias("to_speaker"), "from_concept", F.col(cluster).alias("to_concept"))


def recurring(turns: DataFrame, by: str = "conv_id", seq: str = "turn", cluster: str = "concept") -> DataFrame:
    """Concepts of two turns or more, and how often they come back after a pause."""
    gap = F.col(seq) - F.lag(seq).over(_order([by, cluster], seq))
    rows = turns.withColumn("_gap", gap)
    return rows.groupBy(by, cluster).agg(F.count(F.lit(1)).alias("occurrences"), F.count_if(F.col("_gap") > 1).alias("returns")).filter("occurrences >= 2")


def interleavings(turns: DataFrame, by: str = "conv_id", seq: str = "turn", cluster: str = "concept") -> DataFrame:
    """(by, a, b, n): how often concepts alternate as A, B, A."""
    order = _order([by], seq)
    rows = turns.withColumns({"_1": F.lag(cluster, 1).over(order), "_2": F.lag(cluster, 2).over(order)})
    rows = rows.filter((F.col("_2") == F.col(cluster)) & (F.col("_1") != F.col(cluster)))
    return rows.groupBy(by, F.least("_1", cluster).alias("a"), F.greatest("_1", cluster).alias("b")).agg(F.count(F.lit(1)).alias("n"))


def speaker_shares(turns: DataFrame, speaker: str = "role", cluster: str = "concept") -> DataFrame:
    """(speaker, cluster, units, share of the speaker's units)."""
    counts = turns.groupBy(speaker, cluster).agg(F.count(F.lit(1)).alias("units"))
    return counts.withColumn("share", F.col("units") / F.sum("units").over(Window.partitionBy(speaker)))


def hotspots(timeline: DataFrame, by: str = "conv_id", seq: str = "turn", cluster: str = "concept", activation: str = "activation") -> DataFrame:
    """(by, cluster, coverage, persistence, mean_activation, peak): peak is the earliest turn of most activation."""
    n = F.count(F.lit(1)).over(Window.partitionBy(by))
    rows = timeline.withColumns({"_n": n, "_p": F.row_number().over(_order([by], seq))})
    return rows.groupBy(by, cluster).agg(
        (F.count(F.lit(1)) / F.first("_n")).alias("coverage"),
        ((F.max("_p") - F.min("_p") + 1) / F.first("_n")).alias("persistence"),
        F.avg(activation).alias("mean_activation"),
        F.max(F.struct(F.col(activation), (-F.col(seq)).alias("_s"))).alias("_best"),
    ).withColumn("peak", -F.col("_best._s")).drop("_best")


def speaker_pairs(turns: DataFrame, similarity: str, by: str = "conv_id", seq: str = "turn", speaker: str = "role") -> DataFrame:
    """For unordered pairs of speakers of adjacent turns: count, mean, first, last and change of similarity, a
    column that compares a turn with the one before."""
    before = F.lag(speaker).over(_order([by], seq))
    rows = turns.withColumn("_before", before).filter(F.col("_before") != F.col(speaker))
    pair = rows.groupBy(by, F.least("_before", speaker).alias("a"), F.greatest("_before", speaker).alias("b"))
    return pair.agg(
        F.count(F.lit(1)).alias("n"), F.avg(similarity).alias("mean"), F.min_by(similarity, seq).alias("first"), F.max_by(similarity, seq).alias("last")
    ).withColumn("delta", F.col("last") - F.col("first"))

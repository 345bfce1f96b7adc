"""Exact deduplication by a tree-merge of sorted digest runs.

Ids are dealt to ``runs`` runs by a stable hash. In each run the digests are sorted and merged
(``max``/``min`` over a struct makes Spark plan Sort + SortAggregate, partial before the exchange and
final after it), leaving one entry per digest: the surviving id, how many rows bear that id, and how
many rows the run saw. Runs then merge ``fan_in`` at a time, round after round, until one is left. A
digest is never trusted alone: every level groups by SHA-256, byte length and an independent 64-bit
hash together, so entries merge only when all three agree.

A round shuffles one small entry per (run, digest), so a text that a third of all rows share costs at
most one entry per run after the first round. Rows and texts are never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textspark.llm.common import own, text_or_empty, unused

KEY = ("_sha", "_len", "_check")


def _fingerprints(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    text = text_or_empty(text_col)
    return docs.select(
        own(id_col).alias("_id"),
        F.unhex(F.sha2(text, 256)).alias("_sha"),
        F.octet_length(text).alias("_len"),
        F.xxhash64(text).alias("_check"),
        *more,
    )


def digest_representatives(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", runs: int = 64, fan_in: int = 8
) -> DataFrame:
    """One row per distinct text: its key columns, ``keep_id``, ``keep_rows`` and ``group_size``. Nulls, empty and long
    texts, ties, repeated rows and empty tables are as in exact_dedup."""
    if keep not in ("largest", "smallest") or runs < 1 or fan_in < 2:
        raise ValueError("keep is largest or smallest, runs at least 1, fan_in at least 2")
    best, rank = (F.max, F.col("_id").isNotNull()) if keep == "largest" else (F.min, F.col("_id").isNull())  # nulls lose
    prints = _fingerprints(docs, id_col, text_col)
    level = (
        prints.groupBy(F.pmod(F.xxhash64("_id"), F.lit(runs)).cast("int").alias("_run"), *KEY, "_id")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_run", *KEY, F.struct(rank.alias("_rank"), "_id", "_rows").alias("_entry"), F.col("_rows").alias("_size"))
    )
    level = level.groupBy("_run", *KEY).agg(best("_entry").alias("_entry"), F.sum("_size").alias("_size"))
    left = runs
    while left > 1:
        left = -(-left // fan_in)
        level = (
            level.withColumn("_run", F.floor(F.col("_run") / fan_in).cast("int"))
            .groupBy("_run", *KEY)
            .agg(best("_entry").alias("_entry"), F.sum("_size").alias("_size"))
        )
    return level.select(*KEY, F.col("_entry._id").alias("keep_id"), F.col("_entry._rows").alias("keep_rows"), F.col("_size").alias("group_size"))


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", runs: int = 64, fan_in: int = 8
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as the empty text, so null and empty rows form one
    group. Of a group the row with the largest (or smallest) id stays; a null id stays only if its
    whole group has none (then ``keep_id`` is null and all of its rows are kept). Rows that repeat both
    id and text count in ``group_size`` and get the same answer each; there are no other ties. Texts of any
    length are hashed whole. An empty table gives an empty result with the same columns; other columns of
    the input, whatever their names, are not looked at.
    """
    reps = digest_representatives(docs, id_col, text_col, keep, runs, fan_in)
    prints = _fingerprints(docs, id_col, text_col)
    return prints.join(reps, list(KEY)).select(
        F.col("_id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """The rows of docs that stay, all columns unchanged. Of rows that repeat id and text one stays.

    Null and empty texts are one group, of which one row stays; a group without an id keeps one row. Long
    texts are compared whole, by digest and length. An empty table gives an empty one. Columns may have any names."""
    names = unused(docs.columns, *("_dd" + k for k in KEY), *("_keep" + k for k in KEY), "_keep_id", "_keep_rows")
    mine, theirs, keep_id, keep_rows = names[:3], names[3:6], names[6], names[7]
    reps = digest_representatives(docs, id_col, text_col, keep).select(
        *(F.col(k).alias(n) for k, n in zip(KEY, theirs, strict=True)), F.col("keep_id").alias(keep_id), F.col("keep_rows").alias(keep_rows)
    )
    columns = [own(c) for c in docs.columns]
    text = text_or_empty(text_col)
    prints = (F.unhex(F.sha2(text, 256)), F.octet_length(text), F.xxhash64(text))
    marked = docs.select(*columns, *(p.alias(n) for p, n in zip(prints, mine, strict=True)))
    same = [F.col(a) == F.col(b) for a, b in zip(mine, theirs, strict=True)]
    stays = marked.join(reps, same[0] & same[1] & same[2] & own(id_col).eqNullSafe(F.col(keep_id)))
    single = stays.filter(F.col(keep_rows) == 1).select(*columns)
    repeated = stays.filter(F.col(keep_rows) > 1).dropDuplicates(mine).select(*columns)
    return single.unionByName(repeated)

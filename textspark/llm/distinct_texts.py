"""One row for each distinct text, so that copies of a text are worked on once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textspark.llm.common import cut, text_or_empty

#: Two independent 64-bit hashes, together the key of a text.
KEY = ("_k1", "_k2")
#: The table of copied texts is broadcast up to this many rows (24 bytes each), else joined by shuffle.
MOST_BROADCAST = 500_000


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, _text (null as empty) and KEY of each row."""
    text = text_or_empty(text_col)
    return docs.select(F.col(id_col).alias("_id"), text.alias("_text"), F.xxhash64(text).alias("_k1"), F.xxhash64(F.concat(F.lit("#"), text)).alias("_k2"))


def copied_texts(rows: DataFrame) -> DataFrame:
    """KEY, _rep (the smallest id) and _rows of the texts that several rows hold."""
    return cut(rows.groupBy(*KEY).agg(F.min("_id").alias("_rep"), F.count(F.lit(1)).alias("_rows")).filter("_rows > 1"), "copied")


def representatives(rows: DataFrame, copied: DataFrame) -> DataFrame:
    """The rows of keyed() that stand for their text: those of a copied text's smallest id, and all others."""
    small = copied.select(*KEY, F.col("_rep"), F.lit(True).alias("_is_copied"))
    if copied.count() <= MOST_BROADCAST:
        small = F.broadcast(small)
    joined = rows.join(small, list(KEY), "left")
    return joined.filter(F.col("_is_copied").isNull() | F.col("_id").eqNullSafe(F.col("_rep"))).select("_id", "_text", *KEY)

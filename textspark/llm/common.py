"""Helpers that several training-data operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textspark.sources.scratch import cut, scratch_path

__all__ = ["WORD", "cut", "own", "scratch_path", "table", "text_or_empty", "unused"]

#: A word is a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def text_or_empty(text: str) -> Column:
    return F.coalesce(own(text), F.lit(""))


def own(name: str) -> Column:
    """The column of that name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(columns: Sequence[str], *names: str) -> list[str]:
    """names, each with underscores put behind it until no column is called so."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
        taken.add(name.lower())
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

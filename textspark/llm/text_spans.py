"""Match positions with built-in functions alone.

Spark has no function that returns where all matches of a pattern lie. ``split`` gives the pieces
between them and ``regexp_extract_all`` the matches themselves; running sums of both lengths are the
positions, in code points. Patterns must not match the empty string.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:bigint,end:bigint,match:string>>"


def located(text: Column, matches: Column, pattern: str | Column) -> Column:
    """Array of (start, end, match) for ``matches``, the array of all matches of pattern in text."""
    pairs = F.arrays_zip(matches.alias("m"), F.split(text, pattern, -1).alias("p"))
    step = lambda acc, x: F.struct(
        F.array_append(
            acc["out"],
            F.struct(
                (acc["at"] + F.char_length(x["p"])).alias("start"),
                (acc["at"] + F.char_length(x["p"]) + F.char_length(x["m"])).alias("end"),
                x["m"].alias("match"),
            ),
        ).alias("out"),
        (acc["at"] + F.char_length(x["p"]) + F.char_length(x["m"])).alias("at"),
    )
    zero = F.struct(F.array().cast(SPAN).alias("out"), F.lit(0).cast("bigint").alias("at"))
    found = F.aggregate(F.slice(pairs, F.lit(1), F.size(matches)), zero, step, lambda acc: acc["out"])
    return F.when(F.size(matches) > 0, found).otherwise(F.array().cast(SPAN))


def joined(kinds: Sequence[tuple[str, Column]]) -> Column:
    """All spans as one array of (start, rank, end, kind), sorted by start, then kind as listed."""

    def tagged(rank: int, name: str, spans: Column) -> Column:
        return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(name).alias("kind")))

    return F.array_sort(F.concat(*(tagged(rank, name, spans) for rank, (name, spans) in enumerate(kinds))))


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

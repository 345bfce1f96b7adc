"""Token, normalization and text-statistics expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textspark.functions import patterns as P


def token_array(text: Column | str) -> Column:
    """All tokens of a text in order (punctuation is not emitted)."""
    return F.regexp_extract_all(text, F.lit(f"(?U){P.TOKEN}"), F.lit(0))


def words_array(text: Column | str) -> Column:
    """Normalized tokens: lower case."""
    return F.transform(token_array(text), F.lower)


def token_kind(token: Column) -> Column:
    """Kind of a token, by the first pattern that matches it whole."""
    kind = F.lit("other")
    for name, pattern in reversed(P.TOKEN_KINDS.items()):
        kind = F.when(F.rlike(token, F.lit(f"(?U)^(?:{pattern})$")), F.lit(name)).otherwise(kind)
    return kind


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, token, term) of every token; term is its normalized form."""
    return docs.select(F.col(id_col), F.posexplode(token_array(text_col)).alias("pos", "token")).withColumn("term", F.lower("token"))


def collapse_whitespace(text: Column | str) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def strip(text: Column | str) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def drop_non_ascii(text: Column | str) -> Column:
    return F.regexp_replace(text, r"[^\x00-\x7F]", "")


def line_count(text: Column) -> Column:
    """Lines, a trailing line end opening no further one."""
    ends = F.length(text) - F.length(F.replace(text, F.lit("\n")))
    return F.when(F.length(text) == 0, 0).otherwise(ends + F.when(F.endswith(text, F.lit("\n")), 0).otherwise(1)).cast("bigint")


def stem(term: Column) -> Column:
    """English suffix stemming; lengths are in bytes."""
    word = F.lower(term)
    out = word
    for suffix, ending in reversed(P.STEM_SUFFIXES.items()):
        cut = F.concat(F.left(word, F.length(word) - len(suffix)), F.lit(ending))
        out = F.when(F.endswith(word, F.lit(suffix)) & (F.octet_length(word) > len(suffix) + 2), cut).otherwise(out)
    single = F.when(F.rlike(out, F.lit("(nn|tt|pp)$")), F.left(out, F.length(out) - 1)).otherwise(out)
    return F.when(F.octet_length(word) <= 3, word).otherwise(single)


def script_counts(text: Column) -> dict[str, Column]:
    """Characters of each script; digits, punctuation and white space belong to none."""
    plain = F.regexp_replace(text, r"(?U)[\s\p{N}!-/:-@\[-`{-~…。！？]", "")
    return {name: (F.length(plain) - F.length(F.regexp_replace(plain, f"[{span}]", ""))).cast("bigint") for name, span in P.SCRIPTS.items()}


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value evaluated once, however often it stands there."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def held(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with the columns, each evaluated once a row however often later expressions refer to it."""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


#: Other scripts' letters count as Other.
def script_profile(text: Column | str) -> Column:
    """struct(counts, dominant, is_mixed): characters by script and Other, the largest (the first by name of equal
    ones, null without any), and whether more than one occurs.

    Each script's characters are taken out of what the ones before it left, ASCII letters first, so that a text is
    read about twice."""
    c = F.col(text) if isinstance(text, str) else text
    row = lambda name, n: F.struct(F.lit(name).alias("script"), n.cast("bigint").alias("n"))

    def taken(left: Column, scripts: list[tuple[str, str]], rows: list[Column]) -> Column:
        if not scripts:
            return profile(F.array(*rows, row("Other", F.length(left))))
        (name, span), *rest = scripts
        return bound(F.regexp_replace(left, f"[{span}]+", ""), lambda x: taken(x, rest, [*rows, row(name, F.length(left) - F.length(x))]))

    def profile(rows: Column) -> Column:
        best = lambda x, y: F.when((y["n"] > x["n"]) | ((y["n"] == x["n"]) & (y["script"] < x["script"])), y).otherwise(x)
        return bound(F.array_sort(F.filter(rows, lambda x: x["n"] > 0)), lambda seen: F.struct(
            F.map_from_arrays(F.transform(seen, lambda x: x["script"]), F.transform(seen, lambda x: x["n"])).alias("counts"),
            F.reduce(seen, F.get(seen, F.lit(0)), best)["script"].alias("dominant"), (F.size(seen) > 1).alias("is_mixed"),
        ))

    def after_ascii(unlettered: Column) -> Column:
        beyond = F.regexp_replace(unlettered, r"[\x09-\x0D\x20-\x7E]+", "")
        plain = F.regexp_replace(beyond, r"(?U)[\s\p{N}…。！？]+", "")
        (latin, span), *rest = P.SCRIPTS.items()
        n = F.length(c) - F.length(unlettered)
        return bound(plain, lambda x: bound(F.regexp_replace(x, f"[{span}]+", ""), lambda y: taken(y, rest, [row(latin, n + F.length(x) - F.length(y))])))

    return bound(F.regexp_replace(c, "[A-Za-z]+", ""), after_ascii)


#: A paragraph: from its first character that is no white space through the lines that have one.
PARAGRAPH = r"\S[^\n]*(?:\n[^\S\n]*\S[^\n]*)*"


def paragraph_array(text: Column | str) -> Column:
    return F.transform(F.regexp_extract_all(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit(PARAGRAPH), F.lit(0)), strip)


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ordinal, paragraph) of the runs of non-blank lines, trimmed."""
    return docs.select(F.col(id_col), F.posexplode(paragraph_array(text_col)).alias("ordinal", "paragraph"))


def paragraph_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ordinal, start, end) of paragraphs in code points, from the first to the last character that is no white
    space. Lines may end in CR LF."""
    text = F.coalesce(text_col, F.lit(""))
    pattern = r"\S[^\n]*(?:\n[^\S\n]*\S[^\n]*)*"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    rows = docs.select(F.col(id_col), F.posexplode(F.arrays_zip(found.alias("p"), F.slice(gaps, F.lit(1), F.size(found)).alias("g"), F.transform(found, F.length).alias("n"))).alias("ordinal", "x"), gaps.alias("_g"), F.transform(found, F.length).alias("_n"))
    upto = lambda c, k: F.aggregate(F.slice(c, F.lit(1), k), F.lit(0), lambda s, x: s + x)
    start = upto(F.col("_g"), F.col("ordinal") + 1) + upto(F.col("_n"), F.col("ordinal"))
    return rows.select(id_col, "ordinal", start.cast("bigint").alias("start"), (start + F.length(strip("x.p"))).cast("bigint").alias("end"))

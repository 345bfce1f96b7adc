"""Coordinates of spans: code points, UTF-8 bytes, UTF-16 units, graphemes; caseless search."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_offset(text: Column, at: Column) -> Column:
    """UTF-8 bytes before code point ``at``."""
    return F.octet_length(F.left(text, at.cast("int")))


def utf16_offset(text: Column, at: Column) -> Column:
    """UTF-16 units before code point ``at``."""
    return (F.octet_length(F.encode(F.left(text, at.cast("int")), "utf-16be")) / 2).cast("int")


def graphemes(text: Column | str) -> Column:
    """Extended grapheme clusters."""
    return F.regexp_extract_all(text, F.lit(r"\X"), F.lit(0))


def byte_slice(text: Column, start: Column, end: Column) -> Column:
    """The text between two byte offsets; null unless both lie between characters."""
    raw = F.encode(text, "utf-8")
    part = F.substring(raw, (start + 1).cast("int"), (end - start).cast("int"))
    head = F.substring(raw, F.lit(1), start.cast("int"))
    sound = (start >= 0) & (start <= end) & (end <= F.octet_length(raw)) & F.is_valid_utf8(head.cast("string")) & F.is_valid_utf8(part.cast("string"))
    return F.when(sound, part.cast("string"))


def _folded(text: Column) -> Column:
    return F.translate(F.lower(text), "ς", "σ")


def find_caseless(text: Column, needle: Column) -> Column:
    """Code point at which the first match begins regardless of case, null without one. Texts whose lower case
    has another length are compared as they are."""
    low = F.when(F.length(F.lower(text)) == F.length(text), _folded(text)).otherwise(text)
    return F.when(F.length(needle) > 0, F.nullif(F.position(_folded(needle), low), F.lit(0)) - 1)


def _caseless(texts: pd.Series, needles: pd.Series) -> pd.DataFrame:
    low = lambda c: c.lower().replace("ς", "σ")
    rows = []
    for text, needle in zip(texts, needles, strict=True):
        wanted = low(needle or "")
        pieces = [low(c) for c in text or ""]
        at = "".join(pieces).find(wanted) if wanted else -1
        if at < 0:
            rows.append((None, None, None, None))
            continue
        owner = [i for i, piece in enumerate(pieces) for _ in piece]  # the source character of each folded one
        start, end = owner[at], owner[at + len(wanted) - 1] + 1
        before = len(text[:start].encode())
        rows.append((start, end, before, before + len(text[start:end].encode())))
    return pd.DataFrame(rows, columns=["start", "end", "byte_start", "byte_end"]).astype("Int64")


def find_caseless_span(text: Column, needle: Column) -> Column:
    """struct(start, end, byte_start, byte_end) of the first match regardless of case in the source text, null without
    one. Characters are folded one by one, and a match takes in whole source characters, also where the lower
    case of one is several."""
    return F.pandas_udf(_caseless, "start bigint, end bigint, byte_start bigint, byte_end bigint")(text, needle)


# Letters whose capital is one character although their full upper case is several.
_SMALL = "ß" + "".join(map(chr, (*range(0x1F80, 0x1F88), *range(0x1F90, 0x1F98), *range(0x1FA0, 0x1FA8), 0x1FB3, 0x1FC3, 0x1FF3)))
_CAPITAL = "ẞ" + "".join(c.title() for c in _SMALL[1:])


def softened(text: Column | str) -> Column:
    """Sentence-initial capital, the rest as it is. A capital is one character; a letter without such a one stays."""
    c = F.col(text) if isinstance(text, str) else text
    first = F.translate(F.left(c, F.lit(1)), _SMALL, _CAPITAL)
    capital = F.when(F.length(F.upper(first)) == 1, F.upper(first)).otherwise(first)
    return F.concat(capital, F.substring(c, F.lit(2), F.length(c)))

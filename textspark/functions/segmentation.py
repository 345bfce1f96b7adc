"""Arrow functions where Spark has no built-in: Unicode normalization, sentence spans, graphemes, hashes,
edit distance, historical dates. Each takes and returns whole Arrow batches."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviations that end no sentence, without their closing dot.
ABBREVIATIONS = ("mr", "mrs", "ms", "dr", "prof", "sr", "jr", "st", "vs", "etc", "e.g", "i.e", "u.s", "u.k")
# Characters that may end a sentence.
TERMINATORS = ".?!…。！？"

_END = re.compile(f"[{TERMINATORS}]")


def folded(abbreviation: str) -> str:
    """An abbreviation as it is compared: NFKC, case folded, without dots at its end."""
    return unicodedata.normalize("NFKC", abbreviation.strip().rstrip(".")).casefold()


def _abbreviated(text: str, at: int, known: frozenset[str]) -> bool:
    """Whether the run of letters and dots around the dot at ``at`` is a known abbreviation or a single capital."""
    start, end = at, at
    while start and (text[start - 1].isalpha() or text[start - 1] == "."):
        start -= 1
    while end < len(text) and (text[end].isalpha() or text[end] == "."):
        end += 1
    word = text[start:end].rstrip(".")
    return folded(word) in known or (len(word) == 1 and "A" <= word <= "Z")


def sentence_spans(text: str, abbreviations: tuple[str, ...] = ()) -> list[tuple[int, int]]:
    """Code-point spans of sentences, trimmed. A terminator ends one unless the next character is another, or
    it is a dot between digits, or of an abbreviation (built in or given) or a single capital."""
    known = frozenset(x for x in map(folded, (*ABBREVIATIONS, *abbreviations)) if x)
    spans, start = [], 0

    def add(a: int, b: int) -> None:
        piece = text[a:b]
        left = a + len(piece) - len(piece.lstrip())
        right = b - (len(piece) - len(piece.rstrip()))
        if left < right:
            spans.append((left, right))

    for found in _END.finditer(text):
        i = found.start()
        following = text[i + 1 : i + 2]
        if following and following in TERMINATORS:
            continue
        if found[0] == ".":
            before = text[i - 1 : i] if i else ""
            if before.isascii() and before.isdigit() and following.isascii() and following.isdigit():
                continue
            if _abbreviated(text, i, known):
                continue
        add(start, i + 1)
        start = i + 1
    add(start, len(text))
    return spans


def sentence_array(text: Column | str, abbreviations: tuple[str, ...] = ()) -> Column:
    """The sentences of sentence_spans as an array of texts, in the JVM: a mark is put behind every terminator that
    ends one, and the text is split there. Abbreviations are compared without NFKC here."""
    known = sorted({x for x in map(folded, (*ABBREVIATIONS, *abbreviations)) if x})
    fresh = r"(?<![\p{L}.])"
    words = "|".join(re.escape(x) for x in known)
    rules = [
        rf"(?![{TERMINATORS}])",  # the last of several
        r"(?!(?<=[0-9]\.)[0-9])",  # no decimal point
        rf"(?!(?<={fresh}(?i:{words})\.{{1,20}})(?!\p{{L}}))",  # behind an abbreviation
        rf"(?!(?<={fresh}[A-Z]\.{{1,20}})(?!\p{{L}}))",  # behind a single capital
    ]
    for x in known:  # a dot inside an abbreviation
        for k, c in enumerate(x):
            if c == ".":
                rules.append(rf"(?!(?<={fresh}(?i:{re.escape(x[:k])})\.)(?i:{re.escape(x[k + 1 :])})\.*(?![\p{{L}}.]))")
    dot = r"\." + "".join(rules)
    others = TERMINATORS.replace(".", "")
    marked = F.regexp_replace(text, rf"[{others}](?![{TERMINATORS}])|{dot}", "$0\x00")
    return F.filter(F.transform(F.split(marked, "\x00"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")


def _spans(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"start": a, "end": b} for a, b in sentence_spans(t or "")])


def sentence_spans_udf(text: Column) -> Column:
    return F.pandas_udf(_spans, "array<struct<start:int,end:int>>")(text)


def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def nfkc(text: Column | str) -> Column:
    return F.pandas_udf(_nfkc, "string")(text)


def fnv1a64(data: bytes) -> int:
    """FNV-1a with the published 64-bit offset basis and prime."""
    h = 0xCBF29CE484222325
    for byte in data:
        h = ((h ^ byte) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


_BITS = np.arange(64, dtype=np.uint64)


def simhash(features: list[str]) -> int:
    """64 signed sums over the features' hashes; a bit is set where the sum is not negative."""
    if not features:
        return 0
    hashes = np.fromiter((fnv1a64(f.encode()) for f in features), np.uint64, len(features))
    set_bits = ((hashes[:, None] >> _BITS) & np.uint64(1)).sum(0, dtype=np.int64)
    return int(((2 * set_bits >= len(features)).astype(np.uint64) << _BITS).sum(dtype=np.uint64))


def fnv1a64_all(texts: pa.Array) -> np.ndarray:
    """fnv1a64 of each text of an array without nulls, a byte of all of them at a time."""
    n = len(texts)
    _, bounds, data = texts.buffers()
    if not n:
        return np.empty(0, np.uint64)
    bounds = np.frombuffer(bounds, np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    lengths = np.diff(bounds)
    order = np.argsort(-lengths, kind="stable")
    start, left = bounds[:-1][order], np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), "left")
    octets, h = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8), np.full(n, 0xCBF29CE484222325, np.uint64)
    for i, k in enumerate(left):  # the first k texts have an i-th byte
        h[:k] = (h[:k] ^ octets[start[:k] + i]) * np.uint64(0x100000001B3)
    out = np.empty(n, np.uint64)
    out[order] = h
    return out


def bit_sums(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set in runs of hashes of the given sizes."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    out = np.zeros((len(sizes), 64), np.int64)
    held = sizes > 0
    if held.any():
        out[held] = np.add.reduceat(bits, (np.cumsum(sizes) - sizes)[held], axis=0, dtype=np.int64)
    return out


def osa_distance(a: str, b: str, limit: int) -> int:
    """Edit distance with adjacent transpositions (optimal string alignment); limit + 1 if it is larger."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    older: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [limit + 1] * len(b)
        for j in range(max(1, i - limit), min(len(b), i + limit) + 1):
            best = min(last[j - 1] + (x != b[j - 1]), last[j] + 1, row[j - 1] + 1)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == b[j - 1]:
                best = min(best, older[j - 2] + 1)
            row[j] = best
        if min(row) > limit:
            return limit + 1
        older, last = last, row
    return min(last[-1], limit + 1)


def osa_udf(limit: int):
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([osa_distance(x, y, limit) if x is not None and y is not None else None for x, y in zip(a, b, strict=True)], dtype="Int32")

    return F.pandas_udf(distance, "int")


def century_years(century: int, bc: bool = False, part: str | None = None) -> tuple[int, int]:
    """First and last year of a century; early is its years 1-33, mid 34-66, late 67-100. BC years are negative,
    and a century BC begins with the year farthest back."""
    first, last = {"early": (1, 33), "mid": (34, 66), "late": (67, 100), None: (1, 100)}[part]
    base = (century - 1) * 100
    return (-(base + 101 - first), -(base + 101 - last)) if bc else (base + first, base + last)

"""Historical dates in text: full dates, month and year, year ranges, centuries, decades, era years.

A date is a range of years (negative: BC) with an optional month and day; it is not a DATE, which has no BC
years and no partial dates. Overlapping finds are settled by length, then confidence, then place. What looks
like an amount, a time or a reference by its neighbours is none."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from textspark.functions.segmentation import century_years

LEAST_CONFIDENCE = 0.6
# Month names of English and German, and their short forms.
MONTHS = {
    name: number
    for number, names in enumerate(
        ("january januar jänner jan", "february februar feb", "march märz maerz mar", "april apr", "may mai", "june juni jun", "july juli jul", "august aug", "september sept sep", "october oktober oct okt", "november nov", "december dezember dec dez"), 1
    )
    for name in names.split()
}
# Words for ordinal numbers.
ORDINALS = {w: n for n, w in enumerate("first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth twentieth".split(), 1)} | {"twenty-first": 21}
# Parts of centuries and decades.
PARTS = {"early": "early", "mid": "mid", "late": "late", "frühen": "early", "fruehen": "early", "späten": "late", "spaeten": "late"}
# A number before one of these is an amount or a time.
UNITS = frozenset(
    "people persons person years year yrs percent % dollars euros euro pounds mark marks timestamp times subscribers subs followers views likes comments meters metres feet foot miles km kilometers "
    "kilometres pages page words verses manuscripts copies men women soldiers troops members students o'clock minutes minute seconds second hours hour days day am pm a.m. p.m. point plus k million billion "
    "thousand hundred calories degrees menschen leute jahre jahren prozent seiten stunden minuten uhr".split()
)
# A number behind one of these is a reference or an amount.
REFERENCES = frozenset("number no. nr. page verse chapter room # $ € £ at over under past top psalm seite kapitel".split())
# Words that hedge a statement, and that deny it.
HEDGES = (
    "probably", "possibly", "perhaps", "maybe", "might", "may have", "supposedly", "allegedly", "reportedly", "apparently", "i think", "i believe", "some say", "traditionally", "wahrscheinlich", "vermutlich",
    "vielleicht", "angeblich", "möglicherweise",
)
NEGATIONS = frozenset("not never nicht nie kein keine".split())
# Words that make a date approximate.
APPROXIMATE = frozenset("around about circa ca. c. approximately roughly etwa ungefähr um gegen".split())

_MONTH = "(?P<month>" + "|".join(sorted(MONTHS, key=len, reverse=True)) + r")\.?"
_BC = r"b\.\s?c\.(?:\s?e\.)?|bce\b|bc\b|v\.\s?chr\.?|vor christus\b"
_AD = r"a\.\s?d\.|ad\b|c\.e\.|ce\b|n\.\s?chr\.?|nach christus\b"
_era = lambda name: rf"(?:\s*(?:(?P<{name}bc>{_BC})|(?P<{name}ad>{_AD})))"
_PART = "(?:(?P<part>" + "|".join(PARTS) + r")[\s-]+)?"
_find = lambda pattern: re.compile(rf"\b(?:{pattern})", re.I)

_DAY_FIRST = _find(rf"(?P<day>[0-9]{{1,2}})(?:st|nd|rd|th|\.)?\s+(?:of\s+)?{_MONTH},?\s+(?P<year>[0-9]{{1,4}}){_era('e')}?")
_MONTH_FIRST = _find(rf"{_MONTH}\s+(?P<day>[0-9]{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<year>[0-9]{{1,4}}){_era('e')}?")
_MONTH_YEAR = _find(rf"{_MONTH}\s+(?:of\s+)?(?P<year>[0-9]{{1,4}}){_era('e')}?")
_RANGE = _find(rf"(?:(?P<key>from|between|von|zwischen)\s+)?(?:the\s+years?\s+)?(?P<year>[0-9]{{1,4}}){_era('e')}?\s*(?P<by>-|–|—|to\b|until\b|till\b|and\b|bis\b|und\b)\s*(?P<last>[0-9]{{1,4}}){_era('f')}?")
_CENTURY = _find(rf"{_PART}(?:(?P<n>[0-9]{{1,2}})(?:st|nd|rd|th|\.)|(?P<word>{'|'.join(sorted(ORDINALS, key=len, reverse=True))}))[\s-]+(?:centur(?:y|ies)|jahrhunderts?)\b{_era('e')}?")
_DECADE = _find(rf"{_PART}(?P<year>[0-9]{{3}}0)(?:'?s|er(?:\s+jahren?)?)\b")
_ERA_YEAR = _find(rf"(?P<year>[0-9]{{1,4}}){_era('e')}")
_ERA_FIRST = re.compile(r"\b(?:a\.\s?d\.|ad\b|anno domini)\s+(?P<year>[0-9]{1,4})", re.I)
_YEAR_CUE = _find(rf"(?:in the year|the year|im jahre?|anno)\s+(?P<year>[0-9]{{1,4}}){_era('e')}?")
_CUE = _find(rf"(?:in|since|until|till|before|after|during|from|around|about|circa|ca\.|c\.|approximately|roughly|by|seit|bis|um|etwa|nach|vor)\s+(?P<year>[0-9]{{1,4}}){_era('e')}?")
_BARE = re.compile(r"1[0-9]{3}|20[0-9]{2}")


@dataclass(frozen=True)
class Date:
    start: int
    end: int
    start_year: int
    end_year: int
    month: int | None
    day: int | None
    confidence: float
    approximate: bool = False
    certainty: str = "stated"
    polarity: str = "affirms"


def valid(first: int, last: int, month: int | None, day: int | None) -> bool:
    """No year 0, an end not before the start, a month of the year and a day of a month."""
    return bool(first and last and first <= last and (month is None or 1 <= month <= 12) and (day is None or 1 <= day <= 31))


def _plausible(year: int, era: bool) -> bool:
    return year != 0 and (era or 100 <= year <= 2100)


def _readings(text: str) -> Iterator[Date]:
    def read(m: re.Match, first: int, last: int, confidence: float, month: int | None = None, day: int | None = None, start: int | None = None, loose: bool = False) -> Iterator[Date]:
        if valid(first, last, month, day):
            yield Date(m.start() if start is None else start, m.end(), first, last, month, day, confidence, loose)

    def era(m: re.Match, name: str = "e") -> tuple[bool, int]:
        return bool(m[f"{name}bc"] or m[f"{name}ad"]), -1 if m[f"{name}bc"] else 1

    for pattern in (_DAY_FIRST, _MONTH_FIRST, _MONTH_YEAR):
        for m in pattern.finditer(text):
            has, sign = era(m)
            year, whole = int(m["year"]), pattern is not _MONTH_YEAR
            if _plausible(year, has) and (has or len(m["year"]) >= 3):
                yield from read(m, sign * year, sign * year, 0.95 if whole else 0.9, MONTHS[m["month"].lower()], int(m["day"]) if whole else None)
    for m in _RANGE.finditer(text):
        key, by, a, b = (m["key"] or "").lower(), m["by"].lower(), m["year"], m["last"]
        (has_a, sign_a), (has_b, sign_b) = era(m), era(m, "f")
        has = has_a or has_b
        short = not has and len(b) < len(a)
        if by in ("and", "und") and key not in ("between", "zwischen") or not has and (len(a) < 3 or not key and (len(a) < 4 or by == "until")) or short and not (by in "-–—" and len(b) <= 2):
            continue
        last = int(a[: len(a) - len(b)] + b) if short else int(b)
        first, last = (sign_a if has_a else sign_b) * int(a), (sign_b if has_b else sign_a) * last
        if _plausible(abs(first), has) and _plausible(abs(last), has) and first < last:
            yield from read(m, first, last, 0.9 if key or has else 0.8)
    for m in _CENTURY.finditer(text):
        number = int(m["n"]) if m["n"] else ORDINALS[m["word"].lower()]
        if number:
            yield from read(m, *century_years(number, bool(m["ebc"]), PARTS[m["part"].lower()] if m["part"] else None), 0.85, loose=bool(m["part"]))
    for m in _DECADE.finditer(text):
        year, part = int(m["year"]), PARTS.get((m["part"] or "").lower())
        low, high = {"early": (0, 3), "mid": (3, 6), "late": (6, 9)}.get(part, (0, 9))
        if 1000 <= year <= 2090 and _next_word(text, m.end()) != "of":
            yield from read(m, year + low, year + high, 0.8, loose=bool(part))
    for m in _ERA_YEAR.finditer(text):
        yield from read(m, era(m)[1] * int(m["year"]), era(m)[1] * int(m["year"]), 0.95)
    for m in _ERA_FIRST.finditer(text):
        yield from read(m, int(m["year"]), int(m["year"]), 0.95)
    for m in _YEAR_CUE.finditer(text):
        has, sign = era(m)
        if _plausible(int(m["year"]), has):
            yield from read(m, sign * int(m["year"]), sign * int(m["year"]), 0.9)
    for m in _CUE.finditer(text):
        has, sign = era(m)
        year = int(m["year"])
        if has or len(m["year"]) == 4 and 1000 <= year <= 2100:
            yield from read(m, sign * year, sign * year, 0.9 if has else 0.8, start=m.start("year"))
    for m in _BARE.finditer(text):
        yield from read(m, int(m[0]), int(m[0]), 0.45)


def _next_word(text: str, end: int) -> str:
    rest = text[end:].lstrip()
    return "%" if rest.startswith("%") else rest.split(None, 1)[0].rstrip(",.;:!?)").lower() if rest else ""


def _before(text: str, start: int, n: int) -> list[str]:
    return [w.strip(',("').lower() for w in text[:start].split()[-n:]]


def _free(text: str, d: Date) -> bool:
    """No part of a longer word, number or time."""
    before, after = text[d.start - 1 : d.start], text[d.end : d.end + 1]
    word = lambda c: c.isalnum() or c == "_"
    return not (word(before) or (before == "." and d.start >= 2) or before in ("$", "#", ":") and before) and not (word(after) or after == ":")


def _says(low: str, phrases: tuple[str, ...]) -> bool:
    return any(re.search(rf"(?<!\w){re.escape(p)}(?!\w)", low) for p in phrases)


def dates(text: str, least: float = LEAST_CONFIDENCE) -> list[Date]:
    """Dates of a text in order, none overlapping, of at least that confidence; whether they are approximate, whether
    the text hedges, and whether one of the three words before denies them."""
    low = text.lower()
    clocks = _says(low, ("timestamp", "time stamp"))
    found = [
        d for d in _readings(text)
        if _free(text, d) and not (clocks and d.start_year == d.end_year and d.month is None)
        and _next_word(text, d.end) not in UNITS and not (set(_before(text, d.start, 1)) & REFERENCES)
    ]
    taken: list[Date] = []
    for d in sorted(found, key=lambda d: (d.start - d.end, -d.confidence, d.start)):
        if all(d.end <= t.start or t.end <= d.start for t in taken):
            taken.append(d)
    out = []
    for d in sorted((d for d in taken if d.confidence >= least), key=lambda d: d.start):
        before = _before(text, d.start, 3)
        denied = any(w in NEGATIONS or w.endswith(("n't", "n’t")) for w in before)
        loose = d.approximate or bool(before and before[-1] in APPROXIMATE)
        out.append(Date(d.start, d.end, d.start_year, d.end_year, d.month, d.day, d.confidence, loose, "hedged" if _says(low, HEDGES) else "stated", "denies" if denied else "affirms"))
    return out


def _rows(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [vars(d) for d in dates(t or "")])


def dates_udf(text: Column | str) -> Column:
    kind = "array<struct<start:int,end:int,start_year:int,end_year:int,month:int,day:int,confidence:double,approximate:boolean,certainty:string,polarity:string>>"
    return F.pandas_udf(_rows, kind)(text)

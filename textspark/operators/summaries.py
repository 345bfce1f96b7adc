"""Extractive summaries: sentences scored by how widespread their terms are in the document."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textspark.functions import patterns as P
from textspark.functions import text as T
from textspark.functions.segmentation import sentence_array
from textspark.operators.lexical import ranked


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", abbreviations: tuple[str, ...] = (), collapse: bool = False) -> DataFrame:
    """(id, ordinal, sentence) of every document; white space is collapsed on request."""
    rows = docs.select(F.col(id_col), F.posexplode(sentence_array(F.coalesce(text_col, F.lit("")), abbreviations)).alias("ordinal", "sentence"))
    return rows.withColumn("sentence", T.collapse_whitespace("sentence")) if collapse else rows


def _runs(sorted_array: Column, key: str) -> Column:
    """Places at which the entries' key changes in a sorted array, its two ends included."""
    n = F.size(sorted_array)
    return F.filter(F.sequence(F.lit(0), n), lambda i: (i == 0) | (i == n) | (F.get(sorted_array, i)[key] != F.get(sorted_array, i - 1)[key]))


def _by_run(sorted_array: Column, key: str, make: Callable[[Column], Column]) -> Column:
    """make(entries) of each run of entries with equal key."""
    piece = lambda at: F.transform(F.slice(at, F.lit(1), F.greatest(F.size(at) - 1, F.lit(0))), lambda a, k: make(F.slice(sorted_array, a + 1, F.get(at, k + 1) - a)))
    return T.bound(_runs(sorted_array, key), piece)


def mean_counts(sentences: Column) -> Column:
    """From (o, t), sentences by their ordinal with their terms: (o, score) of those with a term, where score is the mean
    of how often the sentence's terms stand in all of them. Terms are sorted, and runs of equal ones counted."""
    terms = F.sort_array(F.flatten(F.transform(sentences, lambda s: F.transform(s["t"], lambda t: F.struct(t.alias("t"), s["o"].alias("o"))))))
    counts = lambda run: F.transform(run, lambda x: F.struct(x["o"].alias("o"), F.size(run).cast("bigint").alias("n")))
    mean = lambda run: F.struct(F.get(run, F.lit(0))["o"].alias("o"), (F.aggregate(run, F.lit(0).cast("bigint"), lambda s, x: s + x["n"]) / F.size(run)).alias("score"))
    placed = T.bound(terms, lambda e: F.sort_array(F.flatten(_by_run(e, "t", lambda run: T.bound(run, counts)))))
    return T.bound(placed, lambda e: _by_run(e, "o", lambda run: T.bound(run, mean)))


def _scored(docs: DataFrame, stop: Sequence[str], min_tokens: int, id_col: str, text_col: str) -> DataFrame:
    """(id, _s, _w, _f): a document's sentences, their words, and (o, score) of the scored ones; one row a document."""
    rows = T.held(docs.select(F.col(id_col), F.coalesce(text_col, F.lit("")).alias("_x")), _s=sentence_array("_x"))
    rows = T.held(rows.drop("_x"), _w=F.transform("_s", T.words_array))
    keep = lambda w: F.filter(w, lambda t: (F.length(t) >= 3) & (~t.isin(*stop) if stop else F.lit(True)))
    long = F.filter(F.transform("_w", lambda w, o: F.struct(o.alias("o"), F.when(F.size(w) >= min_tokens, keep(w)).alias("t"))), lambda s: s["t"].isNotNull())
    return T.held(rows, _f=mean_counts(long))


def scored_sentences(docs: DataFrame, stop: Sequence[str] = P.STOP_EN, min_tokens: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ordinal, sentence, words, score): the mean count in the document of the sentence's kept terms. A row is a
    document, and nothing is shuffled."""
    pieces = F.transform("_f", lambda x: F.struct(x["o"].alias("ordinal"), F.get("_s", x["o"]).alias("sentence"), F.get("_w", x["o"]).alias("words"), x["score"].alias("score")))
    return _scored(docs, stop, min_tokens, id_col, text_col).select(id_col, F.inline(pieces))


def summarize(docs: DataFrame, k: int = 3, id_col: str = "doc_id", text_col: str = "text", stop: Sequence[str] = P.STOP_EN, min_tokens: int = 3) -> DataFrame:
    """(id, summary): the k best sentences in document order. A row is a document, and nothing is shuffled."""
    rows = _scored(docs, stop, min_tokens, id_col, text_col)
    best = F.slice(F.sort_array(F.transform("_f", lambda x: F.struct((-x["score"]).alias("s"), x["o"].alias("o")))), F.lit(1), F.lit(k))
    parts = F.transform(F.sort_array(F.transform(best, lambda x: x["o"])), lambda o: F.get("_s", o))
    return rows.filter(F.size("_f") > 0).select(id_col, F.array_join(parts, " ").alias("summary"))


def diverse(docs: DataFrame, k: int = 3, weight: float = 0.35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ordinal, sentence): from the 4 k best, one after the other the sentence of highest (1 - weight) score
    less weight times its largest bigram Jaccard similarity to those taken."""
    weight = min(1.0, max(0.0, weight))
    pool = ranked(scored_sentences(docs, id_col=id_col, text_col=text_col), [id_col], [F.desc("score"), F.asc("ordinal")], 4 * k)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank").reset_index(drop=True)
        grams = [set(zip(w, w[1:], strict=False)) for w in map(list, rows["words"])]
        alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        taken: list[int] = []
        while len(taken) < min(k, len(rows)):
            left = [i for i in range(len(rows)) if i not in taken]
            value = lambda i: (1 - weight) * rows["score"][i] - weight * max((alike(grams[i], grams[j]) for j in taken), default=0.0)
            taken.append(max(left, key=lambda i: (value(i), -i)))
        return rows.loc[sorted(taken, key=lambda i: rows["ordinal"][i]), [id_col, "ordinal", "sentence"]]

    kind = docs.schema[id_col].dataType.simpleString()
    return pool.groupBy(id_col).applyInPandas(run, f"{id_col} {kind}, ordinal int, sentence string")  # at most 4 k rows a group

"""What a caller plugs in where a model is needed: plain protocols whose functions map pandas batches, and the operators
that run them over DataFrames in Arrow batches. Nothing here has a model of its own; a missing backend raises."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textspark.operators.predictions import MissingModel

ROLES = ("query", "passage", "symmetric")
# Prefixes that embedding presets put before texts, by preset and role.
PREFIXES = {"e5": {"query": "query: ", "passage": "passage: ", "symmetric": "query: "}, "plain": {}}


class Embedder(Protocol):
    """texts and their role in, one vector each out; ``key`` names the model for caches."""

    key: str

    def __call__(self, texts: pd.Series, role: str) -> pd.Series: ...


class Scorer(Protocol):
    """Batches of the input columns in, batches with the output columns out."""

    def __call__(self, batch: pd.DataFrame) -> pd.DataFrame: ...


def prefixed(text: str, preset: str, role: str):
    """The text with the prefix of its preset and role."""
    if role not in ROLES:
        raise ValueError(f"role is one of {ROLES}")
    return F.concat(F.lit(PREFIXES.get(preset, {}).get(role, "")), F.coalesce(text, F.lit("")))


def embedded(rows: DataFrame, embedder: Embedder | None, text_col: str = "text", role: str = "passage", preset: str = "plain") -> DataFrame:
    """rows with ``vector``. Equal texts are embedded once: distinct texts go through the backend and are joined back."""
    if embedder is None:
        raise MissingModel("embedding needs a backend; import vectors instead")
    texts = rows.select(F.col(text_col).alias("_t")).distinct().withColumn("_p", prefixed("_t", preset, role))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"_t": batch["_t"], "vector": embedder(batch["_p"], role)})

    known = texts.mapInPandas(run, "_t string, vector array<double>")
    return rows.join(known, rows[text_col].eqNullSafe(known["_t"])).drop("_t")


def scored(rows: DataFrame, backend: Scorer | None, schema: str, what: str) -> DataFrame:
    """The backend's rows for batches of rows: classifiers, pair classifiers, sequence labelers, rerankers, readers, syntax
    parsers and interpreters differ in their columns alone."""
    if backend is None:
        raise MissingModel(f"{what} needs a backend; import its predictions instead")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield backend(batch)

    return rows.mapInPandas(run, schema)


def classified(rows: DataFrame, backend: Scorer | None) -> DataFrame:
    return scored(rows, backend, "doc_id bigint, label string, score double", "classification")


def classified_pairs(rows: DataFrame, backend: Scorer | None) -> DataFrame:
    return scored(rows, backend, "doc_id bigint, label string, score double", "pair classification")


def labelled(rows: DataFrame, backend: Scorer | None) -> DataFrame:
    return scored(rows, backend, "doc_id bigint, pos int, label string, score double, start int, end int", "sequence labelling")


def parsed(rows: DataFrame, backend: Scorer | None) -> DataFrame:
    return scored(rows, backend, "sentence_id string, word_id int, form string, lemma string, upos string, feats string, head int, deprel string", "syntax")


def read_answers(rows: DataFrame, backend: Scorer | None) -> DataFrame:
    return scored(rows, backend, "question_id bigint, seq int, text string, score double, attributes map<string,string>", "question answering")


def reranked(rows: DataFrame, backend: Scorer | None) -> DataFrame:
    return scored(rows, backend, "query_id bigint, doc_id bigint, score double", "reranking")


def synthesized(rows: DataFrame, backend: Scorer | None) -> DataFrame:
    return scored(rows, backend, "id string, text string, confidence double", "synthesis")


#: Runs a text through a caller's function row by row in Arrow batches.
def text_function(name: str, function: Callable[[pd.Series], pd.Series], kind: str = "string"):
    return F.pandas_udf(function, kind)

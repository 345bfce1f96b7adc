"""Corpus preparation in stages, each calling one of the training-data operators.

Toxic documents go, then exact copies, then all but one document of each near-duplicate group; the rest is
mixed to target weights (a document that the mix holds twice is two rows) and packed into training
sequences. Every stage's result is a table in the shared folder, from which the next one starts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textspark.llm import exact_dedup, mixing, ngram_jaccard, packing, toxicity
from textspark.llm.common import cut, table
from textspark.llm.queries import MIX_WEIGHTS, mix_domain


def clean_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Trained on the labelled rows among docs; rows predicted toxic go. Null and empty texts are clean."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; null and empty texts are one group."""
    return exact_dedup.keep_first_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of five-word Jaccard similarity of 0.75 or more the row with the least doc_id stays; so do
    rows without a word or without an id."""
    return ngram_jaccard.keep_one_of_each_group(docs)


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix holds it; rows without a word are in none."""
    return mixing.mixed_rows(docs, mix_domain(), weights=MIX_WEIGHTS)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in their bins."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", clean_language),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources to target weights", target_mix),
    ("best-fit packing", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The first stage is a trained classifier, which SQL cannot express.
ORACLE_SQL = None

"""Operators on hand-made rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textspark.operators import annotations, clusters, summaries
from textspark.sources import corpus
from textspark.sources.scratch import scratch_path


def test_average_link():
    x = np.array([[1, 0], [0.9, 0.1], [0, 1], [0.1, 0.9], [-1, 0]], float)
    assert list(clusters.average_link(x)) == [0, 0, 1, 1, 2]
    assert list(clusters.average_link(x[:1])) == [0]
    rng = np.random.default_rng(0)
    x = rng.normal(size=(25, 3))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    groups = [[i] for i in range(25)]
    while len(groups) > 1:
        pairs = [(-np.mean([u[a] @ u[b] for a in g for b in h]), min(g), min(h), i, j) for i, g in enumerate(groups) for j, h in enumerate(groups) if i < j]
        best = min(pairs)
        if -best[0] < 0.6:
            break
        groups[best[3]] += groups.pop(best[4])
    found = clusters.average_link(x)
    assert {frozenset(g) for g in groups} == {frozenset(np.flatnonzero(found == c)) for c in set(found)}


def test_cluster_units(spark):
    units = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [1.0, 0.1]), (2, 0, [0.0, 1.0])], "conv bigint, seq bigint, v array<double>")
    assert {(r.conv, r.seq): r.cluster for r in clusters.cluster_units(units, "conv", "seq", "v").collect()} == {(1, 0): 0, (1, 1): 0, (2, 0): 0}


def test_summaries(spark):
    text = "Cats chase mice daily. Unrelated filler sentence here. Cats and mice play. Mice fear cats greatly."
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id bigint, text string")
    assert summaries.summarize(docs, 2).collect()[0].summary.count(".") == 2
    rows = summaries.diverse(docs, 2).collect()
    assert len(rows) == 2 and all("Unrelated" not in r.sentence for r in rows)


def test_entities(spark):
    rows = [(1, k, label, 10 * k, 10 * k + 5, 0.5) for k, label in enumerate(["B-PER", "I-PER", "O", "I-LOC", "B-LOC", "I-PER"])]
    pieces = spark.createDataFrame(rows, "doc_id bigint, pos int, label string, start int, end int, score double")
    found = sorted((r.start, r.end, r.entity_type) for r in annotations.decode_entities(pieces).collect())
    assert found == [(0, 15, "PER"), (30, 35, "LOC"), (40, 45, "LOC"), (50, 55, "PER")]


def test_containment_and_spans(spark):
    inner = spark.createDataFrame([(1, 0, 3), (1, 5, 8), (1, 90, 95)], "doc_id bigint, start int, end int")
    outer = spark.createDataFrame([(1, 7, 0, 4), (1, 8, 4, 9)], "doc_id bigint, id int, start int, end int")
    assert {(r.start, r.outer_id) for r in annotations.contained_in(inner, outer).collect()} == {(0, 7), (5, 8), (90, None)}
    logits = spark.createDataFrame([(1, p, float(s), float(e), c) for p, s, e, c in [(0, 9, 9, False), (1, 3, 0, True), (2, 0, 3, True), (3, 0, 0, True)]], "question_id bigint, pos int, start_logit double, end_logit double, in_context boolean")
    best = annotations.answer_spans(logits, 1).first()
    assert (best.first, best["last"]) == (1, 2)


def test_corpus_tables(spark):
    docs = corpus.from_texts(spark, ["red blue red", "green"])
    new = spark.createDataFrame([("doc-1", "blue"), ("doc-9", "x")], docs.schema)
    assert {tuple(r) for r in corpus.upsert(docs, new).collect()} == {("doc-0", "red blue red"), ("doc-1", "blue"), ("doc-9", "x")}
    path = scratch_path(spark, "snapshot")
    corpus.save_snapshot(docs, path)
    assert corpus.load_snapshot(spark, path).count() == 2
    new.write.mode("append").parquet(f"{path}/documents")
    with pytest.raises(ValueError):
        corpus.load_snapshot(spark, path)
    assert corpus.violations(docs.union(docs)).count() == 2
    with pytest.raises(Exception, match="blank"):
        corpus.validated(docs.withColumn("id", F.lit(" "))).collect()

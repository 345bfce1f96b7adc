"""What the findings of the second round asked for."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textspark.functions import segmentation, spans
from textspark.functions import text as T
from textspark.operators import index, lexical, linguistics, reports, search, similarity, summaries, vectors
from textspark.plans import conversation_queries, index_queries, layer_queries, lexical_queries, report_queries, search_queries, semantic_queries
from textspark.sources.scratch import cut

SF = "/root/testdata/sf0.001"


def test_script_profile_reads_a_text_a_few_times(spark):
    rows = spark.createDataFrame([("Abé 12, бвгд א\u0001",), ("",), ("αb",), ("1 2!",)], "text string").select(T.script_profile("text").alias("s"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") < 20
    got = [(r.s.counts, r.s.dominant, r.s.is_mixed) for r in rows.collect()]
    assert got == [({"Latin": 3, "Cyrillic": 4, "Hebrew": 1, "Other": 1}, "Cyrillic", True), ({}, None, False), ({"Greek": 1, "Latin": 1}, "Greek", True), ({}, None, False)]


def test_vector_search_forms_no_row_for_a_pair(spark):
    rows = spark.createDataFrame([(i, [float(i % 7), 1.0, None if i % 5 == 0 else float(i % 3)]) for i in range(60)] + [(60, None), (61, [0.0] * 3), (62, [1.0])], "vec_id bigint, embedding array<float>")
    asked = rows.filter("vec_id % 20 = 0 OR vec_id = 62").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    found = vectors.top_k(rows, asked, 4)
    assert "zip_with" not in found._jdf.queryExecution().optimizedPlan().toString()
    pairs = asked.crossJoin(rows).withColumn("score", F.round(vectors.cosine("embedding", "query_vector"), 6)).collect()
    best = sorted(((r.query_id, -(r.score or 0.0), r.vec_id) for r in pairs))
    wanted = [x for q in (0, 20, 40, 60, 62) for x in [b for b in best if b[0] == q][:4]]
    assert sorted((r.query_id, -r.score, r.vec_id) for r in found.collect()) == sorted(wanted)


def test_words_of_turns_are_tokenised_once(spark):
    plan = layer_queries._words(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1


def test_cycles_are_reported_by_the_query(spark):
    assert linguistics.cyclic([1, 2, 3, 4, 5, 6], [2, 3, 2, 0, 4, 9]) == [1, 2, 3]
    n = 20_000
    assert linguistics.cyclic(range(1, n + 1), range(n)) == [] and len(linguistics.cyclic(range(1, n + 1), [n, *range(1, n)])) == n
    assert layer_queries.syntax_violations(spark, SF).filter("problem = 'it is in a cycle'").count() > 0


def test_a_window_carries_its_own_text_alone(spark):
    docs = spark.createDataFrame([("a", "one, two  three four. five"), ("b", "..."), ("c", None)], "id string, body string")
    rows = index.window_texts(docs, 2, 1, "id", "body")
    assert "explode(sequence" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in rows.collect()] == [("a", 0, 0, 2, "one, two"), ("a", 1, 1, 3, "two  three"), ("a", 2, 2, 4, "three four"), ("a", 3, 3, 5, "four. five")]


def test_index_changes_broadcasts_a_written_row(spark):
    assert "textspark-after" in index_queries.index_changes(spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_terms_are_counted_without_a_shuffle(spark):
    docs = spark.createDataFrame([(1, "b a B c a b"), (2, ""), (3, None), (4, "x")], "doc_id bigint, text string")
    rows = lexical.postings(docs)
    assert sorted(map(tuple, rows.collect())) == [(1, "a", 2, 6), (1, "b", 3, 6), (1, "c", 1, 6), (4, "x", 1, 1)]
    for made in (rows, lexical.term_counts(docs), lexical.token_ngrams(docs, 2), reports.ngram_frequencies(docs, 2)):
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.ngram, r.tf, r["rank"]) for r in reports.ngram_frequencies(docs, 2).collect()) == [("a b", 2, 1), ("b a", 1, 2), ("b c", 1, 3), ("c a", 1, 4)]


def test_query_terms_are_met_without_a_shuffle_of_the_postings(spark):
    docs = spark.createDataFrame([(1, "b a B c a b"), (2, "")], "doc_id bigint, text string")
    wanted = cut(spark.createDataFrame([("b",), ("z",)], "term string"), "wanted")
    rows = search.query_postings(docs, wanted, "doc_id", "text")
    assert "SortMergeJoin" not in rows._jdf.queryExecution().executedPlan().toString() and "BroadcastHashJoin" in rows._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, rows.collect()), key=str) == [(1, 6.0, "b", 3), (1, 6.0, None, 1), (2, 0.0, None, 1)]


def test_fuzzy_queries_are_whole_texts(spark):
    asked = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(40)) + " harbuor")], "query_id int, query string")
    vocabulary = spark.createDataFrame([("harbour", 1)], "term string, df bigint")
    rows = index.query_variants(asked, vocabulary, index.FuzzyOptions(max_terms=None)).orderBy("variant").collect()
    assert [r.corrections for r in rows] == [[], ["harbuor>harbour"]] and rows[1].query.split()[0] == "w0" and len(rows[1].query.split()) == 41


def test_a_capital_is_one_character(spark):
    rows = spark.createDataFrame([("ß",), ("ßa",), ("ﬁx",), ("ᾳb",), ("éa",), ("",), ("1a",), (None,)], "t string").select(spans.softened("t").alias("s"))
    assert [r.s for r in rows.collect()] == ["ẞ", "ẞa", "ﬁx", "ᾼb", "Éa", "", "1a", None]


def test_softmax_takes_its_powers_once(spark):
    plan = search_queries.softmax_scores(spark, SF)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("exp(") == 1
    rows = spark.createDataFrame([([1.0, 2.0, 3.0],), ([],), (None,), ([0.0, None],)], "v array<double>").select(vectors.softmax(F.col("v")).alias("p"))
    got = [r.p if r.p is None else [x if x is None else round(x, 6) for x in r.p] for r in rows.collect()]
    assert got == [[0.090031, 0.244728, 0.665241], [], None, [0.0, 0.0]]


def test_a_document_report_shuffles_nothing(spark):
    docs = spark.createDataFrame([(1, "Ab ab CD. @me https://x.org 12 xyz xyz!\n\nab?"), (2, ""), (3, None), (4, "a")], "doc_id bigint, text string")
    made = reports.document_figures(docs)
    for rows in (made, lexical.enriched_stats(docs), lexical.keywords(docs), lexical.top_terms(docs, 3), reports.text_summary(docs), report_queries.document_report(spark, SF)):
        assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert made._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(_x") <= 2
    got = sorted(made.drop("shannon_entropy").collect())
    assert [tuple(r) for r in got] == [(1, 9, 4, 2, "Latin", 4, 6, "xyz"), (4, 1, 1, 1, "Latin", 1, 1, None)]
    kinds = lexical.enriched_stats(docs).filter("doc_id = 1").first()
    assert (kinds.n_tokens, kinds.n_url, kinds.n_mention, round(kinds.lexical_density * 9), round(kinds.hapax_ratio * 6)) == (9, 1, 1, 6, 4)


def test_a_summary_shuffles_nothing(spark):
    docs = spark.createDataFrame([(1, "The cat sat down. A cat and a dog ran. No. Of the to it? Dog cat dog here."), (2, ""), (3, None)], "doc_id bigint, text string")
    made = summaries.summarize(docs, 2)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in made.collect()] == [(1, "A cat and a dog ran. Dog cat dog here.")]
    rows = summaries.scored_sentences(docs).collect()
    assert [(r.ordinal, r.words[0], round(r.score, 6)) for r in rows] == [(0, "the", 1.666667), (1, "a", 2.333333), (4, "dog", 2.5)]


def test_near_duplicates_write_hashes_not_texts(spark, monkeypatch):
    written = []
    monkeypatch.setattr(similarity, "cut", lambda rows, label: written.append(rows.schema) or cut(rows, label))
    dice = random.Random(5)
    texts = [" ".join(dice.choice("abcdefgh") for _ in range(dice.randrange(3, 30))) for _ in range(40)]
    for text in texts[:20]:
        words = text.split()
        words[dice.randrange(len(words))] = "z"
        texts += [" ".join(words), text + " w"]
    texts += [texts[0], texts[0], "one two", "", None]
    found = similarity.near_duplicate_pairs(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), 3, 0.5)
    assert written and not any(f.dataType.simpleString() in ("string", "array<string>") for schema in written for f in schema)
    sets = {i: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} for i, t in enumerate(texts) if t is not None for w in [t.split()]}
    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    wanted = {(i, j, len(sets[i] & sets[j]), alike(sets[i], sets[j])) for i in sets for j in sets if i < j and alike(sets[i], sets[j]) >= 0.5}
    assert len(wanted) > 30 and sorted(map(tuple, found.collect())) == sorted(wanted)


def test_simhashes_get_a_long_text_in_pieces(spark, monkeypatch):
    seen = []
    frame = type(spark.range(1))
    real = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda rows, run, schema: seen.append(rows) or real(rows, run, schema))
    long = " ".join(f"wört{i}" for i in range(1_000))
    texts = [(1, long), (2, "a b"), (3, ""), (4, None), (5, "a b c"), (6, long + " a b c d"), (7, "x " * 500), (8, "a b c d")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = {r.doc_id: r.simhash for r in similarity.simhashes(spark.createDataFrame(texts, "doc_id bigint, text string").coalesce(1)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert seen[0].select(F.max(F.size("s"))).first()[0] == similarity.PIECE
    for i, t in texts:
        w = (t or "").split()
        wanted = None if t is None else segmentation.simhash(sorted({" ".join(w[k : k + 3]) for k in range(len(w) - 2)}))
        assert got[i] == (wanted - (1 << 64) if wanted is not None and wanted >> 63 else wanted)


def test_a_search_shuffles_no_texts(spark):
    for query in (index_queries.engine_sorted, index_queries.index_lexical, index_queries.index_phrases, search_queries.rerank_overlap):
        plan = query(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and ("textspark-candidates" in plan or "textspark-hits" in plan)
    assert "textspark-relevant" in conversation_queries.ranking_metrics(spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_chunks_that_hold_the_phrases_take_part_with_no_score(spark):
    texts = ["b of the x", "of the", "OF, the cat", "cat", None, "of a the cat", "cat of the cat"]
    docs = index.index_documents(spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts) if t], "id string, body string"))
    chunks = docs.select(F.col("id").alias("chunk_id"), F.col("id").alias("document_id"), F.col("body").alias("text"), *index.EXTRAS)
    asked = spark.createDataFrame([(1, "cat"), (2, "zzz")], "query_id int, query string")
    got = [(r.query_id, r.chunk_id, r.score > 0, r.matched_phrases) for r in index.index_search(chunks, asked, index.IndexQuery.lexical(3, phrases=["of the", " "])).orderBy("query_id", "rank").collect()]
    assert [g[:2] for g in got] == [(1, "d6"), (1, "d2"), (1, "d0"), (2, "d0"), (2, "d1"), (2, "d2")] and all(g[3] == ["of the"] for g in got) and [g[2] for g in got][-4:] == [False] * 4


def _given_to_ranked(monkeypatch):
    given, real = [], lexical.ranked
    monkeypatch.setattr(lexical, "ranked", lambda rows, *rest: given.append(rows) or real(rows, *rest))
    return given


def test_tfidf_terms_joins_few_terms_of_a_document(spark, monkeypatch):
    given = _given_to_ranked(monkeypatch)
    made = lexical_queries.tfidf_terms(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert given[0].count() < 12 * docs.count() < lexical.postings(docs).count() / 4
    assert "textspark-document-frequencies" in made._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most_known", [0, 3, 20, 1 << 20])
@pytest.mark.parametrize("k", [1, 4])
def test_the_best_terms_by_tfidf_are_those_of_all_scores(spark, most_known, k):
    dice = random.Random(7)
    word = lambda: f"w{int(dice.paretovariate(0.6)) % 500}"
    texts = [" ".join(word() for _ in range(dice.randrange(1, 60))) for _ in range(60)] + ["", None, "a", "b a", "q r s t u v x y z", "ß É é"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    wanted = lexical.ranked(lexical.tfidf(docs).withColumn("score", F.round("score", 6)), ["doc_id"], [F.desc("score"), F.desc("tf"), F.asc("term")], k)
    columns = ["doc_id", "rank", "term", "tf", "length", "df", "idf", "score"]
    got = lexical.best_tfidf(docs, k, most_known=most_known).select(columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.select(columns).collect()))


def test_a_corpus_report_joins_few_terms_of_a_document(spark, monkeypatch):
    given = _given_to_ranked(monkeypatch)
    made = search_queries.corpus_report(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert given[0].count() < 2 * docs.count() and made.count() == docs.count()
    whole = reports.corpus_report(docs.limit(20).withColumnRenamed("doc_id", "id"), id_col="id")["tfidf"]
    assert given[-1].filter("df IS NULL").count() == 0 and {"id", "term", "tf", "length", "df", "idf", "score", "rank"} == set(whole.columns) and whole.filter("rank > 10").count() == 0


def test_two_neighbourhoods_are_compared_from_one_search(spark):
    plan = semantic_queries.neighbourhood_comparison(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "textspark-neighbours" in plan and "FlatMapGroupsInArrow" not in plan


@pytest.mark.parametrize("k, threshold", [(1, 0.25), (3, -1.0), (4, 0.5), (70, 0.0)])
def test_nearest_of_a_block_are_those_of_all_products(monkeypatch, k, threshold):
    monkeypatch.setattr(vectors, "SLICE", 7)
    monkeypatch.setattr(vectors, "SAMPLE", 11)
    monkeypatch.setattr(vectors, "MOST_BROADCAST", 50)
    x = np.random.default_rng(3).normal(size=(90, 6))
    x[20:50] = x[5] + np.arange(30)[:, None] // 10 * 1e-7  # ties, exact and in six digits
    x[60:63] = 0.0
    x = np.divide(x, n := np.linalg.norm(x, axis=1, keepdims=True), out=np.zeros_like(x), where=n > 0)
    scores = np.round(x @ x.T, 6) + 0.0
    wanted = lambda rows, columns: {(i, j, scores[i, j]) for i in rows for j in sorted((j for j in columns if j != i and scores[i, j] >= threshold), key=lambda j: (-scores[i, j], j))[:k]}
    triples = lambda found, a=0, b=0: {(i + a, j + b, s) for i, j, s in zip(*(c.tolist() for c in found), strict=True)}
    across, back = vectors._nearest(x, x, k, threshold, True)
    assert triples(across) == wanted(range(90), range(90)) and len(back[0]) == 0
    across, back = vectors._nearest(x[:40], x[40:], k, threshold, False)
    assert triples(across, 0, 40) == wanted(range(40), range(40, 90))
    assert triples((back[1], back[0], back[2]), 40, 0) == wanted(range(40, 90), range(40))


@pytest.mark.parametrize("block", [1, 8, 4_096])
def test_a_neighbour_graph_is_that_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    dice = random.Random(2)
    rows = [(f"v{i}", [dice.gauss(0, 1) for _ in range(4)]) for i in range(40)] + [(f"w{i}", [1.0, 2.0, float(i // 4), 0.5]) for i in range(8)] + [("z0", [0.0] * 4), ("z1", None), ("z2", [1.0])]
    table = spark.createDataFrame(rows, "vec_id string, embedding array<float>")
    pairs = table.alias("x").join(table.alias("y"), F.col("x.vec_id") != F.col("y.vec_id")).select(F.col("x.vec_id").alias("a"), F.col("y.vec_id").alias("b"), F.round(F.coalesce(vectors.cosine("x.embedding", "y.embedding"), F.lit(0.0)), 6).alias("score"))
    wanted = lexical.ranked(pairs, ["a"], [F.desc("score"), F.asc("b")], 3).filter("score >= 0.25").select("a", "b", "score", "rank")
    got = vectors.nearest(table, 3).select("a", "b", "score", "rank")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))
    assert vectors.nearest(table.limit(0)).count() == 0 and vectors.knn_graph(table.limit(1)).count() == 0

"""Index, reports, transcripts, linguistics, evaluation, workspace and operations on hand-made rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textspark import backends, operations
from textspark.functions import segmentation as S
from textspark.operators import answers, clusters, evaluation, fuzzy, generation, index, linguistics, markov, vectors
from textspark.operators.predictions import MissingModel
from textspark.sources import contracts, corpus
from textspark.sources.scratch import scratch_path
from textspark.workspace import Workspace, ingest_stream


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [("a", "harbour pilots guide cargo vessels"), ("b", "bakers knead bread dough"), ("c", "the harbour master watches bread ships")]
    docs = index.index_documents(spark.createDataFrame(rows, "id string, body string"))
    return index.chunked(docs)


def test_sentences_keep_abbreviations():
    text = "Mr. Okoro came, e.g. on Monday. It cost 3.50... Really?! U.S. law. J. B. won! und. so"
    spans = [text[a:b] for a, b in S.sentence_spans(text)]
    assert spans == ["Mr. Okoro came, e.g. on Monday.", "It cost 3.50...", "Really?!", "U.S. law.", "J. B. won!", "und.", "so"]
    assert [text[a:b] for a, b in S.sentence_spans(text, ("Und.",))][-1] == "und. so"


def test_sentence_array_is_sentence_spans(spark):
    rng = np.random.default_rng(5)
    parts = ["Mr.", "e.g.", "word", "A.", "3.5", "...", "?!", "i.e", "u.k.", "\n", " ", "é.", "x", "Dr", "St.", "。", "1.", ".", "mr.smith", "Vs"]
    texts = ["".join(rng.choice(parts) + (" " if rng.random() < 0.5 else "") for _ in range(30)) for _ in range(200)] + ["", "  "]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", S.sentence_array("t").alias("s")).collect()
    for r in rows:
        t = texts[r.i]
        assert r.s == [t[a:b] for a, b in S.sentence_spans(t)], t


def test_centuries_before_christ_run_forwards():
    assert S.century_years(5, True, "early") == (-500, -468) and S.century_years(5, True) == (-500, -401)
    assert S.century_years(5, True, "late") == (-434, -401) and S.century_years(19, False, "mid") == (1834, 1866)


def test_index_search_and_fuzzy(spark, chunks):
    asked = spark.createDataFrame([(1, "harbour bread"), (2, "zzz")], "query_id int, query string")
    rows = index.index_search(chunks, asked, index.IndexQuery.lexical(5, explain=True)).collect()
    assert [r.document_id for r in rows if r.query_id == 1][0] == "c" and not [r for r in rows if r.query_id == 2]
    assert rows[0].explanation.startswith("score=1.0000")
    wrong = spark.createDataFrame([(1, "harbuor pilots")], "query_id int, query string")
    best = index.fuzzy_search(chunks, wrong, 3).filter("rank = 1").first()
    assert best.document_id == "a" if "document_id" in best else best.chunk_id == "a:0"
    assert best.corrections == ["harbuor>harbour"]
    with pytest.raises(ValueError, match="vectors"):
        index.index_search(chunks, asked)
    with pytest.raises(ValueError, match="weights"):
        index.IndexQuery.hybrid(weights=(0, 0)).checked()


def test_filters_and_snippets(spark):
    docs = index.index_documents(spark.createDataFrame([("x", "y" * 200 + " Needle here", {"tags": "red, blue", "k": "value"}, ("s1", "web", None, 5.0, None))], f"id string, body string, metadata map<string,string>, source {index.SOURCE}"))
    part = index.chunked(docs)
    for wanted, kept in ((index.IndexFilter(required_tags=["red"]), 1), (index.IndexFilter(required_tags=["green"]), 0), (index.IndexFilter(metadata_contains={"k": "alu"}, seconds=(4, 6)), 1), (index.IndexFilter(seconds=(None, 4)), 0), (index.IndexFilter(source_kinds=["web"], document_ids=["x"]), 1)):
        assert part.filter(wanted.column()).count() == kept
    found = part.select(index.snippet(F.col("text"), F.array(F.lit("needle"))).alias("s")).first().s
    assert found == "y" * 60 + " Needle here"


def test_index_tables_survive_a_snapshot(spark, chunks):
    docs = index.index_documents(spark.createDataFrame([("a", "x")], "id string, body string"))
    known = chunks.select("chunk_id", F.array(F.lit(1.0), F.lit(0.0)).alias("vector"))
    path = scratch_path(spark, "index")
    index.saved(path, docs, chunks, known)
    assert [t.count() for t in index.loaded(spark, path, 2)] == [1, 3, 3]
    with pytest.raises(ValueError, match="dimension"):
        index.loaded(spark, path, 3)
    with pytest.raises(ValueError, match="no chunk"):
        index.checked_vectors(known, chunks.filter("document_id = 'a'"))


def test_expansions_at_distance_two_match_brute_force(spark):
    rng = np.random.default_rng(2)
    words = sorted({"".join(rng.choice(list("abcd"), rng.integers(4, 7))) for _ in range(60)})
    vocabulary = spark.createDataFrame([(w, i % 5) for i, w in enumerate(words)], "term string, df int")
    for distance in (1, 2):
        found = {(r.query_term, r.term, r.distance) for r in fuzzy.expand_terms(vocabulary.select(F.col("term").alias("query_term")), vocabulary, 1000, distance=distance).collect()}
        want = {(a, b, d) for a in words for b in words if a != b and (d := S.osa_distance(a, b, distance)) <= distance}
        assert found == want


def test_average_link_of_many_units_is_average_link():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 5))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    groups, s = [[i] for i in range(300)], u @ u.T
    while True:
        means = {(i, j): s[np.ix_(groups[i], groups[j])].mean() for i in range(len(groups)) for j in range(i + 1, len(groups))} if len(groups) < 40 else None
        if means is None:
            sums = np.array([u[g].sum(0) for g in groups])
            m = sums @ sums.T / np.outer([len(g) for g in groups], [len(g) for g in groups])
            m[np.tril_indices(len(groups))] = -1
            i, j = divmod(int(m.argmax()), len(groups))
            best = m[i, j]
        else:
            (i, j), best = max(means.items(), key=lambda kv: kv[1])
        if best < 0.5:
            break
        groups[i] += groups.pop(j)
    found = clusters.average_link(x, 0.5)
    assert {frozenset(g) for g in groups} == {frozenset(np.flatnonzero(found == c)) for c in set(found)}


def test_block_products_beyond_one_block(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 7)
    monkeypatch.setattr(vectors, "MOST_BROADCAST", 10)
    x = np.random.default_rng(0).integers(-3, 4, (40, 3)).astype(float)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id int, embedding array<double>")
    n = np.linalg.norm(x, axis=1)
    s = np.round(np.divide(x @ x.T, np.outer(n, n), out=np.zeros((40, 40)), where=np.outer(n, n) > 0), 6)
    assert {(r.a, r.b) for r in vectors.neighbour_pairs(rows, 0.5).collect()} == {(i, j) for i in range(40) for j in range(i + 1, 40) if s[i, j] >= 0.5}
    want = set()
    for i in range(40):
        near = sorted((j for j in range(40) if j != i), key=lambda j: (-s[i, j], j))[:4]  # noqa: B023
        want |= {(min(i, j), max(i, j)) for j in near if s[i, j] >= 0.25}
    assert {(r.a, r.b) for r in vectors.knn_graph(rows).collect()} == want
    asked = rows.filter("vec_id < 5").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    top = {(r.query_id, r["rank"]): r.vec_id for r in vectors.top_k(rows, asked, 3).collect()}
    for q in range(5):
        assert [top[q, k] for k in (1, 2, 3)] == sorted(range(40), key=lambda j: (-s[q, j], j))[:3]  # noqa: B023


def test_whisperx_faults_raise(spark):
    good = '{"language": "en", "segments": [{"start": 0, "end": 2, "text": " hi ", "chars": [{"char": "h"}], "extra": 1, "words": [{"word": "hi", "start": 0, "end": 1, "speaker": "A"}, {"word": " "}]}]}'
    row = contracts.parse_whisperx(spark.createDataFrame([("s", good)], "stream_id string, value string")).first()
    assert (row.text, row.speaker, row.segment_index, len(row.words), row.attributes["extra"], row.chars[0].text) == ("hi", "A", 0, 1, "1", "h")
    for bad in ("{}", '{"segments": [{"text": ""}]}', '{"segments": [{"text": "x", "start": 3, "end": 1}]}'):
        with pytest.raises(Exception, match="segments array|transcript"):
            contracts.parse_whisperx(spark.createDataFrame([("s", bad)], "stream_id string, value string")).collect()


def test_trees(spark):
    from itertools import product

    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 4):
        for _ in range(15):
            w = rng.normal(size=(n + 1, n + 1))

            def tree(h):
                return sum(x == 0 for x in h) == 1 and all(climbs(h, d) for d in range(1, n + 1))  # noqa: B023

            def climbs(h, d):
                for _ in range(n + 1):  # noqa: B023
                    if d == 0:
                        return True
                    d = h[d - 1]
                return False

            best = max((h for h in product(range(n + 1), repeat=n) if all(x != d + 1 for d, x in enumerate(h)) and tree(h)), key=lambda h: sum(w[d + 1, x] for d, x in enumerate(h)))  # noqa: B023
            assert linguistics.best_tree(w) == list(best)
    rows = [("s", d, h, float(h == d - 1)) for d in (1, 2, 3) for h in (0, 1, 2, 3) if d != h]
    found = linguistics.decode_trees(spark.createDataFrame(rows, "sentence_id string, dependent int, head int, score double")).orderBy("word_id").collect()
    assert [r["head"] for r in found] == [0, 1, 2]
    looped = spark.createDataFrame([("s", 1, 2, 0, 1), ("s", 2, 1, 2, 3), ("s", 3, 0, 4, 5)], "sentence_id string, word_id int, head int, start int, end int")
    assert {(r.word_id, r.problem) for r in linguistics.syntax_violations(looped).collect()} == {(1, "it is in a cycle"), (2, "it is in a cycle")}


def test_syntax_scores_align_multiword_tokens(spark):
    line = lambda *c: "\t".join(c)
    word = lambda i, form, upos, head: line(str(i), form, form, upos, "_", "_", str(head), "dep", "_", "_")
    gold = "\n".join(["# sent_id = one", line("1-2", "zum", *"________"), word(1, "zu", "ADP", 3), word(2, "dem", "DET", 3), word(3, "Haus", "NOUN", 0)]) + "\n"
    found = "\n".join(["# sent_id = one", word(1, "zum", "ADP", 2), word(2, "Haus", "NOUN", 0)]) + "\n"
    files = lambda text: spark.createDataFrame([("f", text)], "source string, value string")
    same = {r.metric: r.f1 for r in evaluation.syntax_report(evaluation.parse_conllu(files(gold)), evaluation.parse_conllu(files(gold))).collect()}
    assert set(same.values()) == {1.0}
    part = {r.metric: (r.matches, r.gold, r.found) for r in evaluation.syntax_report(evaluation.parse_conllu(files(gold)), evaluation.parse_conllu(files(found))).collect()}
    assert part["tokens"] == (2, 2, 2) and part["words"] == (1, 3, 2) and part["uas"] == (1, 3, 2)
    with pytest.raises(Exception, match="10 columns"):
        evaluation.parse_conllu(files("1\tx\n")).collect()


def test_lemma_tables(spark):
    words = [("running", "VERB", "run"), ("walked", "VERB", "walk"), ("talked", "VERB", "talk"), ("jumped", "VERB", "jump"), ("went", "VERB", "go"), ("Rome", "PROPN", "Rome"), ("Oslo", "PROPN", "Oslo")]
    table = spark.createDataFrame(words, "form string, upos string, lemma string")
    classes, rules, exceptions = evaluation.lemma_tables(table)
    found = {r.form: r.lemma for r in evaluation.lemmas(table.drop("lemma"), classes, rules, exceptions).collect()}
    assert found == {f: lemma for f, _, lemma in words}
    new = evaluation.lemmas(spark.createDataFrame([("asked", "VERB"), ("Paris", "PROPN")], "form string, upos string"), classes, rules, exceptions)
    assert {r.form: r.lemma for r in new.collect()} == {"asked": "ask", "Paris": "Paris"}


def test_generation(spark):
    turns = spark.createDataFrame([("a b c d",), ("a b c e",), ("x y z",)], "text string")
    chain = markov.transitions(turns)
    assert markov.generate(chain, "a b", 10) == ["a", "b", "c", "d"]
    assert markov.completed_seed(markov.starts(turns), "a") == "a b" and markov.completed_seed(markov.starts(turns), "q") is None
    terms = spark.createDataFrame([(1, "b", 1.0), (1, "a", 2.0)], "doc_id int, term string, weight double")
    assert generation.synthesize(terms, "doc_id", 2).first().text == "A relates to b. B relates to a."
    with pytest.raises(Exception, match="positive"):
        generation.synthesize(terms.withColumn("weight", F.lit(0.0)), "doc_id").collect()


def test_answers_need_predictions(spark):
    asked = spark.createDataFrame([(1, "who?", "a b")], "question_id int, question string, context string")
    with pytest.raises(MissingModel):
        answers.imported_answers(asked, None)
    with pytest.raises(ValueError, match="chunks"):
        answers.answer_with_retrieval(asked, asked, None)


def test_corpus_changes_are_checked(spark):
    docs = corpus.from_texts(spark, ["one", "two"])
    new = spark.createDataFrame([("doc-1", "x")], docs.schema)
    assert corpus.replaced(docs, new).count() == 2 and corpus.document_count(docs, "two").first().n == 1
    with pytest.raises(ValueError, match="already"):
        corpus.added(docs, new)
    with pytest.raises(ValueError, match="not there"):
        corpus.replaced(docs, new.withColumn("id", F.lit("q")))
    with pytest.raises(Exception, match="unique"):
        corpus.validated(docs.union(docs)).collect()


def test_workspace_and_stream(spark):
    path = scratch_path(spark, "workspace")
    space = Workspace(spark, path).ingest(spark.createDataFrame([("a", "red fox"), ("b", "blue sky")], "id string, text string"))
    space.ingest(spark.createDataFrame([("b", "green sky")], "id string, text string"))
    asked = spark.createDataFrame([(1, "green fox")], "query_id int, query string")
    assert {r.document_id for r in space.search(asked).collect()} == {"a", "b"} and space.documents().count() == 2
    assert space.analyze()["core"].count() == 2
    source = scratch_path(spark, "segments")
    segments = spark.createDataFrame([("s", 0, "early draft", 0.0, False), ("s", 0, "final words", 0.0, True)], "stream_id string, segment_index bigint, text string, start_seconds double, is_final boolean")
    segments.write.parquet(source)
    stream = spark.readStream.schema(segments.schema).parquet(source)
    ingest_stream(stream, space, scratch_path(spark, "checkpoint")).awaitTermination(120)
    assert space.documents().filter("id = 's:0'").first().body == "final words"


def test_backends(spark):
    rows = spark.createDataFrame([(1, "aa"), (2, "b"), (3, "aa")], "doc_id bigint, text string")

    def embedder(texts, role):
        return texts.map(lambda t: [float(len(t)), 1.0])

    found = {r.doc_id: r.vector for r in backends.embedded(rows, embedder, preset="e5").collect()}
    assert found == {1: [11.0, 1.0], 2: [10.0, 1.0], 3: [11.0, 1.0]}
    labels = backends.classified(rows, lambda b: b.assign(label="x", score=0.5)[["doc_id", "label", "score"]])
    assert labels.count() == 3
    with pytest.raises(MissingModel):
        backends.classified(rows, None)


def test_operations_are_described_and_checked():
    names = {o["name"]: o for o in operations.schema()}
    assert "top_k" in names["index/index.fuzzySearch"]["parameters"] and len(names) > 50
    with pytest.raises(ValueError, match="no option"):
        operations.validate("lexical/lexical.keywords", {"nonsense": 1})


def test_dates_by_family():
    from textspark.functions.temporal import dates

    def first(text):
        found = dates(text)
        return (found[0].start_year, found[0].end_year, found[0].month, found[0].day) if found else None

    cases = {
        "the charter of 9 Feb 1288 survives": (1288, 1288, 2, 9), "on June 3, 12 BC they met": (-12, -12, 6, 3), "since Oktober 1733": (1733, 1733, 10, None), "May 12 was dry": None,
        "between 1640 and 1655": (1640, 1655, None, None), "the siege of 1701-04": (1701, 1704, None, None), "from 80 BC to 60 BC": (-80, -60, None, None), "pages 1640 and 1655": None,
        "a fourteenth century mill": (1301, 1400, None, None), "im frühen 12. Jahrhundert": (1101, 1133, None, None), "late 3rd century BC": (-234, -201, None, None),
        "the early 1870s": (1870, 1873, None, None), "2000s of people": None, "in the year 455": (455, 455, None, None), "by 1499": (1499, 1499, None, None), "room 1499": None, "in 1500 people": None,
        "the 1812 timestamp in 1812": None, "AD 79": (79, 79, None, None), "a tally of 1450": None,
    }
    for text, want in cases.items():
        assert first(text) == want, text
    said = dates("It was probably not around 1602.")[0]
    assert (said.certainty, said.polarity, said.approximate) == ("hedged", "denies", True)


def test_caseless_spans_in_the_source(spark):
    from textspark.functions import spans

    rows = spark.createDataFrame([("xİSTANBUL y", "stan"), ("aΣ", "ς"), ("abc", ""), (None, "a"), ("éA", "a")], "t string, n string")
    found = [tuple(r.x) if r.x.start is not None else None for r in rows.select(spans.find_caseless_span(F.col("t"), F.col("n")).alias("x")).collect()]
    assert found == [(2, 6, 3, 7), (1, 2, 1, 3), None, None, (1, 2, 2, 3)]


def test_semantic_corpus_and_senses(spark):
    from textspark.operators import semantic

    items = spark.createDataFrame([("i1", " ann ", "bank of a river. The bank lends."), ("i2", "bo", "My bank lends money."), ("i3", None, "Nothing here.")], "item_id string, author string, text string")
    found = semantic.word_occurrences(items, "Bank")
    assert {(r.unit_id, r.author) for r in found.collect()} == {("i1:word-context:0", "ann"), ("i1:word-context:1", "ann"), ("i2:word-context:0", "bo")}
    with pytest.raises(ValueError, match="one token"):
        semantic.word_occurrences(items, "two words")
    known = spark.createDataFrame([("bank of a river.", [1.0, 0.0]), ("The bank lends.", [0.0, 1.0]), ("My bank lends money.", [0.1, 1.0])], "text string, vector array<double>")
    senses = {r.cluster_id: (r.occurrences, r.sources, r.authors, r.representative_unit) for r in semantic.word_senses(found, known).collect()}
    assert senses == {"concept-1": (1, 1, 1, "i1:word-context:0"), "concept-2": (2, 2, 2, "i1:word-context:1")}
    units = found.join(known, "text").select("unit_id", "source_id", F.col("author").alias("speaker"), F.xxhash64("unit_id").alias("sequence_index"), "text", "vector")
    parts = semantic.corpus_semantics(items, units)
    assert parts["lexical"].first().item_count == 3 and parts["authors"].count() == 2
    evidence = parts["concepts"].first()
    assert (evidence.members, evidence.sources, evidence.authors) == (2, 2, 2) and evidence.key_terms == ["money", "my", "the", "lends"]
    assert parts["non_concept"].first().units == 1
    named = semantic.interpreted(parts["concepts"], lambda b: b.assign(label="money", confidence=0.5))
    assert named.count() == 1
    with pytest.raises(Exception, match="0 to 1"):
        semantic.interpreted(parts["concepts"].drop("label"), lambda b: b.assign(label="x", confidence=2.0)).collect()


def test_reports_have_their_sections(spark):
    from textspark.operators import reports

    docs = spark.createDataFrame([(1, "Cats chase mice daily. Cats and mice play well. Mice fear cats greatly."), (2, None)], "doc_id int, text string")
    parts = reports.document_report(docs)
    assert {name: rows.count() for name, rows in parts.items() if name in ("core", "script", "extract", "diagnostics")} == {"core": 2, "script": 2, "extract": 1, "diagnostics": 6}
    whole = reports.corpus_report(docs, spark.createDataFrame([(1, "cats")], "query_id int, query string"))
    assert whole["bm25"].count() == 1 and whole["near_duplicates"].count() == 0 and whole["stats"].first().documents == 2

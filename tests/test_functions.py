"""Text functions on hand-made cases."""

from pyspark.sql import functions as F

from textspark.functions import segmentation as S
from textspark.functions import text as T
from textspark.operators import fuzzy, markov, predictions, search, similarity, vectors
from textspark.sources import transcripts


def test_sentences():
    text = "Dr. Smith wrote pi is 3.14. Wait... Really？ Yes!"
    assert [text[a:b] for a, b in S.sentence_spans(text)] == ["Dr. Smith wrote pi is 3.14.", "Wait...", "Really？", "Yes!"]
    assert S.sentence_spans("") == [] and S.sentence_spans("  ") == []
    assert [x for x in S.sentence_spans("你好世界。再见！")] == [(0, 5), (5, 8)]


def test_tokens(spark):
    row = spark.createDataFrame([("See https://x.org/a, mail a.b@c.de or @me #tag 3.14 it’s",)], "text string")
    kinds = row.select(F.explode(T.token_array("text")).alias("t")).select("t", T.token_kind(F.col("t")).alias("k")).collect()
    assert [(r.t, r.k) for r in kinds] == [
        ("See", "word"), ("https://x.org/a", "url"), ("mail", "word"), ("a.b@c.de", "email"), ("or", "word"), ("@me", "mention"), ("#tag", "hashtag"), ("3.14", "number"), ("it’s", "word"),
    ]


def test_stems(spark):
    rows = spark.createDataFrame([(t,) for t in ("running", "tested", "cities", "hat", "relational", "stopped")], "t string")
    assert [r[0] for r in rows.select(T.stem(F.col("t"))).collect()] == ["run", "test", "city", "hat", "relate", "stop"]


def test_lines(spark):
    rows = spark.createDataFrame([("",), ("a",), ("a\n",), ("a\nb",), ("\n\n",)], "t string")
    assert [r[0] for r in rows.select(T.line_count(F.col("t"))).collect()] == [0, 1, 1, 2, 2]


def test_osa():
    assert S.osa_distance("strategy", "stratgey", 2) == 1
    assert S.osa_distance("search", "searh", 1) == 1
    assert S.osa_distance("search", "fetch", 1) == 2
    assert S.osa_distance("ab", "ba", 1) == 1


def test_fuzzy(spark):
    words = ["strategy", "stratgey", "kitchen", "éaimer", "aimer", "aimert"]
    vocabulary = spark.createDataFrame([(w, i + 1) for i, w in enumerate(words)], "term string, df bigint")
    asked = spark.createDataFrame([(w,) for w in ("stratgey", "aimer", "abc")], "query_term string")
    found = {(r.query_term, r.term) for r in fuzzy.expand_terms(asked, vocabulary).collect()}
    assert found == {(a, b) for a in ("stratgey", "aimer") for b in words if a != b and S.osa_distance(a, b, 1) == 1}


def test_century():
    assert S.century_years(18) == (1701, 1800)
    assert S.century_years(5, bc=True) == (-500, -401)
    assert S.century_years(19, part="early") == (1801, 1833)


def test_simhash():
    assert S.fnv1a64(b"") == 0xCBF29CE484222325 and S.fnv1a64(b"a") == 0xAF63DC4C8601EC8C
    assert S.simhash([]) == 0 and S.simhash(["a"]) == S.fnv1a64(b"a")


def test_empty_shingle_sets_are_alike(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c"), (3, "a b c d e f g"), (4, "a b c d e f g h")], "doc_id bigint, text string")
    rows = {(r.left_id, r.right_id): round(r.score, 6) for r in similarity.near_duplicate_pairs(docs).collect()}
    assert rows == {(1, 2): 1.0, (3, 4): 0.75}


def test_bm25_order(spark):
    docs = spark.createDataFrame([(1, "rust cargo crates text analysis"), (2, "rust cargo crates text analysis pipeline"), (3, "video frames")], "doc_id bigint, text string")
    asked = spark.createDataFrame([(0, "rust text analysis")], "query_id bigint, query string")
    assert [r.doc_id for r in search.bm25(docs, asked).orderBy("rank").collect()] == [1, 2]


def test_cosine_and_softmax(spark):
    row = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    got = row.select(vectors.cosine("a", "b").alias("x"), vectors.cosine("a", "z").alias("y"), vectors.softmax(F.col("z")).alias("s")).first()
    assert round(got.x, 6) == 0.707107 and got.y == 0 and got.s == [0.5, 0.5]


def test_transcripts(spark):
    files = spark.createDataFrame([("a", "1\n00:00:01,000 --> 00:00:02,511\nHello\n\n"), ("b", "WEBVTT\n\ncue\n00:00:03.000 --> 00:00:04.250 x:1\nHi\nyou\n")], "stream_id string, value string")
    rows = {r.stream_id: (r.segment_index, r.start_seconds, r.end_seconds, r.text) for r in transcripts.parse_subtitles(files).collect()}
    assert rows == {"a": (1, 1.0, 2.511, "Hello"), "b": (0, 3.0, 4.25, "Hi you")}
    segments = spark.createDataFrame([("s", 0, 1.25, 3.5, "Hello"), ("s", 1, 63.0, 65.125, "World")], "stream_id string, segment_index bigint, start_seconds double, end_seconds double, text string")
    assert transcripts.format_srt(segments).first().srt == "1\n00:00:01,250 --> 00:00:03,500\nHello\n\n2\n00:01:03,000 --> 00:01:05,125\nWorld\n\n"
    wrong = spark.createDataFrame([("s", 0, 1.0, 0.5, "Hello.")], segments.schema)
    assert transcripts.format_webvtt(wrong).first().webvtt == "WEBVTT\n\n00:00:01.000 --> 00:00:01.000\nHello.\n"


def test_subtitle_markup(spark):
    row = spark.createDataFrame([("<i>Hi</i> <00:00:01.000>there &amp;lt; <x>",)], "t string")
    assert row.select(transcripts.clean_subtitle("t")).first()[0] == "Hi there < <x>"


def test_missing_model():
    try:
        predictions.classify(None)
    except predictions.MissingModel:
        return
    raise AssertionError


def test_perplexity_of_unseen(spark):
    chain = markov.transitions(spark.createDataFrame([("a b c a b c",)], "text string"), 1)
    asked = spark.createDataFrame([(1, "a b c"), (2, "a c")], "doc_id bigint, text string")
    assert {r.doc_id: r.perplexity for r in markov.perplexity(asked, chain, 1).collect()} == {1: 1.0, 2: float("inf")}

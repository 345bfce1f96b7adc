"""Registered queries of linguistic layers, predictions, answers, generation and evaluation, with DuckDB SQL. Layers are
made from the tables by arithmetic that SQL repeats, as no model runs here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textspark.functions import patterns as P
from textspark.functions import text as T
from textspark.operators import answers, evaluation, generation, lexical, linguistics, predictions
from textspark.plans.index_queries import _chunks
from textspark.plans.lexical_queries import POSTINGS, STOP, TOKENS, _quoted, _table
from textspark.plans.report_queries import sentence_ctes
from textspark.plans.search_queries import _benchmark, _bm25

TAGS = ("DET", "ADJ", "NOUN", "VERB", "ADV", "ADP", "PART", "AUX", "X")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns' tokens as words 1 to n of a sentence, with a tag by length and a head by arithmetic."""
    turns = _table(spark, sf_dir, "conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("sentence_id"), "text")
    once = T.bound(T.token_array("text"), lambda t: F.struct(F.size(t).alias("n"), t.alias("t")))  # else n is counted again for every word
    rows = turns.select("sentence_id", F.inline(F.array(once))).select("sentence_id", "n", F.posexplode("t").alias("pos", "form"))
    tag = F.get(F.array(*map(F.lit, TAGS)), F.length("form") % len(TAGS))
    return rows.select("sentence_id", (F.col("pos") + 1).alias("word_id"), "pos", "form", tag.alias("upos"), ((F.length("form") * 7 + F.col("pos")) % (F.col("n") + 1)).alias("head"), (F.col("pos") * 10 % 70).alias("start"), (F.col("pos") * 10 % 70 + F.length("form") - 3).alias("end"))


def token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linguistics.token_spans(_docs(spark, sf_dir)).select("doc_id", "pos", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"))


def token_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    rows = linguistics.token_sentences(linguistics.token_spans(docs), linguistics.sentence_spans(docs))
    return rows.groupBy("doc_id", "sentence").agg(F.count(F.lit(1)).alias("tokens"), F.min("pos").alias("first"))


def annotation_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens by the sentence node that holds them."""
    graph = linguistics.annotation_graph(_docs(spark, sf_dir))
    return graph["tokens"].groupBy("doc_id", "sentence_id").agg(F.count(F.lit(1)).alias("tokens"), F.min("node_id").alias("first"))


def subword_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of eight characters of the text against tokens."""
    docs = _docs(spark, sf_dir)
    n = F.greatest(F.ceil(F.length("text") / 8), F.lit(1)).cast("int")
    pieces = docs.filter("text IS NOT NULL").select("doc_id", F.length("text").alias("l"), F.explode(F.sequence(F.lit(0), n - 1)).alias("subword"))
    pieces = pieces.select("doc_id", "subword", (F.col("subword") * 8).alias("start"), F.least(F.col("subword") * 8 + 8, F.col("l")).alias("end"))
    found = linguistics.aligned_subwords(pieces, linguistics.token_spans(docs))
    return found.groupBy("doc_id", "pos").agg(F.min("subword").alias("first"), F.count(F.lit(1)).alias("pieces"))


def caseless_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 'THE' of each document in the source's code points and bytes."""
    from textspark.functions import spans

    rows = _docs(spark, sf_dir).select("doc_id", spans.find_caseless_span(F.col("text"), F.lit("THE")).alias("x"))
    return rows.filter("x.start IS NOT NULL").select("doc_id", "x.start", "x.end", "x.byte_start")


def contraction_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents, and some that have clitics, in the document's language."""
    rows = T.tokens(_docs(spark, sf_dir)).join(_docs(spark, sf_dir).select("doc_id", "lang"), "doc_id").select("lang", "token")
    more = spark.range(1).select(F.inline(F.arrays_zip(F.array(*map(F.lit, ("en", "en", "en", "en", "de", "es", "fr"))).alias("lang"), F.array(*map(F.lit, ("Don't", "CANNOT", "we’ll", "isn", "Zur", "DEL", "del"))).alias("token"))))
    split = linguistics.split_contraction(F.col("lang"), F.col("token"))
    return rows.unionByName(more).distinct().withColumn("parts", F.array_join(split, "+")).filter("parts IS NOT NULL")


def phrase_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linguistics.phrase_chunks(_words(spark, sf_dir), ["sentence_id"])


def syntax_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linguistics.syntax_violations(_words(spark, sf_dir))


def feature_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("doc_id") % 5 == 0, F.lit("_")).otherwise(F.concat(F.lit("Src="), "source", F.lit("|Lang="), "lang"))
    rows = _docs(spark, sf_dir).select("doc_id", linguistics.features(raw).alias("f"))
    return rows.select("doc_id", linguistics.feature_text(F.col("f")).alias("feats"), linguistics.feature_text(linguistics.with_feature(F.col("f"), "Lang", "x")).alias("changed"), F.col("f")["Src"].alias("src"))


def label_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags, relations, entity labels and language tags that the tables' values make."""
    rows = _docs(spark, sf_dir)
    label = F.when(F.col("doc_id") % 3 == 0, "O").when(F.col("doc_id") % 3 == 1, F.concat(F.lit("B-"), F.upper("lang"))).otherwise(F.upper("lang"))
    entity, rel = linguistics.entity_label(label), linguistics.relation(F.concat_ws(":", F.lit("nsubj"), F.when(F.col("doc_id") % 2 == 0, F.lit("pass"))))
    return rows.select("doc_id", entity["prefix"].alias("prefix"), entity["entity_type"].alias("entity_type"), rel["base"].alias("base"), rel["subtype"].alias("subtype"), linguistics.primary_subtag(F.concat(F.upper("lang"), F.lit("-XX"))).alias("language"), linguistics.universal_tag(F.when(F.col("doc_id") % 2 == 0, " noun").otherwise("thing")).alias("upos"))


def _language_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0.5 and up for the document's language, 0.4 for English, 0.1 for French."""
    rows = _docs(spark, sf_dir)
    pairs = F.array(F.struct(F.col("lang").alias("language"), (F.lit(0.5) + F.col("doc_id") % 4 / 10).alias("score")), F.struct(F.lit("xx").alias("language"), F.lit(0.4).alias("score")), F.struct(F.lit("yy").alias("language"), F.lit(0.1).alias("score")))
    return rows.select("doc_id", F.inline(pairs))


def language_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = linguistics.language_decisions(_docs(spark, sf_dir), _language_scores(spark, sf_dir))
    return rows.select("doc_id", "status", "language", F.round("confidence", 6).alias("confidence"), F.round("margin", 6).alias("margin"), F.array_join("candidates", ",").alias("candidates"))


def sentence_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages by sentence, the document's where the sentence has none, and the reports on two operations."""
    decided = linguistics.language_decisions(_docs(spark, sf_dir), _language_scores(spark, sf_dir))
    sentence = _docs(spark, sf_dir).select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("sentence"), "lang")
    sentence = sentence.select("doc_id", "sentence", F.when(F.col("sentence") == 0, F.concat("lang", F.lit("-A"))).alias("language"))
    routes = linguistics.routed(sentence, decided)
    producers = spark.range(1).select(F.inline(F.array(F.struct(F.lit("pos").alias("operation"), F.lit("en").alias("language"), F.lit("supported").alias("support"), F.lit("import").alias("producer")))))
    reports = linguistics.operation_reports(routes, producers).filter("operation IN ('pos', 'chunks')")
    kept = linguistics.kept_sentences(routes, reports, "pos").select("doc_id", "sentence", F.lit(True).alias("kept"))
    return reports.join(routes, ["doc_id", "sentence"]).join(kept, ["doc_id", "sentence"], "left").select("doc_id", "sentence", "language", "route", "operation", "support", "reason", F.coalesce("kept", F.lit(False)).alias("kept"))


def language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    decided = linguistics.language_decisions(docs, _language_scores(spark, sf_dir))
    sentence = docs.select("doc_id", F.explode(F.when(F.col("doc_id") % 3 == 0, F.array("lang", F.lit("qq"))).otherwise(F.array("lang"))).alias("language"))
    scripts = docs.select("doc_id", F.lit(False).alias("is_mixed"))
    rows = linguistics.language_profile(decided, sentence, scripts)
    return rows.select("doc_id", "language", "status", F.array_join("sentence_languages", ",").alias("spoken"), "is_mixed")


def innermost_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words' spans in windows of 20, 30 and 40 characters, of the words of their sentence."""
    words = _words(spark, sf_dir).filter("pos < 12").select("sentence_id", F.col("word_id").alias("span_id"), F.col("start"), (F.col("start") + 5).alias("end"))
    boxes = words.select("sentence_id", F.col("span_id").alias("container_id"), F.col("start"), (F.col("start") + 20 + F.col("span_id") % 3 * 10).alias("end"))
    return linguistics.innermost(words, boxes).select("sentence_id", "span_id", "container_id")


def _logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("doc_id"), F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double") * 10).alias("logits"), F.lit(0).alias("pos"), F.lit(0).alias("start"), F.lit(1).alias("end"))


def nli_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions.decode_nli(_logits(spark, sf_dir), ["Contradiction", "neutral", "ENTAILMENT"])
    return rows.select("doc_id", "label", *(F.round(c, 6).alias(c) for c in predictions.NLI))


def decoded_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions.decode_sequence(_logits(spark, sf_dir), ["a", "b", "c"], 2).withColumn("score", F.round("score", 6))


def token_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions.token_predictions(_logits(spark, sf_dir), ["O", "B-PER", "I-PER"])
    return rows.select("doc_id", "label", F.round("score", 6).alias("score"))


def entailment_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _logits(spark, sf_dir)
    return rows.select("doc_id", F.round(predictions.entailment_score(F.col("logits"), 2), 6).alias("alone"), F.round(predictions.entailment_score(F.col("logits"), 2, 0), 6).alias("pair"))


def _scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "labels")
    part = lambda name, value: rows.select("doc_id", F.lit(name).alias("label"), value.cast("double").alias("score"))
    return part("positive", F.col("quality") + 0.5).unionByName(part("NEG", F.col("toxic") * 2 + F.col("doc_id") % 7 / 10)).unionByName(part("other", F.lit(0.25)))


def zero_shot_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions.zero_shot(_scored_labels(spark, sf_dir), ["positive", "NEG"], 2, normalize=True).withColumn("score", F.round("score", 6))


def sentiment_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions.sentiment(_scored_labels(spark, sf_dir))
    return rows.select("doc_id", F.round("positive", 6).alias("positive"), F.round("negative", 6).alias("negative"), F.round("compound", 6).alias("compound"))


def synthesized_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = lexical.top_terms(_docs(spark, sf_dir), 5).select("doc_id", "term", F.col("tf").alias("n"))
    rows = generation.synthesize(generation.terms_from_counts(top, "doc_id"), "doc_id")
    return rows.select("doc_id", "text", F.round("confidence", 6).alias("confidence"))


def event_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("who"), F.concat(F.lit("Text "), "event_type", F.lit("/x-Web")).alias("label"), F.when(F.col("event_id") % 3 == 0, F.lit(None).cast("double")).otherwise(F.col("event_id") % 5 - 1).alias("score"))
    return generation.terms_from_events(rows, "who")


def analysis_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of turns, every third and fourth one a named entity."""
    words = _words(spark, sf_dir).select(F.col("sentence_id").alias("doc_id"), "pos", F.col("form").alias("surface"), F.lower("form").alias("normalized"), F.lit(None).cast("string").alias("lemma"))
    entities = words.filter("pos % 4 = 2").select("doc_id", F.col("pos").alias("token_start"), (F.col("pos") + 2).alias("token_end"), F.lit("ENTITY").alias("name"))
    return generation.analysis_terms(words, "entity", entities)


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two imported answers a question: its first and second word."""
    rows = _benchmark(spark, sf_dir).select(F.col("query_id").alias("question_id"), F.split("query", " ").alias("w"))
    attributes = lambda a: F.create_map(F.lit("char_start"), F.lit(a), F.lit("char_end"), F.lit("x"))
    pair = F.array(F.struct(F.lit(1).alias("seq"), F.get("w", F.lit(0)).alias("text"), F.lit(0.5).alias("score"), attributes("3").alias("attributes")), F.struct(F.lit(2).alias("seq"), F.get("w", F.lit(1)).alias("text"), (0.25 + F.col("question_id") % 2 / 2).alias("score"), attributes("4").alias("attributes")))
    return rows.select("question_id", F.inline(pair))


def imported_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _benchmark(spark, sf_dir).select(F.col("query_id").alias("question_id"), F.lit("who?").alias("question"), F.col("query").alias("context"))
    return answers.imported_answers(asked, _spans(spark, sf_dir)).select("question_id", "answer", "score", "char_start", "rank")


def answered_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _benchmark(spark, sf_dir).select(F.col("query_id").alias("question_id"), F.when(F.col("query_id") % 5 == 1, F.lit(" ")).otherwise("who?").alias("question"), F.when(F.col("query_id") % 5 == 2, F.lit("")).otherwise(F.col("query")).alias("context"))
    return answers.answered_batch(asked, _spans(spark, sf_dir).filter("question_id % 5 != 3"))


def index_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _benchmark(spark, sf_dir).filter("query_id % 4 = 0").select(F.col("query_id").alias("question_id"), F.col("query").alias("question"))
    rows = answers.answer_with_index(_chunks(spark, sf_dir), asked, _spans(spark, sf_dir), 3, 1)
    return rows.select("question_id", "answer", "score", "rank", "chunk_id")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "labels").select("doc_id", (F.col("doc_id") % 3).alias("part"), F.col("quality").alias("gold"), F.when(F.col("doc_id") % 4 == 0, F.col("toxic")).otherwise(F.col("quality")).alias("found"))


def evaluation_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir)
    return evaluation.accuracy(rows).join(evaluation.macro_f1(rows)).select("n", F.round("accuracy", 6).alias("accuracy"), "labels", F.round("macro_f1", 6).alias("macro_f1"))


def evaluation_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("lang", F.round(F.col("n_chars") / 100).alias("gold"), (F.col("doc_id") * 37 % 101).cast("double").alias("found"))
    return evaluation.correlation(rows, by=["lang"]).select("lang", "n", F.round("spearman", 6).alias("spearman"), F.round("mae", 6).alias("mae"))


def boundary_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence ends against the ends of all but every third sentence, by language."""
    docs = _docs(spark, sf_dir)
    gold = linguistics.sentence_spans(docs).select(F.col("doc_id").alias("case_id"), "ordinal", F.col("end").alias("boundary"))
    found = gold.filter("ordinal % 3 != 2").select("case_id", (F.col("boundary") + F.when(F.col("ordinal") % 7 == 0, 1).otherwise(0)).alias("boundary"))
    report = evaluation.boundary_report(gold.select("case_id", "boundary"), found, docs.select(F.col("doc_id").alias("case_id"), F.col("lang").alias("group")))
    return report.filter("level != 'case'").select("level", "name", "matches", "gold", "found", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


def entity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact spans with type, by type."""
    gold = linguistics.token_spans(_docs(spark, sf_dir)).filter("pos % 5 = 0").select("doc_id", "start", "end", (F.length("token") % 3).alias("entity_type"))
    found = gold.withColumn("entity_type", F.when(F.col("start") % 2 == 0, F.lit(1)).otherwise(F.col("entity_type")))
    report = evaluation.agreement(gold, found, ["doc_id", "start", "end", "entity_type"], ["entity_type"])
    return report.select("entity_type", "matches", "gold", "found", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


def metric_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics by source against limits at a revision."""
    reports = _docs(spark, sf_dir).groupBy(F.col("source").alias("metric")).agg((F.count(F.lit(1)) / 100).alias("value")).withColumn("revision", F.when(F.endswith("metric", F.lit("1")), "old").otherwise("new")).filter("metric NOT LIKE '%2'")
    limits = _docs(spark, sf_dir).select(F.col("source").alias("metric"), F.lit(0.1).alias("least"), F.lit("new").alias("revision")).distinct()
    return evaluation.gates(reports, limits).select("metric", "status", F.round("value", 6).alias("value"))


def recall_at_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textspark.operators import search

    hits = search.bm25(_docs(spark, sf_dir), _benchmark(spark, sf_dir), 1)
    judged = _docs(spark, sf_dir).join(F.broadcast(_benchmark(spark, sf_dir).select("query_id").distinct()), F.col("doc_id") % 40 == F.col("query_id")).select("query_id", "doc_id")  # the stated queries
    return evaluation.ranking_at_one(hits, judged).withColumn("recall_at_1", F.round("recall_at_1", 6))


def _conllu(spark: SparkSession, sf_dir: str, change: bool = False) -> DataFrame:
    """A CoNLL-U file for each conversation, a sentence a turn; ``change`` moves heads and tags of some words."""
    words = _words(spark, sf_dir)
    upos = F.when(F.lit(change) & (F.col("word_id") % 4 == 0), "X").otherwise(F.col("upos"))
    head = F.when(F.lit(change) & (F.col("word_id") % 3 == 0), 0).otherwise(F.col("word_id") - 1)
    row = F.concat_ws("\t", F.col("word_id").cast("string"), "form", F.lower("form"), upos, F.lit("_"), F.lit("_"), head.cast("string"), F.lit("dep"), F.lit("_"), F.lit("_"))
    sentences = words.groupBy("sentence_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_id", row.alias("r")))), lambda x: x["r"]), "\n").alias("body"))
    text = F.concat(F.lit("# sent_id = "), "sentence_id", F.lit("\n1.1\te\te\t_\t_\t_\t_\t_\t_\t_\n"), "body", F.lit("\n"))
    return sentences.groupBy(F.split("sentence_id", ":")[0].alias("source")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sentence_id", text.alias("t")))), lambda x: x["t"]), "\n").alias("value"))


def conllu_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.parse_conllu(_conllu(spark, sf_dir)).select("sent_id", "word_id", "form", "lemma", "upos", "head")


def syntax_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = evaluation.syntax_report(evaluation.parse_conllu(_conllu(spark, sf_dir)), evaluation.parse_conllu(_conllu(spark, sf_dir, True)))
    return report.select("metric", "matches", "gold", "found", F.round("f1", 6).alias("f1"))


def iob_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _words(spark, sf_dir)
    row = F.concat_ws("\t", F.col("word_id").cast("string"), "form", F.when(F.col("word_id") % 3 == 0, "B-PER").otherwise("O"))
    body = words.groupBy("sentence_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_id", row.alias("r")))), lambda x: x["r"]), "\n").alias("b"))
    files = body.select(F.col("sentence_id").alias("source"), F.concat(F.lit("# x\n"), "b").alias("value"))
    return evaluation.parse_iob(files).select("source", F.col("position").cast("bigint").alias("position"), "token", "label")


def xquad_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _benchmark(spark, sf_dir)
    answer = F.struct(F.split("query", " ")[0].alias("text"), F.lit(0).alias("answer_start"))
    paragraph = F.struct(F.col("query").alias("context"), F.array(F.struct(F.col("query_id").cast("string").alias("id"), F.lit("what?").alias("question"), F.array(answer).alias("answers"))).alias("qas"))
    files = rows.groupBy((F.col("query_id") % 4).alias("f")).agg(F.to_json(F.struct(F.array(F.struct(F.lit("t").alias("title"), F.collect_list(paragraph).alias("paragraphs"))).alias("data"))).alias("value"))
    return evaluation.parse_xquad(files).select("question_id", "question", "answer", "answer_start", F.md5("context").alias("digest"))


QUERIES = {
    f.__name__: f
    for f in (
        token_spans, token_sentences, annotation_graph, subword_alignment, caseless_spans, contraction_splits, phrase_chunks, syntax_violations, feature_maps, label_codecs, language_decisions, sentence_routing,
        language_profiles, innermost_containers, nli_decisions, decoded_sequences, token_predictions, entailment_scores, zero_shot_labels, sentiment_scores, synthesized_texts, event_terms,
        analysis_terms, imported_answers, answered_batch, index_answers, evaluation_accuracy, evaluation_correlation, boundary_scores, entity_scores, metric_gates, recall_at_one, conllu_words,
        syntax_scores, iob_tokens, xquad_questions,
    )
}

_TOK = _quoted(P.TOKEN)
_SPANS = f"""ts AS (SELECT doc_id, pos, e - length(token) AS start, e AS "end", token FROM (SELECT doc_id, pos, token, sum(g + length(token)) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS e FROM (SELECT doc_id, unnest(t) AS token, unnest(list_transform(g[1:len(t)], lambda x: length(x))) AS g, generate_subscripts(t, 1) - 1 AS pos
    FROM (SELECT doc_id, regexp_extract_all(text, {_TOK}) AS t, regexp_split_to_array(text, {_TOK}) AS g FROM documents))))"""
_SSP = sentence_ctes() + r""", sspan AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS ordinal, a - 1 + length(p) - length(regexp_replace(p, '^\s+', '')) AS s, a - 1 + length(regexp_replace(p, '\s+$', '')) AS z FROM (SELECT doc_id, a, substring(text, a, e - a + 1) AS p FROM ss JOIN sd USING (doc_id) WHERE e >= a) WHERE regexp_replace(p, '\s+', '', 'g') <> '')"""
_W = f"""w AS (SELECT sentence_id, pos + 1 AS word_id, pos, form, {list(TAGS)}[length(form) % {len(TAGS)} + 1] AS upos, (length(form) * 7 + pos) % (n + 1) AS head, pos * 10 % 70 AS start, pos * 10 % 70 + length(form) - 3 AS "end", n
    FROM (SELECT conv_id || ':' || turn AS sentence_id, len(t) AS n, unnest(t) AS form, generate_subscripts(t, 1) - 1 AS pos FROM (SELECT conv_id, turn, regexp_extract_all(text, {_TOK}) AS t FROM conversations)))"""
_DECIDED = """dd AS (SELECT doc_id, lang, 0.5 + doc_id % 4 / 10 AS s, (length(regexp_replace(coalesce(text, ''), '[^A-Za-zÀ-ɏ]', '', 'g')) > 0) AS latin FROM documents),
    dw AS (SELECT doc_id, len(list_filter(regexp_extract_all(coalesce(text, ''), {tok}), lambda x: regexp_matches(x, '\\p{{L}}'))) AS n FROM documents), de AS (SELECT doc_id, lang, s, CASE WHEN n < 2 THEN 'too_short' WHEN round(s - 0.4, 9) >= 0.25 THEN 'detected' ELSE 'ambiguous' END AS status FROM dd JOIN dw USING (doc_id))""".format(tok=_TOK)
_L3 = "lg AS (SELECT vec_id AS doc_id, exp(x[1]) AS a, exp(x[2]) AS b, exp(x[3]) AS c FROM (SELECT vec_id, list_transform(embedding[1:3], lambda v: v::DOUBLE * 10) AS x FROM embeddings)), sm AS (SELECT doc_id, a / (a + b + c) AS a, b / (a + b + c) AS b, c / (a + b + c) AS c, c / (a + c) AS pair FROM lg)"
_LABELS = "sl AS (SELECT doc_id, 'positive' AS label, quality + 0.5 AS score FROM labels UNION ALL SELECT doc_id, 'NEG', toxic * 2 + doc_id % 7 / 10 FROM labels)"
_QA = "qa AS (SELECT item_id AS question_id, 1 AS seq, string_split(text, ' ')[1] AS answer, 0.5 AS score, 3 AS char_start FROM benchmark UNION ALL SELECT item_id, 2, string_split(text, ' ')[2], 0.25 + item_id % 2 / 2, 4 FROM benchmark), qr AS (SELECT *, (row_number() OVER (PARTITION BY question_id ORDER BY score DESC, seq))::INT AS rank FROM qa WHERE answer IS NOT NULL)"
_PRF = "round(CASE WHEN f > 0 THEN m / f ELSE 0 END, 6) AS precision, round(CASE WHEN g > 0 THEN m / g ELSE 0 END, 6) AS recall, round(CASE WHEN m > 0 THEN 2 * m / (f + g) ELSE 0 END, 6) AS f1"
_P = "p AS (SELECT quality AS gold, CASE WHEN doc_id % 4 = 0 THEN toxic ELSE quality END AS found FROM labels)"

ORACLE_SQL = {
    "token_spans": f'WITH {_SPANS} SELECT doc_id, pos, start, "end" FROM ts',
    "token_sentences": f'WITH {_SPANS}, {_SSP} SELECT doc_id, sentence, count(*) AS tokens, min(pos) AS first FROM (SELECT ts.doc_id, pos, ordinal AS sentence FROM ts LEFT JOIN sspan ON ts.doc_id = sspan.doc_id AND start >= s AND start < z) GROUP BY ALL',
    "annotation_graph": f"""WITH {_SPANS}, {_SSP}, n AS (SELECT doc_id, count(*) AS n FROM ts GROUP BY ALL), x AS (SELECT ts.doc_id, pos, min(ordinal) AS o FROM ts LEFT JOIN sspan ON ts.doc_id = sspan.doc_id AND start >= s AND "end" <= z GROUP BY ALL)
        SELECT doc_id, coalesce(o, 0) + n AS sentence_id, count(*) AS tokens, min(pos) AS first FROM x JOIN n USING (doc_id) GROUP BY ALL""",
    "subword_alignment": f"""WITH {_SPANS}, p AS (SELECT doc_id, l, unnest(range(0, greatest(ceil(l / 8), 1)::BIGINT)) AS k FROM (SELECT doc_id, length(text) AS l FROM documents)) SELECT p.doc_id, pos, min(k) AS first, count(*) AS pieces FROM p JOIN ts ON p.doc_id = ts.doc_id AND k * 8 < "end" AND start < least(k * 8 + 8, l) AND k * 8 < l GROUP BY ALL""",
    "caseless_spans": "WITH x AS (SELECT doc_id, text, strpos(lower(text), 'the') - 1 AS s FROM documents) SELECT doc_id, s AS start, s + 3 AS \"end\", strlen(substring(text, 1, s)) AS byte_start FROM x WHERE s >= 0",
    "contraction_splits": f"""WITH {TOKENS}, x AS (SELECT DISTINCT lang, token FROM tok JOIN documents USING (doc_id) UNION SELECT * FROM (VALUES ('en', 'Don''t'), ('en', 'CANNOT'), ('en', 'we’ll'), ('en', 'isn'), ('de', 'Zur'), ('es', 'DEL'), ('fr', 'del'))),
        m AS (SELECT * FROM (VALUES {', '.join(f"('{lang}', '{form}', '{parts.replace(' ', '+')}')" for lang, words in linguistics.CONTRACTIONS.items() for form, parts in words.items())}) AS v(lang, form, parts)),
        y AS (SELECT x.lang, token, CASE WHEN x.lang = 'en' THEN CASE WHEN lower(token) = 'cannot' THEN token[:3] || '+' || token[4:] WHEN regexp_matches(token, '^[\\p{{L}}\\p{{N}}]+[nN][''’][tT]$') THEN token[:-4] || '+' || token[-3:]
          WHEN regexp_matches(token, '^[\\p{{L}}\\p{{N}}]+[''’](?i:s|m|re|ve|ll|d)$') THEN regexp_replace(token, '([''’])', '+\\1') END ELSE parts END AS parts FROM x LEFT JOIN m ON x.lang = m.lang AND lower(token) = form) SELECT * FROM y WHERE parts IS NOT NULL""",
    "phrase_chunks": f"""WITH {_W}, c AS (SELECT sentence_id, string_agg(CASE upos WHEN 'DET' THEN 'D' WHEN 'ADJ' THEN 'N' WHEN 'NOUN' THEN 'N' WHEN 'VERB' THEN 'V' WHEN 'AUX' THEN 'V' WHEN 'ADV' THEN 'A' WHEN 'PART' THEN 'T' WHEN 'ADP' THEN 'P' ELSE 'x' END, '' ORDER BY pos) AS c FROM w GROUP BY ALL),
        m AS (SELECT sentence_id, unnest(x) AS m, unnest(list_transform(g[1:len(x)], lambda y: length(y))) AS g, generate_subscripts(x, 1) AS k FROM (SELECT sentence_id, regexp_extract_all(c, 'P[DN]*|[DN]N*|[VA][VAT]*') AS x, regexp_split_to_array(c, 'P[DN]*|[DN]N*|[VA][VAT]*') AS g FROM c)),
        s AS (SELECT *, sum(g + length(m)) OVER (PARTITION BY sentence_id ORDER BY k)::BIGINT AS e FROM m), r AS (SELECT sentence_id, m, e - length(m) AS token_start, e AS token_end FROM s)
        SELECT sentence_id, CASE WHEN m[1] = 'P' THEN 'prepositional' WHEN m[1] IN ('D', 'N') THEN 'noun' ELSE 'verb' END AS kind, token_start, token_end, CASE WHEN m[1] = 'P' THEN token_start WHEN m[1] IN ('D', 'N') THEN token_end - 1 WHEN strpos(m, 'V') > 0 THEN token_start + strpos(m, 'V') - 1 ELSE token_start END AS head FROM r""",
    "syntax_violations": f"""WITH RECURSIVE {_W}, ok AS (SELECT sentence_id, word_id FROM w WHERE head = 0 UNION ALL SELECT w.sentence_id, w.word_id FROM w JOIN ok ON w.sentence_id = ok.sentence_id AND w.head = ok.word_id AND w.head > 0), x AS (SELECT *, count(*) FILTER (head = 0) OVER (PARTITION BY sentence_id) AS r, lag(start) OVER (PARTITION BY sentence_id ORDER BY word_id) AS b FROM w)
        SELECT sentence_id, word_id, 'it is its own head' AS problem FROM x WHERE head = word_id UNION ALL SELECT sentence_id, word_id, 'not one root' FROM x WHERE r <> 1 AND word_id = 1
        UNION ALL SELECT sentence_id, word_id, 'its span goes back' FROM x WHERE start < b UNION ALL SELECT sentence_id, word_id, 'its span ends before it starts' FROM x WHERE "end" < start
        UNION ALL SELECT sentence_id, word_id, 'it is in a cycle' FROM w ANTI JOIN ok USING (sentence_id, word_id)""",
    "feature_maps": "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '_' ELSE 'Lang=' || lang || '|Src=' || source END AS feats, CASE WHEN doc_id % 5 = 0 THEN 'Lang=x' ELSE 'Lang=x|Src=' || source END AS changed, CASE WHEN doc_id % 5 <> 0 THEN source END AS src FROM documents",
    "label_codecs": "SELECT doc_id, ['O', 'B', 'I'][doc_id % 3 + 1] AS prefix, CASE WHEN doc_id % 3 <> 0 THEN upper(lang) END AS entity_type, 'nsubj' AS base, CASE WHEN doc_id % 2 = 0 THEN 'pass' END AS subtype, lang AS language, CASE WHEN doc_id % 2 = 0 THEN 'NOUN' ELSE 'X' END AS upos FROM documents",
    "language_decisions": f"WITH {_DECIDED} SELECT doc_id, status, CASE WHEN status = 'detected' THEN lang END AS language, CASE WHEN status <> 'too_short' THEN round(s, 6) END AS confidence, CASE WHEN status <> 'too_short' THEN round(s - 0.4, 6) END AS margin, CASE WHEN status <> 'too_short' THEN lang || ',xx,yy' END AS candidates FROM de",
    "sentence_routing": f"""WITH {_DECIDED}, r AS (SELECT doc_id, s.k AS sentence, CASE WHEN s.k = 0 THEN lang WHEN status = 'detected' THEN lang END AS language, CASE WHEN s.k = 0 THEN 'sentence' WHEN status = 'detected' THEN 'document' ELSE 'none' END AS route FROM de, (VALUES (0), (1)) AS s(k))
        SELECT doc_id, sentence, language, route, o.o AS operation, CASE WHEN o.o = 'pos' AND language = 'en' THEN 'supported' ELSE 'unsupported' END AS support, CASE WHEN o.o = 'pos' AND language = 'en' THEN NULL WHEN language IS NULL THEN 'no language' ELSE 'no layer for ' || language END AS reason, coalesce(language = 'en', false) AS kept
        FROM r, (VALUES ('pos'), ('chunks')) AS o(o)""",
    "language_profiles": f"WITH {_DECIDED} SELECT doc_id, CASE WHEN status = 'detected' THEN lang END AS language, status, CASE WHEN doc_id % 3 = 0 THEN lang || ',qq' ELSE lang END AS spoken, doc_id % 3 = 0 OR (status <> 'too_short' AND round(s - 0.4, 9) <= 0.12) AS is_mixed FROM de",
    "innermost_containers": f"""WITH {_W}, x AS (SELECT sentence_id, word_id, start AS a, start + 5 AS b, start + 20 + word_id % 3 * 10 AS c FROM w WHERE pos < 12)
        SELECT x.sentence_id, x.word_id AS span_id, arg_min(y.word_id, ((y.c - y.a) * 1000 + y.word_id)) AS container_id FROM x LEFT JOIN x y ON x.sentence_id = y.sentence_id AND x.a >= y.a AND x.b <= y.c GROUP BY ALL""",
    "nli_decisions": f"WITH {_L3} SELECT doc_id, CASE WHEN c >= b AND c >= a THEN 'entailment' WHEN a >= b THEN 'contradiction' ELSE 'neutral' END AS label, round(c, 6) AS entailment, round(b, 6) AS neutral, round(a, 6) AS contradiction FROM sm",
    "decoded_sequences": f"WITH {_L3}, x AS (SELECT doc_id, 'a' AS label, a AS score FROM sm UNION ALL SELECT doc_id, 'b', b FROM sm UNION ALL SELECT doc_id, 'c', c FROM sm) SELECT doc_id, label, round(score, 6) AS score, (row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label))::INT AS rank FROM x QUALIFY rank <= 2",
    "token_predictions": f"WITH {_L3} SELECT doc_id, CASE WHEN a >= b AND a >= c THEN 'O' WHEN b >= c THEN 'B-PER' ELSE 'I-PER' END AS label, round(greatest(a, b, c), 6) AS score FROM sm",
    "entailment_scores": f"WITH {_L3} SELECT doc_id, round(c, 6) AS alone, round(pair, 6) AS pair FROM sm",
    "zero_shot_labels": f"WITH {_LABELS}, t AS (SELECT *, score / sum(score) OVER (PARTITION BY doc_id) AS s FROM sl) SELECT doc_id, label, round(s, 6) AS score, 'This example is about ' || label || '.' AS hypothesis, (row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, label))::INT AS rank FROM t",
    "sentiment_scores": "SELECT doc_id, round(max(quality) + 0.5, 6) AS positive, round(max(toxic * 2 + doc_id % 7 / 10), 6) AS negative, round(max(quality) + 0.5 - max(toxic * 2 + doc_id % 7 / 10), 6) AS compound FROM labels GROUP BY doc_id",
    "synthesized_texts": f"""WITH {POSTINGS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, term) AS rank FROM post WHERE term NOT IN {STOP}), l AS (SELECT doc_id, list(term ORDER BY tf DESC, term) AS t FROM r WHERE rank <= 5 GROUP BY doc_id),
        k AS (SELECT doc_id, t, k, list_transform(range(0, least(len(t), 4)), lambda o: t[(k + o) % len(t) + 1]) AS w FROM l, (VALUES (0), (1), (2)) AS v(k)),
        s AS (SELECT doc_id, k, len(t) AS n, upper(w[1][1]) || w[1][2:] || CASE len(w) WHEN 1 THEN '.' WHEN 2 THEN ' relates to ' || w[2] || '.' WHEN 3 THEN ' connects ' || w[2] || ' and ' || w[3] || ', with context inferred.' ELSE ' connects ' || w[2] || ', ' || w[3] || ', and ' || w[4] || ', with context inferred.' END AS s FROM k)
        SELECT doc_id, string_agg(s, ' ' ORDER BY k) AS text, round(least(0.5, 0.25 + least(any_value(n), 10) * 0.025), 6) AS confidence FROM s GROUP BY doc_id""",
    "event_terms": "WITH e AS (SELECT user_id % 50 AS who, greatest(CASE WHEN event_id % 3 = 0 THEN 1 ELSE event_id % 5 - 1 END, 0)::DOUBLE AS w, unnest(list_transform(list_filter(regexp_split_to_array('Text ' || event_type || '/x-Web', '[^\\p{L}\\p{N}]+'), lambda p: strlen(p) > 1 AND p NOT IN ('audio', 'text', 'video', 'analysis')), lambda p: lower(p))) AS term FROM events) SELECT who, term, sum(w) AS weight FROM e GROUP BY ALL HAVING sum(w) > 0",
    "analysis_terms": f"WITH {_W} SELECT sentence_id AS doc_id, CASE WHEN pos % 4 = 2 THEN 'ENTITY' ELSE form END AS term, count(*)::DOUBLE AS weight FROM w WHERE pos % 4 <> 3 GROUP BY ALL",
    "imported_answers": f"WITH {_QA} SELECT question_id, answer, score, char_start, rank FROM qr",
    "answered_batch": f"""WITH {_QA}, b AS (SELECT item_id AS question_id, CASE item_id % 5 WHEN 1 THEN 'question is blank' WHEN 2 THEN 'context is blank' WHEN 3 THEN 'no imported prediction' END AS error FROM benchmark)
        SELECT b.question_id, CASE WHEN error IS NULL THEN 'ok' ELSE 'error' END AS status, error, answer, score FROM b LEFT JOIN qr ON b.question_id = qr.question_id AND rank = 1 AND error IS NULL""",
    "index_answers": f"""WITH {_bm25("SELECT * FROM documents WHERE trim(text) <> ''", 'query_id % 4 = 0', 64)}, {_QA}, z AS (SELECT query_id AS question_id, doc_id, CASE WHEN max(score) OVER w - min(score) OVER w <= 1.1920929e-07 THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS s FROM bm WINDOW w AS (PARTITION BY query_id)),
        h AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(s, 6) DESC, doc_id::VARCHAR) AS k FROM z QUALIFY k <= 3), x AS (SELECT h.question_id, answer, qr.score, rank, h.doc_id, k, contains(d.text, answer) AS c FROM h JOIN qr USING (question_id) JOIN d USING (doc_id) WHERE rank = 1), y AS (SELECT *, bool_or(c) OVER (PARTITION BY question_id) AS held FROM x)
        SELECT question_id, answer, score, rank, doc_id::VARCHAR AS chunk_id FROM y WHERE CASE WHEN held THEN c ELSE k = 1 END""",
    "evaluation_accuracy": f"""WITH {_P}, l AS (SELECT DISTINCT unnest([gold, found]) AS l FROM p), f AS (SELECT l, (SELECT count(*) FROM p WHERE gold = l AND found = l) AS m, (SELECT count(*) FROM p WHERE gold = l) AS g, (SELECT count(*) FROM p WHERE found = l) AS f FROM l)
        SELECT (SELECT count(*) FROM p) AS n, (SELECT round(avg((gold = found)::INT), 6) FROM p) AS accuracy, count(*) AS labels, round(avg(CASE WHEN m > 0 THEN 2 * m / (g + f) ELSE 0 END), 6) AS macro_f1 FROM f""",
    "evaluation_correlation": """WITH x AS (SELECT lang, round(n_chars / 100) AS a, (doc_id * 37 % 101)::DOUBLE AS b FROM documents), r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY a) + (count(*) OVER (PARTITION BY lang, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY lang ORDER BY b) + (count(*) OVER (PARTITION BY lang, b) - 1) / 2 AS rb FROM x)
        SELECT lang, count(*) AS n, round(corr(ra, rb), 6) AS spearman, round(avg(abs(a - b)), 6) AS mae FROM r GROUP BY lang""",
    "boundary_scores": f"""WITH {_SSP}, g AS (SELECT doc_id, lang, ordinal, z FROM sspan JOIN documents USING (doc_id)), f AS (SELECT doc_id, lang, z + (ordinal % 7 = 0)::INT AS z FROM g WHERE ordinal % 3 <> 2), c AS (SELECT lang, (SELECT count(*) FROM g x JOIN f y ON x.doc_id = y.doc_id AND x.z = y.z WHERE x.lang = l.lang) AS m, (SELECT count(*) FROM g x WHERE x.lang = l.lang) AS g, (SELECT count(*) FROM f y WHERE y.lang = l.lang) AS f FROM (SELECT DISTINCT lang FROM g) l),
        a AS (SELECT 'group' AS level, lang AS name, m, g, f FROM c UNION ALL SELECT 'all', '', sum(m)::BIGINT, sum(g)::BIGINT, sum(f)::BIGINT FROM c) SELECT level, name, m AS matches, g AS gold, f AS found, {_PRF} FROM a""",
    "entity_scores": f"""WITH {_SPANS}, g AS (SELECT length(token) % 3 AS t, CASE WHEN start % 2 = 0 THEN 1 ELSE length(token) % 3 END AS u FROM ts WHERE pos % 5 = 0), a AS (SELECT l.t AS entity_type, count(*) FILTER (g.t = l.t AND u = l.t) AS m, count(*) FILTER (g.t = l.t) AS g, count(*) FILTER (u = l.t) AS f FROM g, (VALUES (0), (1), (2)) AS l(t) GROUP BY l.t)
        SELECT entity_type, m AS matches, g AS gold, f AS found, {_PRF} FROM a""",
    "metric_gates": "WITH v AS (SELECT source AS metric, count(*) / 100 AS value FROM documents GROUP BY ALL) SELECT metric, CASE WHEN metric LIKE '%2' THEN 'missing' WHEN metric LIKE '%1' THEN 'stale' WHEN value >= 0.1 THEN 'passed' ELSE 'failed' END AS status, CASE WHEN metric NOT LIKE '%2' THEN round(value, 6) END AS value FROM v",
    "recall_at_one": f"WITH {_bm25('SELECT * FROM documents', k=1)}, j AS (SELECT item_id AS query_id, doc_id FROM documents JOIN benchmark ON doc_id % 40 = item_id), jq AS (SELECT DISTINCT query_id FROM j) SELECT count(*) AS queries, round(avg((EXISTS (SELECT 1 FROM bm JOIN j USING (query_id, doc_id) WHERE bm.query_id = jq.query_id))::INT), 6) AS recall_at_1 FROM jq",
    "conllu_words": f"WITH {_W} SELECT sentence_id AS sent_id, word_id, form, lower(form) AS lemma, upos, word_id - 1 AS head FROM w",
    "syntax_scores": f"""WITH {_W}, c AS (SELECT count(*) AS n, count(*) FILTER (word_id % 4 <> 0 OR upos = 'X') AS u, count(*) FILTER (word_id % 3 <> 0) AS h FROM w)
        SELECT metric, m AS matches, n AS gold, n AS found, round(m / n, 6) AS f1 FROM c, LATERAL (VALUES ('tokens', n), ('words', n), ('upos', u), ('ufeats', n), ('lemma', n), ('uas', h), ('las', h)) AS v(metric, m)""",
    "iob_tokens": f"WITH {_W} SELECT sentence_id AS source, pos AS position, form AS token, CASE WHEN word_id % 3 = 0 THEN 'B-PER' ELSE 'O' END AS label FROM w",
    "xquad_questions": "SELECT item_id::VARCHAR AS question_id, 'what?' AS question, string_split(text, ' ')[1] AS answer, 0 AS answer_start, md5(text) AS digest FROM benchmark",
}

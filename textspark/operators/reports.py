"""Reports on documents and corpora: text statistics, readability, lexical profiles, composed of the other operators.

Per-document figures are array expressions over the document's tokens and sentences, so they need no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textspark.functions import patterns as P
from textspark.functions import text as T
from textspark.functions.segmentation import nfkc, sentence_array
from textspark.operators import lexical, predictions, search, similarity, summaries, vectors

PUNCTUATION = r"[!-/:-@\[-`{-~…。！？]"


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def basic(text: Column) -> dict[str, Column]:
    """bytes, chars, words, lines and sentences of a text."""
    return {
        "bytes": F.octet_length(text).cast("bigint"), "chars": F.char_length(text).cast("bigint"), "words": F.size(T.token_array(text)).cast("bigint"),
        "lines": T.line_count(text), "sentences": F.size(sentence_array(text)).cast("bigint"),
    }


def text_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(text_col, F.lit(""))
    return docs.select(id_col, *(c.alias(n) for n, c in basic(text).items()))


def detailed_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """text_stats and paragraphs, tokens, unique_tokens, words per sentence, characters per word (of words and
    numbers, over all words)."""
    text = F.coalesce(text_col, F.lit(""))
    tokens = T.token_array(text)
    rows = docs.select(id_col, *(c.alias(n) for n, c in basic(text).items()), F.size(T.paragraph_array(text)).cast("bigint").alias("paragraphs"), tokens.alias("_t"))
    plain = F.filter("_t", lambda t: T.token_kind(t).isin("word", "number"))
    chars = F.aggregate(plain, F.lit(0), lambda s, t: s + F.length(t))
    return rows.select(
        id_col, "bytes", "chars", "words", "lines", "sentences", "paragraphs", F.size("_t").cast("bigint").alias("tokens"),
        F.size(F.array_distinct(F.transform("_t", F.lower))).cast("bigint").alias("unique_tokens"),
        _ratio(F.col("words"), F.col("sentences")).alias("words_per_sentence"), _ratio(chars, F.col("words")).alias("chars_per_word"),
    )


def readability(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return detailed_stats(docs, id_col, text_col).select(id_col, "sentences", "words", "words_per_sentence", "chars_per_word")


def normalization_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lowercase: bool = True, compose: bool = True, ascii_only: bool = False) -> DataFrame:
    """(id, text, and the basic figures before_ and after_): normalized text, white space collapsed."""
    text = F.coalesce(text_col, F.lit(""))
    out = nfkc(text) if compose else text
    out = F.lower(out) if lowercase else out
    out = T.collapse_whitespace(T.drop_non_ascii(out) if ascii_only else out)
    rows = docs.select(id_col, text.alias("_before"), out.alias("text"))
    return rows.select(id_col, "text", *(c.alias(f"before_{n}") for n, c in basic(F.col("_before")).items()), *(c.alias(f"after_{n}") for n, c in basic(F.col("text")).items()))


def sentence_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sentence_min, sentence_max, sentence_mean, sentence_p50, sentence_p90): tokens of the document's
    sentences, percentiles by nearest rank; zeros without a sentence."""
    lengths = F.array_sort(F.transform(sentence_array(F.coalesce(text_col, F.lit(""))), lambda s: F.size(T.token_array(s)).cast("bigint")))
    rows = docs.select(id_col, lengths.alias("_l"))
    n = F.size("_l")
    at = lambda p: F.get("_l", F.floor((n - 1) * F.lit(p) + 0.5).cast("int"))
    zero = lambda c: F.when(n > 0, c).otherwise(F.lit(0)).cast("bigint")
    mean = F.aggregate("_l", F.lit(0).cast("bigint"), lambda s, x: s + x) / F.greatest(n, F.lit(1))
    return rows.select(
        id_col, zero(F.get("_l", F.lit(0))).alias("sentence_min"), zero(F.get("_l", n - 1)).alias("sentence_max"), mean.alias("sentence_mean"),
        zero(at(0.5)).alias("sentence_p50"), zero(at(0.9)).alias("sentence_p90"),
    )


def punctuation_ratio(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, punctuation_ratio): single punctuation characters between tokens, among them and the tokens."""
    text = F.coalesce(text_col, F.lit(""))
    outside = F.array_join(F.split(text, f"(?U){P.TOKEN}", -1), "")
    marks = F.length(outside) - F.length(F.regexp_replace(outside, PUNCTUATION, ""))
    return docs.select(id_col, _ratio(marks, marks + F.size(T.token_array(text))).alias("punctuation_ratio"))


def text_summary(docs: DataFrame, k: int = 10, stop: Sequence[str] = P.STOP_EN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """text_stats, unique_terms, lexical_diversity and top_terms, an array of (term, n) in their order."""
    text = F.coalesce(text_col, F.lit(""))
    rows = T.held(docs.select(F.col(id_col), *(c.alias(n) for n, c in basic(text).items() if n != "words"), text.alias("_x")), _c=lexical.counted(T.words_array("_x")))
    words = F.aggregate("_c", F.lit(0).cast("bigint"), lambda s, x: s + x["n"])
    unique = F.size("_c").cast("bigint")
    terms = F.transform(lexical.by_count(lexical.not_stopped(F.col("_c"), stop), k), lambda x: F.struct(x["v"].alias("term"), x["n"].alias("n")))
    return rows.select(id_col, "bytes", "chars", words.alias("words"), "lines", "sentences", unique.alias("unique_terms"), _ratio(unique, words).alias("lexical_diversity"), terms.alias("top_terms"))


def lexical_profile(items: DataFrame, by: Sequence[str] = (), k: int = 20, text_col: str = "text") -> DataFrame:
    """One row for each group of items (one of all without ``by``): item_count, word_count, unique_terms,
    lexical_diversity, top_terms. Counts are combined per (group, term) before anything is gathered."""
    keys = list(by) or ["_all"]
    rows = items if by else items.withColumn("_all", F.lit(1))
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("item_count"))
    terms = rows.select(*keys, F.explode(T.words_array(text_col)).alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("n"))
    totals = terms.groupBy(*keys).agg(F.sum("n").alias("word_count"), F.count(F.lit(1)).alias("unique_terms"))
    top = lexical.ranked(terms, keys, [F.desc("n"), F.asc("term")], k).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "term", "n"))).alias("_top"))
    both = sizes.join(totals, keys, "left").join(top, keys, "left").fillna(0, ["word_count", "unique_terms"])
    terms = F.coalesce(F.transform("_top", lambda x: F.struct(x["term"].alias("term"), x["n"].alias("n"))), F.array().cast("array<struct<term:string,n:bigint>>"))
    return both.select(*by, "item_count", "word_count", "unique_terms", _ratio(F.col("word_count") * 0 + F.col("unique_terms"), F.col("word_count")).alias("lexical_diversity"), terms.alias("top_terms"))


def limited_terms(postings: DataFrame, most: int, id_col: str = "doc_id") -> DataFrame:
    """Postings of each document's ``most`` counts (count, then term), with the ``length`` that they leave."""
    kept = lexical.ranked(postings, [id_col], [F.desc("tf"), F.asc("term")], most).drop("rank")
    return kept.withColumn("length", F.sum("tf").over(Window.partitionBy(id_col)))


def document_report(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", k: int = 10) -> dict[str, DataFrame]:
    """The sections of a document report, each a table by id: core, script, enriched, readability, keywords, phrases,
    ngrams2, ngrams3, summary, diverse summary, classification (from imported labels) and diagnostics, the
    sections that have no input."""
    sections = {
        "core": detailed_stats(docs, id_col, text_col),
        "script": docs.select(id_col, T.script_profile(F.coalesce(text_col, F.lit(""))).alias("script")),
        "enriched": lexical.enriched_stats(docs, id_col=id_col, text_col=text_col).join(sentence_lengths(docs, id_col, text_col), id_col).join(punctuation_ratio(docs, id_col, text_col), id_col),
        "readability": readability(docs, id_col, text_col),
        "summary": text_summary(docs, k, id_col=id_col, text_col=text_col),
        "keywords": lexical.keywords(docs, k, id_col=id_col, text_col=text_col),
        "phrases": lexical.phrase_keywords(docs, k, id_col=id_col, text_col=text_col),
        "ngrams2": ngram_frequencies(docs, 2, id_col, text_col),
        "ngrams3": ngram_frequencies(docs, 3, id_col, text_col),
        "extract": summaries.summarize(docs, 3, id_col, text_col),
        "diverse": summaries.diverse(docs, 3, 0.35, id_col, text_col),
    }
    missing = ["linguistic", "embedding"]
    if labels is not None:
        sections["classification"] = predictions.classify(labels, 3, id_col)
    else:
        missing.append("classification")
    sections["diagnostics"] = docs.select(id_col, F.explode(F.array(*(F.struct(F.lit(m).alias("section"), F.lit("no imported layer").alias("reason")) for m in missing))).alias("d")).select(id_col, "d.*")
    return sections


def document_figures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of every document with tokens figures of several sections side by side: (id, words, sentences, paragraphs,
    dominant, shannon_entropy, sentence_max, unique_terms, keyword). A text is read once, and nothing is shuffled."""
    rows = docs.select(F.col(id_col), F.coalesce(text_col, F.lit("")).alias("_x"))
    rows = T.held(rows, _t=T.token_array("_x"), _s=sentence_array("_x"))
    rows = T.held(rows, _c=lexical.counted(F.transform("_t", F.lower)), _k=lexical.by_count(lexical.counted(lexical.keyword_terms(F.col("_t"))), 1))
    words = F.size("_t").cast("bigint")
    longest = F.array_max(F.transform("_s", lambda s: F.size(T.token_array(s)).cast("bigint")))
    return rows.filter(F.size("_t") > 0).select(
        id_col, words.alias("words"), F.size("_s").cast("bigint").alias("sentences"), F.size(T.paragraph_array("_x")).cast("bigint").alias("paragraphs"), T.script_profile("_x")["dominant"].alias("dominant"),
        lexical.entropy(F.col("_c"), words).alias("shannon_entropy"), F.coalesce(longest, F.lit(0)).cast("bigint").alias("sentence_max"), F.size("_c").cast("bigint").alias("unique_terms"),
        F.get("_k", F.lit(0))["v"].alias("keyword"),
    )


def ngram_frequencies(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ngram, tf, frequency, rank): by count, then terms one by one."""
    grams = T.bound(T.words_array(F.coalesce(text_col, F.lit(""))), lambda w: lexical.windows_of(w, n))
    rows = docs.select(F.col(id_col), F.inline(F.array(T.bound(grams, lambda g: F.struct(F.size(g).alias("_l"), lexical.counted(g).alias("c"))))))
    order = F.transform("c", lambda x: F.struct((-x["n"]).alias("n"), x["v"].alias("v")))
    rows = rows.select(id_col, "_l", F.posexplode(F.sort_array(order)).alias("_k", "x"))
    return rows.select(id_col, F.array_join("x.v", " ").alias("ngram"), (-F.col("x.n")).alias("tf"), (-F.col("x.n") / F.col("_l")).alias("frequency"), (F.col("_k") + 1).alias("rank"))


def corpus_report(docs: DataFrame, queries: DataFrame | None = None, embeddings: DataFrame | None = None, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", k: int = 10) -> dict[str, DataFrame]:
    """The sections of a corpus report: stats, terms, tfidf and keywords by document, searches (with queries),
    near_duplicates (windows of 5, similarity 0.6), neighbours (with embeddings), labels (with predictions)."""
    out = {
        "stats": lexical.corpus_stats(docs, id_col, text_col),
        "terms": lexical.corpus_term_stats(docs, id_col, text_col).orderBy(F.desc("collection_count"), F.desc("document_count"), F.asc("term")),
        "tfidf": lexical.best_tfidf(docs, k, id_col, text_col),
        "keywords": lexical.keywords(docs, k, id_col=id_col, text_col=text_col),
        "near_duplicates": similarity.near_duplicate_pairs(docs, 5, 0.6, id_col, text_col).orderBy(F.desc("score"), "left_id", "right_id"),
    }
    if queries is not None:
        out["bm25"] = search.bm25(docs, queries, k, id_col=id_col, text_col=text_col)
        out["tfidf_search"] = search.tfidf_search(docs, queries, k, id_col, text_col)
    if embeddings is not None:
        out["neighbours"] = vectors.knn_graph(embeddings, k, -1.0)
    if labels is not None:
        out["labels"] = predictions.label_distribution(labels, id_col).orderBy(F.desc("n"), F.desc("mean"), F.asc("label"))
    return out

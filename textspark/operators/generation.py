"""Text from weighted terms by fixed templates, and terms from counts, events and analyses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textspark.functions.spans import softened
from textspark.functions.text import collapse_whitespace

MODES = ("surface", "normalized", "lemma", "entity")
# labels' words that name a medium, not a term.
MEDIA_WORDS = ("audio", "text", "video", "analysis")


def ranked_terms(terms: DataFrame, by: str) -> DataFrame:
    """(by, terms): an array of each group's terms, white space collapsed, by falling weight, then text. A blank term
    or a weight that is not positive and finite raises when it is read. A group's terms are one prompt."""
    fail = lambda why: F.raise_error(F.lit(why)).cast("string")
    sound = (F.col("weight") > 0) & (F.col("weight") < float("inf"))
    clean = F.when(F.trim("term") == "", fail("a term is blank")).when(~sound, fail("a weight is not positive")).otherwise(collapse_whitespace("term"))
    rows = terms.select(by, F.struct((-F.col("weight")).alias("w"), clean.alias("t")).alias("x")).groupBy(by).agg(F.array_sort(F.collect_list("x")).alias("x"))
    return rows.select(by, F.transform("x", lambda x: x["t"]).alias("terms"))


def _sentence(terms: Column) -> Column:
    n = F.size(terms)
    first, rest = softened(F.get(terms, F.lit(0))), F.slice(terms, F.lit(2), F.greatest(n - 1, F.lit(0)))
    last = F.element_at(terms, -1)
    joined = F.when(n == 3, F.array_join(rest, " and ")).otherwise(F.concat(F.array_join(F.slice(rest, F.lit(1), F.greatest(n - 2, F.lit(0))), ", "), F.lit(", and "), last))
    return F.when(n == 1, F.concat(first, F.lit("."))).when(n == 2, F.concat(first, F.lit(" relates to "), last, F.lit("."))).otherwise(F.concat(first, F.lit(" connects "), joined, F.lit(", with context inferred.")))


def synthesize(terms: DataFrame, by: str, sentences: int = 3, low: int = 2, high: int = 4) -> DataFrame:
    """(by, text, confidence) from terms (by, term, weight): sentences over rotating windows of the ranked terms;
    confidence is 0.25 and 0.025 a term, ten at most, 0.5 at most."""
    if sentences < 1 or not 1 <= low <= high:
        raise ValueError("sentences and term bounds are at least 1, the bounds in order")
    rows = ranked_terms(terms, by)
    n = F.size("terms")
    span = F.greatest(F.least(n, F.lit(high)), F.least(F.lit(low), n))
    window = lambda k: F.transform(F.sequence(F.lit(0), span - 1), lambda o: F.get("terms", (k + o) % n))
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(sentences - 1)), lambda k: _sentence(window(k))), " ")
    return rows.select(by, text.alias("text"), F.least(F.lit(0.5), 0.25 + F.least(n, F.lit(10)) * 0.025).alias("confidence"))


def terms_from_counts(counts: DataFrame, by: str) -> DataFrame:
    """(by, term, weight) of counts (by, term, n) above 0."""
    return counts.filter("n > 0").select(by, "term", F.col("n").cast("double").alias("weight"))


def label_terms(label: Column) -> Column:
    """The words of a label of more than one byte, in lower case, but for those that name a medium."""
    parts = F.split(label, r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(parts, lambda p: (F.octet_length(p) > 1) & ~p.isin(*MEDIA_WORDS)), F.lower)


def terms_from_events(events: DataFrame, by: str) -> DataFrame:
    """(by, term, weight): events (by, label, score) give their labels' words their score, 1 if null, never negative."""
    rows = events.select(by, F.explode(label_terms(F.col("label"))).alias("term"), F.greatest(F.coalesce("score", F.lit(1.0)), F.lit(0.0)).alias("w"))
    return rows.groupBy(by, "term").agg(F.sum("w").alias("weight")).filter("weight > 0")


def analysis_tokens(tokens: DataFrame, mode: str = "surface", entities: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id, pos, token) of an analysed text (pos, surface, normalized, lemma): as written, normalized, lemmas where
    known, or with entities (id, token_start, token_end, name) in place of their tokens."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    form = {"surface": F.col("surface"), "normalized": F.col("normalized"), "lemma": F.coalesce("lemma", "normalized")}.get(mode, F.col("surface"))
    rows = tokens.select(id_col, "pos", form.alias("token"))
    if mode != "entity":
        return rows
    spans = entities.select(F.col(id_col).alias("_d"), "token_start", "token_end", "name")
    inside = (F.col(id_col) == F.col("_d")) & (F.col("pos") >= F.col("token_start")) & (F.col("pos") < F.col("token_end"))
    first = F.row_number().over(Window.partitionBy(id_col, "pos").orderBy("token_start", F.desc("token_end")))
    both = rows.join(spans, inside, "left").withColumn("_r", first).filter("_r = 1")
    kept = both.filter(F.col("name").isNull() | (F.col("pos") == F.col("token_start")))
    return kept.select(id_col, "pos", F.coalesce("name", "token").alias("token"))


def analysis_terms(tokens: DataFrame, mode: str = "lemma", entities: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id, term, weight): how often each token of the mode stands in the analysis."""
    rows = analysis_tokens(tokens, mode, entities, id_col)
    return rows.groupBy(id_col, F.col("token").alias("term")).agg(F.count(F.lit(1)).cast("double").alias("weight"))

"""Imported predictions: top labels, distributions, metrics. Models are not run here; an operation that would
need one raises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textspark.operators.lexical import ranked


class MissingModel(ValueError):
    """An operation needs imported predictions and none were given."""


def classify(predictions: DataFrame | None, k: int = 3, id_col: str = "doc_id") -> DataFrame:
    """The k best labels of each document by score, ties by label."""
    if predictions is None:
        raise MissingModel("classification needs imported predictions")
    return ranked(predictions, [id_col], [F.desc("score"), F.asc("label")], max(1, k))


def label_distribution(predictions: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(label, n, total, mean) over each document's best label."""
    best = classify(predictions, 1, id_col)
    return best.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("total"), F.avg("score").alias("mean"))


def precision_recall(gold: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """One row of matches, gold, found, precision, recall and f1 on multisets of keys."""
    a = gold.groupBy(*keys).agg(F.count(F.lit(1)).alias("g"))
    b = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("p"))
    sums = a.join(b, keys, "full_outer").fillna(0, ["g", "p"]).agg(F.sum(F.least("g", "p")).alias("matches"), F.sum("g").alias("gold"), F.sum("p").alias("found"))
    ratio = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    rows = sums.withColumns({"precision": ratio(F.col("matches"), F.col("found")), "recall": ratio(F.col("matches"), F.col("gold"))})
    total = F.col("precision") + F.col("recall")
    return rows.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), total))


def ranking_metrics(hits: DataFrame, relevant: DataFrame, k: int = 10, by: str = "query_id", id_col: str = "doc_id") -> DataFrame:
    """One row: queries, mrr, recall and ndcg at k, over the queries that have relevant documents."""
    judged = relevant.select(by, id_col).distinct().withColumn("_rel", F.lit(1))
    sizes = judged.groupBy(by).agg(F.count(F.lit(1)).alias("n_relevant"))
    top = hits.filter(F.col("rank") <= k).join(judged, [by, id_col])
    gains = top.groupBy(by).agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("found"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_relevant", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    rows = sizes.join(gains, by, "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.agg(
        F.count(F.lit(1)).alias("queries"),
        F.avg(zero(1 / F.col("first"))).alias("mrr"),
        F.avg(zero(F.col("found") / F.col("n_relevant"))).alias("recall"),
        F.avg(zero(F.col("dcg") / ideal)).alias("ndcg"),
    )


def nearest_ranks(rows: DataFrame, by: str, value: str, quantiles: dict[str, float]) -> DataFrame:
    """(by, n, one column a quantile): the value at place round((n - 1) p) of the sorted values, halves away from
    zero. Equal values are counted first, so running sums go over distinct values, not over rows."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(by).orderBy(value))
    placed = counts.withColumns({"_upto": upto, "_n": F.sum("_c").over(Window.partitionBy(by))})
    place = lambda p: F.floor((F.col("_n") - 1) * p + 0.5)
    at = [F.min(F.when(F.col("_upto") > place(p), F.col(value))).alias(name) for name, p in quantiles.items()]
    return placed.groupBy(by).agg(F.first("_n").alias("n"), *at)


def sentiment(predictions: DataFrame, id_col: str = "doc_id", positive: tuple[str, ...] = ("positive", "pos"), negative: tuple[str, ...] = ("negative", "neg")) -> DataFrame:
    """(id, positive, negative, compound) from the scores of label aliases."""
    best = lambda names: F.coalesce(F.max(F.when(F.lower("label").isin(*names), F.col("score"))), F.lit(0.0))
    rows = predictions.groupBy(id_col).agg(best(positive).alias("positive"), best(negative).alias("negative"))
    return rows.withColumn("compound", F.col("positive") - F.col("negative"))


TEMPLATE = "This example is about {}."
NLI = ("entailment", "neutral", "contradiction")


def hypotheses(labels: list[str], template: str = TEMPLATE) -> list[str]:
    if not labels:
        raise ValueError("a zero-shot request has at least one label")
    return [template.replace("{}", label) for label in labels]


def zero_shot(predictions: DataFrame | None, labels: list[str], k: int = 3, template: str = TEMPLATE, normalize: bool = False, id_col: str = "doc_id") -> DataFrame:
    """(id, label, score, hypothesis, rank) from imported scores of the labels; with ``normalize``, as for a backend's
    raw scores, each document's scores are divided by their sum."""
    if predictions is None:
        raise MissingModel("zero-shot classification needs imported predictions")
    texts = dict(zip(labels, hypotheses(labels, template), strict=True))
    rows = predictions.filter(F.col("label").isin(*labels))
    if normalize:
        total = F.sum("score").over(Window.partitionBy(id_col))
        rows = rows.withColumn("score", F.when(total > 1.1920929e-07, F.col("score") / total).otherwise(F.col("score")))
    named = F.create_map(*(F.lit(x) for pair in texts.items() for x in pair))
    return classify(rows, k, id_col).withColumn("hypothesis", named[F.col("label")])


def _softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda s, y: s + y))


def decode_sequence(logits: DataFrame, labels: list[str], k: int = 3, id_col: str = "doc_id") -> DataFrame:
    """(id, label, score, rank) from rows of logits (id, logits): the softmax's k best labels."""
    names = F.array(*map(F.lit, labels))
    pairs = F.arrays_zip(_softmax(F.col("logits")).alias("score"), names.alias("label"))
    rows = logits.select(id_col, F.inline(pairs)).select(id_col, "label", "score")
    return classify(rows, k, id_col)


def entailment_score(logits: Column, entailment: int, contradiction: int | None = None) -> Column:
    """The softmax share of entailment, against contradiction alone where its place is given."""
    if contradiction is None:
        return F.get(_softmax(logits), F.lit(entailment))
    pair = F.array(F.get(logits, F.lit(contradiction)), F.get(logits, F.lit(entailment)))
    return F.get(_softmax(pair), F.lit(1))


def decode_nli(logits: DataFrame, labels: list[str], id_col: str = "doc_id") -> DataFrame:
    """(id, label, entailment, neutral, contradiction) from three-way logits. labels name the three in the logits' order,
    else ValueError; of equal shares entailment counts first, then contradiction. Logits that are not three
    finite numbers give nulls."""
    order = [x.strip().lower() for x in labels]
    if sorted(order) != sorted(NLI):
        raise ValueError(f"labels name each of {NLI} once")
    sound = (F.size("logits") == 3) & F.forall("logits", lambda x: ~F.isnan(x) & (F.abs(x) != float("inf")))
    shares = F.when(sound, _softmax(F.col("logits")))
    rows = logits.select(id_col, *(F.get(shares, F.lit(order.index(n))).alias(n) for n in NLI))
    e, n, c = (F.col(x) for x in NLI)
    return rows.withColumn("label", F.when((e >= n) & (e >= c), "entailment").when(c >= n, "contradiction").when(e.isNotNull(), "neutral"))


def token_predictions(logits: DataFrame, labels: list[str], id_col: str = "doc_id") -> DataFrame:
    """(id, pos, label, score, start, end) from token logits (id, pos, logits, start, end): the softmax's best label,
    the first of equal ones."""
    shares = _softmax(F.col("logits"))
    best = F.array_max(shares)
    names = F.array(*map(F.lit, labels))
    return logits.select(id_col, "pos", F.element_at(names, F.array_position(shares, best).cast("int")).alias("label"), best.alias("score"), "start", "end")


def normalized_scores(predictions: DataFrame, id_col: str = "doc_id") -> DataFrame:
    total = F.sum("score").over(Window.partitionBy(id_col))
    return predictions.withColumn("score", F.when(total > 1.1920929e-07, F.col("score") / total).otherwise(F.col("score")))


# Models whose predictions can be imported, by task.
CATALOG = (
    ("classification", "sequence classifier", "labels and scores"),
    ("zero-shot", "NLI pair classifier", "entailment logits"),
    ("token-classification", "token classifier", "piece labels with offsets"),
    ("question-answering", "extractive reader", "start and end logits"),
    ("embedding", "sentence embedder", "vectors by text"),
    ("syntax", "dependency parser", "words with heads, relations and features"),
)


def catalog(spark) -> DataFrame:
    """(task, model, imports): what each task imports, as no model runs here."""
    return spark.createDataFrame(list(CATALOG), "task string, model string, imports string")

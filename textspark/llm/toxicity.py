"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

The kernel compares words by their gapped three-letter subsequences: phi(s) has an entry for each
letter triple, the sum over its occurrences of decay**(characters skipped), at most ``GAP`` skipped
between neighbours, so that a word with letters inserted (or with dots or dashes between them) still
shares most of an insult's weight. Single letters parted by one white space each are one word, the white
space a skipped character. Letters count by a code: one for each Latin letter, 36 over which those of
other scripts are dealt. k(s, t) = <phi(s), phi(t)> / (n(s) n(t)), n the norm of a word's
occurrence weights.

Training, on a bounded sample of labelled rows: texts become sentences, sentences that occur more than
once count once, and those seen under both labels are left out. For each word, the numbers of toxic and
clean contexts (the words it follows) give a likelihood ratio, and so for each run of four or five letters over
all words that hold it; words that are, or hold a run that is, far over-represented in toxic sentences are
the witnesses, words of clean sentences the counter-examples, after a first fit joined by those that
score highest. Landmarks are drawn from both, K^-1/2 over them maps words to features, and a linear SVM
(squared hinge, Newton steps) separates them. A sentence scores as its worst word, a text as its worst
sentence, and a logistic curve fitted on the sample's texts turns the margin into a probability.

A trained model is one weight per letter triple: the sum over landmarks of their coefficients times
phi(landmark), so that scoring a word is a sum of table look-ups, whatever the number of landmarks.
Scoring is one pass over the texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textspark.llm.common import cut
from textspark.llm.words import slices

GAP = 2
DECAY = 0.6
#: Bits of a letter's code, and the codes of what is no letter and of the first letter outside a to z.
BITS = 6
REST, OTHERS = (1 << BITS) - 1, 27
TRIPLES = 1 << 3 * BITS
#: Code points from here on (no script's letters among them, but for rare ideographs) are no letters.
POINTS = 0x34000
#: Margin of a text without a word to score.
FLOOR = -2.0
STEPS = [(a, b) for a in range(1, GAP + 2) for b in range(1, GAP + 2)]


def _letter_table() -> np.ndarray:
    """By code point under POINTS: 0 white space, 1-26 a Latin letter, OTHERS to REST - 1 other letters, REST the rest."""
    table = np.full(POINTS, REST, np.uint8)
    for point in range(POINTS):
        char = chr(point)
        base = char.lower()[:1]
        if char.isspace():
            table[point] = 0
        elif "a" <= base <= "z":
            table[point] = ord(base) - 96
        elif char.isalpha():
            table[point] = OTHERS + ord(base) % (REST - OTHERS)
    return table


_LETTERS = _letter_table()


def codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Letter codes of all texts, each followed by a break, and where each text begins. White space between two
    single letters has the code REST, so that it does not part them."""
    joined = "\n".join(x or "" for x in texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    out = np.where(points < POINTS, _LETTERS[np.minimum(points, POINTS - 1)], np.uint8(REST)).astype(np.int32)
    sizes = np.fromiter((len(x or "") + 1 for x in texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    solid = np.concatenate(([False], out > 0, [False]))
    single = (out > 0) & (out < REST) & ~solid[:-2] & ~solid[2:]
    between = np.flatnonzero(single[:-2] & single[2:]) + 1  # the character between is no part of a word
    breaks = np.zeros(len(out), bool)
    breaks[ends - 1] = True
    out[between[~breaks[between]]] = REST
    return out, np.concatenate(([0], ends[:-1]))


def occurrences(c: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each gap pattern: the places where a triple begins, its index, and its weight."""
    letter = (c > 0) & (c < REST)
    solid = c > 0
    for a, b in STEPS:
        n = len(c) - a - b
        if n <= 0:
            continue
        ok = letter[:n] & letter[a : a + n] & letter[a + b :]
        for k in (*range(1, a), *range(a + 1, a + b)):
            ok &= solid[k : k + n]
        at = np.flatnonzero(ok)
        yield at, (c[at] << 2 * BITS) | (c[at + a] << BITS) | c[at + a + b], DECAY ** (a + b - 2)


def word_starts(c: np.ndarray) -> np.ndarray:
    """Where words (runs without white space, but for that which parts single letters) begin."""
    solid = c > 0
    return np.flatnonzero(solid & ~np.concatenate(([False], solid[:-1])))


def margins(texts: list[str | None], weights: np.ndarray, bias: float) -> np.ndarray:
    """Each text's largest word margin, FLOOR if it has no word of three letters."""
    c, begins = codes(texts)
    total, norm = np.zeros(len(c), np.float32), np.zeros(len(c), np.float32)
    for at, index, weight in occurrences(c):
        total[at] += weights[index] * np.float32(weight)
        norm[at] += np.float32(weight * weight)
    out = np.full(len(texts), FLOOR)
    starts = word_starts(c)
    if len(starts):
        sums, norms = np.add.reduceat(total, starts), np.add.reduceat(norm, starts)
        value = np.where(norms > 0, sums / np.sqrt(np.maximum(norms, 1e-9)) + bias, FLOOR)
        owner = np.searchsorted(begins, starts, "right") - 1
        first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        out[owner[first]] = np.maximum(np.maximum.reduceat(value, first), FLOOR)
    return out


def features(words: list[str], triples: np.ndarray | None = None) -> np.ndarray:
    """phi(word) / n(word) as dense rows over the given sorted triples (all if none are)."""
    place = np.arange(TRIPLES) if triples is None else np.full(TRIPLES, -1)
    if triples is not None:
        place[triples] = np.arange(len(triples))
    out = np.zeros((len(words), TRIPLES if triples is None else len(triples)), np.float32)
    c, begins = codes(words)
    norm = np.zeros(len(words))
    for at, index, weight in occurrences(c):
        owner = np.searchsorted(begins, at, "right") - 1
        norm += np.bincount(owner, minlength=len(words)) * weight * weight
        known = place[index] >= 0
        np.add.at(out, (owner[known], place[index[known]]), np.float32(weight))
    return out / np.sqrt(np.maximum(norm, 1e-9))[:, None].astype(np.float32)


def triples_of(words: list[str]) -> np.ndarray:
    """The sorted triples that any of the words has."""
    c, _ = codes(words)
    return np.unique(np.concatenate([index for _, index, _ in occurrences(c)]))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float, rounds: int = 15) -> np.ndarray:
    """Primal Newton for a squared-hinge SVM; the last weight is the bias. y is -1 or 1."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1]) / cost
    ridge[-1, -1] = 1e-3 / cost
    active = np.ones(len(x), bool)
    for _ in range(rounds):
        xa = x[active]
        w = np.linalg.solve(ridge + (xa.T @ xa).astype(np.float64), (xa.T @ y[active].astype(x.dtype)).astype(np.float64))
        now = y * (x @ w.astype(x.dtype)) < 1
        if (now == active).all():
            break
        active = now
    return w


def fit_words(good: list[str], bad: list[str], landmarks: int, cost: float) -> tuple[np.ndarray, float]:
    """Weights by triple and the bias of the SVM on Nystroem features of words. Landmarks are the first of the
    good words, at most half, and the first of the bad ones."""
    chosen = good[: landmarks // 2] + bad[: landmarks - len(good[: landmarks // 2])]
    triples = triples_of(chosen)  # the kernel with a landmark sees no others
    phi = features(chosen, triples)
    values, vectors = np.linalg.eigh((phi @ phi.T).astype(np.float64))
    keep = values > 1e-6 * values.max()
    project = phi.T @ (vectors[:, keep] / np.sqrt(values[keep])).astype(np.float32)
    words = good + bad
    x = np.vstack([features(words[k : k + 256], triples) @ project for k in range(0, len(words), 256)])
    w = fit_svm(x, np.concatenate([np.ones(len(good)), -np.ones(len(bad))]), cost)
    weights = np.zeros(TRIPLES, np.float32)
    weights[triples] = project @ w[:-1].astype(np.float32)
    return weights, float(w[-1])


def _fitted(examples: DataFrame, landmarks: int, cost: float) -> tuple[np.ndarray, float]:
    """fit_words in one task on examples (word, y, rank), a bounded table; the driver gets the weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        rows.sort(key=lambda r: (r[2], r[0]))
        good, bad = [r[0] for r in rows if r[1] == 1], [r[0] for r in rows if r[1] != 1]
        weights, bias = fit_words(good, bad, landmarks, cost)
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([bias])], ["weights", "bias"])

    row = examples.select("word", "y", "rank").coalesce(1).mapInArrow(run, "weights binary, bias double").first()
    return np.frombuffer(bytes(row.weights), np.float32), row.bias


def fit_logistic(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Platt's smoothed logistic fit; the slope is kept positive."""
    pos, neg = label.sum(), len(label) - label.sum()
    target = np.where(label == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([margin, np.ones(len(margin))], 1)
    w = np.array([1.0, np.log((pos + 1) / (neg + 1))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (target - p) - 1e-3 * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return max(float(w[0]), 1e-3), float(w[1])


def held_out(id_col: str) -> Column:
    """True for rows that training must not see: crc32(id as text) mod 4 is 2 (a null id counts as '')."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _word_table(sample: DataFrame, text_col: str) -> DataFrame:
    """(word, toxic, clean): after how many different words each word of 3 to 40 letters stands in toxic
    and in clean sentences only, so that copies and near copies of a text weigh once; and a row with a null
    word for the numbers of sentences."""
    sentences = (
        sample.select(F.explode(F.split(F.lower(text_col), r"[.!?\n]+")).alias("s"), "toxic")
        .groupBy(F.xxhash64(F.trim("s")).alias("h"))
        .agg(F.first("s").alias("s"), F.max("toxic").alias("high"), F.min("toxic").alias("low"))
        .filter("high = low")
    )
    words = F.regexp_extract_all("s", F.lit(r"\p{L}{3,40}+"), F.lit(0))
    placed = F.transform(words, lambda w, i: F.struct(w.alias("word"), F.when(i > 0, F.xxhash64(F.get(words, i - 1))).otherwise(F.lit(0)).alias("after")))
    counted = F.array_append(placed, F.struct(F.lit(None).cast("string").alias("word"), F.col("h").alias("after")))
    return (
        sentences.select("high", F.inline(counted))
        .groupBy("word", "after")
        .agg(F.max("high").alias("high"), F.min("high").alias("low"))
        .filter("high = low")
        .groupBy("word")
        .agg(F.sum("high").cast("double").alias("toxic"), F.sum(1 - F.col("high")).cast("double").alias("clean"))
    )


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_rows: int = 12_000,
    witnesses: int = 1_500,
    others: int = 12_000,
    landmarks: int = 384,
    cost: float = 40.0,
) -> Model:
    """Fits on the max_rows labelled rows outside the held-out fold whose ids hash lowest.

    Null labels are left out; of an id with several labels the highest counts. Without rows, or with one
    label only, every text scores the share of toxic rows (0 without rows)."""
    allowed = (
        labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("_lid"))
        .agg(F.max(label_col).cast("int").alias("toxic"))
        .orderBy(F.xxhash64("_lid"), "_lid")
        .limit(max_rows)
    )
    texts = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_lid"), F.col(text_col).alias("_text"))
    sample = cut(texts.join(F.broadcast(allowed), "_lid").select("_text", "toxic"), "toxicity-sample")  # at most max_rows
    table = cut(_word_table(sample, "_text"), "toxicity-words")
    totals = table.filter("word IS NULL").select("toxic", "clean").first()
    n_toxic, n_clean = (totals.toxic, totals.clean) if totals else (0.0, 0.0)
    if not n_toxic or not n_clean:
        share = 1.0 if n_toxic else 0.0
        return Model(np.zeros(TRIPLES, np.float32), 0.0, 1e-3, 30.0 if share else -30.0)
    rate = n_toxic / (n_toxic + n_clean)
    n = F.col("toxic") + F.col("clean")
    part = lambda k, p: F.when(k > 0, k * F.log(k / (n * p))).otherwise(0.0)
    known = table.filter("word IS NOT NULL").withColumn("ratio", 2 * (part(F.col("toxic"), rate) + part(F.col("clean"), 1 - rate)))
    runs = F.flatten(
        F.transform(
            F.array(F.lit(4), F.lit(5)),
            lambda k: F.when(F.length("word") >= k, F.transform(F.sequence(F.lit(1), F.length("word") - k + 1), lambda i: F.substring("word", i, k))).otherwise(F.array().cast("array<string>")),
        )
    )
    marked = known.select("word", "toxic", "clean", F.explode(F.array_distinct(F.array_append(runs, F.concat(F.lit("="), "word")))).alias("run"))
    telling = (
        marked.groupBy("run")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .withColumn("ratio", 2 * (part(F.col("toxic"), rate) + part(F.col("clean"), 1 - rate)))
        .filter((F.col("toxic") >= 4) & (F.col("toxic") / n >= 0.8) & (F.col("ratio") >= 30))
        .orderBy(F.desc("ratio"), "run")
        .limit(witnesses)
        .select("run", "ratio")
    )
    found = (
        marked.filter("toxic > clean")
        .join(F.broadcast(telling), "run")  # at most `witnesses` rows
        .groupBy("word")
        .agg((-F.max("ratio") * F.max("toxic")).alias("rank"))
        .orderBy("rank", "word")
        .limit(witnesses)
        .select("word", F.lit(1).alias("y"), "rank")
    )
    clean = known.filter((F.col("clean") >= 1) & (F.col("ratio") < 6)).select("word")
    place = (F.xxhash64("word") / float(1 << 63)).alias("rank")
    plain = clean.select("word", F.lit(-1).alias("y"), place).orderBy("rank", "word").limit(others)
    examples = cut(found.unionByName(plain), "toxicity-examples")
    if examples.select("y").distinct().count() < 2:
        return Model(np.zeros(TRIPLES, np.float32), 0.0, 1e-3, float(np.log(rate / (1 - rate))))
    weights, bias = _fitted(examples, landmarks, cost)
    scored = _scored(clean, "word", Model(weights, bias, 1.0, 0.0)).filter("clean_margin > -1")
    hardest = scored.orderBy(F.desc("clean_margin"), "word").limit(others // 4).select("word", F.lit(-1).alias("y"), F.lit(2.0).alias("rank"))
    weights, bias = _fitted(examples.unionByName(cut(hardest, "toxicity-hardest")), landmarks, cost)
    rows = _scored(sample, "_text", Model(weights, bias, 1.0, 0.0)).select("clean_margin", "toxic").collect()  # at most max_rows
    slope, offset = fit_logistic(np.array([r.clean_margin for r in rows]), np.array([r.toxic for r in rows]))
    return Model(weights, bias, slope, offset)


def _scored(df: DataFrame, text_col: str, model: Model) -> DataFrame:
    """df's other columns (and a short text) with ``clean_margin``, each text's largest margin."""
    kept = [c for c in df.columns if c != "_text"]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(margins(texts, model.weights, model.bias))], [*kept, "clean_margin"]
            )

    return df.mapInArrow(run, f"{schema}, clean_margin double")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id, the columns in carry, and ``score`` from 0 to 1.

    Null and empty texts, and texts without a word of three letters, score as the lowest margin. Repeated
    rows, equal and null ids get their own rows; an empty table gives an empty result."""
    kept = [id_col, *carry]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    rows = docs.select(*(F.col(c).alias(f"_c{k}") for k, c in enumerate(kept)), F.col(text_col).alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, len(kept), 1_000_000):
                found = model.probability(margins(part.column(len(kept)).to_pylist(), model.weights, model.bias))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(kept))), pa.array(found)], [*kept, "score"])

    return rows.mapInArrow(run, f"{schema}, score double")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns unchanged, whose text scores under the threshold.

    Null and empty texts, and those without a word of three letters, score lowest and stay (unless the model
    knows toxic texts only); long texts are scored whole; repeated rows, equal and null ids are told apart;
    no ties arise. An empty table gives an empty one. Columns may have any names: they travel by place."""
    place = docs.columns.index(text_col)
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, place, 1_000_000):
                scores = model.probability(margins(part.column(place).to_pylist(), model.weights, model.bias))
                yield part.filter(pa.array(scores < threshold))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, **settings) -> DataFrame:
    """Trains, then scores every row: id, held_out, score, predicted."""
    model = train(docs, labels, id_col, text_col, **settings)
    return score(docs, model, id_col, text_col).select(
        id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )

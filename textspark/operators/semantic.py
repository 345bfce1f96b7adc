"""Semantic reports over units with imported vectors: units of documents, conversations and corpora, concepts,
timelines, hotspots, evidence, word senses, graphs. Without vectors an operation raises; no model runs here.

A unit is a row (unit_id, source_id, kind, parent_id, sequence_index, start, end, speaker, text); with vectors and
clusters it also has ``vector`` and ``cluster_id``."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textspark.functions import segmentation as S
from textspark.functions import text as T
from textspark.operators import clusters, dynamics, vectors
from textspark.operators.lexical import ranked
from textspark.operators.predictions import MissingModel
from textspark.operators.reports import lexical_profile
from textspark.sources.scratch import cut

NEIGHBOURS, NEIGHBOUR_THRESHOLD, CLUSTER_THRESHOLD = 4, 0.25, 0.6
KEY_TERMS, MIN_UNITS = 4, 2


def checked_options(neighbours: int = NEIGHBOURS, neighbour_threshold: float = NEIGHBOUR_THRESHOLD, cluster_threshold: float = CLUSTER_THRESHOLD) -> None:
    if neighbours < 1 or not all(-1 <= t <= 1 for t in (neighbour_threshold, cluster_threshold)):
        raise ValueError("neighbours is at least 1, thresholds between -1 and 1")


def document_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sentences, paragraphs and the whole of each document; a sentence's parent is the first paragraph that holds
    it, a paragraph's the document."""
    text = F.coalesce(text_col, F.lit(""))
    own = F.col(id_col).cast("string")
    rows = docs.select(own.alias("source_id"), text.alias("_text"), F.col("speaker") if "speaker" in docs.columns else F.lit(None).cast("string").alias("speaker"))
    spans = rows.select("source_id", "speaker", "_text", F.posexplode(S.sentence_spans_udf(F.col("_text"))).alias("sequence_index", "s"))
    paragraphs = T.paragraph_spans(rows, "source_id", "_text")
    holders = paragraphs.select("source_id", "ordinal", F.col("start").alias("_a"), F.col("end").alias("_b"))
    sentences = spans.select("source_id", "speaker", "sequence_index", F.col("s.start").cast("bigint").alias("start"), F.col("s.end").cast("bigint").alias("end"), F.substring("_text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("text"))
    inside = (F.col("start") >= F.col("_a")) & (F.col("end") <= F.col("_b"))
    parents = sentences.select("source_id", "sequence_index", "start", "end").join(holders, "source_id").filter(inside).groupBy("source_id", "sequence_index").agg(F.min("ordinal").alias("_p"))
    sentences = sentences.join(parents, ["source_id", "sequence_index"], "left")
    name = lambda *parts: F.concat_ws(":", *(p if isinstance(p, Column) else F.lit(p) for p in parts))
    texts = paragraphs.join(rows, "source_id").withColumn("text", F.substring("_text", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")))
    source, at = F.col("source_id"), F.col("sequence_index").cast("string")
    parent = F.when(F.col("_p").isNotNull(), name(source, "paragraph", F.col("_p").cast("string")))
    one = sentences.select(name(source, "sentence", at).alias("unit_id"), "source_id", F.lit("sentence").alias("kind"), parent.alias("parent_id"), F.col("sequence_index").cast("bigint").alias("sequence_index"), "start", "end", "speaker", "text")
    two = texts.select(name(source, "paragraph", F.col("ordinal").cast("string")).alias("unit_id"), "source_id", F.lit("paragraph").alias("kind"), name(source, "document").alias("parent_id"), F.col("ordinal").cast("bigint").alias("sequence_index"), "start", "end", "speaker", "text")
    three = rows.select(name(source, "document").alias("unit_id"), "source_id", F.lit("document").alias("kind"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).cast("bigint").alias("sequence_index"), F.lit(0).cast("bigint").alias("start"), F.length("_text").cast("bigint").alias("end"), "speaker", F.col("_text").alias("text"))
    return one.unionByName(two).unionByName(three)


def conversation_units(turns: DataFrame, conversation: str = "conv_id", seq: str = "turn", speaker: str = "role", text_col: str = "text") -> DataFrame:
    """Turns and their sentences, by conversation; a sentence's parent is its turn. A turn's id is conversation:turn."""
    own = F.concat_ws(":", F.col(conversation).cast("string"), F.col(seq).cast("string"))
    text = F.coalesce(text_col, F.lit(""))
    place = F.row_number().over(Window.partitionBy(conversation).orderBy(seq)) - 1
    rows = turns.select(F.col(conversation).alias("conversation"), own.alias("source_id"), place.cast("bigint").alias("sequence_index"), F.col(speaker).alias("speaker"), text.alias("text"))
    one = rows.select("conversation", F.concat("source_id", F.lit(":turn")).alias("unit_id"), "source_id", F.lit("turn").alias("kind"), F.lit(None).cast("string").alias("parent_id"), "sequence_index", "speaker", "text")
    parts = rows.select("conversation", "source_id", "speaker", F.posexplode(S.sentence_array(F.col("text"))).alias("_k", "text"))
    two = parts.select(
        "conversation", F.concat("source_id", F.lit(":sentence:"), F.col("_k").cast("string")).alias("unit_id"), "source_id", F.lit("sentence").alias("kind"),
        F.concat("source_id", F.lit(":turn")).alias("parent_id"), F.col("_k").cast("bigint").alias("sequence_index"), "speaker", "text",
    )
    return one.unionByName(two)


def clustered(units: DataFrame, by: str, seq: str = "sequence_index", vector: str = "vector", threshold: float = CLUSTER_THRESHOLD) -> DataFrame:
    """units with ``cluster_id``, concept-1 and so on in each group, in order of first members."""
    checked_options(cluster_threshold=threshold)
    found = clusters.cluster_units(units, by, seq, vector, threshold)
    return units.join(found, [by, seq]).withColumn("cluster_id", F.concat(F.lit("concept-"), (F.col("cluster") + 1).cast("string"))).drop("cluster")


def concepts(units: DataFrame, by: str, seq: str = "sequence_index", vector: str = "vector") -> DataFrame:
    """(by, cluster_id, representative, representative_vector, coherence, members) of clustered units."""
    keyed = units.select(F.struct(by, "cluster_id").alias("_c"), F.col(seq).alias("_q"), F.col(vector).alias("_v"))
    best = vectors.medoids(keyed, "_q", "_c", "_v")
    rows = best.select(F.col(f"_c.{by}").alias(by), "_c.cluster_id", F.col("medoid").alias("representative"), F.col("cohesion").alias("coherence"), F.col("n").alias("members"))
    own = units.select(by, F.col(seq).alias("representative"), F.col(vector).alias("representative_vector"))
    return rows.join(own, [by, "representative"])


def timeline(units: DataFrame, by: str, seq: str = "sequence_index", vector: str = "vector") -> DataFrame:
    """(by, seq, cluster_id, shift, activation): how far a unit is from the one before, (1 - cosine) / 2, 0 for the
    first, and its cosine to the concept's representative, both within [0, 1]."""
    order = Window.partitionBy(by).orderBy(seq)
    known = concepts(units, by, seq, vector).select(by, "cluster_id", "representative_vector")
    rows = units.join(known, [by, "cluster_id"]).withColumn("_before", F.lag(vector).over(order))
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    shift = F.when(F.col("_before").isNull(), 0.0).otherwise(clamp((1 - vectors.cosine("_before", vector)) / 2))
    return rows.select(by, seq, "cluster_id", shift.alias("shift"), clamp(vectors.cosine(vector, "representative_vector")).alias("activation"))


def hotspots(points: DataFrame, by: str, seq: str = "sequence_index") -> DataFrame:
    """dynamics.hotspots with a rank in each group: coverage, mean activation, cluster id as a string."""
    rows = dynamics.hotspots(points, by, seq, "cluster_id", "activation")
    order = Window.partitionBy(by).orderBy(F.desc(F.round("coverage", 9)), F.desc(F.round("mean_activation", 9)), F.asc("cluster_id"))
    return rows.withColumn("rank", F.row_number().over(order))


def speaker_profiles(units: DataFrame, by: str) -> DataFrame:
    """(by, speaker, cluster_id, units, share, rank) of the units that name a speaker."""
    counts = units.filter(F.col("speaker").isNotNull()).groupBy(by, "speaker", "cluster_id").agg(F.count(F.lit(1)).alias("units"))
    own = Window.partitionBy(by, "speaker")
    return counts.withColumns({"share": F.col("units") / F.sum("units").over(own), "rank": F.row_number().over(own.orderBy(F.desc("units"), F.asc("cluster_id")))})


def neighbours(units: DataFrame, by: str, seq: str = "sequence_index", vector: str = "vector", k: int = NEIGHBOURS, threshold: float = NEIGHBOUR_THRESHOLD) -> DataFrame:
    """(by, a, b, score): each unit's k best within its group, of at least threshold. A group is one task."""
    checked_options(k, threshold)
    import numpy as np

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(seq)
        x = np.array(rows[vector].tolist(), float)
        n = np.linalg.norm(x, axis=1, keepdims=True)
        u = np.divide(x, n, out=np.zeros_like(x), where=n > vectors.EPSILON)
        ids, edges = rows[seq].to_numpy(), {}
        for i in range(len(u)):
            s = np.round(u @ u[i], 6)
            at = np.delete(np.arange(len(u)), i)
            for j in at[np.lexsort((ids[at], -s[at]))][:k]:
                if s[j] >= threshold:
                    edges[(min(ids[i], ids[j]), max(ids[i], ids[j]))] = s[j]
        return pd.DataFrame([(rows[by].iloc[0], a, b, float(v)) for (a, b), v in edges.items()], columns=[by, "a", "b", "score"])

    kinds = {c: units.schema[c].dataType.simpleString() for c in (by, seq)}
    return units.select(by, seq, vector).groupBy(by).applyInPandas(run, f"{by} {kinds[by]}, a {kinds[seq]}, b {kinds[seq]}, score double")


def report(units: DataFrame, by: str, seq: str = "sequence_index", vector: str = "vector", conversation: bool = False, threshold: float = CLUSTER_THRESHOLD) -> dict[str, DataFrame]:
    """The tables of a semantic report on primary units with vectors: units with clusters, neighbours, concepts,
    timeline, hotspots, profiles, and for conversations their dynamics."""
    if vector not in units.columns:
        raise MissingModel("a semantic report needs imported vectors")
    rows = cut(clustered(units, by, seq, vector, threshold), "clustered")
    points = timeline(rows, by, seq, vector)
    out = {
        "units": rows, "neighbours": neighbours(rows, by, seq, vector), "concepts": concepts(rows, by, seq, vector).drop("representative_vector"),
        "timeline": points, "hotspots": hotspots(points, by, seq), "profiles": speaker_profiles(rows, by),
    }
    if conversation:
        names = {"by": by, "seq": seq, "cluster": "cluster_id"}
        spoken = names | {"speaker": "speaker"}
        order = Window.partitionBy(by).orderBy(seq)
        similar = rows.withColumn("similarity", vectors.cosine(F.lag(vector).over(order), F.col(vector)))
        out |= {
            "threads": dynamics.threads(rows, **names), "introductions": dynamics.introductions(rows, **spoken), "adoptions": dynamics.adoptions(rows, **spoken),
            "hand_offs": dynamics.hand_offs(rows, **spoken), "recurring": dynamics.recurring(rows, **names), "interleavings": dynamics.interleavings(rows, **names),
            "pairs": dynamics.speaker_pairs(similar, "similarity", by, seq, "speaker"),
        }
    return out


def concept_terms(units: DataFrame, k: int = KEY_TERMS, cluster: str = "cluster_id", id_col: str = "unit_id") -> DataFrame:
    """(cluster, term, n, score, rank): a concept's telling terms by (1 + ln n) idf squared, idf over units. Terms of
    one character, without a letter, or (with five units or more) in four fifths of the units are left out."""
    rows = units.select(F.col(cluster), F.col(id_col), F.explode(T.words_array("text")).alias("term"))
    each = cut(rows.groupBy(cluster, id_col, "term").agg(F.count(F.lit(1)).alias("tf")), "unit-terms")
    df = each.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    total = units.agg(F.count(F.lit(1)).alias("_units"))
    counts = each.groupBy(cluster, "term").agg(F.sum("tf").alias("n")).join(df, "term").join(F.broadcast(total))  # one row
    idf = F.log((F.col("_units") + 1) / (F.col("df") + 1)) + 1
    kept = counts.filter((F.length("term") >= 2) & F.rlike("term", F.lit(r"\p{L}")) & ~((F.col("_units") >= 5) & (F.col("df") * 5 >= F.col("_units") * 4)))
    scored = kept.withColumn("score", F.round((1 + F.log("n")) * idf * idf, 6))
    return ranked(scored.select(cluster, "term", "n", "score"), [cluster], [F.desc("score"), F.desc("n"), F.asc("term")], k)


def concept_evidence(units: DataFrame, found: DataFrame, least: int = MIN_UNITS) -> DataFrame:
    """(cluster_id, label, key_terms, coherence, members, sources, authors, rank) of the concepts with at least ``least``
    units; ``found`` has cluster_id and coherence. The label is the first three key terms, or the id."""
    sizes = units.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("members"), F.count_distinct("source_id").alias("sources"), F.count_distinct("speaker").alias("authors"))
    terms = concept_terms(units).groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("key_terms"))  # at most KEY_TERMS
    rows = sizes.filter(F.col("members") >= least).join(found.select("cluster_id", "coherence"), "cluster_id", "left").join(terms, "cluster_id", "left")
    rows = rows.withColumn("key_terms", F.coalesce("key_terms", F.array().cast("array<string>")))
    label = F.when(F.size("key_terms") > 0, F.array_join(F.slice("key_terms", 1, 3), " · ")).otherwise(F.col("cluster_id"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("members"), F.desc(F.round("coherence", 9)), F.asc("cluster_id"))  # a row a concept
    return rows.withColumns({"label": label, "rank": F.row_number().over(order)})


def corpus_semantics(items: DataFrame, units: DataFrame, k: int = 20, least: int = MIN_UNITS) -> dict[str, DataFrame]:
    """The report on items (item_id, author, source, text) whose sentences are units with vectors: lexical profile of
    all and by author, concept evidence, and the number of units in smaller concepts."""
    rows = cut(clustered(units.withColumn("_all", F.lit(0)), "_all"), "corpus-units")
    found = concepts(rows, "_all")
    small = rows.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < least)
    return {
        "lexical": lexical_profile(items, (), k), "authors": lexical_profile(items.filter("author IS NOT NULL").withColumn("author", F.trim("author")), ("author",), k),
        "concepts": concept_evidence(rows, found, least), "non_concept": small.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("units")), "units": rows,
    }


def word_occurrences(items: DataFrame, target: str, id_col: str = "item_id", author: str = "author") -> DataFrame:
    """(unit_id, source_id, author, sequence_index, text): one unit for each occurrence of a token, its sentence the
    text; numbered within the item. A target that is not one token raises."""
    spark = items.sparkSession
    terms = spark.range(1).select(T.words_array(F.lit(target)).alias("w")).first().w
    if len(terms) != 1:
        raise ValueError("a word-sense target is exactly one token")
    rows = items.select(F.col(id_col).cast("string").alias("source_id"), F.trim(author).alias("author"), F.posexplode(S.sentence_array(F.coalesce("text", F.lit("")))).alias("_s", "text"))
    hits = rows.select("*", F.posexplode(T.words_array("text")).alias("_p", "term")).filter(F.col("term") == terms[0])
    place = F.row_number().over(Window.partitionBy("source_id").orderBy("_s", "_p")) - 1
    numbered = hits.withColumn("sequence_index", place.cast("bigint"))
    return numbered.select(F.concat_ws(":", "source_id", F.lit("word-context"), F.col("sequence_index").cast("string")).alias("unit_id"), "source_id", "author", "sequence_index", "text")


def word_senses(occurrences: DataFrame, vectors_by_text: DataFrame, threshold: float = CLUSTER_THRESHOLD) -> DataFrame:
    """(cluster_id, occurrences, sources, authors, representative): the senses of a word, clusters of its contexts'
    imported vectors (text, vector)."""
    rows = vectors.rows_by_vector(vectors_by_text, occurrences)
    # zipped numbers: ids in order, so that the first members of concepts are the first occurrences
    placed = rows.withColumn("_q", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("unit_id"))).withColumn("_all", F.lit(0))  # one word's occurrences
    found = clustered(placed, "_all", "_q", "vector", threshold)
    best = concepts(found, "_all", "_q").select("cluster_id", "representative")
    names = found.select(F.col("_q").alias("representative"), F.col("unit_id").alias("representative_unit"))
    sums = found.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("occurrences"), F.count_distinct("source_id").alias("sources"), F.count_distinct("author").alias("authors"))
    return sums.join(best, "cluster_id").join(names, "representative").drop("representative")


def interpreted(concept_rows: DataFrame, backend: Callable[[pd.DataFrame], pd.DataFrame] | None) -> DataFrame:
    """concept_rows with ``label`` and ``confidence`` from a backend that maps pandas batches of them to (cluster_id,
    label, confidence); a confidence outside [0, 1] raises when it is read, a missing backend at once."""
    if backend is None:
        raise MissingModel("interpretation needs a backend")

    def run(batches):
        for batch in batches:
            yield backend(batch)[["cluster_id", "label", "confidence"]]

    named = concept_rows.mapInPandas(run, "cluster_id string, label string, confidence double")
    checked = F.when(F.col("confidence").between(0, 1), F.col("confidence")).otherwise(F.raise_error(F.lit("a confidence is outside 0 to 1")).cast("double"))
    return concept_rows.join(named.withColumn("confidence", checked), "cluster_id")


def graph(units: DataFrame, edges: DataFrame, concept_rows: DataFrame, mentions: DataFrame | None = None, canonical: DataFrame | None = None, layers: dict[str, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, kind, label) and edges (source, target, kind, label, weight) of a linguistic semantic graph.

    units has unit_id, sequence_index, cluster_id, text; edges a and b, unit ids, and score; concept_rows
    cluster_id and label. mentions (mention_id, sentence_index, text, entity_type) hang on the unit of their
    sentence and on the canonical entity (entity_id, name, aliases) that bears their lower-cased text;
    further layers (row_id, sentence_index, label) by name, such as event, relation, discourse, topic."""
    node = lambda df, i, kind, label: df.select(i.alias("node_id"), F.lit(kind).alias("kind"), label.alias("label"))
    none, no_weight = F.lit(None).cast("string"), F.lit(None).cast("double")
    edge = lambda df, a, b, kind, label=none, weight=no_weight: df.select(a.alias("source"), b.alias("target"), F.lit(kind).alias("kind"), label.alias("label"), weight.alias("weight"))
    concept = F.concat(F.lit("concept:"), "cluster_id")
    nodes = [node(units, F.col("unit_id"), "unit", F.col("text")), node(concept_rows, concept, "concept", F.col("label"))]
    links = [edge(edges, F.col("a"), F.col("b"), "semantic_neighbour", weight=F.col("score")), edge(units, F.col("unit_id"), concept, "concept_membership")]
    at = units.select("unit_id", F.col("sequence_index").alias("sentence_index"))
    if mentions is not None:
        own = F.concat(F.lit("mention:"), F.col("mention_id").cast("string"))
        nodes.append(node(mentions, own, "entity_mention", F.col("text")))
        links.append(edge(mentions.join(at, "sentence_index"), F.col("unit_id"), own, "unit_contains_mention", F.col("entity_type")))
        if canonical is not None:
            entity = F.concat(F.lit("entity:"), F.col("entity_id").cast("string"))
            nodes.append(node(canonical, entity, "canonical_entity", F.col("name")))
            names = canonical.select("entity_id", F.explode(F.array_distinct(F.transform("aliases", F.lower))).alias("_n"))
            links.append(edge(mentions.join(names, F.lower("text") == F.col("_n")), own, entity, "mention_canonical"))
    for name, rows in (layers or {}).items():
        own = F.concat(F.lit(f"{name}:"), F.col("row_id").cast("string"))
        nodes.append(node(rows, own, name, F.col("label")))
        links.append(edge(rows.join(at, "sentence_index"), F.col("unit_id"), own, f"unit_contains_{name}"))
    union = lambda parts: parts[0] if len(parts) == 1 else union([parts[0].unionByName(parts[1]), *parts[2:]])
    return union(nodes), union(links)

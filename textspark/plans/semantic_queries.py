"""Registered queries of the semantic operators, with DuckDB SQL. Fifty consecutive embeddings are a source's units,
their label the concept where SQL has to follow; turns take the vector of a number made of theirs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textspark.operators import semantic, vectors
from textspark.plans.lexical_queries import _quoted, _table
from textspark.plans.report_queries import P, sentence_ctes
from textspark.sources.scratch import cut


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return rows.select(
        F.floor(F.col("vec_id") / 50).alias("source_id"), F.col("vec_id").alias("sequence_index"), F.col("vec_id").cast("string").alias("unit_id"), F.col("embedding").alias("vector"),
        F.concat(F.lit("concept-"), F.col("label").cast("string")).alias("cluster_id"), F.concat(F.lit("s"), (F.col("vec_id") % 3).cast("string")).alias("speaker"),
    )


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as units whose concept is their source."""
    rows = _table(spark, sf_dir, "documents")
    return rows.select(F.col("doc_id").alias("unit_id"), F.col("doc_id").alias("source_id"), F.col("lang").alias("speaker"), F.col("source").alias("cluster_id"), "text")


def document_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = semantic.document_units(_table(spark, sf_dir, "documents")).filter("kind != 'paragraph'")
    return rows.select("unit_id", "kind", "sequence_index", F.md5("text").alias("digest"))


def conversation_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = semantic.conversation_units(_table(spark, sf_dir, "conversations"))
    return rows.select("unit_id", "kind", "parent_id", "sequence_index", "speaker", F.md5("text").alias("digest"))


def semantic_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = semantic.concepts(_units(spark, sf_dir), "source_id")
    return rows.select("source_id", "cluster_id", "representative", F.round("coherence", 4).alias("coherence"), "members")


def semantic_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = semantic.timeline(_units(spark, sf_dir), "source_id")
    return rows.withColumns({c: F.round(c, 5) for c in ("shift", "activation")})


def semantic_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = semantic.timeline(_units(spark, sf_dir), "source_id").withColumn("activation", F.round("activation", 5))
    rows = semantic.hotspots(points, "source_id")
    return rows.withColumns({c: F.round(c, 4) for c in ("coverage", "persistence", "mean_activation")})


def semantic_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.speaker_profiles(_units(spark, sf_dir), "source_id").withColumn("share", F.round("share", 6))


def semantic_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.neighbours(_units(spark, sf_dir), "source_id")


def concept_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.concept_terms(_texts(spark, sf_dir))


def concept_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _texts(spark, sf_dir)
    found = texts.groupBy("cluster_id").agg(F.avg(F.length("text") / 1000).alias("coherence"))
    rows = semantic.concept_evidence(texts, found)
    return rows.select("cluster_id", "label", "members", "sources", "authors", F.round("coherence", 6).alias("coherence"), "rank")


def neighbourhood_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = cut(vectors.nearest(_table(spark, sf_dir, "embeddings"), 4), "neighbours")  # the three best are among the four
    return vectors.compare_edges(vectors.undirected(near), vectors.undirected(near.filter("rank <= 3")))


def word_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("lang").alias("author"), "text")
    return semantic.word_occurrences(items, "The").select("unit_id", "author", F.md5("text").alias("digest"))


def _turn_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with the vector of a number made of conversation and turn."""
    known = _table(spark, sf_dir, "embeddings")
    n = known.agg(F.count(F.lit(1)).alias("_n"))
    turns = _table(spark, sf_dir, "conversations").join(F.broadcast(n))  # one row
    keyed = turns.withColumn("vec_id", (F.col("conv_id") * 7 + F.col("turn")) % F.col("_n"))
    return keyed.join(known, "vec_id").select("conv_id", F.col("turn").alias("sequence_index"), F.col("role").alias("speaker"), "text", F.col("embedding").alias("vector"))


def conversation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts by average link, threads and hotspots of every conversation: one row a concept."""
    parts = semantic.report(_turn_units(spark, sf_dir), "conv_id", conversation=True, threshold=0.2)
    rows = parts["hotspots"].join(parts["threads"], ["conv_id", "cluster_id"]).join(parts["introductions"], ["conv_id", "cluster_id"])
    return rows.select("conv_id", "cluster_id", F.round("coverage", 5).alias("coverage"), "segments", "introduced_at", "introduced_by")


def semantic_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges by kind of the graph of the first-level layers."""
    units = _units(spark, sf_dir).withColumn("text", F.col("unit_id"))
    edges = vectors.knn_graph(_table(spark, sf_dir, "embeddings")).select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), "score")
    concept = units.select("cluster_id", F.col("cluster_id").alias("label")).distinct()
    mentions = units.select(F.col("unit_id").alias("mention_id"), F.col("sequence_index").alias("sentence_index"), F.upper("speaker").alias("text"), F.lit("PER").alias("entity_type"))
    canonical = units.select(F.col("speaker").alias("entity_id"), F.col("speaker").alias("name"), F.array("speaker").alias("aliases")).distinct()
    _, links = semantic.graph(units, edges, concept, mentions, canonical)
    return links.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("target").alias("targets"))


QUERIES = {
    f.__name__: f
    for f in (
        document_units, conversation_units, semantic_concepts, semantic_timeline, semantic_hotspots, semantic_profiles, semantic_neighbours, concept_terms, concept_evidence,
        neighbourhood_comparison, word_occurrences, conversation_report, semantic_graph,
    )
}

_U = "u AS (SELECT vec_id // 50 AS source_id, vec_id AS q, embedding::DOUBLE[] AS v, 'concept-' || label AS cluster_id, 's' || vec_id % 3 AS speaker FROM embeddings)"
_MED = f"""{_U}, pr AS (SELECT x.source_id, x.cluster_id, x.q AS a, y.q AS b, list_cosine_similarity(x.v, y.v) AS s FROM u x JOIN u y ON x.source_id = y.source_id AND x.cluster_id = y.cluster_id AND x.q <> y.q),
    mm AS (SELECT u.source_id, u.cluster_id, u.q, round(coalesce(avg(s), 0), 9) AS m FROM u LEFT JOIN pr ON u.source_id = pr.source_id AND u.q = pr.a GROUP BY ALL), md AS (SELECT source_id, cluster_id, q AS representative FROM mm QUALIFY row_number() OVER (PARTITION BY source_id, cluster_id ORDER BY m DESC, q) = 1)"""
_TIME = f"""{_MED}, tl AS (SELECT x.source_id, x.q AS sequence_index, x.cluster_id, round(coalesce((1 - list_cosine_similarity(lag(x.v) OVER (PARTITION BY x.source_id ORDER BY x.q), x.v)) / 2, 0), 5) AS shift,
    round(greatest(0, least(1, list_cosine_similarity(x.v, r.v))), 5) AS activation FROM u x JOIN md ON x.source_id = md.source_id AND x.cluster_id = md.cluster_id JOIN u r ON r.source_id = md.source_id AND r.q = md.representative)"""
_KNN = """SELECT least(a, b) AS a, greatest(a, b) AS b, max(score) AS score FROM (SELECT x.vec_id AS a, y.vec_id AS b, round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) AS score FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id
    QUALIFY row_number() OVER (PARTITION BY x.vec_id ORDER BY round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) DESC, y.vec_id) <= {k}) WHERE score >= 0.25 GROUP BY 1, 2"""
_TERMS = f"""x AS (SELECT source AS cluster_id, doc_id, lower(unnest(regexp_extract_all(text, {_quoted(P.TOKEN)}))) AS term FROM documents), df AS (SELECT term, count(DISTINCT doc_id) AS df FROM x GROUP BY term), c AS (SELECT cluster_id, term, count(*) AS n FROM x GROUP BY ALL), nn AS (SELECT count(*) AS u FROM documents),
    kt AS (SELECT cluster_id, term, n, round((1 + ln(n)) * pow(ln((u + 1) / (df + 1)) + 1, 2), 6) AS score FROM c JOIN df USING (term), nn WHERE length(term) >= 2 AND regexp_matches(term, '\\p{{L}}') AND NOT (u >= 5 AND df * 5 >= u * 4)),
    ct AS (SELECT *, (row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, n DESC, term))::INT AS rank FROM kt QUALIFY rank <= 4)"""

ORACLE_SQL = {
    "document_units": f"WITH {sentence_ctes()} SELECT doc_id || ':sentence:' || ordinal AS unit_id, 'sentence' AS kind, ordinal AS sequence_index, md5(sentence) AS digest FROM sent UNION ALL SELECT doc_id || ':document', 'document', 0, md5(coalesce(text, '')) FROM documents",
    "conversation_units": f"""WITH cv AS (SELECT conv_id || ':' || turn AS k, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS q, role, coalesce(text, '') AS text FROM conversations), {sentence_ctes(table='cv', key='k')}
        SELECT k || ':turn' AS unit_id, 'turn' AS kind, NULL AS parent_id, q AS sequence_index, role AS speaker, md5(text) AS digest FROM cv UNION ALL SELECT k || ':sentence:' || ordinal, 'sentence', k || ':turn', ordinal, role, md5(sentence) FROM sent JOIN cv USING (k)""",
    "semantic_concepts": f"WITH {_MED}, co AS (SELECT source_id, cluster_id, avg(s) AS s FROM pr GROUP BY ALL) SELECT source_id, cluster_id, representative, round(coalesce(s, 1.0), 4) AS coherence, (SELECT count(*) FROM u WHERE u.source_id = md.source_id AND u.cluster_id = md.cluster_id) AS members FROM md LEFT JOIN co USING (source_id, cluster_id)",
    "semantic_timeline": f"WITH {_TIME} SELECT * FROM tl",
    "semantic_hotspots": f"""WITH {_TIME}, p AS (SELECT *, count(*) OVER (PARTITION BY source_id) AS n, row_number() OVER (PARTITION BY source_id ORDER BY sequence_index) AS p FROM tl),
        h AS (SELECT source_id, cluster_id, count(*) / max(n) AS coverage, (max(p) - min(p) + 1) / max(n) AS persistence, avg(activation) AS mean_activation, arg_max(sequence_index, (activation, -sequence_index)) AS peak FROM p GROUP BY ALL)
        SELECT source_id, cluster_id, round(coverage, 4) AS coverage, round(persistence, 4) AS persistence, round(mean_activation, 4) AS mean_activation, peak, (row_number() OVER (PARTITION BY source_id ORDER BY round(coverage, 9) DESC, round(mean_activation, 9) DESC, cluster_id))::INT AS rank FROM h""",
    "semantic_profiles": f"WITH {_U}, c AS (SELECT source_id, speaker, cluster_id, count(*) AS units FROM u GROUP BY ALL) SELECT *, round(units / sum(units) OVER (PARTITION BY source_id, speaker), 6) AS share, (row_number() OVER (PARTITION BY source_id, speaker ORDER BY units DESC, cluster_id))::INT AS rank FROM c",
    "semantic_neighbours": f"""WITH {_U}, e AS (SELECT x.source_id, x.q AS a, y.q AS b, round(list_cosine_similarity(x.v, y.v), 6) AS score FROM u x JOIN u y ON x.source_id = y.source_id AND x.q <> y.q), r AS (SELECT *, row_number() OVER (PARTITION BY source_id, a ORDER BY score DESC, b) AS k FROM e)
        SELECT source_id, least(a, b) AS a, greatest(a, b) AS b, max(score) AS score FROM r WHERE k <= 4 AND score >= 0.25 GROUP BY 1, 2, 3""",
    "concept_terms": f"WITH {_TERMS} SELECT cluster_id, term, n, score, rank FROM ct",
    "concept_evidence": f"""WITH {_TERMS}, l AS (SELECT cluster_id, string_agg(term, ' · ' ORDER BY rank) AS label FROM ct WHERE rank <= 3 GROUP BY ALL), s AS (SELECT source AS cluster_id, count(*) AS members, count(DISTINCT doc_id) AS sources, count(DISTINCT lang) AS authors, avg(length(text) / 1000) AS h FROM documents GROUP BY ALL)
        SELECT cluster_id, coalesce(label, cluster_id) AS label, members, sources, authors, round(h, 6) AS coherence, (row_number() OVER (ORDER BY members DESC, round(h, 9) DESC, cluster_id))::INT AS rank FROM s LEFT JOIN l USING (cluster_id) WHERE members >= 2""",
    "neighbourhood_comparison": f"WITH x AS ({_KNN.format(k=4)}), y AS ({_KNN.format(k=3)}) SELECT count(*) FILTER (x.score IS NOT NULL AND y.score IS NOT NULL) AS shared, count(*) FILTER (y.score IS NULL) AS left_only, count(*) FILTER (x.score IS NULL) AS right_only, coalesce(max(abs(x.score - y.score)), 0) AS max_delta FROM x FULL JOIN y USING (a, b)",
    "word_occurrences": f"""WITH {sentence_ctes()}, o AS (SELECT doc_id, ordinal, sentence, generate_subscripts(t, 1) AS p, unnest(t) AS w FROM (SELECT *, list_transform(regexp_extract_all(sentence, {_quoted(P.TOKEN)}), lambda x: lower(x)) AS t FROM sent))
        SELECT doc_id || ':word-context:' || (row_number() OVER (PARTITION BY doc_id ORDER BY ordinal, p) - 1) AS unit_id, lang AS author, md5(sentence) AS digest FROM o JOIN documents USING (doc_id) WHERE w = 'the'""",
    "semantic_graph": f"""WITH {_U}, e AS ({_KNN.format(k=4)}) SELECT 'semantic_neighbour' AS kind, count(*) AS n, count(DISTINCT b) AS targets FROM e UNION ALL SELECT 'concept_membership', count(*), count(DISTINCT cluster_id) FROM u
        UNION ALL SELECT 'unit_contains_mention', count(*), count(*) FROM u UNION ALL SELECT 'mention_canonical', count(*), count(DISTINCT speaker) FROM u""",
}

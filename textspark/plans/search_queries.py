"""Registered queries of retrieval and vector operators, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textspark.functions import patterns as P
from textspark.functions import text as T
from textspark.operators import lexical, search, vectors
from textspark.plans.lexical_queries import POSTINGS, _quoted, _table
from textspark.sources.scratch import cut


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25(_table(spark, sf_dir, "documents"), _benchmark(spark, sf_dir))


def tfidf_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.tfidf_search(_table(spark, sf_dir, "documents"), _benchmark(spark, sf_dir))


def token_window_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = search.token_chunks(_table(spark, sf_dir, "documents"))
    return chunks.select("chunk_id", "token_start", "token_end", F.md5(F.array_join("terms", " ")).alias("digest"))


def filtered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = search.filter_documents(_table(spark, sf_dir, "documents"), equals={"lang": "en"}, any_of={"source": ["src1", "src2", "src3"]}, between={"n_chars": (200, None)})
    return search.bm25(docs, _benchmark(spark, sf_dir), k=5)


def phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.phrase_filter(_table(spark, sf_dir, "documents"), ["of the"]).select("doc_id", "lang", "source")


def document_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.facets(_table(spark, sf_dir, "documents"), ["lang", "source"])


def tags_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = search.parse_tags(F.concat_ws(", ", "source", F.concat_ws(";", "lang", "source")))
    return _table(spark, sf_dir, "documents").select("doc_id", F.array_join(tags, " ").alias("tags"))


def _vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0")  # the stated query set
    return rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.top_k(_table(spark, sf_dir, "embeddings"), _vector_queries(spark, sf_dir))


def related_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = vectors.top_k(_table(spark, sf_dir, "embeddings"), _vector_queries(spark, sf_dir), k=11).filter("query_id != vec_id")
    return lexical.ranked(hits.drop("rank"), ["query_id"], [F.desc("score"), F.asc("vec_id")], 10)


def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.neighbour_pairs(_table(spark, sf_dir, "embeddings"), 0.25)


def knn_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.knn_graph(_table(spark, sf_dir, "embeddings"))


def label_medoids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.medoids(_table(spark, sf_dir, "embeddings")).withColumn("cohesion", F.round("cohesion", 4))


def label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.mean_vectors(_table(spark, sf_dir, "embeddings"), "label").withColumn("value", F.round("value", 6))


def softmax_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    p = vectors.softmax(F.transform("embedding", lambda x: x.cast("double")))
    best = T.bound(p, lambda p: T.bound(F.array_max(p), lambda top: F.struct(F.round(top, 6).alias("highest"), (F.array_position(p, top) - 1).alias("at"))))
    return rows.select("vec_id", F.inline(F.array(best)))


def hybrid_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexical_hits = search.bm25(_table(spark, sf_dir, "documents"), _benchmark(spark, sf_dir).filter("query_id % 20 = 0"), k=64)
    semantic = vectors.top_k(_table(spark, sf_dir, "embeddings"), _vector_queries(spark, sf_dir), k=64).withColumnRenamed("vec_id", "doc_id")
    return search.fuse(lexical_hits, semantic.join(lexical_hits.select("query_id").distinct(), "query_id", "left_semi"), 10).select("query_id", "doc_id", "score", "rank")


def rerank_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, asked = _table(spark, sf_dir, "documents"), _benchmark(spark, sf_dir)
    hits = cut(search.bm25(docs, asked).join(asked, "query_id"), "hits")  # ten a query, so that texts are not shuffled
    hits = docs.select("doc_id", "text").join(search.small(hits), "doc_id")
    return search.overlap_rerank(hits, 3).select("query_id", "doc_id", "rerank_score", "rank")


def corpus_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its statistics and its best TF-IDF term."""
    docs = _table(spark, sf_dir, "documents")
    best = lexical.best_tfidf(docs, 1).select("doc_id", F.col("term").alias("best_term"), "length")
    return docs.select("doc_id", "lang").join(best, "doc_id", "left").select("doc_id", "lang", "best_term", F.coalesce("length", F.lit(0)).cast("bigint").alias("n_terms"))


QUERIES = {
    f.__name__: f
    for f in (
        bm25_topk, tfidf_search, token_window_chunks, filtered_search, phrase_search, document_facets, tags_parse, vector_topk, related_vectors,
        cosine_pairs, knn_graph, label_medoids, label_centroids, softmax_scores, hybrid_fusion, rerank_overlap, corpus_report,
    )
}


def _bm25(docs: str, where: str = "true", k: int = 10) -> str:
    return f"""d AS ({docs}), toks AS (SELECT doc_id, regexp_extract_all(text, {_quoted(P.TOKEN)}) AS t FROM d), tok AS (SELECT doc_id, lower(unnest(t)) AS term FROM toks),
        post AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL), len AS (SELECT doc_id, len(t) AS dl FROM toks), n AS (SELECT count(*) AS n, avg(dl) AS mean FROM len),
        q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, lower(unnest(regexp_extract_all(text, {_quoted(P.TOKEN)}))) AS term FROM benchmark) WHERE {where} GROUP BY ALL),
        df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
        sc AS (SELECT query_id, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score, count(*) AS matched
          FROM q JOIN post USING (term) JOIN df USING (term) JOIN len USING (doc_id), n GROUP BY ALL),
        bm AS (SELECT query_id, doc_id, score, matched, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, matched DESC, doc_id))::INT AS rank FROM sc QUALIFY rank <= {k})"""


_PAIR = "list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[])"
_PAIRS = f"pairs AS (SELECT x.vec_id AS a, y.vec_id AS b, round({_PAIR}, 6) AS score FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id)"
_TOP = f"top AS (SELECT x.vec_id AS query_id, y.vec_id, round({_PAIR}, 6) AS score, (row_number() OVER (PARTITION BY x.vec_id ORDER BY round({_PAIR}, 6) DESC, y.vec_id))::INT AS rank FROM embeddings x, embeddings y WHERE x.vec_id % 20 = 0)"

ORACLE_SQL = {
    "bm25_topk": f"WITH {_bm25('SELECT * FROM documents')} SELECT * FROM bm",
    "filtered_search": "WITH " + _bm25("SELECT * FROM documents WHERE lang = 'en' AND source IN ('src1', 'src2', 'src3') AND n_chars >= 200", k=5) + " SELECT * FROM bm",
    "tfidf_search": f"""WITH {POSTINGS}, df AS (SELECT term, count(*) AS df FROM post GROUP BY term), n AS (SELECT count(*) AS n FROM documents),
        dw AS (SELECT doc_id, term, tf / sum(tf) OVER (PARTITION BY doc_id) * (ln((n + 1) / (df + 1)) + 1) AS w FROM post JOIN df USING (term), n),
        q AS (SELECT query_id, term, count(*) AS tf FROM (SELECT item_id AS query_id, lower(unnest(regexp_extract_all(text, {_quoted(P.TOKEN)}))) AS term FROM benchmark) GROUP BY ALL),
        qw AS (SELECT query_id, term, tf / sum(tf) OVER (PARTITION BY query_id) * (ln((n + 1) / (coalesce(df, 0) + 1)) + 1) AS w FROM q LEFT JOIN df USING (term), n),
        dn AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM dw GROUP BY doc_id), qn AS (SELECT query_id, sqrt(sum(w * w)) AS norm FROM qw GROUP BY query_id),
        s AS (SELECT query_id, doc_id, sum(dw.w * qw.w) AS dot, count(*) AS matched FROM dw JOIN qw USING (term) GROUP BY ALL),
        c AS (SELECT query_id, doc_id, round(dot / (dn.norm * qn.norm), 6) AS score, matched FROM s JOIN dn USING (doc_id) JOIN qn USING (query_id))
        SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, matched DESC, doc_id))::INT AS rank FROM c QUALIFY rank <= 10""",
    "token_window_chunks": f"""WITH toks AS (SELECT doc_id, list_transform(regexp_extract_all(text, {_quoted(P.TOKEN)}), lambda x: lower(x)) AS t FROM documents),
        o AS (SELECT doc_id, t, unnest(range(0, greatest(0, ceil((len(t) - 256) / 224))::BIGINT + 1)) AS o FROM toks WHERE len(t) > 0)
        SELECT doc_id || ':' || o AS chunk_id, o * 224 AS token_start, least(o * 224 + 256, len(t)) AS token_end, md5(array_to_string(t[o * 224 + 1:o * 224 + 256], ' ')) AS digest FROM o""",
    "phrase_search": f"SELECT doc_id, lang, source FROM documents WHERE contains(array_to_string(list_transform(regexp_extract_all(text, {_quoted(P.TOKEN)}), lambda x: lower(x)), ' '), 'of the')",
    "document_facets": "SELECT 'lang' AS field, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source",
    "tags_parse": "SELECT doc_id, array_to_string(list_sort(list_distinct([source, lang])), ' ') AS tags FROM documents",
    "vector_topk": f"WITH {_TOP} SELECT * FROM top WHERE rank <= 10",
    "related_vectors": f"WITH {_TOP}, r AS (SELECT query_id, vec_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS k FROM top WHERE rank <= 11 AND query_id <> vec_id) SELECT query_id, vec_id, score, k AS rank FROM r WHERE k <= 10",
    "cosine_pairs": f"WITH {_PAIRS} SELECT * FROM pairs WHERE score >= 0.25",
    "knn_graph": f"""WITH {_PAIRS}, b AS (SELECT a, b, score FROM pairs UNION ALL SELECT b, a, score FROM pairs), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS k FROM b)
        SELECT least(a, b) AS a, greatest(a, b) AS b, max(score) AS score FROM r WHERE k <= 4 AND score >= 0.25 GROUP BY 1, 2""",
    "label_medoids": f"""WITH i AS (SELECT x.vec_id AS a, y.vec_id AS b, {_PAIR} AS score, x.label FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id AND x.label = y.label),
        t AS (SELECT label, a, round(avg(score), 9) AS mean FROM i GROUP BY ALL UNION ALL SELECT label, min(vec_id), 0 FROM embeddings GROUP BY label HAVING count(*) = 1),
        m AS (SELECT label, a AS medoid FROM t QUALIFY row_number() OVER (PARTITION BY label ORDER BY mean DESC, a) = 1)
        SELECT label, medoid, round(coalesce((SELECT avg(score) FROM i WHERE i.label = m.label), 1.0), 4) AS cohesion, (SELECT count(*) FROM embeddings e WHERE e.label = m.label) AS n FROM m""",
    "label_centroids": "WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings) SELECT label, dim::INT AS dim, round(avg(x), 6) AS value, count(*) AS n FROM x GROUP BY ALL",
    "softmax_scores": """WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), p AS (SELECT *, exp(x - max(x) OVER (PARTITION BY vec_id)) AS e FROM x)
        SELECT vec_id, round(max(e) / sum(e), 6) AS highest, min(i) FILTER (e = 1) AS at FROM p GROUP BY vec_id""",
    "hybrid_fusion": f"""WITH {_bm25('SELECT * FROM documents', 'query_id % 20 = 0', 64)}, {_TOP}, t AS (SELECT * FROM top WHERE rank <= 64 AND query_id IN (SELECT query_id FROM bm)),
        l AS (SELECT query_id, doc_id, CASE WHEN max(score) OVER w - min(score) OVER w <= 1.1920929e-07 THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS l FROM bm WINDOW w AS (PARTITION BY query_id)),
        s AS (SELECT query_id, vec_id AS doc_id, CASE WHEN max(score) OVER w - min(score) OVER w <= 1.1920929e-07 THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS s FROM t WINDOW w AS (PARTITION BY query_id)),
        f AS (SELECT query_id, doc_id, coalesce(s, 0) AS s, round(0.4 * coalesce(l, 0) + 0.6 * coalesce(s, 0), 6) AS score FROM l FULL JOIN s USING (query_id, doc_id))
        SELECT query_id, doc_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, s DESC, doc_id))::INT AS rank FROM f QUALIFY rank <= 10""",
    "rerank_overlap": f"""WITH {_bm25('SELECT * FROM documents')}, q2 AS (SELECT item_id AS query_id, list_distinct(list_transform(regexp_extract_all(text, {_quoted(P.TOKEN)}), lambda x: lower(x))) AS qt FROM benchmark),
        s AS (SELECT query_id, doc_id, bm.rank AS first_rank, round(len(list_intersect(qt, list_transform(t, lambda x: lower(x)))) / greatest(len(qt), 1), 6) AS rerank_score FROM bm JOIN q2 USING (query_id) JOIN toks USING (doc_id))
        SELECT query_id, doc_id, rerank_score, (row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, first_rank))::INT AS rank FROM s QUALIFY rank <= 3""",
    "corpus_report": f"""WITH {POSTINGS}, d AS (SELECT term, count(*) AS df FROM post GROUP BY term), n AS (SELECT count(*) AS n FROM documents),
        s AS (SELECT doc_id, term, tf, sum(tf) OVER (PARTITION BY doc_id) AS l, round(tf / sum(tf) OVER (PARTITION BY doc_id) * (ln((n + 1) / (df + 1)) + 1), 6) AS score FROM post JOIN d USING (term), n),
        b AS (SELECT doc_id, term, l FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, tf DESC, term) = 1)
        SELECT doc_id, lang, term AS best_term, coalesce(l, 0)::BIGINT AS n_terms FROM documents LEFT JOIN b USING (doc_id)""",
}

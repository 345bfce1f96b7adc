"""Registered queries of the lexical and text operators, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textspark.functions import patterns as P
from textspark.functions import text as T
from textspark.operators import lexical, markov, similarity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _in(words) -> str:
    return "(" + ", ".join(map(_quoted, words)) + ")"


#: Exploded tokens and postings of documents, as DuckDB CTEs.
TOKENS = f"toks AS (SELECT doc_id, regexp_extract_all(text, {_quoted(P.TOKEN)}) AS t FROM documents), tok AS (SELECT doc_id, unnest(t) AS token, lower(unnest(t)) AS term, generate_subscripts(t, 1) - 1 AS pos FROM toks)"
POSTINGS = f"{TOKENS}, post AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL)"
STOP = _in(P.STOP_EN)


def doc_text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return _table(spark, sf_dir, "documents").select(
        "doc_id",
        F.octet_length(text).cast("bigint").alias("bytes"),
        F.char_length(text).cast("bigint").alias("chars"),
        F.size(T.token_array(text)).cast("bigint").alias("words"),
        T.line_count(text).alias("lines"),
    )


def token_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.tokens(_table(spark, sf_dir, "documents"))
    return rows.groupBy("doc_id", T.token_kind(F.col("token")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def script_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = T.script_counts(F.col("text"))
    return _table(spark, sf_dir, "documents").select("doc_id", *(counts[s].alias(s.lower()) for s in counts))


def normalized_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower(T.drop_non_ascii("text"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(T.collapse_whitespace(low)).alias("digest"))


def term_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.term_frequencies(_table(spark, sf_dir, "documents")).withColumn("frequency", F.round("frequency", 9))


def top_terms_no_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.top_terms(_table(spark, sf_dir, "documents"), 5).select("doc_id", "rank", "term", "tf", F.round("frequency", 6).alias("frequency"))


def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.keywords(_table(spark, sf_dir, "documents")).select("doc_id", "rank", "term", "tf", F.round("score", 6).alias("score"))


def rake_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.phrase_keywords(_table(spark, sf_dir, "documents"), 5).select("doc_id", "rank", F.md5("phrase").alias("phrase"), "n_terms", F.round("score", 4).alias("score"))


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.corpus_stats(_table(spark, sf_dir, "documents")).withColumn("mean_terms", F.round("mean_terms", 6))


def corpus_term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.corpus_term_stats(_table(spark, sf_dir, "documents")).withColumn("frequency", F.round("frequency", 9))


def enriched_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lexical.enriched_stats(_table(spark, sf_dir, "documents"))
    rounded = [c for c, kind in rows.dtypes if kind == "double"]
    return rows.withColumns({c: F.round(c, 6) for c in rounded})


def token_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.token_ngrams(_table(spark, sf_dir, "documents"), 2)


def char_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.char_ngrams(_table(spark, sf_dir, "documents"), 3).groupBy("ngram").agg(F.sum("tf").alias("n"), F.count(F.lit(1)).alias("documents"))


def stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.stem_counts(_table(spark, sf_dir, "documents"))


def tfidf_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.best_tfidf(_table(spark, sf_dir, "documents"), 10).select("doc_id", "rank", "term", "tf", "df", "score")


def sparse_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.sparse_matrix(_table(spark, sf_dir, "documents"))


def cooccurrence_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.related_terms(_table(spark, sf_dir, "documents")).withColumn("score", F.round("score", 6))


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.near_duplicate_pairs(_table(spark, sf_dir, "documents")).withColumn("score", F.round("score", 6))


def benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.set_overlap(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def markov_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markov.transitions(_table(spark, sf_dir, "conversations"))


def markov_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markov.starts(_table(spark, sf_dir, "conversations"))


def markov_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markov.predict(markov.transitions(_table(spark, sf_dir, "conversations"))).withColumn("probability", F.round("probability", 6))


def markov_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    keyed = turns.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("doc_id"), "text")
    return markov.perplexity(keyed, markov.transitions(turns)).withColumn("perplexity", F.round("perplexity", 4))


QUERIES = {
    f.__name__: f
    for f in (
        doc_text_stats, token_kind_counts, script_profile, normalized_texts, term_frequencies, top_terms_no_stop, keywords, rake_phrases, corpus_stats,
        corpus_term_stats, enriched_stats, token_bigrams, char_trigrams, stems, tfidf_terms, sparse_matrix, cooccurrence_related, near_duplicates,
        benchmark_overlap, markov_transitions, markov_starts, markov_predict, markov_perplexity,
    )
}

_KIND = "CASE " + " ".join(f"WHEN regexp_full_match(token, {_quoted(p)}) THEN '{k}'" for k, p in P.TOKEN_KINDS.items()) + " ELSE 'other' END"
_PLAIN = r"regexp_replace(text, '[\s\p{N}!-/:-@\[-`{-~…。！？]', '', 'g')"
_STEM = "CASE WHEN strlen(term) <= 3 THEN term ELSE regexp_replace(cut, '(n)n$|(t)t$|(p)p$', '\\1\\2\\3') END"
_CUT = "CASE " + " ".join(f"WHEN ends_with(term, '{s}') AND strlen(term) > {len(s) + 2} THEN term[:-{len(s) + 1}] || '{r}'" for s, r in P.STEM_SUFFIXES.items()) + " ELSE term END"
_TURNS = f"toks AS (SELECT conv_id, turn, list_transform(regexp_extract_all(text, {_quoted(P.TOKEN)}), lambda x: lower(x)) AS t FROM conversations)"
_CHAIN = f"{_TURNS}, g AS (SELECT conv_id, turn, t, unnest(range(1, len(t) - 1)) AS i FROM toks), chain AS (SELECT t[i] || ' ' || t[i + 1] AS context, t[i + 2] AS next, count(*) AS n FROM g GROUP BY ALL)"
_SHINGLES = "w AS (SELECT {id}, list_transform(regexp_extract_all(text, {p}), lambda x: lower(x)) AS t FROM {table}), i AS (SELECT {id}, t, unnest(range(1, len(t) - 3)) AS i FROM w), e AS (SELECT DISTINCT {id}, array_to_string(t[i:i + 4], ' ') AS g FROM i)"

ORACLE_SQL = {
    "doc_text_stats": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
        SELECT doc_id, strlen(text) AS bytes, length(text) AS chars, len(regexp_extract_all(text, {_quoted(P.TOKEN)})) AS words,
          CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - (CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0 END) END::BIGINT AS lines FROM d""",
    "token_kind_counts": f"WITH {TOKENS} SELECT doc_id, {_KIND} AS kind, count(*) AS n FROM tok GROUP BY ALL",
    "script_profile": "SELECT doc_id, " + ", ".join(f"(length({_PLAIN}) - length(regexp_replace({_PLAIN}, '[{span}]', '', 'g')))::BIGINT AS {name.lower()}" for name, span in P.SCRIPTS.items()) + " FROM documents",
    "normalized_texts": r"SELECT doc_id, md5(trim(regexp_replace(lower(regexp_replace(text, '[^\x00-\x7F]', '', 'g')), '\s+', ' ', 'g'))) AS digest FROM documents",
    "term_frequencies": f"WITH {POSTINGS} SELECT doc_id, term, tf, round(tf / sum(tf) OVER (PARTITION BY doc_id), 9) AS frequency FROM post",
    "top_terms_no_stop": f"""WITH {POSTINGS}, f AS (SELECT *, tf / sum(tf) OVER (PARTITION BY doc_id) AS fr FROM post),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, term) AS rank FROM f WHERE term NOT IN {STOP})
        SELECT doc_id, rank::INT AS rank, term, tf, round(fr, 6) AS frequency FROM r WHERE rank <= 5""",
    "keywords": f"""WITH {TOKENS}, k AS (SELECT doc_id, term, count(*) AS tf FROM tok WHERE token NOT LIKE '@%' AND token NOT LIKE '#%' AND length(term) >= 3 AND term NOT IN {STOP} GROUP BY ALL),
        r AS (SELECT *, tf / sum(tf) OVER (PARTITION BY doc_id) AS s, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, term) AS rank FROM k)
        SELECT doc_id, rank::INT AS rank, term, tf, round(s, 6) AS score FROM r WHERE rank <= 10""",
    "rake_phrases": f"""WITH {TOKENS}, k AS (SELECT *, length(term) >= 3 AND term NOT IN {STOP} AS keep FROM tok),
        g AS (SELECT *, sum((NOT keep)::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM k),
        w AS (SELECT *, count(*) OVER (PARTITION BY doc_id, run) AS l FROM g WHERE keep),
        s AS (SELECT doc_id, term, (sum(l - 1) + count(*)) / count(*) AS ws FROM w GROUP BY ALL),
        p AS (SELECT doc_id, run, string_agg(term, ' ' ORDER BY pos) AS phrase, count(*) AS n_terms, sum(ws) AS sc FROM w JOIN s USING (doc_id, term) GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(sc, 6) DESC, phrase, run) AS rank FROM p)
        SELECT doc_id, rank::INT AS rank, md5(phrase) AS phrase, n_terms, round(sc, 4) AS score FROM r WHERE rank <= 5""",
    "corpus_stats": f"WITH {POSTINGS} SELECT (SELECT count(*) FROM documents) AS documents, sum(tf)::BIGINT AS total_terms, count(DISTINCT term) AS unique_terms, round(sum(tf) / (SELECT count(*) FROM documents), 6) AS mean_terms FROM post",
    "corpus_term_stats": f"WITH {POSTINGS} SELECT term, sum(tf)::BIGINT AS collection_count, count(*) AS document_count, round(sum(tf) / (SELECT sum(tf) FROM post), 9) AS frequency FROM post GROUP BY term",
    "enriched_stats": f"""WITH {TOKENS}, k AS (SELECT *, {_KIND} AS kind FROM tok),
        c AS (SELECT doc_id, term, count(*) AS tf, count(*) FILTER (kind = 'word') AS w, count(*) FILTER (kind = 'number') AS nu, count(*) FILTER (kind = 'url') AS u, count(*) FILTER (kind = 'email') AS e,
          count(*) FILTER (kind = 'mention') AS m, count(*) FILTER (kind = 'hashtag') AS h,
          count(*) FILTER (kind = 'word' AND regexp_matches(token, '\\p{{L}}') AND NOT regexp_matches(token, '[\\p{{Ll}}\\p{{Lt}}\\p{{Lm}}\\p{{Lo}}]')) AS up FROM k GROUP BY ALL),
        s AS (SELECT *, tf / sum(tf) OVER (PARTITION BY doc_id) AS sh FROM c)
        SELECT doc_id, sum(tf)::BIGINT AS n_tokens, round(sum(w) / sum(tf), 6) AS lexical_density, round(coalesce(sum(tf) FILTER (term IN {STOP}), 0) / sum(tf), 6) AS stopword_ratio,
          round(count(*) FILTER (tf = 1) / count(*), 6) AS hapax_ratio, round(sum(-sh * log2(sh)), 6) AS shannon_entropy, round(sum(up) / greatest(sum(w), 1), 6) AS uppercase_ratio, round(sum(nu) / sum(tf), 6) AS numeric_ratio,
          sum(u)::BIGINT AS n_url, sum(e)::BIGINT AS n_email, sum(m)::BIGINT AS n_mention, sum(h)::BIGINT AS n_hashtag FROM s GROUP BY doc_id""",
    "token_bigrams": f"WITH toks AS (SELECT doc_id, list_transform(regexp_extract_all(text, {_quoted(P.TOKEN)}), lambda x: lower(x)) AS t FROM documents), g AS (SELECT doc_id, t, unnest(range(1, len(t))) AS i FROM toks) SELECT doc_id, t[i] || ' ' || t[i + 1] AS ngram, count(*) AS tf FROM g GROUP BY ALL",
    "char_trigrams": "WITH g AS (SELECT doc_id, lower(text) AS t, unnest(range(1, length(text) - 1)) AS i FROM documents) SELECT t[i:i + 2] AS ngram, count(*) AS n, count(DISTINCT doc_id) AS documents FROM g GROUP BY ALL",
    "stems": f"WITH {POSTINGS}, s AS (SELECT term, tf, {_CUT} AS cut FROM post) SELECT {_STEM} AS stem, sum(tf)::BIGINT AS n FROM s GROUP BY 1",
    "tfidf_terms": f"""WITH {POSTINGS}, d AS (SELECT term, count(*) AS df FROM post GROUP BY term), n AS (SELECT count(*) AS n FROM documents),
        s AS (SELECT doc_id, term, tf, df, round(tf / sum(tf) OVER (PARTITION BY doc_id) * (ln((n + 1) / (df + 1)) + 1), 6) AS score FROM post JOIN d USING (term), n),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, tf DESC, term) AS rank FROM s) SELECT doc_id, rank::INT AS rank, term, tf, df, score FROM r WHERE rank <= 10""",
    "sparse_matrix": f"WITH {POSTINGS} SELECT doc_id, dense_rank() OVER (ORDER BY term) - 1 AS column, tf AS value FROM post",
    "cooccurrence_related": f"""WITH {TOKENS}, c AS (SELECT term, count(*) AS n FROM tok GROUP BY ALL), l AS (SELECT list_transform(t, lambda x: lower(x)) AS t FROM toks),
        w AS (SELECT t, unnest(range(1, len(t) + 1)) AS i FROM l), p AS (SELECT t[i] AS x, unnest(t[i + 1:i + 4]) AS y FROM w), g AS (SELECT least(x, y) AS a, greatest(x, y) AS b, count(*) AS n FROM p WHERE x <> y GROUP BY ALL)
        SELECT a, b, g.n, round(g.n / sqrt(ca.n::DOUBLE * cb.n), 6) AS score FROM g JOIN c ca ON a = ca.term JOIN c cb ON b = cb.term""",
    "near_duplicates": "WITH " + _SHINGLES.format(id="doc_id", p=_quoted(P.TOKEN), table="documents") + """,
        z AS (SELECT doc_id, count(g) AS n FROM documents LEFT JOIN e USING (doc_id) GROUP BY doc_id),
        c AS (SELECT x.doc_id AS l, y.doc_id AS r, count(*) AS c FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL)
        SELECT l AS left_id, r AS right_id, c AS intersection, round(c / (a.n + b.n - c), 6) AS score FROM c JOIN z a ON l = a.doc_id JOIN z b ON r = b.doc_id WHERE c / (a.n + b.n - c) >= 0.6
        UNION ALL SELECT a.doc_id, b.doc_id, 0, 1.0 FROM z a JOIN z b ON a.doc_id < b.doc_id WHERE a.n = 0 AND b.n = 0""",
    "benchmark_overlap": "WITH " + _SHINGLES.format(id="doc_id", p=_quoted(P.TOKEN), table="documents") + ", b AS (WITH " + _SHINGLES.format(id="item_id", p=_quoted(P.TOKEN), table="benchmark") + """ SELECT item_id, g FROM e)
        SELECT item_id, doc_id, count(*) AS shared FROM e JOIN b USING (g) GROUP BY ALL""",
    "markov_transitions": f"WITH {_CHAIN} SELECT context, next, n FROM chain",
    "markov_starts": f"WITH {_TURNS} SELECT t[1] || ' ' || t[2] AS context, count(*) AS n FROM toks WHERE len(t) > 2 GROUP BY ALL",
    "markov_predict": f"WITH {_CHAIN}, r AS (SELECT *, n / sum(n) OVER (PARTITION BY context) AS p, row_number() OVER (PARTITION BY context ORDER BY n DESC, next) AS rank FROM chain) SELECT context, next, n, round(p, 6) AS probability, rank::INT AS rank FROM r WHERE rank = 1",
    "markov_perplexity": f"WITH {_CHAIN}, k AS (SELECT context, next, n / sum(n) OVER (PARTITION BY context) AS p FROM chain) SELECT conv_id || ':' || turn AS doc_id, count(*) AS n, round(exp(-avg(ln(p))), 4) AS perplexity FROM g JOIN k ON t[i] || ' ' || t[i + 1] = context AND t[i + 2] = next GROUP BY ALL",
}

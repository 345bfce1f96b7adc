"""Registered queries over conversations, transcripts, predictions, pages and events, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textspark.operators import dynamics, predictions, search
from textspark.plans.lexical_queries import _table
from textspark.plans.search_queries import _benchmark, _bm25
from textspark.sources import transcripts
from textspark.sources.scratch import cut
from textspark.streaming import windows


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with a stand-in concept, the length class of the text."""
    return _table(spark, sf_dir, "conversations").withColumn("concept", (F.length("text") % 5).cast("bigint"))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = (F.col("turn") * 5).cast("double")
    return _table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("stream_id"), F.col("turn").alias("segment_index"), "text", F.col("role").alias("speaker"),
        start.alias("start_seconds"), (start + F.length("text") / 64).alias("end_seconds"),
    )


def thread_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dynamics.threads(_turns(spark, sf_dir))


def introductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dynamics.introductions(_turns(spark, sf_dir))


def adoptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dynamics.adoptions(_turns(spark, sf_dir))


def hand_offs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dynamics.hand_offs(_turns(spark, sf_dir))


def recurring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dynamics.recurring(_turns(spark, sf_dir))


def interleavings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dynamics.interleavings(_turns(spark, sf_dir))


def speaker_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dynamics.speaker_shares(_turns(spark, sf_dir)).withColumn("share", F.round("share", 6))


def speaker_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dynamics.speaker_pairs(_turns(spark, sf_dir).withColumn("similarity", F.length("text") / 8), "similarity")
    return rows.withColumn("mean", F.round("mean", 6))


def hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dynamics.hotspots(_turns(spark, sf_dir).withColumn("activation", F.length("text").cast("double")))
    return rows.withColumns({c: F.round(c, 6) for c in ("coverage", "persistence", "mean_activation")})


def srt_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.format_srt(_segments(spark, sf_dir)).select("stream_id", F.md5("srt").alias("digest"))


def webvtt_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.format_webvtt(_segments(spark, sf_dir)).select("stream_id", F.md5("webvtt").alias("digest"))


def srt_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formatted and parsed again: times to the millisecond."""
    flat = _segments(spark, sf_dir).withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " "))).filter("text != ''")
    files = transcripts.format_srt(flat).withColumnRenamed("srt", "value")
    return transcripts.parse_subtitles(files).select("stream_id", "segment_index", F.round("start_seconds", 3).alias("start_seconds"), F.round("end_seconds", 3).alias("end_seconds"), F.md5("text").alias("digest"))


def segment_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _segments(spark, sf_dir)
    return rows.select(transcripts.segment_ids(rows).alias("id"), "speaker", F.md5(F.trim("text")).alias("digest"))


def ordering_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _segments(spark, sf_dir).withColumn("start_seconds", F.length("text").cast("double"))
    return transcripts.ordering_violations(rows).select("stream_id", "segment_index", "start_seconds", "latest")


def speaker_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.infer_speakers(_segments(spark, sf_dir), ["stream_id"])


def html_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", F.md5(transcripts.decode_entities("html")).alias("digest"))


def imported_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions.classify(_predictions(spark, sf_dir), 1)


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "labels")
    part = lambda name: rows.select("doc_id", F.lit(name).alias("label"), F.col(name).cast("double").alias("score"))
    return part("quality").unionByName(part("toxic"))


def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions.label_distribution(_predictions(spark, sf_dir)).withColumn("mean", F.round("mean", 6))


def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "labels")
    scores = predictions.precision_recall(rows.filter("quality = 1"), rows.filter("toxic = 0"), ["doc_id"])
    return scores.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


def ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 results judged by the documents whose text holds the benchmark text."""
    docs, asked = _table(spark, sf_dir, "documents"), _benchmark(spark, sf_dir)
    relevant = docs.join(F.broadcast(asked), F.contains(F.col("text"), F.col("query"))).select("query_id", "doc_id")  # the benchmark is a fixed, small set
    relevant = cut(relevant, "relevant")  # read twice
    found = predictions.ranking_metrics(search.bm25(docs, asked), relevant)
    return found.withColumns({c: F.round(c, 6) for c in ("mrr", "recall", "ndcg")})


def nearest_rank_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions.nearest_ranks(_table(spark, sf_dir, "documents"), "lang", "n_chars", {"p50": 0.5, "p90": 0.9})


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.windowed_counts(_table(spark, sf_dir, "events"))
    return rows.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.sessions(_table(spark, sf_dir, "events"))
    return rows.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n")


QUERIES = {
    f.__name__: f
    for f in (
        thread_segments, introductions, adoptions, hand_offs, recurring, interleavings, speaker_shares, speaker_pairs, hotspots, srt_format, webvtt_format,
        srt_roundtrip, segment_ids, ordering_violations, speaker_inference, html_entities, imported_classification, label_distribution, precision_recall,
        ranking_metrics, nearest_rank_percentiles, event_windows, user_sessions,
    )
}

_T = "t AS (SELECT *, length(text) % 5 AS concept FROM conversations)"
_S = "s AS (SELECT conv_id AS stream_id, turn AS segment_index, text, role AS speaker, (turn * 5)::DOUBLE AS a, turn * 5 + length(text) / 64 AS b FROM conversations)"


def _stamp(x: str, mark: str) -> str:
    ms = f"round({x} * 1000)::BIGINT"
    return f"lpad(({ms} // 3600000)::VARCHAR, 2, '0') || ':' || lpad(({ms} // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad(({ms} // 1000 % 60)::VARCHAR, 2, '0') || '{mark}' || lpad(({ms} % 1000)::VARCHAR, 3, '0')"


_INTRO = "i AS (SELECT conv_id, concept, min(turn) AS introduced_at, arg_min(role, turn) AS introduced_by FROM t WHERE role IS NOT NULL GROUP BY ALL)"
_PRED = "p AS (SELECT doc_id, 'quality' AS label, quality::DOUBLE AS score FROM labels UNION ALL SELECT doc_id, 'toxic', toxic::DOUBLE FROM labels), b AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label))::INT AS rank FROM p QUALIFY rank = 1)"

ORACLE_SQL = {
    "thread_segments": f"""WITH {_T}, p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM t), g AS (SELECT *, p - row_number() OVER (PARTITION BY conv_id, concept ORDER BY p) AS g FROM p)
        SELECT conv_id, concept, count(DISTINCT g) AS segments, count(DISTINCT g) - 1 AS re_entries, count(*) AS units FROM g GROUP BY ALL""",
    "introductions": f"WITH {_T}, {_INTRO} SELECT * FROM i",
    "adoptions": f"WITH {_T}, {_INTRO} SELECT conv_id, concept, role, min(turn) AS adopted_at FROM t JOIN i USING (conv_id, concept) WHERE role <> introduced_by AND turn > introduced_at GROUP BY ALL",
    "hand_offs": f"""WITH {_T}, l AS (SELECT *, lag(role) OVER w AS fs, lag(concept) OVER w AS fc FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
        SELECT conv_id, turn, fs AS from_speaker, role AS to_speaker, fc AS from_concept, concept AS to_concept FROM l WHERE fs <> role AND fc <> concept""",
    "recurring": f"""WITH {_T}, l AS (SELECT *, turn - lag(turn) OVER (PARTITION BY conv_id, concept ORDER BY turn) AS gap FROM t)
        SELECT conv_id, concept, count(*) AS occurrences, count(*) FILTER (gap > 1) AS returns FROM l GROUP BY ALL HAVING count(*) >= 2""",
    "interleavings": f"""WITH {_T}, l AS (SELECT *, lag(concept) OVER w AS x, lag(concept, 2) OVER w AS y FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
        SELECT conv_id, least(x, concept) AS a, greatest(x, concept) AS b, count(*) AS n FROM l WHERE y = concept AND x <> concept GROUP BY ALL""",
    "speaker_shares": f"WITH {_T}, c AS (SELECT role, concept, count(*) AS units FROM t GROUP BY ALL) SELECT *, round(units / sum(units) OVER (PARTITION BY role), 6) AS share FROM c",
    "speaker_pairs": """WITH l AS (SELECT *, length(text) / 8 AS s, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS x FROM conversations)
        SELECT conv_id, least(x, role) AS a, greatest(x, role) AS b, count(*) AS n, round(avg(s), 6) AS mean, arg_min(s, turn) AS first, arg_max(s, turn) AS last, arg_max(s, turn) - arg_min(s, turn) AS delta FROM l WHERE x <> role GROUP BY ALL""",
    "hotspots": f"""WITH {_T}, p AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM t)
        SELECT conv_id, concept, round(count(*) / max(n), 6) AS coverage, round((max(p) - min(p) + 1) / max(n), 6) AS persistence, round(avg(length(text)), 6) AS mean_activation, arg_max(turn, length(text) * 100000 - turn) AS peak FROM p GROUP BY conv_id, concept""",
    "srt_format": f"""WITH {_S}, c AS (SELECT stream_id, segment_index, row_number() OVER (PARTITION BY stream_id ORDER BY segment_index) || chr(10) || {_stamp('a', ',')} || ' --> ' || {_stamp('greatest(a, b)', ',')} || chr(10) || trim(text) || chr(10) || chr(10) AS cue FROM s)
        SELECT stream_id, md5(string_agg(cue, '' ORDER BY segment_index)) AS digest FROM c GROUP BY stream_id""",
    "webvtt_format": f"""WITH {_S}, c AS (SELECT stream_id, segment_index, {_stamp('a', '.')} || ' --> ' || {_stamp('greatest(a, b)', '.')} || chr(10) || trim(text) || chr(10) AS cue FROM s)
        SELECT stream_id, md5('WEBVTT' || chr(10) || chr(10) || string_agg(cue, chr(10) ORDER BY segment_index)) AS digest FROM c GROUP BY stream_id""",
    "srt_roundtrip": f"""WITH {_S}, f AS (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM s)
        SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY segment_index) AS segment_index, a AS start_seconds, round(round(b * 1000) / 1000, 3) AS end_seconds, md5(t) AS digest FROM f WHERE t <> ''""",
    "segment_ids": f"WITH {_S} SELECT stream_id || ':' || segment_index AS id, speaker, md5(trim(text)) AS digest FROM s",
    "ordering_violations": """WITH s AS (SELECT conv_id AS stream_id, turn AS segment_index, length(text)::DOUBLE AS start_seconds, turn * 5 + length(text) / 64 AS e FROM conversations),
        l AS (SELECT *, max(start_seconds) OVER (PARTITION BY stream_id ORDER BY segment_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM s)
        SELECT stream_id, segment_index, start_seconds, latest FROM l WHERE start_seconds < latest OR e < start_seconds""",
    "speaker_inference": f"""WITH {_S}, g AS (SELECT stream_id, speaker, round(sum(CASE WHEN b > a THEN b - a ELSE 1.0 END), 6) AS spent, count(*) AS n FROM s GROUP BY ALL)
        SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY spent DESC, n DESC, speaker) = 1""",
    "html_entities": "SELECT page_id, md5(replace(replace(replace(replace(replace(replace(replace(html, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' ')) AS digest FROM pages",
    "imported_classification": f"WITH {_PRED} SELECT * FROM b",
    "label_distribution": f"WITH {_PRED} SELECT label, count(*) AS n, sum(score) AS total, round(avg(score), 6) AS mean FROM b GROUP BY label",
    "precision_recall": """WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS m, count(*) FILTER (quality = 1) AS g, count(*) FILTER (toxic = 0) AS f FROM labels)
        SELECT m AS matches, g AS gold, f AS found, round(m / f, 6) AS precision, round(m / g, 6) AS recall, round(2 * m / (f + g), 6) AS f1 FROM c""",
    "ranking_metrics": f"""WITH {_bm25('SELECT * FROM documents')}, rel AS (SELECT DISTINCT b.item_id AS query_id, x.doc_id FROM documents x JOIN benchmark b ON contains(x.text, b.text)),
        z AS (SELECT query_id, count(*) AS nr FROM rel GROUP BY ALL), g AS (SELECT query_id, min(rank) AS f, count(*) AS c, sum(1 / log2(rank + 1)) AS dcg FROM bm JOIN rel USING (query_id, doc_id) GROUP BY ALL)
        SELECT count(*) AS queries, round(avg(coalesce(1 / f, 0)), 6) AS mrr, round(avg(coalesce(c / nr, 0)), 6) AS recall, round(avg(coalesce(dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, least(nr, 10) + 1) r(i)), 0)), 6) AS ndcg FROM z LEFT JOIN g USING (query_id)""",
    "nearest_rank_percentiles": """WITH p AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents)
        SELECT lang, max(n) AS n, max(n_chars) FILTER (i = floor((n - 1) * 0.5 + 0.5)) AS p50, max(n_chars) FILTER (i = floor((n - 1) * 0.9 + 0.5)) AS p90 FROM p GROUP BY lang""",
    "event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "user_sessions": """WITH l AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l)
        SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n FROM s GROUP BY user_id, k""",
}

"""Registered queries of transcript parsing and conversion, with DuckDB SQL. Files are made from conversations, so
that SQL knows what has to come out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textspark.plans.conversation_queries import _S, _segments
from textspark.plans.lexical_queries import _table
from textspark.sources import contracts, transcripts


def _whisperx_files(spark: SparkSession, sf_dir: str, flat: bool = False) -> DataFrame:
    """A WhisperX file for each conversation; words are the first three pieces of a turn, a second each."""
    rows = _segments(spark, sf_dir)
    start = F.col("start_seconds")
    pieces = F.slice(F.filter(F.split("text", r"\s+"), lambda w: w != ""), 1, 3)
    words = F.transform(pieces, lambda w, i: F.struct(w.alias("word"), (start + i).alias("startSeconds"), (start + i + 0.5).alias("end"), F.lit(1.5).alias("score"), F.col("speaker").alias("speaker_label"), F.lit("x").alias("extra")))
    segment = F.struct(F.col("segment_index").alias("id"), F.concat(F.lit(" "), "text", F.lit(" ")).alias("text"), start.alias("start"), (start + 5).alias("endSeconds"), (-F.length("text") / 100).alias("avg_logprob"), *([] if flat else [words.alias("words")]))
    files = rows.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("segment_index", segment.alias("s"), words.alias("w")))).alias("c"))
    whole = F.struct(F.lit("en").alias("language"), F.transform("c", lambda x: x["s"]).alias("segments"), F.flatten(F.transform("c", lambda x: x["w"])).alias("word_segments"))
    return files.select("stream_id", F.to_json(whole).alias("value"))


def _parsed(rows: DataFrame) -> DataFrame:
    return rows.select(
        "stream_id", "segment_index", F.md5("text").alias("digest"), "language", "start_seconds", "end_seconds", "speaker", F.round("confidence", 6).alias("confidence"),
        F.size("words").cast("bigint").alias("n_words"), F.array_join(F.transform("words", lambda w: F.concat_ws("|", w["text"], w["confidence"].cast("string"), w["attributes"]["extra"])), " ").alias("words"),
    )


def whisperx_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(contracts.parse_whisperx(_whisperx_files(spark, sf_dir).filter(~F.contains("value", F.lit('"text":"  "')))))


def whisperx_flat_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(contracts.parse_whisperx(_whisperx_files(spark, sf_dir, flat=True).filter(~F.contains("value", F.lit('"text":"  "')))))


def whisper_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _segments(spark, sf_dir)
    segment = F.struct(F.col("segment_index").alias("id"), F.col("start_seconds").alias("start"), F.col("end_seconds").alias("end"), F.concat(F.lit(" "), "text").alias("text"), F.lit(0.25).alias("no_speech_prob"))
    files = rows.groupBy("stream_id").agg(F.to_json(F.struct(F.lit("de").alias("language"), F.collect_list(segment).alias("segments"))).alias("value"))
    found = transcripts.parse_whisper(files)
    return found.select("stream_id", "segment_index", "start_seconds", "end_seconds", "language", "confidence", F.md5("text").alias("digest"))


def webvtt_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = _segments(spark, sf_dir).withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " "))).filter("text != ''")
    files = transcripts.format_webvtt(flat).withColumnRenamed("webvtt", "value")
    return transcripts.parse_subtitles(files).select("stream_id", "segment_index", F.round("start_seconds", 3).alias("start_seconds"), F.round("end_seconds", 3).alias("end_seconds"), F.md5("text").alias("digest"))


def plain_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("stream_id"), F.col("text").alias("value"))
    return transcripts.parse_lines(files).select("stream_id", "segment_index", F.md5("text").alias("digest"))


def _full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with all columns; every seventh has no text, every fifth starts early."""
    rows = _segments(spark, sf_dir)
    at = F.when(F.col("segment_index") % 5 == 4, F.col("start_seconds") - 30).otherwise(F.col("start_seconds"))
    empty = lambda kind: F.array().cast(f"array<{kind}>")
    return rows.select(
        "stream_id", "segment_index", F.when(F.col("segment_index") % 7 == 3, F.lit("  ")).otherwise(F.concat(F.lit("\n "), "text", F.lit(" "))).alias("text"), F.lit(None).cast("string").alias("language"),
        at.alias("start_seconds"), (at + F.length("text") / 64).alias("end_seconds"), "speaker", (F.length("text") / 100).alias("confidence"), F.lit(True).alias("is_final"),
        empty(contracts.WORD).alias("words"), empty(contracts.CHAR).alias("chars"), F.create_map(F.lit("speaker"), F.lit("old"), F.lit("k"), F.lit("v")).alias("attributes"),
    )


def transcript_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.violations(contracts.normalized(_full(spark, sf_dir)))


def transcript_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.joined_texts(contracts.normalized(_full(spark, sf_dir))).select("stream_id", F.md5("text").alias("digest"))


def text_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = contracts.text_segments(contracts.normalized(_full(spark, sf_dir)))
    return rows.select("id", "timestamp_ms", F.round("duration_seconds", 6).alias("duration_seconds"), "is_final", F.col("attributes")["speaker"].alias("speaker"), F.round(F.col("attributes")["confidence"].cast("double"), 6).alias("confidence"), F.col("attributes")["k"].alias("k"), "source.source_kind", F.md5("text").alias("digest"))


def segment_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments to documents to segments again, and as corpus documents."""
    docs = contracts.documents_of(contracts.text_segments(contracts.normalized(_full(spark, sf_dir))))
    back = contracts.segments_of(docs)
    corpus = contracts.contract_documents(docs.withColumnRenamed("metadata", "attributes")).select("id", F.col("metadata")["timestamp_seconds"].cast("double").alias("seconds"))
    return back.join(corpus, "id").select("id", "segment_index", "timestamp_ms", "source.source_kind", "seconds", F.md5("text").alias("digest"))


def segment_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _full(spark, sf_dir)
    return rows.select("stream_id", "segment_index", F.array_join(F.array_sort(F.map_keys(contracts.metadata(rows, "web"))), ",").alias("keys"), contracts.metadata(rows)["speaker"].alias("speaker"))


def words_to_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word in the middle of the text of every second turn, against windows that overlap."""
    rows = _segments(spark, sf_dir)
    words = rows.filter("segment_index % 2 = 0").select("stream_id", F.col("segment_index").alias("word"), (F.col("start_seconds") + 1).alias("start_seconds"), (F.col("start_seconds") + 3).alias("end_seconds"))
    wide = rows.select("stream_id", "segment_index", (F.col("start_seconds") - 6).alias("start_seconds"), (F.col("start_seconds") + 6).alias("end_seconds"))
    return contracts.words_to_segments(words, wide).select("stream_id", "word", "segment_index")


QUERIES = {
    f.__name__: f
    for f in (
        whisperx_segments, whisperx_flat_words, whisper_segments, webvtt_roundtrip, plain_lines, transcript_violations, transcript_texts, text_segments, segment_documents, segment_metadata,
        words_to_segments,
    )
}

_STRIP = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
_X = f"""{_S}, bad AS (SELECT DISTINCT stream_id FROM s WHERE text = ''), w AS (SELECT *, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')[1:3] AS p FROM s WHERE stream_id NOT IN (SELECT stream_id FROM bad))
    SELECT stream_id, segment_index, md5({_STRIP}) AS digest, 'en' AS language, a AS start_seconds, a + 5 AS end_seconds, CASE WHEN len(p) > 0 THEN speaker END AS speaker, round(exp(-length(text) / 100), 6) AS confidence, len(p) AS n_words,
      array_to_string(list_transform(p, lambda x: x || '|1.0|x'), ' ') AS words FROM w"""
_F = f"f AS (SELECT stream_id, segment_index, CASE WHEN segment_index % 7 = 3 THEN '' ELSE {_STRIP} END AS t, CASE WHEN segment_index % 5 = 4 THEN a - 30 ELSE a END AS a, length(text) / 64 AS d, speaker, length(text) / 100 AS c FROM s)"

ORACLE_SQL = {
    "whisperx_segments": "WITH " + _X,
    "whisperx_flat_words": "WITH " + _X,
    "whisper_segments": f"WITH {_S} SELECT stream_id, segment_index, a AS start_seconds, b AS end_seconds, 'de' AS language, 0.75 AS confidence, md5(trim(' ' || text)) AS digest FROM s",
    "webvtt_roundtrip": f"""WITH {_S}, f AS (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM s)
        SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY segment_index) - 1 AS segment_index, a AS start_seconds, round(round(b * 1000) / 1000, 3) AS end_seconds, md5(t) AS digest FROM f WHERE t <> ''""",
    "plain_lines": "WITH l AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) - 1 AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) AS x FROM documents)) SELECT doc_id AS stream_id, i AS segment_index, md5(trim(line)) AS digest FROM l WHERE trim(line) <> ''",
    "transcript_violations": f"""WITH {_S}, {_F}, l AS (SELECT *, lag(a) OVER (PARTITION BY stream_id ORDER BY segment_index) AS p FROM f)
        SELECT stream_id, segment_index, 'its text is empty' AS problem FROM l WHERE t = '' UNION ALL SELECT stream_id, segment_index, 'its start moves backward' FROM l WHERE a < p""",
    "transcript_texts": f"WITH {_S}, {_F} SELECT stream_id, md5(string_agg(t, ' ' ORDER BY segment_index)) AS digest FROM f WHERE t <> '' GROUP BY stream_id",
    "text_segments": f"WITH {_S}, {_F} SELECT stream_id || ':' || segment_index AS id, round(a * 1000)::BIGINT AS timestamp_ms, round((a + d) - a, 6) AS duration_seconds, true AS is_final, speaker, round(least(1, c), 6) AS confidence, 'v' AS k, 'transcript_segment' AS source_kind, md5(t) AS digest FROM f",
    "segment_documents": f"WITH {_S}, {_F} SELECT stream_id || ':' || segment_index AS id, 0::BIGINT AS segment_index, round(a * 1000)::BIGINT AS timestamp_ms, 'text_segment' AS source_kind, a AS seconds, md5(t) AS digest FROM f",
    "segment_metadata": f"WITH {_S} SELECT stream_id, segment_index, 'confidence,end_seconds,source,speaker,start_seconds' AS keys, speaker FROM s",
    "words_to_segments": f"WITH {_S}, w AS (SELECT stream_id, segment_index AS word, a + 2 AS m FROM s WHERE segment_index % 2 = 0) SELECT w.stream_id, word, min(segment_index) AS segment_index FROM w JOIN s ON w.stream_id = s.stream_id AND m BETWEEN a - 6 AND a + 6 GROUP BY ALL",
}

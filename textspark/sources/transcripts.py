"""Transcript formats: SubRip and WebVTT parsing and formatting, plain lines, Whisper JSON, segments.

Parsers take a DataFrame with one file per row (as ``spark.read.text(path, wholetext=True)`` gives) and
return one row per segment; nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textspark.functions import patterns as P
from textspark.functions.text import collapse_whitespace

STAMP = "^(?:([0-9]+):)?([0-9]+):([0-9]+(?:\\.[0-9]+)?)$"


def seconds_of(stamp: Column) -> Column:
    """hh:mm:ss,mmm or mm:ss.mmm in seconds; null if it is neither."""
    plain = F.trim(F.replace(stamp, F.lit(","), F.lit(".")))
    part = lambda k: F.coalesce(F.nullif(F.regexp_extract(plain, STAMP, k), F.lit("")).cast("double"), F.lit(0.0))
    return F.when(F.rlike(plain, F.lit(STAMP)), part(1) * 3600 + part(2) * 60 + part(3))


def stamp_of(seconds: Column, mark: str = ",") -> Column:
    """Seconds as hh:mm:ss,mmm, negative ones as 0."""
    millis = F.round(F.greatest(seconds, F.lit(0.0)) * 1000).cast("bigint")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    hours = F.floor(millis / 3600000)
    return F.concat(
        F.when(hours < 10, two(hours)).otherwise(hours.cast("string")), F.lit(":"), two(F.floor(millis / 60000) % 60), F.lit(":"), two(F.floor(millis / 1000) % 60), F.lit(mark),
        F.lpad((millis % 1000).cast("string"), 3, "0"),
    )


def parse_subtitles(files: DataFrame, text_col: str = "value", id_col: str = "stream_id") -> DataFrame:
    """(stream, segment_index, start_seconds, end_seconds, text) of SubRip or WebVTT texts. Blocks are split at
    blank lines; a block's first line, if a number before the times, is its index, else its place. A block
    without times raises, unless it opens with WEBVTT."""
    blocks = F.split(F.regexp_replace(text_col, "\r\n?", "\n"), "\n\n")
    rows = files.select(F.col(id_col), F.posexplode(blocks).alias("_b", "block"))
    lines = F.filter(F.transform(F.split("block", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = rows.withColumn("lines", lines).filter((F.size("lines") > 0) & ~F.startswith(F.get("lines", F.lit(0)), F.lit("WEBVTT")))
    at = F.aggregate(F.transform("lines", lambda x, i: F.when(F.contains(x, F.lit("-->")), i)), F.lit(None).cast("int"), lambda s, x: F.coalesce(s, x))
    rows = rows.withColumn("at", F.coalesce(at, F.raise_error(F.lit("subtitle block without times")).cast("int")))
    rows = rows.withColumn("body", F.slice("lines", F.col("at") + 2, F.size("lines"))).filter(F.size("body") > 0)
    times = F.split(F.get("lines", F.col("at")), "-->")
    place = F.row_number().over(Window.partitionBy(id_col).orderBy("_b")) - 1
    own = F.when(F.col("at") > 0, F.get("lines", F.lit(0)).try_cast("bigint"))
    return rows.select(
        id_col,
        F.coalesce(own, place).cast("bigint").alias("segment_index"),
        seconds_of(F.get(times, F.lit(0))).alias("start_seconds"),
        seconds_of(F.get(F.split(F.trim(F.get(times, F.lit(1))), r"\s+"), F.lit(0))).alias("end_seconds"),
        F.array_join("body", " ").alias("text"),
    )


def parse_lines(files: DataFrame, text_col: str = "value", id_col: str = "stream_id") -> DataFrame:
    """(stream, segment_index, text) of the trimmed lines that are not empty; the index is the line's number."""
    rows = files.select(F.col(id_col), F.posexplode(F.split(F.regexp_replace(text_col, "\r\n?", "\n"), "\n")).alias("segment_index", "line"))
    return rows.withColumn("text", F.trim("line")).filter("text != ''").select(id_col, F.col("segment_index").cast("bigint"), "text")


WHISPER = "struct<text:string,language:string,segments:array<struct<id:bigint,start:double,end:double,text:string,avg_logprob:double,no_speech_prob:double>>>"


def parse_whisper(files: DataFrame, text_col: str = "value", id_col: str = "stream_id") -> DataFrame:
    """Segments of Whisper JSON; confidence is avg_logprob, else 1 - no_speech_prob."""
    rows = files.select(F.col(id_col), F.from_json(text_col, WHISPER).alias("j")).select(id_col, F.col("j.language").alias("language"), F.explode("j.segments").alias("s"))
    return rows.select(
        id_col, F.col("s.id").alias("segment_index"), F.col("s.start").alias("start_seconds"), F.col("s.end").alias("end_seconds"), F.trim("s.text").alias("text"), "language",
        F.coalesce("s.avg_logprob", 1 - F.col("s.no_speech_prob")).alias("confidence"),
    )


def format_srt(segments: DataFrame, id_col: str = "stream_id") -> DataFrame:
    """(stream, srt): numbered cues by segment index; a missing end is two seconds after the start. A stream is
    one file, so its cues meet in one row."""
    return _formatted(segments, id_col, "srt")


def format_webvtt(segments: DataFrame, id_col: str = "stream_id") -> DataFrame:
    """(stream, webvtt) as format_srt, with a header and without numbers."""
    return _formatted(segments, id_col, "webvtt")


def _formatted(segments: DataFrame, id_col: str, name: str) -> DataFrame:
    start = F.coalesce("start_seconds", F.lit(0.0))
    end = F.greatest(F.coalesce("end_seconds", start + 2.0), start)
    mark = "," if name == "srt" else "."
    number = F.row_number().over(Window.partitionBy(id_col).orderBy("segment_index"))
    times = F.concat(stamp_of(start, mark), F.lit(" --> "), stamp_of(end, mark), F.lit("\n"), F.trim("text"))
    cue = F.concat(number.cast("string"), F.lit("\n"), times, F.lit("\n\n")) if name == "srt" else F.concat(times, F.lit("\n"))
    cues = segments.select(F.col(id_col), F.struct(F.col("segment_index"), cue.alias("cue")).alias("c"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda x: x["cue"]), "" if name == "srt" else "\n")
    return cues.groupBy(id_col).agg((joined if name == "srt" else F.concat(F.lit("WEBVTT\n\n"), joined)).alias(name))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Segments of all files under path, each by its extension: srt and vtt, txt and lines, json."""
    files = spark.read.text(path, wholetext=True).withColumn("stream_id", F.input_file_name())
    kind = F.lower(F.regexp_extract("stream_id", r"\.([A-Za-z0-9]+)$", 1))
    timed = parse_subtitles(files.filter(kind.isin("srt", "vtt")))
    plain = parse_lines(files.filter(kind.isin("txt", "lines")))
    return timed.unionByName(plain, allowMissingColumns=True).unionByName(parse_whisper(files.filter(kind == "json")), allowMissingColumns=True)


def decode_entities(text: Column | str) -> Column:
    out = F.col(text) if isinstance(text, str) else text
    for entity, char in P.ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def clean_subtitle(text: Column | str) -> Column:
    """Markup of known tags goes, time stamps in tags become spaces, entities are decoded, white space collapses."""
    stamps = F.regexp_replace(text, r"<\s*[0-9]{2}:[0-9]{2}:[0-9]{2}[.,][0-9]{3}\s*>", " ")
    tags = F.regexp_replace(stamps, rf"<\s*/*(?:{'|'.join(P.SUBTITLE_TAGS)})(?:[\s.][^>]*)?\s*>|<\s*>", "")
    return collapse_whitespace(decode_entities(tags))


def segment_ids(segments: DataFrame, stream: str = "stream_id", index: str = "segment_index") -> Column:
    return F.concat_ws(":", F.col(stream).cast("string"), F.col(index).cast("string"))


def ordering_violations(segments: DataFrame, id_col: str = "stream_id") -> DataFrame:
    """Segments that start before an earlier one, or end before they start."""
    before = Window.partitionBy(id_col).orderBy("segment_index").rowsBetween(Window.unboundedPreceding, -1)
    rows = segments.withColumn("latest", F.max("start_seconds").over(before))
    return rows.filter((F.col("start_seconds") < F.col("latest")) | (F.col("end_seconds") < F.col("start_seconds")))


def infer_speakers(words: DataFrame, by: list[str]) -> DataFrame:
    """The speaker of most word time for each segment; words without a valid duration weigh 1. Ties go to more
    words, then to the first name."""
    spent = F.when(F.col("end_seconds") > F.col("start_seconds"), F.col("end_seconds") - F.col("start_seconds")).otherwise(1.0)
    sums = words.filter(F.col("speaker").isNotNull()).groupBy(*by, "speaker").agg(F.round(F.sum(spent), 6).alias("spent"), F.count(F.lit(1)).alias("n"))
    best = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("spent"), F.desc("n"), F.asc("speaker")))
    return sums.withColumn("_r", best).filter("_r = 1").drop("_r")

"""Transcript segments as tables: WhisperX import, normalization, strict checks, and the way to text segments and
documents. A segment is a row (stream_id, segment_index, text, language, start_seconds, end_seconds, speaker,
confidence, is_final, words, chars, attributes); a transcript is its stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textspark.functions.text import strip
from textspark.sources import transcripts

WORD = "struct<text:string,start_seconds:double,end_seconds:double,confidence:double,speaker:string,attributes:map<string,string>>"
CHAR = "struct<text:string,start_seconds:double,end_seconds:double,confidence:double,attributes:map<string,string>>"
SEGMENT = f"struct<segment_index:bigint,text:string,language:string,start_seconds:double,end_seconds:double,speaker:string,confidence:double,words:array<{WORD}>,chars:array<{CHAR}>,attributes:map<string,string>>"
MAPS = "array<map<string,string>>"

# Names that WhisperX files use for one field, the first that is there counts.
START, END = ("start", "start_seconds", "startSeconds"), ("end", "end_seconds", "endSeconds")
SPEAKER = ("speaker", "speaker_label", "speakerLabel")
WORD_TEXT, CHAR_TEXT, INDEX = ("word", "text"), ("char", "character", "text"), ("id", "index")
WORD_SCORE, SEGMENT_SCORE = ("confidence", "score", "probability"), ("confidence", "score", "avg_logprob", "no_speech_prob")


def _first(obj: Column, names: Sequence[str]) -> Column:
    return F.coalesce(*(obj[n] for n in names))


def _number(obj: Column, names: Sequence[str]) -> Column:
    finite = lambda n: F.nullif(F.nullif(F.nullif(obj[n].try_cast("double"), F.lit(float("inf"))), F.lit(float("-inf"))), F.lit(float("nan")))
    return F.coalesce(*map(finite, names))


def clamped(x: Column) -> Column:
    """A confidence within [0, 1]; null where it is not finite."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def _confidence(obj: Column, names: Sequence[str]) -> Column:
    scaled = {"avg_logprob": F.exp, "no_speech_prob": lambda x: 1 - x}
    return F.coalesce(*(clamped(scaled.get(n, lambda x: x)(_number(obj, [n]))) for n in names))


def _rest(obj: Column, *known: Sequence[str]) -> Column:
    names = [n for group in known for n in group]
    return F.map_filter(F.transform_values(obj, lambda _, v: F.coalesce(v, F.lit("null"))), lambda k, _: ~k.isin(*names))


def _words(raw: Column) -> Column:
    parsed = F.coalesce(F.from_json(raw, MAPS), F.array().cast(MAPS))
    return F.transform(
        parsed,
        lambda w: F.struct(
            F.coalesce(_first(w, WORD_TEXT), F.lit("")).alias("text"), _number(w, START).alias("start_seconds"), _number(w, END).alias("end_seconds"), _confidence(w, WORD_SCORE).alias("confidence"),
            _first(w, SPEAKER).alias("speaker"), _rest(w, WORD_TEXT, START, END, WORD_SCORE, SPEAKER).alias("attributes"),
        ),
    ).cast(f"array<{WORD}>")


def _chars(raw: Column) -> Column:
    parsed = F.coalesce(F.from_json(raw, MAPS), F.array().cast(MAPS))
    return F.transform(
        parsed,
        lambda c: F.struct(
            F.coalesce(_first(c, CHAR_TEXT), F.lit("")).alias("text"), _number(c, START).alias("start_seconds"), _number(c, END).alias("end_seconds"), _confidence(c, WORD_SCORE).alias("confidence"),
            _rest(c, CHAR_TEXT, START, END, WORD_SCORE).alias("attributes"),
        ),
    ).cast(f"array<{CHAR}>")


def parse_whisperx(files: DataFrame, text_col: str = "value", id_col: str = "stream_id") -> DataFrame:
    """Segments of WhisperX JSON files, one a row. Aliases of fields are known, others are kept as attributes; words of a
    flat ``word_segments`` list go to the first segment around their midpoint if no segment has its own; a missing
    speaker is that of most word time. A file without a segments array, or one that violations() finds fault
    with, raises when it is read."""
    root = F.from_json(text_col, "map<string,string>")
    rows = files.select(F.col(id_col).alias("stream_id"), root.alias("_r"))
    raw = F.from_json(F.col("_r")["segments"], MAPS)
    rows = rows.withColumn("_s", F.coalesce(raw, F.raise_error(F.lit("WhisperX JSON without a segments array")).cast(MAPS)))
    known = ("text", "words", "word_segments", "chars", "characters", "language")
    segments = F.transform(
        "_s",
        lambda s, i: F.struct(
            F.coalesce(_first(s, INDEX).try_cast("bigint"), i.cast("bigint")).alias("segment_index"), F.coalesce(s["text"], F.lit("")).alias("text"), F.coalesce(s["language"], F.col("_r")["language"]).alias("language"),
            _number(s, START).alias("start_seconds"), _number(s, END).alias("end_seconds"), _first(s, SPEAKER).alias("speaker"), _confidence(s, SEGMENT_SCORE).alias("confidence"),
            _words(_first(s, ("words", "word_segments"))).alias("words"), _chars(_first(s, ("chars", "characters"))).alias("chars"), _rest(s, INDEX, known, START, END, SPEAKER, SEGMENT_SCORE).alias("attributes"),
        ),
    ).cast(f"array<{SEGMENT}>")
    rows = rows.withColumn("_g", segments).withColumn("_flat", _words(F.col("_r")["word_segments"]))
    holds = lambda s, w: (midpoint(w["start_seconds"], w["end_seconds"]) >= s["start_seconds"]) & (midpoint(w["start_seconds"], w["end_seconds"]) <= s["end_seconds"])
    earlier = lambda i, w: F.exists(F.slice("_g", F.lit(1), i), lambda s: holds(s, w))
    given = F.transform("_g", lambda s, i: s.withField("words", F.filter("_flat", lambda w: F.coalesce(holds(s, w), F.lit(False)) & ~F.coalesce(earlier(i, w), F.lit(False)))))
    empty = F.forall("_g", lambda s: F.size(s["words"]) == 0)
    rows = rows.select("stream_id", F.explode(F.when(empty & (F.size("_flat") > 0), given).otherwise(F.col("_g"))).alias("s")).select("stream_id", "s.*").withColumn("is_final", F.lit(True))
    out = with_speakers(normalized(rows))
    faults = violations(out).groupBy(F.col("stream_id").alias("_f")).agg(F.min("problem").alias("_problem"))
    checked = out.join(faults, F.col("stream_id") == F.col("_f"), "left")
    text = F.when(F.col("_problem").isNotNull(), F.raise_error(F.concat(F.lit("transcript: "), F.col("_problem"))).cast("string")).otherwise(F.col("text"))
    return checked.withColumn("text", text).drop("_f", "_problem")


def midpoint(start: Column, end: Column) -> Column:
    """The middle of a span, or the bound that is known."""
    return F.coalesce((start + end) * 0.5, start, end)


def duration(start: Column, end: Column) -> Column:
    return F.greatest(end - start, F.lit(0.0))


def milliseconds(seconds: Column) -> Column:
    """A media timestamp on a base of 1/1000 s."""
    return F.round(seconds * 1000).cast("bigint")


def rational_seconds(pts: Column, numerator: Column, denominator: Column) -> Column:
    return pts * numerator / denominator


def spoken_by(words: Column) -> Column:
    """The speaker of most word time; a word without a valid duration weighs 1. Ties: more words, then the first name."""
    named = F.filter(words, lambda w: F.coalesce(w["speaker"], F.lit("")) != "")
    spent = lambda w: F.when(w["end_seconds"] > w["start_seconds"], w["end_seconds"] - w["start_seconds"]).otherwise(1.0)
    names = F.array_sort(F.array_distinct(F.transform(named, lambda w: w["speaker"])))
    sums = F.transform(
        names,
        lambda n: F.struct(
            F.aggregate(F.filter(named, lambda w: w["speaker"] == n), F.lit(0.0), lambda s, w: s + spent(w)).alias("spent"), F.size(F.filter(named, lambda w: w["speaker"] == n)).alias("n"), n.alias("name")
        ),
    )
    best = F.aggregate(sums, F.lit(None).cast("struct<spent:double,n:int,name:string>"), lambda a, x: F.when(a.isNull() | (x["spent"] > a["spent"]) | ((x["spent"] == a["spent"]) & (x["n"] > a["n"])), x).otherwise(a))
    return best["name"]


def with_speakers(segments: DataFrame) -> DataFrame:
    return segments.withColumn("speaker", F.coalesce("speaker", spoken_by(F.col("words"))))


def normalized(segments: DataFrame) -> DataFrame:
    """Texts trimmed, confidences clamped, words and characters without text left out, blank speakers of words null."""
    words = F.transform("words", lambda w: w.withField("text", strip(w["text"])).withField("confidence", clamped(w["confidence"])).withField("speaker", F.nullif(strip(w["speaker"]), F.lit(""))))
    chars = F.transform("chars", lambda c: c.withField("confidence", clamped(c["confidence"])))
    return segments.withColumns(
        {"text": strip("text"), "confidence": clamped(F.col("confidence")), "words": F.filter(words, lambda w: w["text"] != ""), "chars": F.filter(chars, lambda c: c["text"] != "")}
    )


def joined_texts(segments: DataFrame) -> DataFrame:
    """(stream_id, text): a transcript's segments that have text, by a space. A stream is one transcript."""
    parts = segments.filter("text != ''").groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("segment_index", "text"))).alias("_p"))
    return parts.select("stream_id", F.array_join(F.transform("_p", lambda x: x["text"]), " ").alias("text"))


def violations(segments: DataFrame) -> DataFrame:
    """(stream_id, segment_index, problem) of all strict rules that a segment breaks: finite times in order, text, starts
    that do not go back, words and characters inside the segment."""
    before = Window.partitionBy("stream_id").orderBy("segment_index").rowsBetween(Window.unboundedPreceding, -1)
    rows = segments.withColumn("_latest", F.last("start_seconds", ignorenulls=True).over(before))
    finite = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(True))
    late = lambda a, b: F.coalesce(b < a, F.lit(False))
    a, b = F.col("start_seconds"), F.col("end_seconds")
    outside = lambda x: F.coalesce(x["start_seconds"] < a, F.lit(False)) | F.coalesce(x["end_seconds"] > b, F.lit(False))
    some = lambda column, test: F.coalesce(F.exists(column, test), F.lit(False))
    rules = {
        "a time is not finite": ~finite(a) | ~finite(b) | some("words", lambda w: ~finite(w["start_seconds"]) | ~finite(w["end_seconds"])),
        "it ends before it starts": late(a, b) | some("words", lambda w: late(w["start_seconds"], w["end_seconds"])) | some("chars", lambda c: late(c["start_seconds"], c["end_seconds"])),
        "a confidence is not finite": ~finite(F.col("confidence")) | some("words", lambda w: ~finite(w["confidence"])),
        "its text is empty": F.coalesce(strip("text"), F.lit("")) == "",
        "its start moves backward": F.coalesce(a < F.col("_latest"), F.lit(False)),
        "a word is outside": some("words", outside),
        "a character is outside": some("chars", outside),
    }
    found = F.filter(F.array(*(F.when(test, F.lit(name)) for name, test in rules.items())), lambda p: p.isNotNull())
    return rows.select("stream_id", "segment_index", F.explode(found).alias("problem"))


def words_to_segments(words: DataFrame, segments: DataFrame) -> DataFrame:
    """words (stream_id, start_seconds, end_seconds) with ``segment_index``: the first segment of their stream around
    their midpoint; words outside all are left out. An interval join on the stream."""
    spans = segments.select(F.col("stream_id").alias("_s"), F.col("segment_index"), F.col("start_seconds").alias("_a"), F.col("end_seconds").alias("_b"))
    at = midpoint(F.col("start_seconds"), F.col("end_seconds"))
    pairs = words.join(spans, (F.col("stream_id") == F.col("_s")) & (at >= F.col("_a")) & (at <= F.col("_b")))
    return pairs.groupBy(*words.columns).agg(F.min("segment_index").alias("segment_index"))


def metadata(segments: DataFrame, source: str | None = None) -> Column:
    """language, speaker, start_seconds, end_seconds, confidence and source of a segment, those that are known."""
    names = [c for c in ("language", "speaker", "start_seconds", "end_seconds", "confidence") if c in segments.columns]
    pairs = [x for n in names for x in (F.lit(n), F.col(n).cast("string"))] + ([F.lit("source"), F.lit(source)] if source else [])
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def text_segments(segments: DataFrame, kind: str = "transcript_segment", uri: str | None = None) -> DataFrame:
    """Segments as timed text: (id, stream_id, segment_index, text, language, timestamp_ms, duration_seconds, is_final,
    attributes with speaker and confidence, source)."""
    a, b = F.col("start_seconds"), F.col("end_seconds")
    more = F.map_filter(F.create_map(F.lit("speaker"), F.col("speaker"), F.lit("confidence"), F.col("confidence").cast("string")), lambda _, v: v.isNotNull())
    kept = F.map_filter("attributes", lambda k, _: ~k.isin("speaker", "confidence")) if "attributes" in segments.columns else F.create_map().cast("map<string,string>")
    source = F.struct(F.col("stream_id").cast("string").alias("source_id"), F.lit(kind).alias("source_kind"), F.lit(uri).cast("string").alias("uri"), a.alias("timestamp_seconds"), duration(a, b).alias("duration_seconds"))
    return segments.select(
        transcripts.segment_ids(segments).alias("id"), "stream_id", "segment_index", "text", "language", milliseconds(a).alias("timestamp_ms"), duration(a, b).alias("duration_seconds"),
        F.coalesce("is_final", F.lit(True)).alias("is_final"), F.map_concat(kept, more).alias("attributes"), source.alias("source"),
    )


def documents_of(segments: DataFrame) -> DataFrame:
    """Text segments as documents (id, text, language, timestamp_ms, metadata); metadata gains timestamp_seconds and
    duration_seconds where they are known."""
    seconds = F.map_filter(
        F.create_map(F.lit("timestamp_seconds"), (F.col("timestamp_ms") / 1000).cast("string"), F.lit("duration_seconds"), F.col("duration_seconds").cast("string")), lambda _, v: v.isNotNull()
    )
    return segments.select("id", "text", "language", "timestamp_ms", F.map_concat("attributes", seconds).alias("metadata"))


def segments_of(documents: DataFrame) -> DataFrame:
    """Documents as text segments of their own stream, index 0; timed ones carry a source of kind text_segment."""
    at = F.col("timestamp_ms") / 1000
    none = F.lit(None).cast("double")
    source = F.when(at.isNotNull(), F.struct(F.col("id").alias("source_id"), F.lit("text_segment").alias("source_kind"), F.lit(None).cast("string").alias("uri"), at.alias("timestamp_seconds"), none.alias("duration_seconds")))
    return documents.select("id", F.col("id").alias("stream_id"), F.lit(0).cast("bigint").alias("segment_index"), "text", "language", "timestamp_ms", none.alias("duration_seconds"), F.lit(True).alias("is_final"), F.col("metadata").alias("attributes"), source.alias("source"))


def contract_documents(documents: DataFrame) -> DataFrame:
    """Corpus documents of documents with attributes: those, and timestamp_seconds, as metadata."""
    seconds = F.map_filter(F.create_map(F.lit("timestamp_seconds"), (F.col("timestamp_ms") / 1000).cast("string")), lambda _, v: v.isNotNull())
    return documents.select("id", "text", "language", F.map_concat(F.map_filter("attributes", lambda k, _: k != "timestamp_seconds"), seconds).alias("metadata"))


def write_srt(segments: DataFrame, path: str) -> None:
    """SubRip files under path, a folder stream_id=... with one file to a stream."""
    transcripts.format_srt(segments).select("stream_id", F.col("srt").alias("value")).write.partitionBy("stream_id").option("lineSep", "\n").text(path)


def read_normalized(spark: SparkSession, path: str) -> DataFrame:
    """Segments of all transcript files under path: subtitle markup cleaned, those left empty dropped, normalized."""
    rows = transcripts.read_transcripts(spark, path)
    for name, kind in (("language", "string"), ("speaker", "string"), ("confidence", "double"), ("is_final", "boolean"), ("words", f"array<{WORD}>"), ("chars", f"array<{CHAR}>"), ("attributes", "map<string,string>")):
        if name not in rows.columns:
            empty = F.array().cast(kind) if kind.startswith("array") else F.create_map().cast(kind) if kind.startswith("map") else F.lit(None).cast(kind)
            rows = rows.withColumn(name, empty)
    return normalized(rows.withColumn("text", transcripts.clean_subtitle("text")).filter("text != ''"))

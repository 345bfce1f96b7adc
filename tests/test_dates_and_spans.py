from pyspark.sql import functions as F

from textspark.functions import spans, temporal


def years(text):
    return [(d.start_year, d.end_year, d.month, d.day) for d in temporal.dates(text)]


def test_dates():
    assert years("Hume was an 18th century thinker") == [(1701, 1800, None, None)]
    assert years("on 3 May 1808 and July 4, 1776") == [(1808, 1808, 5, 3), (1776, 1776, 7, 4)]
    assert years("the war of 1914-18 began") == [(1914, 1918, None, None)]
    assert years("in the late 19th century and the 1920s") == [(1867, 1900, None, None), (1920, 1929, None, None)]
    assert years("he died 44 BC") == [(-44, -44, None, None)]
    assert years("a heap of 1234 things") == [] and years("") == []
    assert years("am 3. Oktober 1990 im 5. Jahrhundert v. Chr.") == [(1990, 1990, 10, 3), (-500, -401, None, None)]


def test_spans(spark):
    row = spark.createDataFrame([("é😀x ΣΊΣΥΦΟΣ",)], "t string")
    t = F.col("t")
    got = row.select(
        spans.byte_offset(t, F.lit(2)).alias("b"), spans.utf16_offset(t, F.lit(2)).alias("u"), F.size(spans.graphemes("t")).alias("g"),
        spans.byte_slice(t, F.lit(2), F.lit(6)).alias("s"), spans.byte_slice(t, F.lit(1), F.lit(6)).alias("bad"), spans.find_caseless(t, F.lit("σίσυφος")).alias("f"),
        spans.find_caseless(t, F.lit("zz")).alias("none"),
    ).first()
    assert (got.b, got.u, got.g, got.s, got.bad, got.f, got.none) == (6, 3, 11, "😀", None, 4, None)

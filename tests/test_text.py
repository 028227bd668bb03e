"""Text expressions: what is computed once, and short cuts against the whole."""

from pyspark.sql import functions as F

from lexispark.functions import profiles, text


def test_detection_cuts_a_text_once(spark):
    df = spark.createDataFrame([("the and of",)], "t string").select(text.detect_language(F.col("t"), profiles.codes()).alias("x"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_the_excerpt_of_a_long_text_is_that_of_the_whole(spark):
    rows = [("x " * n + "y",) for n in (10, 99, 100, 499, 500, 501, 900)] + [(" " * 1500 + "a b " * 200,), ("ab" * 2000,), ("a" + " " * 3000 + "b",), ("",), (None,)]
    df = spark.createDataFrame(rows, "t string")
    for r in df.select(text.excerpt_of(F.col("t")).alias("a"), text.excerpt(text.collapse(F.col("t"))).alias("b")).collect():
        assert r.a == r.b

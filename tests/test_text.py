from pyspark.sql import functions as F

from quarry.functions.text import char_length, parse_gt, parse_gt_lenient, py_strip, text_head, with_prefix


def _one(spark, expr, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


def test_parse_strict_dedupes(spark):
    assert sorted(_one(spark, parse_gt("v"), "5 5 7")) == [5, 7]


def test_parse_lenient_keeps_repeats_and_drops_junk(spark):
    assert _one(spark, parse_gt_lenient("v"), "5 5 7") == [5, 5, 7]
    assert _one(spark, parse_gt_lenient("v"), "5 x7 0012") == [5, 12]


def test_parse_null_and_empty(spark):
    assert _one(spark, parse_gt("v"), None) == []
    assert _one(spark, parse_gt("v"), "") == []
    assert _one(spark, parse_gt_lenient("v"), None) == []


def test_parse_splits_on_unicode_whitespace(spark):
    assert sorted(_one(spark, parse_gt("v"), "1 2\t3\n")) == [1, 2, 3]


def test_strip_like_python(spark):
    assert _one(spark, py_strip(F.col("v")), "  x\n") == "x"
    assert _one(spark, py_strip(F.col("v")), " a b　") == "a b"


def test_head_counts_code_points(spark):
    s = "é" * 2000
    assert _one(spark, text_head("v", 1500), s) == s[:1500]
    assert _one(spark, char_length("v"), s) == 2000


def test_prefix(spark):
    assert _one(spark, with_prefix("v", "q: "), "x") == "q: x"

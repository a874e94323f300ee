"""Scalar functions and metrics against values worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from sorrel.functions import metrics, text


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_title_and_year(spark):
    rows = spark.createDataFrame([("Toy Story (1995)",), ("Untitled",), ("A (x) (2001)",)], "raw string")
    got = [tuple(r) for r in rows.select(text.title_of(F.col("raw")), text.year_of(F.col("raw"))).collect()]
    assert got == [("Toy Story", 1995), ("Untitled", None), ("A (x)", 2001)]


def test_descriptions(spark):
    rows = spark.createDataFrame([(" foo  bar . . ",), ("?",), ("Mug.",), ("",)], "d string")
    assert [r[0] for r in rows.select(text.normal_description(F.col("d"))).collect()] == ["FOO BAR .", "?", "MUG", ""]


def test_formats(spark):
    x = F.lit
    got = one(spark, text.fmt(x(1.23456)), text.fmt(x(2.0), 2), text.fmt(x(float("nan"))), text.fmt(x(None).cast("double")), text.format_percent(x(0.1234)), text.format_metric(x(float("inf"))), text.escape_html(x("<a href=\"x\">'&</a>")))
    assert tuple(got) == ("1.2346", "2.00", "—", "—", "12.34%", "n/a", "&lt;a href=&quot;x&quot;&gt;&#39;&amp;&lt;/a&gt;")


def test_names_and_buckets(spark):
    x = F.lit
    got = one(spark, text.title_or_number(x("Seven Samurai"), x(7)), text.title_or_number(x(None).cast("string"), x(999)), text.rating_bucket(x(4.0)), text.rating_bucket(x(2.0)), text.rating_bucket(x(3.0)), text.clamp(x(14.0), 1.0, 5.0), text.node_radius(x(0.1)), text.node_colour(x(0.05)), text.because_you_liked(x("A"), F.array(x("B"), x("C"))), text.format_itemset(F.array().cast("array<string>")))
    assert tuple(got) == ("Seven Samurai", "Movie #999", "high", "low", "medium", 5.0, 8.0, "rgb(177, 177, 150)", 'Because you liked "A", we recommend: B, C', "(empty)")


def test_metrics_with_zero_denominators(spark):
    x = F.lit
    c = metrics.confidence(x(0), x(0))
    got = one(spark, c, metrics.lift(F.struct(x(0.5).alias("value"), x(True).alias("defined")), x(0), x(5)), metrics.support(x(0), x(0)), metrics.support(x(3), x(5)))
    assert [tuple(v) for v in got] == [(0.0, False), (0.0, False), (0.0, False), (0.6, True)]


def test_jaccard(spark):
    a = lambda *v: F.array(*[F.lit(k) for k in v]).cast("array<string>")
    got = one(spark, metrics.jaccard(a("a", "b"), a("b", "c")), metrics.jaccard(a(), a()))
    assert got[0] == pytest.approx(1 / 3) and got[1] == 0


def test_thresholds():
    assert metrics.threshold_errors(0.01, 0.3) == []
    for bad in ((math.nan, 0.3), (0.01, 1.5), (0, 0.3), ("x", 0.3)):
        assert len(metrics.threshold_errors(*bad)) == 1

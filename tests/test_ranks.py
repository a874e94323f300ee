"""Places in one order, by ranges."""

import random

from pyspark.sql import functions as F

from sorrel.operators.ranks import with_place


def test_places(spark):
    pick = random.Random(2)
    rows = [(pick.randrange(40), f"t{pick.randrange(500)}") for _ in range(2_000)]
    df = spark.createDataFrame(rows, "_number int, title string").repartition(9)
    got = with_place(df, F.desc("_number"), "title", name="nth", first=0).collect()
    assert sorted(r["nth"] for r in got) == list(range(2_000))
    assert [(r["_number"], r["title"]) for r in sorted(got, key=lambda r: r["nth"])] == sorted(rows, key=lambda r: (-r[0], r[1]))


def test_one_value_and_no_rows(spark):
    same = spark.range(100).select(F.lit(1).alias("id"))
    assert sorted(r["place"] for r in with_place(same, "id").collect()) == list(range(1, 101))
    assert with_place(same.limit(0), "id").count() == 0

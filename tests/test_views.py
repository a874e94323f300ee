"""Views of the star schema: joins dealt by the size of the table, each row read once."""

import pytest
from pyspark.sql import functions as F

from sorrel.operators import baskets as bk
from sorrel.plans import queries, views
from sorrel.scratch import Scratch

SF = "/root/testdata/sf0.001"


def test_a_join_has_as_many_pieces_as_its_lines_need(spark, monkeypatch):
    small = views.ratings(spark, SF)
    monkeypatch.setattr(views, "PIECE", 500)
    n = views.pieces(views.table(spark, SF, "lineitem"))
    assert n > 4 and views.ratings(spark, SF).rdd.getNumPartitions() == n
    assert not small.exceptAll(views.ratings(spark, SF)).count()
    assert views.baskets(spark, SF).rdd.getNumPartitions() == n


@pytest.mark.parametrize("name", ["assoc_rules_all_splits", "frequent_itemsets", "frequent_itemsets_1_3"])
def test_baskets_are_saved_once(spark, monkeypatch, name):
    made = []
    monkeypatch.setattr(views, "baskets", lambda s, sf, f=views.baskets: made.append(1) or f(s, sf))
    saved = []
    monkeypatch.setattr(Scratch, "save", lambda self, df, f=Scratch.save: saved.append(df.columns) or f(self, df))
    given = []
    for f in ("frequent_itemsets", "small_itemsets_of"):
        monkeypatch.setattr(bk, f, lambda b, *a, g=getattr(bk, f), **k: given.append(b.inputFiles()) or g(b, *a, **k))
    queries.QUERIES[name](spark, SF)
    assert made == [1] and ["items"] in saved
    assert all("baskets-" in path for path in given[0])


def test_ratings_are_joined_once_for_all_lines(spark, monkeypatch):
    joined = []
    monkeypatch.setattr(views, "ratings", lambda s, sf, f=views.ratings: joined.append(1) or f(s, sf).withColumn("rating", F.raise_error(F.lit("read"))).limit(0))
    plans = []
    from pyspark.sql.readwriter import DataFrameWriter

    monkeypatch.setattr(DataFrameWriter, "text", lambda self, path, f=DataFrameWriter.text: plans.append(self._df._jdf.queryExecution().optimizedPlan().toString()) or f(self, path))
    queries.ratings_from_file(spark, SF)
    assert joined == [1] and "Union" not in plans[0]

"""What products and ratings put on disk."""

import numpy as np

from sorrel.operators import collaborative, products
from sorrel.plans import views


def test_f6_numbers_of_an_id_do_not_travel_with_its_entries(spark, monkeypatch):
    """entries travel as streams, one for each task and tile, and without what belongs to their id."""
    rows = [(u, i, float((u * i) % 5 + 1)) for u in range(30) for i in range(8) if (u + i) % 3]
    r = spark.createDataFrame(rows, "userId int, movieId int, rating double")
    saved, sent = [], []
    save, streamed = products.Scratch.save, products.streamed
    monkeypatch.setattr(products.Scratch, "save", lambda self, df: saved.append(df.columns) or save(self, df))
    monkeypatch.setattr(products, "streamed", lambda rows, *a: sent.append((rows, streamed(rows, *a))) or sent[-1][1])
    found = collaborative.similarities(r, "userId", "movieId", strategy="mean").collect()
    assert len(found) == 30 * 29 - sum(1 for x in range(30) for y in range(30) if x != y and not any((x + i) % 3 and (y + i) % 3 for i in range(8)))
    assert max(len(c) for c in saved) <= 4
    (before, after), = sent
    assert before.count() >= 2 * len(rows) and after.columns == ["i", "j", "data"]
    assert after.count() <= after.rdd.getNumPartitions() and after.agg({"data": "count"}).first()[0] < len(rows)


def test_streams_give_their_rows_back(spark, monkeypatch):
    monkeypatch.setattr(products, "PACK", 7)
    rows = spark.range(50).selectExpr("cast(id % 3 as int) i", "cast(id % 2 as int) j", "id % 5 q", "id p", "case when id % 4 > 0 then id / 2 end v0").repartition(2)
    packed = products.streamed(rows, ["i", "j"], ["q", "p"])
    got = []
    for r in packed.toArrow().to_batches():
        for k in range(r.num_rows):
            part = r.slice(k, 1)
            got += [(part["i"][0].as_py(), part["j"][0].as_py(), *row.values()) for b in products.unstreamed([part]) for row in b.to_pylist()]
    assert sorted(got, key=lambda r: r[3]) == sorted(map(tuple, rows.collect()), key=lambda r: r[3])


def test_last_ratings_leave_the_price_where_it_is(spark):
    """a rating is its quantity's, so the price behind it in the order is neither joined nor shuffled."""
    plan = views.last_ratings(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    used = [line for line in plan.splitlines() if "Relation" not in line]
    assert any("l_quantity" in line for line in used) and not any("l_extendedprice" in line for line in used)


def test_rows_are_ordered_by_one_number_or_by_columns():
    pick = np.random.default_rng(2)
    few = [pick.integers(-3, 4, 500).astype(np.int32), pick.integers(0, 9, 500)]
    for columns in (few, [few[0], pick.integers(-(1 << 62), 1 << 62, 500), few[1]]):
        rows = list(zip(*columns))
        assert [rows[k] for k in products.in_order(columns)] == sorted(rows)

"""Readers on small files."""

from sorrel.operators import cleaning
from sorrel.sources import readers
from sorrel.streaming.baskets import windowed_item_counts


def test_items(spark, tmp_path):
    flags = ["0"] * 19
    flags[1], flags[18] = "1", "1"
    (tmp_path / "items").write_text("1|Toy (1995)|d|v|u|" + "|".join(flags) + "\n\n2|short\n")
    got = readers.read_items(spark, str(tmp_path / "items")).collect()
    assert [(r["id"], r["title"], r["genres"]) for r in got] == [(1, "Toy (1995)", ["Action", "Western"])]
    shifted = readers.read_items(spark, str(tmp_path / "items"), legacy_shift=True).first()
    assert shifted["genres"] == ["Adventure"]


def test_ratings_and_edges(spark, tmp_path):
    (tmp_path / "r").write_text("1\t2\t3\t4\nbad\n\n5\t6\t4.5\t7\n")
    assert [tuple(r) for r in readers.read_ratings(spark, str(tmp_path / "r")).collect()] == [(1, 2, 3.0, 4), (5, 6, 4.5, 7)]
    (tmp_path / "e").write_text("1,2\n2,3\n")
    assert readers.read_edges(spark, str(tmp_path / "e")).count() == 2


def test_retail(spark, tmp_path):
    head = ",".join(readers.RETAIL_COLUMNS)
    (tmp_path / "log.csv").write_text(f'{head}\n1,P1,"Cup, red",1,d,2.0,7,UK\n2,P1,Cup\n')
    rows = cleaning.with_drop_reason(readers.read_retail(spark, str(tmp_path / "log.csv")).cache())
    assert {r["reason"]: r["n"] for r in cleaning.waterfall(rows).collect()} == {"kept": 1, "bad_columns": 1}


def test_encoded_round_trip(spark, tmp_path):
    items = spark.createDataFrame([(0, "A", "a")], "idx int, stock string, description string")
    baskets = spark.createDataFrame([(1, [0])], "basket_id bigint, item_idx array<int>")
    assert readers.write_encoded(items, baskets, "made here", str(tmp_path / "d")) == 1
    a, b, meta = readers.read_encoded(spark, str(tmp_path / "d"))
    assert a.collect() == items.collect() and b.collect() == baskets.collect() and meta.first()["n_baskets"] == 1


def test_menu_and_ids(spark):
    assert readers.lunch_menu(spark).count() == 12
    assert [r["id"] for r in readers.id_list(spark, 3).collect()] == [1, 2, 3]


def test_stream(spark, tmp_path):
    spark.sql("select 'A' stock, 1 basket_id, timestamp'2024-01-01 10:00:00' ts union all select 'A', 2, timestamp'2024-01-01 11:00:00'").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("stock string, basket_id int, ts timestamp").parquet(str(tmp_path / "in"))
    q = windowed_item_counts(stream).writeStream.outputMode("update").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [r["n"] for r in spark.sql("select n from counts").collect()] == [2]

"""Retail cleaning: literal rows, the report of its passes, and order by place in files."""

from pyspark.sql import functions as F

from sorrel.functions import text as tx
from sorrel.operators import cleaning
from sorrel.sources import readers

# Rows whose outcome is known by hand: invoice, code, description, quantity, price, customer; reason, code, description.
LITERAL = [
    ("536365", " 85123a\t", "White\u00a0 Hanging\tHeart .", "6", "2.55", "17850", "kept", "85123A", "WHITE HANGING HEART"),
    ("536366", "22752", "\t\u2003", "2", "7.65", "17850", "blank_description", "22752", ""),
    ("536367", "22745", "A box", "1", "1.0", "\t\u00a0", "blank_customer", "22745", "A BOX"),
    ("536368", "POST1", "POSTAGE\t", "1", "18", "12583", "non_product", "POST1", "POSTAGE"),
    ("536369", "22746", "A cup", "2d", "1.0", "1", "bad_number", "22746", "A CUP"),
    ("536370", "22747", "A cup", "2", "0x1p3", "1", "bad_number", "22747", "A CUP"),
    ("536371", "22748", "A cup", "\u00a01_000 ", "1e-2", "1", "kept", "22748", "A CUP"),
    ("536372", "22749", "A cup", "1__0", "1", "1", "bad_number", "22749", "A CUP"),
    ("536373", "22750", "A cup", "nan", "inf", "1", "kept", "22750", "A CUP"),
    ("536374", "22751", "A cup", "5.", ".5", "1", "kept", "22751", "A CUP"),
    ("536375", "\u3000", "A cup", "5", "1", "1", "blank_code", "", "A CUP"),
    ("536376", "gift_0001_20", "A voucher", "5", "1", "1", "non_product", "GIFT_0001_20", "A VOUCHER"),
    ("C536377", "22753", "A cup", "-5", "1", "1", "cancellation_or_adjustment", "22753", "A CUP"),
    ("536378", "22754", "?", "0", "1", "1", "quantity", "22754", "?"),
    ("536379", "22755", "foo . .", "1", "-0.0", "1", "price", "22755", "FOO ."),
]
COLUMNS = ["InvoiceNo", "StockCode", "Description", "Quantity", "UnitPrice", "CustomerID"]


def log(spark, rows):
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in COLUMNS))


def test_literal_rows(spark):
    out = cleaning.with_drop_reason(log(spark, [r[:6] for r in LITERAL]))
    got = out.select("InvoiceNo", F.coalesce("drop_reason", F.lit("kept")), "stock", tx.normal_description(F.col("Description"))).collect()
    assert sorted(map(tuple, got)) == sorted((r[0], *r[6:]) for r in LITERAL)


def test_numbers_are_read_strictly(spark):
    def reads(x):
        try:
            return float(x)
        except ValueError:
            return None

    texts = ["1", " 2\t", "2d", "2f", "1_0", "_1", "1_", "1__0", ".5", "5.", ".", "", "1e5", "1E-2", "e5", "+1", "--1", "inf", "-Infinity", "NaN", "0x10", "1 2", "\u00a07", "1.5_0", "infinit"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", tx.number_of(F.col("t")).alias("v"), tx.normal_code(F.col("t")).alias("c")).collect():
        assert repr(r["v"]) == repr(reads(r["t"])), r
        assert r["c"] == r["t"].strip().upper()


def test_whites_are_the_class():
    import re

    assert {chr(c) for c in range(0x10000) if re.match(f"[{tx.WHITE}]", chr(c))} == set(tx.WHITES)


def test_report_of_the_passes(spark):
    rows = [LITERAL[k][:6] for k in range(len(LITERAL))]
    rows += [(f"{i}", f"A{j}", f"thing {j}", "1", "1", "9") for i in range(7) for j in range(4) if (i + j) % 3]
    done = cleaning.clean_log(log(spark, rows).repartition(3))
    report = {(r["section"], r["name"]): r["n"] for r in done.report.collect()}
    kept = done.kept.collect()
    baskets = done.baskets.collect()
    assert report["rows", "raw"] == len(rows) and report["rows", "kept"] == len(kept)
    assert report["rows", "in_baskets"] == sum(len(b["items"]) for b in baskets)
    assert report["size", "baskets"] == len(baskets) == 7
    assert report["size", "items"] == 4 and report["dropped", "bad_number"] == 3 and report["dropped", "bad_columns"] == 0
    assert sum(n for (s, _), n in report.items() if s == "dropped") == len(rows) - len(kept)
    best = {name: n for (s, name), n in report.items() if s == "top"}
    assert best == {s: sum(s in {i["stock"] for i in b["items"]} for b in baskets) for s in ("A0", "A1", "A2", "A3")}


def test_report_of_an_empty_log(spark):
    done = cleaning.clean_log(log(spark, []))
    assert {r["n"] for r in done.report.collect()} == {0}


def test_first_entries_by_place_in_files(spark, tmp_path):
    """Codes repeat within and across files; the first one in file order counts, whatever the tasks."""
    for name, lines in (("a.csv", ["x,one", "y,two", "x,three"]), ("b.csv", ["z,four", "y,five", "z,six"]), ("c.csv", [f"w{k % 50},v{k}" for k in range(5_000)])):
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = readers.with_position(spark.read.csv(str(tmp_path), schema="stock string, description string"))
        got = {r["stock"]: r["description"] for r in cleaning.first_entries(rows.repartition(5)).collect()}
        assert rows.rdd.getNumPartitions() > 5
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {"x": "one", "y": "two", "z": "four"} | {f"w{k}": f"v{k}" for k in range(50)}


def test_baskets_in_first_seen_order(spark):
    lines = [("i9", "b"), ("i2", "a"), ("i9", "a"), ("i5", "c"), ("i2", "c"), ("i1", "a"), ("i1", "b")]
    kept = spark.createDataFrame([(i, s, s, k) for k, (i, s) in enumerate(lines)], "invoice string, stock string, description string, place long").repartition(4)
    baskets = cleaning.build_baskets(kept, cleaning.canonical_descriptions(kept))
    assert [(r["nth"], r["invoice"]) for r in cleaning.in_first_seen_order(kept, baskets).orderBy("nth").collect()] == [(0, "i9"), (1, "i2"), (2, "i1")]


def test_baskets_are_dealt_out_once(spark):
    """One shuffle by invoice serves distinct codes and baskets; codes without a description and small baskets are left out."""
    from pyspark.sql import functions as F

    from sorrel.operators import cleaning

    kept = spark.createDataFrame([("1", "a"), ("1", "b"), ("1", "a"), ("2", "a"), ("2", "x"), ("3", "b"), ("3", "a")], "invoice string, stock string")
    canonical = spark.createDataFrame([("a", "A"), ("b", "B")], "stock string, description string")
    made = cleaning.build_baskets(kept, F.broadcast(canonical))
    assert {r["invoice"]: [tuple(i) for i in r["items"]] for r in made.collect()} == {"1": [("a", "A"), ("b", "B")], "3": [("a", "A"), ("b", "B")]}
    assert made._jdf.queryExecution().sparkPlan().toString().count("hashpartitioning") == 0
    assert kept.count() and cleaning.build_baskets(kept, F.broadcast(canonical))._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(invoice") == 1

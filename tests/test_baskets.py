"""Rules and itemsets on five baskets, with counts worked out by hand."""

import pytest
from pyspark.sql import functions as F

from sorrel.operators import baskets as bk
from sorrel.operators import cleaning, rules

FIVE = [("T1", "bread milk jam ham"), ("T2", "bread milk jam"), ("T3", "bread milk"), ("T4", "bread jam eggs"), ("T5", "bread eggs")]


@pytest.fixture(scope="module")
def baskets(spark):
    return spark.createDataFrame([(b, i.split()) for b, i in FIVE], "basket_id string, items array<string>").cache()


@pytest.fixture(scope="module")
def index(baskets):
    return bk.postings(baskets).cache()


def test_item_counts(index):
    assert {r["stock"]: r["n"] for r in bk.item_counts(index).collect()} == {"bread": 5, "milk": 3, "jam": 3, "eggs": 2, "ham": 1}


@pytest.mark.parametrize(("items", "n"), [(["bread", "milk"], 3), (["milk", "milk"], 3), ([], 0), (["none"], 0), (["bread", "none"], 0)])
def test_count_itemset(index, items, n):
    assert bk.count_itemset(index, items).first()["n"] == n


def test_dedupe(spark):
    got = spark.createDataFrame([(["milk", "bread", "milk", "bread", "jam"],)], "i array<string>").select(bk.dedupe("i")).first()[0]
    assert got == ["milk", "bread", "jam"]


@pytest.mark.parametrize(("least", "sizes"), [(0.4, {1: 4, 2: 4, 3: 1}), (0.2, {1: 5, 2: 8, 3: 5, 4: 1})])
def test_itemsets(baskets, least, sizes):
    found = bk.frequent_itemsets(baskets, least).collect()
    by_size = {}
    for r in found:
        by_size[len(r["items"])] = by_size.get(len(r["items"]), 0) + 1
        assert r["items"] == sorted(r["items"]) and r["support"] == r["count"] / 5
    assert by_size == sizes


def test_small_itemsets_agree(baskets, index):
    grown = {tuple(r["items"]): r["count"] for r in bk.frequent_itemsets(baskets, 0.2).collect() if len(r["items"]) <= 3}
    assert {tuple(r["items"]): r["count"] for r in bk.small_itemsets(index, 5, 0.2, 3).collect()} == grown


def test_small_itemsets_shuffle_counts_only(spark, baskets, monkeypatch):
    """No join by baskets: candidates are made where a basket is, also where lists are too long to broadcast."""
    found = bk.small_itemsets_of(baskets, 5, 0.2, 4)
    whole = {tuple(r["items"]): r["count"] for r in bk.frequent_itemsets(baskets, 0.2).collect()}
    assert {tuple(r["items"]): r["count"] for r in found.collect()} == whole
    monkeypatch.setattr(bk, "BROADCAST_SETS", 0)
    assert {tuple(r["items"]): r["count"] for r in bk.small_itemsets_of(baskets, 5, 0.2, 4).collect()} == whole
    assert bk.small_itemsets_of(baskets.limit(0), 0, 0.2, 3).count() == 0


def test_support_at_the_edge(spark):
    rows = [(i, ["x", "y"] if i < 7 else ["z", "w"]) for i in range(100)]
    b = spark.createDataFrame(rows, "basket_id int, items array<string>")
    assert {tuple(r["items"]) for r in bk.frequent_itemsets(b, 0.07).collect()} >= {("x",), ("y",), ("x", "y")}


@pytest.mark.parametrize(("s", "c", "n", "single", "lifted"), [(0.4, 0.5, 12, 10, 6), (0.4, 0.6, 12, None, 6), (0.2, 0.5, 38, 27, 24)])
def test_rules(baskets, s, c, n, single, lifted):
    found = rules.generate_rules(bk.frequent_itemsets(baskets, s), 5, c)
    rows = found.collect()
    assert len(rows) == n
    if single is not None:
        assert sum(len(r["consequent"]) == 1 for r in rows) == single
    assert sum(r["lift"] > 1 + 1e-12 for r in rows) == lifted


def test_enrich_and_reverse(spark, index):
    bare = spark.createDataFrame([(["jam"], ["eggs"]), (["milk"], ["jam"]), (["none"], ["milk"])], "antecedent array<string>, consequent array<string>")
    rich = rules.enrich(bare, index, 5)
    got = {tuple(r["antecedent"]): r for r in rich.collect()}
    assert got[("jam",)]["confidence"] == pytest.approx(1 / 3) and got[("jam",)]["lift"] == pytest.approx(5 / 6)
    assert got[("milk",)]["lift"] == pytest.approx(10 / 9)
    assert not got[("none",)]["confidence_defined"] and got[("none",)]["joint"] == 0
    back = {tuple(r["antecedent"]): r for r in rules.reverse(rich, F.lit(5)).collect()}
    assert back[("eggs",)]["confidence"] == pytest.approx(1 / 2)
    assert back[("eggs",)]["lift"] == pytest.approx(5 / 6)


def test_enrich_keeps_what_is_given(spark, index):
    given = spark.createDataFrame([(["jam"], ["eggs"], 0.9)], "antecedent array<string>, consequent array<string>, confidence double")
    assert rules.enrich(given, index, 5).first()["confidence"] == 0.9


LOG = [
    ("C1", "P1", "Cup", "-1", "2.0", "7"),
    ("c1", "p1 ", " cup. ", "1", "2.0", "7"),
    ("1", "P1", "  ", "1", "2.0", "7"),
    ("1", "P1", "Cup", "one", "2.0", "7"),
    ("1", "P1", "Cup", "0", "2.0", "7"),
    ("1", "P1", "Cup", "1", "0", "7"),
    ("1", "P1", "Cup", "1", "2.0", " "),
    ("1", " ", "Cup", "1", "2.0", "7"),
    ("1", "gift_0001", "Voucher", "1", "2.0", "7"),
    ("1", "TEST1", "Test", "1", "2.0", "7"),
    ("1", "b", "Debt", "1", "2.0", "7"),
    ("1", "P9", "Postage", "1", "2.0", "7"),
    ("1", "MISC1", "Adjustment", "1", "2.0", "7"),
    ("1", "DCGS0003", "Boxed glass ashtray", "1", "2.0", "7"),
    ("1", "P1", "cup", "1", "2.0", "7"),
    ("2", "P1", "Mug", "1", "2.0", "7"),
    ("2", "P1", "Mug", "1", "2.0", "7"),
]


def test_retail_cleaning(spark):
    log = spark.createDataFrame(LOG, "InvoiceNo string, StockCode string, Description string, Quantity string, UnitPrice string, CustomerID string")
    reasoned = cleaning.with_drop_reason(log)
    got = {r["reason"]: r["n"] for r in cleaning.waterfall(reasoned).collect()}
    assert got == {"cancellation_or_adjustment": 1, "blank_description": 1, "bad_number": 1, "quantity": 1, "price": 1, "blank_customer": 1, "blank_code": 1, "non_product": 5, "kept": 5}
    kept = cleaning.kept_lines(reasoned)
    names = cleaning.canonical_descriptions(kept)
    assert {r["stock"]: r["description"] for r in names.collect()} == {"P1": "CUP", "DCGS0003": "BOXED GLASS ASHTRAY"}
    b = cleaning.build_baskets(kept, names)
    assert [(r["invoice"], [i["stock"] for i in r["items"]]) for r in b.collect()] == [("1", ["DCGS0003", "P1"])]
    d = cleaning.item_dictionary(b)
    assert [(r["idx"], r["stock"]) for r in d.orderBy("idx").collect()] == [(0, "DCGS0003"), (1, "P1")]
    again = cleaning.decode_baskets(cleaning.encode_baskets(b, d), d)
    assert again.collect() == b.collect()


def test_bitmaps(spark):
    """Ids around the ends of buckets, a hot code in many rows, and the same counts as by postings."""
    ids = [-32_769, -32_768, -5, 0, 1, 2, 32_767, 32_768, 32_769, 65_536, 65_537, 10**12]
    rows = [("a", i) for i in ids] + [("b", i) for i in ids[::2]] + [("c", 2)] + [("hot", i) for i in range(1, 200_000, 3)]
    index = spark.createDataFrame(rows, "stock string, basket_id long")
    maps = bk.posting_bitmaps(index.unionByName(index.where("stock = 'a'")))
    back = {}
    for r in bk.bitmap_ids(maps).collect():
        assert r["basket_ids"] == sorted(r["basket_ids"])
        back.setdefault(r["stock"], []).extend(r["basket_ids"])
    assert {s: sorted(x) for s, x in back.items()} == {s: sorted(i for t, i in rows if t == s) for s in ("a", "b", "c", "hot")}
    assert {r["stock"]: r["n"] for r in bk.bitmap_counts(maps).collect()} == {"a": 12, "b": 6, "c": 1, "hot": 66_667}
    assert maps.where("stock = 'hot'").count() == 7
    for items in (["a"], ["a", "b"], ["b", "a", "b"], ["a", "b", "c"], ["a", "hot"], ["a", "nothing"], []):
        assert bk.count_in_bitmaps(maps, items).first()["n"] == bk.count_itemset(index, items).first()["n"]


def test_numbered_baskets(spark):
    index = spark.createDataFrame([("a", "x9"), ("b", "x9"), ("a", "x10")], "stock string, basket_id string")
    assert sorted(map(tuple, bk.numbered(index).collect())) == [("a", 1), ("a", 2), ("b", 2)]


def test_rules_of_a_large_itemset(spark):
    """Twenty items with their large parts, singles and pairs: consequents grow while they are confident, and end where no part is listed."""
    from itertools import combinations

    from sorrel.operators import rules

    items = [f"i{k:02d}" for k in range(20)]
    count = lambda c: 40 if items[0] in c else 100
    sets = [c for k in (1, 2, 18, 19, 20) for c in combinations(items, k)]
    frame = spark.createDataFrame([(list(c), count(c)) for c in sets], "items array<string>, count long")
    known, want = set(sets), set()
    for c in sets:
        for k in (1, 2):
            for right in combinations(c, k):
                left = tuple(i for i in c if i not in right)
                if left in known and count(c) / count(left) >= 0.9:
                    want.add((left, right))
    got = {(tuple(r["antecedent"]), tuple(r["consequent"])) for r in rules.generate_rules(frame, 200, 0.9).collect()}
    assert got == want
    assert sum(len(a) == 18 and len(b) == 2 for a, b in got) == 171
    assert rules.generate_rules(frame.limit(0), 200, 0.9).count() == 0


def test_enrich_counts_each_set_once(spark, monkeypatch):
    """Rules that share their sides ask for few sets; items in any order, an unknown item and an empty side included."""
    from sorrel.operators import rules

    index = spark.createDataFrame([(b, s) for b in range(6) for s in "abc" if b % (ord(s) - 95)], "basket_id long, stock string")
    asked = spark.createDataFrame([(["a"], ["b"]), (["b"], ["a"]), (["b", "a"], ["c"]), (["c", "a"], ["b"]), (["z"], ["a"]), ([], ["a"])], "antecedent array<string>, consequent array<string>")
    saved, save = [], rules.Scratch.save
    monkeypatch.setattr(rules.Scratch, "save", lambda self, df: saved.append(save(self, df)) or saved[-1])
    got = {(tuple(r["antecedent"]), tuple(r["consequent"])): (r["joint"], r["antecedent_count"], r["consequent_count"]) for r in rules.enrich(asked, index, 6).collect()}
    has = {s: {b for b in range(6) if b % (ord(s) - 95)} for s in "abc"} | {"z": set()}
    count = lambda items: len(set.intersection(*[has[s] for s in items])) if items else 0
    assert got == {(a, c): (count({*a, *c}), count(a), count(c)) for a, c in got} and len(got) == 6
    assert sorted(r["items"] for r in saved[1].collect()) == [["a"], ["a", "b"], ["a", "b", "c"], ["a", "c"], ["a", "z"], ["b"], ["c"], ["z"]]

"""Dropped lines against all pairs, and the edit distance against plain dynamic programming."""

import random

import pytest
from helpers import awkward, clashing
from pyspark.sql import functions as F

from sorrel.llm import linededup as ld


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def change(rnd, text, n):
    chars = list(text)
    for _ in range(n):
        i, k = rnd.randrange(len(chars) + 1), rnd.random()
        if k < 0.34 or not chars:
            chars.insert(i, rnd.choice("abé\U0001f600"))
        elif k < 0.67:
            chars.pop(min(i, len(chars) - 1))
        else:
            chars[min(i, len(chars) - 1)] = rnd.choice("abé\U0001f600")
    return "".join(chars)


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_edit_distance(spark, threshold):
    rnd = random.Random(threshold)
    pairs = [(a := "".join(rnd.choice("abé\U0001f600") for _ in range(rnd.randint(0, 14))), change(rnd, a, rnd.randint(0, 5))) for _ in range(1500)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", ld.edit_distance(F.col("a"), F.col("b"), threshold).alias("d")).collect():
        want = edits(r["a"], r["b"])
        assert (r["d"] == want) if want <= threshold else r["d"] > threshold, (r, want)


def brute(rows, threshold):
    """rows -> {doc: dropped lines}, links of lines; lines under LEAST_CHARS are left alone."""
    first = {}
    for i, t in sorted(r for r in rows if r[1] is not None):
        for k, x in enumerate(t.split("\n")):
            if len(x) >= ld.LEAST_CHARS:
                first[x] = min((i, k), first.get(x, (i, k)))
    near = {x: [y for y in first if x != y and abs(len(x) - len(y)) <= threshold and edits(x, y) <= threshold] for x in first}
    return {i: [k for k, x in enumerate((t or "").split("\n")) if x in first and (i, k) > min(first[y] for y in [x, *near[x]])] for i, t in rows}, near


def cases(seed, variants):
    rnd = random.Random(seed)
    lines = ["".join(rnd.choice("ab é") for _ in range(rnd.choice([5, 19, 20, 21, 25, 40]))) for _ in range(25)]
    hot = "the one line that so many documents hold, with small changes at its end: "
    docs = []
    for i in range(70):
        own = [change(rnd, rnd.choice(lines), rnd.randint(0, 3)) for _ in range(rnd.randint(0, 4))]
        if i < variants:
            own.append(hot + "".join(rnd.choice("xyz") for _ in range(8)))
        docs.append((i, "\n".join(own)))
    return docs


@pytest.mark.parametrize(("seed", "variants", "threshold"), [(1, 0, 2), (2, 60, 2), (3, 40, 1)])
def test_brute_force(spark, seed, variants, threshold):
    rows = cases(seed, variants)
    want, near = brute(rows, threshold)
    got = {r["doc_id"]: r for r in ld.line_report(spark.createDataFrame(rows, "doc_id long, text string"), threshold, short_lines=False).collect()}
    for i, t in rows:
        assert got[i]["dropped_lines"] == want[i]
        assert got[i]["n_links"] == sum(len(near.get(x, [])) for x in t.split("\n"))
        assert got[i]["n_lines"] == len(t.split("\n")) and got[i]["n_dropped"] == len(want[i])
    texts = {r["doc_id"]: r["text"] for r in ld.drop_lines(spark.createDataFrame(rows, "doc_id long, text string"), threshold, short_lines=False).collect()}
    assert texts == {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[i]) for i, t in rows}


def test_every_near_line_shares_a_key(spark):
    rnd = random.Random(9)
    pairs = [(a := "".join(rnd.choice("abcdef") for _ in range(rnd.randint(20, 60))), change(rnd, a, rnd.randint(1, 2))) for _ in range(800)]
    df = spark.createDataFrame([(i, max(p, key=len), min(p, key=len)) for i, p in enumerate(pairs)], "h1 long, long string, short string")
    asked = ld.probe_keys(df.select("h1", F.char_length("long").alias("n"), F.col("long").alias("line")), 2).groupBy("h1").agg(F.collect_set("key").alias("asked"))
    keys = df.join(asked, "h1").select("long", "short", F.arrays_overlap("asked", ld.segment_keys(F.col("short"), F.char_length("short"), 2)).alias("met"))
    signs = keys.withColumn("flips", F.bit_count(ld.parities(F.col("long")).bitwiseXOR(ld.parities(F.col("short")))))
    for r in signs.collect():
        d = edits(r["long"], r["short"])
        assert d > 2 or (r["met"] and r["flips"] <= 4 * d)


def test_awkward_rows(spark):
    docs = clashing(awkward(spark), "line", "at", "h1", "dropped", "id", "t1", "t2", "_id", "_dropped", "_line_id", "_line_dropped", "first", "key")
    got = {r["doc_id"]: r["text"] for r in ld.drop_lines(docs).collect()}
    assert got[1] is None and got[2] == "" and got[3].startswith("same") and got[4] == ""
    assert {r["_dropped"] for r in ld.drop_lines(docs).select("_dropped").collect()} == {"mine"}
    assert ld.drop_lines(docs).columns == docs.columns and ld.drop_lines(docs).count() == docs.count()
    assert ld.line_report(docs.limit(0)).count() == 0


def test_equal_short_lines_go(spark):
    rows = [(1, "Home\nhome\n\n\u3000\nA line of its own, long enough to be near"), (2, "Home\n\n \n好的。\nHomes"), (3, "x\n好的。\nA line of its own, long enough to be nearr\nx")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["dropped_lines"] for r in ld.line_report(df, short_lines=True).collect()}
    assert got == {1: [], 2: [0], 3: [1, 2, 3]}
    texts = {r["doc_id"]: r["text"] for r in ld.drop_lines(df, short_lines=True).collect()}
    assert texts == {1: rows[0][1], 2: "\n \n好的。\nHomes", 3: "x"}


def test_short_lines_brute_force(spark):
    rows = cases(4, 20)
    seen, want = set(), {}
    long_, _ = brute(rows, 2)
    for i, t in sorted(rows):
        want[i] = list(long_[i])
        for k, x in enumerate(t.split("\n")):
            if x.strip() and len(x) < ld.LEAST_CHARS:
                want[i] += [k] if x in seen else []
                seen.add(x)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["dropped_lines"] for r in ld.line_report(docs, short_lines=True).collect()} == {i: sorted(w) for i, w in want.items()}


A, B, C = ("line a of the fixture, quite unlike the rest", "the second one, which is called b here", "and one more: 12345 67890")


def kept_lines(rows, threshold=2):
    """Texts after the rule, by plain loops over the rows in the order of id (null first) and text; a repeated row is the row itself."""
    left = {}
    everything = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    for i, t in everything:
        before = [x for j, u in everything if (j is not None, j or 0) < (i is not None, i or 0) for x in u.split("\n")]
        own = []
        for x in t.split("\n"):
            if not any(edits(x, y) <= threshold for y in [*before, *own] if len(x) >= ld.LEAST_CHARS):
                own.append(x)
        left[i, t] = "\n".join(own)
    return left


def test_rows_that_repeat_an_id_are_told_apart(spark):
    rows = [(1, B), (3, A), (3, B), (4, B + "\n" + C), (4, C + "!"), (4, B + "\n" + C)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["text"]) for r in ld.drop_lines(docs).collect())
    assert got[:3] == [(1, B), (3, ""), (3, A)]
    assert len(got) == 6 and {t for i, t in got if i == 4} in ({C, ""}, {"", C + "!"})
    assert {k: v for k, v in kept_lines(rows).items() if k[0] != 4} == {(1, B): B, (3, A): A, (3, B): ""}
    report = ld.line_report(docs)
    assert report.count() == 6 and sorted((r["doc_id"], r["n_links"]) for r in report.collect() if r["doc_id"] == 4) == [(4, 1)] * 3


def test_rows_without_an_id_are_told_apart(spark):
    rows = [(None, A), (None, B), (None, B), (7, A), (7, C)]
    got = sorted((r["doc_id"] or 0, r["text"]) for r in ld.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(0, A), (0, B), (0, B), (7, ""), (7, C)])


def test_tiles_of_a_hot_segment(spark, monkeypatch):
    monkeypatch.setattr(ld, "TILE", 16)
    rows = cases(6, 60)
    want, near = brute(rows, 2)
    got = {r["doc_id"]: r for r in ld.line_report(spark.createDataFrame(rows, "doc_id long, text string"), short_lines=False).collect()}
    assert all(got[i]["dropped_lines"] == want[i] and got[i]["n_links"] == sum(len(near.get(x, [])) for x in t.split("\n")) for i, t in rows)


def test_lines_are_dropped_in_linear_time(spark):
    """A text of 10^6 lines, half of which go; and what is left of small ones."""
    import time

    from pyspark.sql import functions as F

    from sorrel.llm.linededup import without_lines

    n = 1_000_000
    one = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: k.cast("string")), "\n").alias("text"), F.sequence(F.lit(0), F.lit(n - 1), F.lit(2)).alias("gone"))
    began = time.perf_counter()
    left = one.select(without_lines(F.col("text"), F.col("gone"))).first()[0]
    assert time.perf_counter() - began < 60
    assert left == "\n".join(str(k) for k in range(2, n + 1, 2))
    small = spark.createDataFrame([("a\n\nb\na\n", [0, 3]), ("", [0]), ("x", []), ("\n", [1])], "text string, gone array<int>")
    assert [r[0] for r in small.select(without_lines(F.col("text"), F.col("gone"))).collect()] == ["\nb\n", "", "x", ""]

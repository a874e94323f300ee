"""Product codes against a plain Lloyd in integers, and Elkan's bounds against true distances."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sorrel.llm import vectorcodes as vc

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=4, entries=256, rounds=4):
    """{(id, vector): (code, error)} and the entries, by Python integers."""
    kept = [(i, [int(np.floor(float(v) * 1024)) for v in x]) for i, x, _ in rows if x is not None and all(v is not None and np.isfinite(v) for v in x)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    sub = len(kept[0][1]) // parts
    books = [[x[p * sub : (p + 1) * sub] for _, x in kept[:entries]] for p in range(parts)]
    square = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b))
    for k in range(rounds + 1):
        codes = [[min((square(x[p * sub : (p + 1) * sub], c), e) for e, c in enumerate(books[p])) for p in range(parts)] for _, x in kept]
        if k < rounds:
            for p in range(parts):
                for e in range(len(books[p])):
                    own = [x[p * sub : (p + 1) * sub] for (_, x), c in zip(kept, codes) if c[p][1] == e]
                    if own:
                        books[p][e] = [sum(v) // len(own) for v in zip(*own)]
    return sorted((str(i), "".join(f"{e:02x}" for _, e in c), sum(d for d, _ in c)) for (i, _), c in zip(kept, codes)), books


def got(done):
    return sorted((str(r["id"]), r["code"].hex(), r["error"]) for r in done.codes.collect())


def grid(n, width, levels, seed):
    """Vectors on a coarse grid, so that distances tie and rows repeat."""
    pick = np.random.default_rng(seed)
    return [(int(i), [float(v) / 16 for v in pick.integers(-levels, levels + 1, width)], int(pick.integers(0, 3))) for i in pick.permutation(n)]


@pytest.mark.parametrize(("n", "width", "levels", "entries"), [(300, 8, 2, 16), (400, 16, 40, 32), (20, 4, 3, 256), (300, 4, 1, 7)])
def test_against_plain_lloyd(spark, n, width, levels, entries):
    rows = grid(n, width, levels, n + levels)
    done = vc.compress(spark.createDataFrame(rows, SCHEMA).repartition(3), entries=entries)
    want, books = brute(rows, entries=entries)
    assert got(done) == want
    assert done.entries.tolist() == books
    assert done.sha256() == hashlib.sha256(",".join(str(v) for p in books for e in p for v in e).encode()).hexdigest()


def test_bounds_pass_entries_over(spark):
    pick = np.random.default_rng(5)
    near = pick.normal(size=(40, 16))
    rows = [(i, (near[i % 40] + pick.normal(size=16) * 0.02).tolist(), 0) for i in range(1_000)]
    done = vc.compress(spark.createDataFrame(rows, SCHEMA), entries=40)
    assert got(done) == brute(rows, entries=40)[0]
    every = 1_000 * 4 * 40
    assert done.distances[0] == (every, every)
    assert all(n < every / 5 for n, _ in done.distances[1:])


def test_bounds_hold(spark):
    pick = np.random.default_rng(6)
    for size in (3, 50, 1_000, 1 << 27):
        x = pick.integers(-size, size + 1, (200, 4))
        c = pick.integers(-size, size + 1, (33, 4))
        b = vc.first_bounds(x, c)
        for k in range(5):
            upper, gaps = vc.pack(b)
            wide, lower = vc.unpack(upper, gaps, 33)
            true = np.array([[np.sqrt(float(sum((int(s) - int(t)) ** 2 for s, t in zip(r, e)))) for e in c] for r in x])
            assert (b.own == vc.between_all(x, c).argmin(1)).all()
            assert (wide >= true[np.arange(200), b.own]).all() and (lower <= true).all()
            moved = c + pick.integers(-max(1, size // 20), max(1, size // 20) + 1, c.shape) * (k % 2)
            book = vc.Moved.of(c, moved)
            b, c = vc.next_bounds(x, vc.Bounds(b.own, wide, lower, 0), book), moved


def test_exact_distances_of_large_components():
    pick = np.random.default_rng(7)
    x, c = pick.integers(-(1 << 28), 1 << 28, (20, 4)), pick.integers(-(1 << 28), 1 << 28, (9, 4))
    true = [[sum((int(s) - int(t)) ** 2 for s, t in zip(r, e)) for e in c] for r in x]
    assert vc.between_all(x, c).tolist() == true
    assert vc.between(x[:9], c).tolist() == [true[i][i] for i in range(9)]


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None, 1), (2, [0.5, nan, 0.0, 0.0], 1), (3, [inf, 0.0, 0.0, 0.0], 1), (4, [None, 0.0, 0.0, 0.0], 2), (5, [-inf, 0.0, 0.0, 0.0], None),
        (None, [0.25, -0.0001, 0.0, 1.0], None), (None, [0.25, -0.5, 0.0, 1.0], None), (7, [0.25, -0.5, 0.0, 1.0], 1), (7, [0.25, -0.5, 0.0, 1.0], 1), (7, [0.1, 3.0, 2.0, 1.0], 2),
    ]
    for entries in (1, 2, 256):
        done = vc.compress(spark.createDataFrame(rows, SCHEMA), entries=entries)
        assert got(done) == brute(rows, entries=entries)[0]
        summed = vc.with_label_errors(done.codes).collect()
        assert len(summed) == 5
        for r in summed:
            assert r["label_error"] == sum(s["error"] for s in summed if s["label"] == r["label"])


def test_empty_and_clashing(spark):
    none = spark.createDataFrame([], SCHEMA)
    done = vc.compress(none)
    assert vc.with_label_errors(done.codes).count() == 0 and done.sha256() == hashlib.sha256(b"").hexdigest()
    nothing = spark.createDataFrame([(1, None, 2)], SCHEMA)
    assert vc.compress(nothing).codes.count() == 0
    rows = grid(50, 8, 3, 1)
    odd = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("mine") for c in ("x", "code", "ID", "upper", "part", "n", "error")})
    assert got(vc.compress(odd, entries=8)) == brute(rows, entries=8)[0]


def test_refused(spark):
    with pytest.raises(ValueError):
        vc.compress(spark.createDataFrame([(1, [1.0] * 4, 1), (2, [1.0] * 8, 1)], SCHEMA))
    with pytest.raises(ValueError):
        vc.compress(spark.createDataFrame([(1, [1.0] * 6, 1)], SCHEMA))
    with pytest.raises(ValueError):
        vc.compress(spark.createDataFrame([(1, [1e30] * 4, 1)], SCHEMA))


def test_totals_of_many_keys(spark):
    """The salted join equals the broadcast one."""
    from sorrel.llm.common import with_totals

    rows = spark.range(300).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 7).cast(T.IntegerType()).alias("label"), F.lit(2).alias("error"))
    totals = rows.groupBy("label").agg(F.sum("error").alias("sum"))
    few, many = (sorted(map(tuple, with_totals(rows, totals, ["label"], "id", limit).collect()), key=str) for limit in (100, 1))
    assert few == many and len(few) == 300

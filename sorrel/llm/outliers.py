"""Quality rules by robust multivariate outliers, with DataFrame functions only.

Counts of a text (words, characters in words, symbols, repeated lines, words in repeated
3-word windows) become a vector of five transformed statistics, rounded to thousandths.
For each language and source, the location and scatter of these vectors are estimated by
the minimum covariance determinant. There are four starts: mean and covariance; medians and
quartile ranges; and, of the statistics centred and scaled by those, the correlations of
their hyperbolic tangents and of their spatial signs. Concentration steps replace an
estimate by that of the three quarters of rows nearest to it by Mahalanobis distance, until
no determinant changes any more (MOST_STEPS bounds this); the start that ends with the
smallest determinant is taken, and reweighted once by the rows within the 97.5 % ellipsoid.
A row is kept if its distance to the estimate is within a far quantile of the chi-square law.

The steps are joins and aggregates: distances fall into bins of 1/128 on a log scale, and
the sums of each bin are what the next estimate needs, so that a step is one aggregation
with map-side sums, whatever the size of a group. Sums are integers and so do not depend on
the order of rows. A small floor is added to the variances, since a statistic that is 0
for most rows (symbols, repeated lines) has none. Inverses come from Cholesky factors
written as column expressions.

Groups of fewer than LEAST rows share the estimate of the small groups of their language,
these share one of all small groups, and below that every row is kept.

Cases: a null or empty text has no words and fails the base rules; null languages and
sources are groups of their own; rows that repeat an id are judged each; ties in distance
are judged alike; an empty table gives no rows. A text is one row of work here, with
about 100 bytes of memory per word.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

DIMS = 5
NAMES = [f"x{i}" for i in range(DIMS)]
PAIRS = [(i, j) for i in range(DIMS) for j in range(i + 1)]
#: Thousandths of a transformed statistic, and the floor of each statistic's deviation.
UNIT = 1000
FLOORS = (0.15, 0.04, 0.05, 0.15, 0.12)
KEPT_SHARE = 0.75
#: Bins of a unit of the logarithm of the squared distance.
BINS = 128
#: Steps end when no log determinant moves by more than SETTLED, or after so many.
MOST_STEPS = 30
SETTLED = 1e-4
LEAST = 60
REWEIGHT = 0.975
#: A clean row of a normal group is rejected once in so many.
FAR = 1e-6
SPACE = r"\x20\x09-\x0D"


def chi_square(x: float, k: int) -> float:
    """The chi-square distribution function, from the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, z = k / 2, x / 2
    term = total = 1 / a
    n = 0
    while term > total * 1e-15:
        n += 1
        term *= z / (a + n)
        total += term
    return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a)))


def quantile(p: float, k: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square(mid, k) < p else (lo, mid)
    return (lo + hi) / 2


def consistency(share: float) -> float:
    """What the covariance of the nearest share of normal rows is multiplied by."""
    return share / chi_square(quantile(share, DIMS), DIMS + 2)


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more among the words."""
    n = F.size(words)
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))

    def covered(s: Column) -> Column:
        again = F.transform(s, lambda x, j: F.when((F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]), x["i"]))
        places = F.array_sort(F.array_compact(again))
        return F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda a, p: F.struct((a["n"] + p + 3 - F.greatest(p, a["end"])).alias("n"), (p + 3).alias("end")))["n"]

    return F.when(n < 3, F.lit(0)).otherwise(_with(F.array_sort(windows), covered)).cast("long")


def base_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and base_failed; the text column goes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = F.char_length(F.regexp_replace(text, f"[{SPACE}]+", ""))
    symbols = F.char_length(text) - F.char_length(F.regexp_replace(text, "[#*$%&|<>]+", ""))

    def measured(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n_words"), repeated_words(words).alias("n_repeat_words"))

    def lined(lines: Column) -> Column:
        n = F.size(lines)
        return F.struct(n.cast("long").alias("n_lines"), (n - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    words = F.array_remove(F.split(text, f"[{SPACE}]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    rest = [c for c in docs.columns if c != text_col]
    out = docs.select(*rest, bare.cast("long").alias("word_chars"), symbols.cast("long").alias("n_symbols"), _with(words, measured).alias("_w"), _with(lines, lined).alias("_l"))
    out = out.select(*rest, "_w.n_words", "word_chars", "n_symbols", "_l.n_lines", "_l.n_dup_lines", "_w.n_repeat_words")
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def vector() -> list[Column]:
    """The transformed statistics, in thousandths."""
    n, chars = F.col("n_words"), F.col("word_chars")
    share = lambda a, b: F.asin(F.sqrt(F.least(a / F.greatest(b, F.lit(1)), F.lit(1.0))))
    values = (
        F.log1p(n.cast("double")),
        F.log((chars + 1) / (n + 1)),
        share(F.col("n_symbols"), chars),
        share(F.col("n_dup_lines"), F.col("n_lines")),
        share(F.col("n_repeat_words"), n),
    )
    return [F.round(v * UNIT).cast("long").alias(x) for v, x in zip(values, NAMES, strict=True)]


def _sums() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(f"s_{x}") for x in NAMES], *[F.sum(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"p_{i}_{j}") for i, j in PAIRS]]


SUMS = ["n", *[f"s_{x}" for x in NAMES], *[f"p_{i}_{j}" for i, j in PAIRS]]


def _estimate(sums: DataFrame, factor: float) -> DataFrame:
    """Sums to location m_i, Cholesky factor l_i_j of the scatter, and log determinant."""
    n = F.col("n").cast("double")
    out = sums.withColumns({f"m_{i}": F.col(f"s_{x}") / n for i, x in enumerate(NAMES)})
    floor = lambda i, j: (FLOORS[i] * UNIT) ** 2 if i == j else 0.0
    out = out.withColumns({f"c_{i}_{j}": factor * (F.col(f"p_{i}_{j}") / n - F.col(f"m_{i}") * F.col(f"m_{j}")) + F.lit(floor(i, j)) for i, j in PAIRS})
    return _factor(out)


def _factor(df: DataFrame) -> DataFrame:
    """The Cholesky factor of c_i_j, and its log determinant."""
    rest = [c for c in df.columns if not c.startswith(("s_", "p_", "c_"))]
    for i in range(DIMS):
        for j in range(i + 1):
            left = F.col(f"c_{i}_{j}") - sum((F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)), F.lit(0.0))
            df = df.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(left, F.lit(1e-9))) if i == j else left / F.col(f"l_{j}_{j}"))
    det = sum((2 * F.log(f"l_{i}_{i}") for i in range(DIMS)), F.lit(0.0))
    return df.select(*rest, *[f"l_{i}_{j}" for i, j in PAIRS], det.alias("det"))


def _distance(df: DataFrame) -> DataFrame:
    """df with d2, the squared Mahalanobis distance of x0... to the estimate beside them."""
    rest = df.columns
    for i in range(DIMS):
        left = F.col(NAMES[i]) - F.col(f"m_{i}") - sum((F.col(f"l_{i}_{k}") * F.col(f"y_{k}") for k in range(i)), F.lit(0.0))
        df = df.withColumn(f"y_{i}", left / F.col(f"l_{i}_{i}"))
    return df.select(*rest, sum((F.col(f"y_{i}") * F.col(f"y_{i}") for i in range(DIMS)), F.lit(0.0)).alias("d2"))


def _medians(rows: DataFrame) -> DataFrame:
    """Medians and quartile ranges by group, from counts of hundredths, m_i and w_i."""
    width = UNIT // 100
    each = rows.select("g", F.posexplode(F.array(*[F.floor(F.col(x) / width) for x in NAMES])).alias("dim", "bin"))
    counts = each.groupBy("g", "dim", "bin").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("g", "dim")
    counts = counts.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("bin"))) * width
    found = counts.groupBy("g", "dim").agg(at(0.5).alias("mid"), ((at(0.75) - at(0.25)) / 1.349).alias("wide"))
    wide = found.groupBy("g").agg(*[F.max(F.when(F.col("dim") == i, F.col("mid"))).cast("double").alias(f"m_{i}") for i in range(DIMS)], *[F.max(F.when(F.col("dim") == i, F.col("wide"))).alias(f"w_{i}") for i in range(DIMS)])
    return wide


def _floored(i: int) -> Column:
    """Scale of statistic i: its quartile range as a deviation, with the floor."""
    return F.sqrt(F.col(f"w_{i}") * F.col(f"w_{i}") + F.lit((FLOORS[i] * UNIT) ** 2))


def _diagonal(mid: DataFrame) -> DataFrame:
    """Medians and quartile ranges as an estimate."""
    own = {f"c_{i}_{j}": _floored(i) * _floored(j) if i == j else F.lit(0.0) for i, j in PAIRS}
    return _factor(mid.withColumns(own).drop(*[f"w_{i}" for i in range(DIMS)]))


def _bounded_scores(rows: DataFrame, mid: DataFrame, start: int) -> DataFrame:
    """The estimate by correlations of bounded scores: hyperbolic tangents (start 2) or spatial signs (start 3)."""
    z = [(F.col(x) - F.col(f"m_{i}")) / _floored(i) for i, x in enumerate(NAMES)]
    if start == 2:
        y = [F.tanh(v) for v in z]
    else:
        length = F.sqrt(sum((v * v for v in z), F.lit(1e-12)))
        y = [v / length for v in z]
    scored = rows.join(mid, "g").select("g", *[F.round(v * UNIT).cast("long").alias(x) for v, x in zip(y, NAMES, strict=True)])
    sums = scored.groupBy("g").agg(*_sums())
    n = F.col("n").cast("double")
    second = lambda i, j: F.col(f"p_{i}_{j}") / n - F.col(f"s_x{i}") * F.col(f"s_x{j}") / (n * n) + F.lit(1.0 if i == j else 0.0)
    own = {f"c_{i}_{j}": second(i, j) / F.sqrt(second(i, i) * second(j, j)) * _floored(i) * _floored(j) for i, j in PAIRS}
    return _factor(sums.join(mid, "g").withColumns(own).drop("n", *[f"w_{i}" for i in range(DIMS)]))


MODEL = ["g", "start", *[f"m_{i}" for i in range(DIMS)], *[f"l_{i}_{j}" for i, j in PAIRS], "det"]


def estimates(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(g, m_i, l_i_j): the estimate of each group of rows (g, x0 ...)."""
    plain = _estimate(rows.groupBy("g").agg(*_sums()), 1.0).withColumn("start", F.lit(0))
    mid = scratch.save(_medians(rows))
    starts = [plain, _diagonal(mid).withColumn("start", F.lit(1)), *[_bounded_scores(rows, mid, k).withColumn("start", F.lit(k)) for k in (2, 3)]]
    model = scratch.save(reduce(DataFrame.unionByName, [s.select(*MODEL) for s in starts]))
    for _ in range(MOST_STEPS):
        near = _distance(rows.join(model, "g")).withColumn("bin", F.floor(F.log(F.col("d2") + 1e-6) * BINS))
        bins = near.groupBy("g", "start", "bin").agg(*_sums())
        w = Window.partitionBy("g", "start")
        bins = bins.withColumn("before", F.sum("n").over(w.orderBy("bin")) - F.col("n")).withColumn("all", F.sum("n").over(w))
        half = bins.where(F.col("before") < KEPT_SHARE * F.col("all")).groupBy("g", "start").agg(*[F.sum(c).alias(c) for c in SUMS])
        last, model = model, scratch.save(_estimate(half, consistency(KEPT_SHARE)).select(*MODEL))
        change = model.join(last.select("g", "start", F.col("det").alias("was")), ["g", "start"])
        if (change.agg(F.max(F.abs(F.col("det") - F.col("was"))).alias("m")).first()["m"] or 0.0) <= SETTLED:
            break
    best = model.groupBy("g").agg(F.min_by(F.struct(*MODEL[1:]), F.struct("det", "start")).alias("m")).select("g", "m.*")
    inner = _distance(rows.join(best, "g")).where(F.col("d2") <= quantile(REWEIGHT, DIMS)).groupBy("g").agg(*_sums())
    return scratch.save(_estimate(inner, consistency(REWEIGHT)).drop("det"))


OUT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept"]


def keep_normal(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """docs without the text, with the base counts, base_failed, distance (null where nothing was estimated) and kept; columns of these names give way."""
    scratch = Scratch(docs.sparkSession, "outliers")
    gone = {c.lower() for c in (text_col, *OUT)}
    given = [F.col(c) for c in docs.columns if c.lower() not in gone]
    base = docs.select(F.struct(F.lit(0).alias("_"), *given).alias("_own"), F.col(lang_col).alias("_lang"), F.col(source_col).alias("_source"), F.col(text_col).alias("_text"))
    base = scratch.save(base_counts(base, "_text").select("*", *vector()))
    sane = base.where(~F.col("base_failed"))
    sizes = sane.groupBy("_lang", "_source").agg(F.count(F.lit(1)).alias("n"))
    small = F.col("n") < LEAST
    of_lang = F.sum(F.when(small, F.col("n")).otherwise(0)).over(Window.partitionBy("_lang"))
    few = small & (F.col("few") < LEAST)
    key = F.when(~small, F.to_json(F.struct(F.lit(0).alias("k"), "_lang", "_source"))).when(~few, F.to_json(F.struct(F.lit(1).alias("k"), "_lang"))).otherwise(F.lit("all"))
    groups = scratch.save(sizes.withColumn("few", of_lang).select("_lang", "_source", key.alias("g"), "n"))
    rows = scratch.save(_same_group(sane, groups).select("g", *NAMES))
    enough = groups.groupBy("g").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST).select("g")
    model = estimates(rows.join(enough, "g", "left_semi"), scratch)
    scratch.keep(base, groups, model)
    judged = _distance(_same_group(base, groups.drop("n").join(model.drop("n"), "g")))
    judged = judged.withColumn("distance", F.sqrt("d2")).withColumn("kept", ~F.col("base_failed") & (F.col("d2").isNull() | (F.col("d2") <= quantile(1 - FAR, DIMS))))
    return judged.select("_own.*", *OUT).drop("_")


def _same_group(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows with the columns of their language and source; nulls are equal."""
    other = groups.withColumnsRenamed({"_lang": "_l2", "_source": "_s2"})
    return rows.join(other, F.col("_lang").eqNullSafe(F.col("_l2")) & F.col("_source").eqNullSafe(F.col("_s2")), "left").drop("_l2", "_s2")

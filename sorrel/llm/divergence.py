"""Source divergence audit: how far the words of each source are from its language and from other sources.

Terms are runs of letters and of characters beyond ASCII, A-Z lower-cased; a language keeps the V
terms that at least 3 of its documents hold. A group is a (language, source), and it and its
language give each kept term of n occurrences there the integer probability
p = 1 + floor(10^9 * (n + 1) / (N + V)), N being their occurrences of all kept terms. The score of
p against q is floor((p - q)^2 / q).

* `term`: each group's terms that are likelier there than in the language, best TOP only, found by
  upper bounds. The terms of a group with the same count share p, and the score falls as q grows,
  so the smallest q of such a bucket bounds it. Buckets are taken best-first until they hold TOP
  sure terms; their scores give a k-th value, and only buckets whose bound is strictly below it
  stay closed. All others are evaluated, so ties at the last rank are whole.
* `pair`: every two sources of a language, summed over all V terms. What a term adds where a source
  lacks it depends on the other source's count only, so count buckets give that sum; postings add
  the difference for the terms that both hold. Postings meet in tiles of BLOCK x BLOCK sources and
  some hundred thousand rows each, in numpy; no pair of postings becomes a row.

Cases: null texts, languages and sources are empty ones; a group without terms has its pairs; in a
language without kept terms every pair's value is 0; repeated rows count each; an empty table gives
an empty table; other columns are not read. Texts are read whole, in slices of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrays import LOWER, borders, ragged, slices, spread
from .common import SALTS, Scratch, with_totals

SCALE = 1_000_000_000
LEAST_DOCS = 3
TOP = 200
#: Sources of one side of a tile, and postings in a tile's piece of the terms.
BLOCK = 256
PIECE = 200_000
#: Pairs of postings in one numpy step.
STEP = 1 << 20

TERM_BYTES = np.zeros(256, bool)
TERM_BYTES[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
COUNTS = "lang string, source string, term string, n long, docs long"


def _codes(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = column.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, start of each run of equal keys in that order)."""
    order = np.argsort(keys, kind="stable")
    return order, np.flatnonzero(np.diff(keys[order], prepend=-1))


def count_slice(lang: pa.Array, source: pa.Array, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch | None:
    """Occurrences and documents of each (lang, source, term) of some texts."""
    data = LOWER[data]
    starts, ends, first = borders(data, offsets, TERM_BYTES)
    if not len(starts):
        return None
    bounds = np.concatenate([[0], np.cumsum(ends - starts)])
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data[TERM_BYTES[data]])])
    code, terms = _codes(words)
    in_doc = np.repeat(np.arange(len(lang)), np.diff(first)) * len(terms) + code
    order, runs = _runs(in_doc)
    doc, code = np.divmod(in_doc[order[runs]], len(terms))
    times = np.diff(np.append(runs, len(starts)))
    lang_of, langs = _codes(lang)
    source_of, sources = _codes(source)
    order, runs = _runs((lang_of[doc] * len(sources) + source_of[doc]) * len(terms) + code)
    at = order[runs]
    return pa.RecordBatch.from_arrays(
        [langs.take(pa.array(lang_of[doc[at]])), sources.take(pa.array(source_of[doc[at]])), terms.take(pa.array(code[at])).cast(pa.string()), pa.array(np.add.reduceat(times[order], runs)), pa.array(np.diff(np.append(runs, len(order))))],
        names=["lang", "source", "term", "n", "docs"],
    )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = ragged(batch.column(2))
        for a, b in slices(offsets):
            found = count_slice(batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            if found is not None:
                yield found


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of all terms."""
    each = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")]).mapInArrow(_count, COUNTS)
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(n: Column, size: Column) -> Column:
    """1 + floor(10^9 * (n + 1) / size), exactly; null for a size of 0."""
    size = F.nullif(size, F.lit(0).cast("long"))
    more = (n + 1).cast("decimal(20,0)") * F.lit(SCALE)
    return F.lit(1) + F.when(n < 9_000_000_000, F.call_function("div", (n + 1) * F.lit(SCALE), size)).otherwise(F.call_function("div", more, size.cast("decimal(20,0)")))


def score(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _scores(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


class Audit:
    """Term statistics of all documents, saved: `groups` (lang, source, no, size, terms, v, p0) and `postings` (lang, source, no, term, n, p, q, p0), kept terms that occur."""

    def __init__(self, docs: DataFrame, least_docs: int = LEAST_DOCS):
        self.scratch = scratch = Scratch(docs.sparkSession, "divergence")
        each = scratch.save(count_terms(docs))
        terms = scratch.save(each.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs"))
        langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_size"))
        met = scratch.save(each.drop("docs").join(terms, ["lang", "term"]))
        sizes = met.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("terms"))
        known = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
        zero = F.lit(0).cast("long")
        groups = known.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["size", "terms", "v", "lang_size"])
        number = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("no")
        self.groups = scratch.save(groups.select("*", number, probability(zero, F.col("size") + F.col("v")).alias("p0")))
        full = with_totals(met, self.groups, ["lang", "source"], "term")
        self.postings = scratch.save(full.select("lang", "source", "no", "term", "n", probability(F.col("n"), F.col("size") + F.col("v")).alias("p"), probability(F.col("total"), F.col("lang_size") + F.col("v")).alias("q"), "p0"))
        by_count = self.postings.groupBy("lang", "source", "no", "n", "p").agg(F.count(F.lit(1)).alias("terms"), F.min("q").alias("least_q"), F.max("q").alias("most_q"))
        self.buckets = scratch.save(by_count)
        scratch.keep(self.groups, self.postings, self.buckets)

    def evaluated(self, top: int = TOP) -> DataFrame:
        """(lang, source, item, value) of all terms in the buckets that the bounds open, p above q."""
        scratch, group = self.scratch, ["lang", "source"]
        bounded = self.buckets.where(F.col("p") > F.col("least_q")).withColumn("bound", score(F.col("p"), F.col("least_q")))
        sure = F.when(F.col("p") > F.col("most_q"), F.col("terms")).otherwise(0)
        before = F.sum(sure).over(Window.partitionBy(*group).orderBy(F.desc("bound"), "n").rowsBetween(Window.unboundedPreceding, -1))
        placed = scratch.save(bounded.select(*group, "n", "bound", F.coalesce(before, F.lit(0)).alias("before")))

        def terms_of(chosen: DataFrame) -> DataFrame:
            rows = with_totals(self.postings, chosen.select(*group, "n", F.lit(True).alias("open")), [*group, "n"], "term")
            return rows.where(F.col("p") > F.col("q")).select(*group, F.col("term").alias("item"), score(F.col("p"), F.col("q")).alias("value"))

        first = scratch.save(terms_of(placed.where(F.col("before") < top)))
        place = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("value")))
        kth = first.withColumn("place", place).where(F.col("place") == top).select(*group, F.col("value").alias("kth"))
        unseen = with_totals(placed.where(F.col("before") >= top), kth, group, "n", how="left")
        return first.unionByName(terms_of(unseen.where(F.col("kth").isNull() | (F.col("bound") >= F.col("kth")))))

    def top_terms(self, top: int = TOP) -> DataFrame:
        """(lang, source, item, value, rank)."""
        return _ranked(self.evaluated(top)).where(F.col("rank") <= top)

    def pairs(self, block: int = BLOCK, piece: int = PIECE) -> DataFrame:
        """(lang, source, item, value, rank) for every two sources of a language."""
        fix = self._both(block, piece)
        zs = self.groups.where("v > 0").groupBy("lang").agg(F.collect_set("p0").alias("zs"))
        by_p = self.buckets.groupBy("lang", "no", "p").agg(F.sum("terms").alias("terms"))
        with_z = with_totals(by_p, zs, ["lang"], "no").withColumn("z", F.explode("zs"))
        # what the terms of one source add against a source that lacks them, and the other way round
        one = self.scratch.save(with_z.groupBy("lang", "no", "z").agg(F.sum(F.col("terms") * score(F.col("p"), F.col("z"))).alias("mine"), F.sum(F.col("terms") * score(F.col("z"), F.col("p"))).alias("theirs")))
        side = lambda s, *more: [F.col(c).alias(f"{s}_{c}") for c in ("source", "no", "terms", "p0", *more)]
        g = self.groups.select("lang", "v", *side("g")).withColumn("salt", F.pmod("g_no", F.lit(SALTS)))
        h = self.groups.select("lang", *side("h")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        both = g.join(h, ["lang", "salt"]).where("g_no <> h_no").drop("salt")
        both = both.join(fix, ["lang", "g_no", "h_no"], "left")
        both = both.join(one.select("lang", F.col("no").alias("g_no"), F.col("z").alias("h_p0"), "mine"), ["lang", "g_no", "h_p0"], "left")
        both = both.join(one.select("lang", F.col("no").alias("h_no"), F.col("z").alias("g_p0"), "theirs"), ["lang", "h_no", "g_p0"], "left")
        neither = (F.col("v") - F.col("g_terms") - F.col("h_terms")) * score(F.col("g_p0"), F.col("h_p0"))
        zero = F.lit(0).cast("long")
        value = F.when(F.col("v") > 0, neither + F.coalesce("mine", zero) + F.coalesce("theirs", zero) + F.coalesce("fix", zero)).otherwise(zero)
        return _ranked(both.select("lang", F.col("g_source").alias("source"), F.col("h_source").alias("item"), value.alias("value")))

    def _both(self, block: int, piece: int) -> DataFrame:
        """(lang, g_no, h_no, fix): what the terms that both sources hold add to the sums by buckets."""
        pieces = max(1, -(-self.postings.count() // piece))
        blocks = self.groups.groupBy("lang").agg((F.floor(F.max("no") / block) + 1).cast("int").alias("blocks"))
        rows = with_totals(self.postings.select("lang", "no", "term", "p", "p0"), blocks, ["lang"], "term")
        own = F.floor(F.col("no") / block).cast("int")
        rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.select("lang", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), F.pmod(F.xxhash64("term"), F.lit(pieces)).alias("piece"), "no", "term", "p", "p0")
        found = rows.groupBy("lang", "low", "high", "piece").applyInArrow(_tile(block), "lang string, g_no int, h_no int, fix long")
        return self.scratch.save(found.groupBy("lang", "g_no", "h_no").agg(F.sum("fix").alias("fix")))


def _fix(p: np.ndarray, p0: np.ndarray, q: np.ndarray, q0: np.ndarray) -> np.ndarray:
    return _scores(p, q) - _scores(p, q0) - _scores(p0, q) + _scores(p0, q0)


def _tile(block: int):
    """Sums over the postings of two blocks of sources, for one piece of the terms."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        low, high = key[1].as_py(), key[2].as_py()
        term, terms = _codes(rows.column("term").combine_chunks())
        no, p, p0 = (rows.column(c).to_numpy() for c in ("no", "p", "p0"))
        order = np.argsort(term, kind="stable")
        a, b = order[no[order] // block == low], order[no[order] // block == high]
        there, back = np.zeros((2, block, block), np.int64)
        starts = np.searchsorted(term[b], np.arange(len(terms) + 1))
        times = np.diff(starts)[term[a]]
        ends = np.cumsum(times)
        at = 0
        while at < len(a):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP, "right")))
            x = np.repeat(a[at:to], times[at:to])
            y = b[spread(starts[term[a[at:to]]], times[at:to])]
            where = (no[x] - low * block, no[y] - high * block)
            np.add.at(there, where, _fix(p[x], p0[x], p[y], p0[y]))
            if low != high:
                np.add.at(back, where, _fix(p[y], p0[y], p[x], p0[x]))
            at = to
        g, h = np.nonzero(there)
        i, j = np.nonzero(back)
        return pa.table({
            "lang": pa.array([key[0].as_py()] * (len(g) + len(i)), pa.string()),
            "g_no": pa.array(np.concatenate([g + low * block, j + high * block]), pa.int32()),
            "h_no": pa.array(np.concatenate([h + high * block, i + low * block]), pa.int32()),
            "fix": np.concatenate([there[g, h], back[i, j]]),
        })

    return run


def _ranked(rows: DataFrame) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return rows.withColumn("rank", place)


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, block: int = BLOCK, piece: int = PIECE) -> DataFrame:
    """(lang, source, part, item, value, rank): both parts over all documents (lang, source, text)."""
    done = Audit(docs, least_docs)
    parts = [rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, rows in (("pair", done.pairs(block, piece)), ("term", done.top_terms(top)))]
    return parts[0].unionByName(parts[1])

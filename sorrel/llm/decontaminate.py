"""Benchmark decontamination by Wu-Manber search over words.

Texts and test items become sequences of 64-bit word hashes (A-Z lower-cased; a word is a
run of digits, letters a-z and non-ASCII characters). A pattern is a window of 13
consecutive item words; an item of fewer words is one pattern. For all patterns of one
length m, three tables are made:

* shift: a block of B = 3 words, hashed to a bucket, gives the least distance from any
  place of that block in a pattern to the pattern's end; a block in no pattern gives
  m - B + 1. A search skips that many words, since no occurrence can end before.
* suffix buckets: where the shift is 0, the block is the end of some patterns; these are
  the candidates, thinned by the hash of their first block.
* the patterns' words: a candidate counts if its m word hashes, then its bytes, are equal.

Many cursors, each in its own stretch of a batch, take their skips in the same numpy calls.

The tables hold benchmark text only. Its size is measured first; above `max_bytes` it is
split by item into several passes, each of which broadcasts one part, and the passes'
hits are merged by document.

Cases: a null or empty text has no words, no hits and is clean; null or wordless items
match nothing; repeated rows give repeated rows; equal windows of several items count for
each of them; an empty benchmark finds nothing; a null item_id counts in hits, not items.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .arrays import LOWER, borders, byte_class, mix, ragged, slices, span_hashes, spread
from .common import annotate, unused

WINDOW = 13
BLOCK = 3
#: Benchmark bytes whose tables are broadcast at once. Each 13-word window keeps its words' hashes (104 bytes), its text and its
#: owners, some 500 bytes for each 6 of text: about 80 times the text, in the driver and in each worker.
MAX_BYTES = 4 << 20
STRETCH = 512
#: Columns that find_items adds.
ADDED = ["n_words", "n_hit", "hit_ranges", "item_ids", "contaminated"]
FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _block(words: np.ndarray, last: np.ndarray, size: int) -> np.ndarray:
    """The hash of the block of words that ends at each place."""
    total = words[last] * FACTORS[0]
    for k in range(1, size):
        total = total + words[last - k] * FACTORS[k]
    return mix(total)


class Group:
    """The tables for all patterns of one length."""

    def __init__(self, words: np.ndarray, numbers: np.ndarray):
        """words: one row of word hashes for each pattern; numbers: the patterns' numbers."""
        self.m = words.shape[1]
        self.block = min(BLOCK, self.m)
        self.most = self.m - self.block + 1
        flat = words.ravel()
        row = np.arange(len(words)) * self.m
        self.bits = max(10, math.ceil(math.log2(8 * flat.size)))
        self.shift = np.full(1 << self.bits, self.most, np.uint8)
        for j in range(self.block - 1, self.m):
            np.minimum.at(self.shift, self._bucket(_block(flat, row + j, self.block)), self.m - 1 - j)
        suffix = _block(flat, row + self.m - 1, self.block)
        order = np.argsort(suffix, kind="stable")
        self.words, self.numbers = words[order], numbers[order]
        self.suffixes, self.first, self.count = np.unique(suffix[order], return_index=True, return_counts=True)
        self.prefix = _block(flat, row + self.block - 1, self.block)[order]

    def _bucket(self, blocks: np.ndarray) -> np.ndarray:
        return (blocks >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, words: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(last word, row in this group) of each place whose word hashes are a pattern's."""
        n = len(words)
        none = np.zeros(0, np.int64)
        if n < self.m:
            return none, none
        at = np.arange(self.m - 1, n, STRETCH)
        stop = np.minimum(at + STRETCH, n)
        found = []
        while len(at):
            blocks = _block(words, at, self.block)
            skip = self.shift[self._bucket(blocks)].astype(np.int64)
            hit = skip == 0
            if hit.any():
                found.append((at[hit], blocks[hit]))
            at = at + np.maximum(skip, 1)
            go = at < stop
            at, stop = at[go], stop[go]
        if not found:
            return none, none
        last = np.concatenate([x for x, _ in found])
        blocks = np.concatenate([x for _, x in found])
        place = np.minimum(np.searchsorted(self.suffixes, blocks), len(self.suffixes) - 1)
        ok = (self.suffixes[place] == blocks) & (text_of[last - self.m + 1] == text_of[last])
        last, place = last[ok], place[ok]
        # each place with each pattern of its bucket whose first block agrees
        rows = spread(self.first[place], self.count[place])
        last = np.repeat(last, self.count[place])
        ok = _block(words, last - self.m + self.block, self.block) == self.prefix[rows]
        last, rows = last[ok], rows[ok]
        for j in range(self.m):
            ok = words[last - self.m + 1 + j] == self.words[rows, j]
            last, rows = last[ok], rows[ok]
        return last, rows


class Patterns:
    """All patterns of some items."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        data, offsets = ragged(pa.array([t or "" for _, t in items], pa.large_string()))
        data = LOWER[data]
        starts, ends, first = borders(data, offsets, byte_class("alnum"))
        hashes = span_hashes(data, starts, ends)
        known: dict[bytes, int] = {}
        by_length: dict[int, list[tuple[int, int]]] = {}
        owners: list[set] = []
        texts: list[bytes] = []
        for i, (item, _) in enumerate(items):
            a, b = int(first[i]), int(first[i + 1])
            m = min(window, b - a)
            for s in range(a, b - m + 1) if m else ():
                text = b" ".join(data[starts[k] : ends[k]].tobytes() for k in range(s, s + m))
                if (p := known.get(text)) is None:
                    p = known[text] = len(owners)
                    owners.append(set())
                    texts.append(text)
                    by_length.setdefault(m, []).append((p, s))
                if item is not None:
                    owners[p].add(item)
        self.groups = [Group(np.stack([hashes[s : s + m] for _, s in some]), np.array([p for p, _ in some])) for m, some in by_length.items()]
        self.texts, self.owners = texts, [sorted(o) for o in owners]
        self.flags = byte_class("alnum")

    def search(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[list]]:
        """(n_words, n_hit, hit ranges of words, items) of each text."""
        data = LOWER[data]
        starts, ends, first = borders(data, offsets, self.flags)
        n = len(offsets) - 1
        words = span_hashes(data, starts, ends)
        text_of = np.repeat(np.arange(n), np.diff(first))
        edge = np.zeros(len(words) + 1, np.int64)
        items: list[set] = [set() for _ in range(n)]
        for group in self.groups:
            last, rows = group.find(words, text_of)
            numbers = group.numbers[rows]
            for e, p in zip(last.tolist(), numbers.tolist(), strict=True):
                s = e - group.m + 1
                if b" ".join([data[starts[k] : ends[k]].tobytes() for k in range(s, e + 1)]) == self.texts[p]:
                    edge[s] += 1
                    edge[e + 1] -= 1
                    items[text_of[e]].update(self.owners[p])
        hit = np.cumsum(edge[:-1]) > 0
        total = np.concatenate(([0], np.cumsum(hit)))
        n_hit = total[first[1:]] - total[first[:-1]]
        ranges = []
        for i in range(n):
            if not n_hit[i]:
                ranges.append(np.zeros((0, 2), np.int64))
                continue
            own = np.concatenate(([False], hit[first[i] : first[i + 1]], [False]))
            ranges.append(np.flatnonzero(own[1:] != own[:-1]).reshape(-1, 2))
        return np.diff(first), n_hit, ranges, [sorted(x) for x in items]


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    """At least a twentieth of the words lie in occurrences."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def find_items(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", max_bytes: int = MAX_BYTES) -> DataFrame:
    """docs with n_words, n_hit, hit_ranges (word numbers, end exclusive), item_ids and contaminated."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text).alias("text")).where(F.col("text").isNotNull())
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    passes = max(1, -(-total // max_bytes))
    item_type = items.schema["item"].dataType
    fields = [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("hit_ranges", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))),
        T.StructField("item_ids", T.ArrayType(item_type)),
    ]
    docs = docs.drop(*{"contaminated", *(f.name for f in fields)})
    at = docs.columns.index(text_col)
    arrow_item = to_arrow_type(item_type)

    def one_pass(k: int) -> DataFrame:
        part = items if passes == 1 else items.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == k)
        tables = spark.sparkContext.broadcast(Patterns([tuple(r) for r in part.collect()]))

        def make():
            patterns = tables.value

            def each(batch: pa.RecordBatch) -> dict[str, pa.Array]:
                data, offsets = ragged(batch.column(at))
                words, hits, ranges, found = [], [], [], []
                for a, b in slices(offsets):
                    w, h, r, i = patterns.search(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    words.append(w)
                    hits.append(h)
                    ranges += [[{"start": s, "stop": e} for s, e in x.tolist()] for x in r]
                    found += i
                return {"n_words": pa.array(np.concatenate(words)), "n_hit": pa.array(np.concatenate(hits)), "hit_ranges": pa.array(ranges, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), "item_ids": pa.array(found, pa.list_(arrow_item))}

            return each

        return annotate(docs, make, fields)

    if passes == 1:
        out = one_pass(0)
    else:
        out = _merged(docs, [one_pass(k) for k in range(passes)], passes)
    return out.withColumn("contaminated", is_contaminated(F.col("n_hit"), F.col("n_words")))


def _merged(docs: DataFrame, found: list[DataFrame], passes: int) -> DataFrame:
    """One row for each row of docs from the rows of all passes; equal rows of docs stay as many as they were."""
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    own, results = unused(docs, "_own"), ["n_words", "n_hit", "hit_ranges", "item_ids"]
    every = every.select(F.struct(*docs.columns).alias(own), *results)
    every = every.groupBy(own).agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit_ranges")))).alias("ranges"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
        (F.count(F.lit(1)) / passes).cast("int").alias("copies"),
    )
    joined = F.aggregate(
        "ranges",
        F.expr("cast(array() as array<struct<start: bigint, stop: bigint>>)"),
        lambda done, r: F.when((F.size(done) > 0) & (F.element_at(done, -1)["stop"] >= r["start"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["stop"], r["stop"]).alias("stop"))))).otherwise(F.concat(done, F.array(r))),
    )
    every = every.withColumn("hit_ranges", joined).withColumn("n_hit", F.aggregate("hit_ranges", F.lit(0).cast("long"), lambda n, r: n + r["stop"] - r["start"]))
    return every.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(f"{own}.*", *results)

"""SimHash near-duplicates by tiled exact comparison.

Fingerprints: texts are lower-cased (A-Z), split into words at white space, and every run
of 3 words (repeats included; all words if there are fewer) gives one XXH64; a bit of the
fingerprint is set where over half of the hashes have it. No words: fingerprint 0.

Links: two fingerprints link if they differ in at most 2 bits. Distinct fingerprints are
dealt into tiles by bands of population counts, at most TILE or so to a tile, and tile is
compared with tile by exclusive-or and bit counts in numpy. Two tiles whose population counts
differ by more than the radius cannot hold a link, and are skipped. Nor are two tiles compared where
their fingerprints agree in too few blocks: with the 64 bits in m blocks, two that link agree
in some m - 2 of them, so a tile is further divided by the bits of each choice of m - 2 blocks
(m grows with the number of fingerprints), and only parts of equal bits meet. Each pair of
tiles is a group of its own, whatever shares the bits, so no task gets a whole bucket. From a
pair of tiles come only the links of a spanning forest, never all pairs.

Components: each fingerprint takes the smallest label among its links, labels are
followed to their own labels, and this repeats until nothing changes.

Cases: null and empty texts have fingerprint 0 and so form one component; repeated rows and
equal texts share a fingerprint; texts may be of any length; a null doc_id is no label but
gets its component's; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import LOWER, borders, byte_class, ragged, roots, slices, spread
from .common import Scratch, annotate, place_of, text_hashes, unused

SEED = 42
SHINGLE = 3
RADIUS = 2
TILE = 2048
#: Rows of whole groups that a worker takes at once, or bytes of them, and pairs that it compares in one numpy call.
ROWS = 20_000
BYTES = 64 << 20
STRIP = 1 << 20


def shingles_of(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, runs): the hash of every run of words of each text, end to end, and how many each text has."""
    starts, ends, first = borders(data, offsets, byte_class("space"))
    n = len(offsets) - 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    # all words with one blank after each, end to end
    low = LOWER[data]
    lengths = ends - starts
    keep = np.zeros(len(low) + 1, np.int8)
    np.add.at(keep, starts, 1)
    np.add.at(keep, ends, -1)
    keep = np.cumsum(keep[:-1], dtype=np.int8) > 0
    begin = np.cumsum(lengths + 1) - lengths - 1
    stop = begin + lengths
    text = np.full(int(stop[-1]) + 1, 0x20, np.uint8)
    inside = np.ones(len(text), bool)
    inside[stop] = False
    text[inside] = low[keep]
    text = text.tobytes()
    count = np.diff(first)
    runs = np.where(count > shingle, count - shingle + 1, np.minimum(count, 1))
    where = np.repeat(first[:-1] - (np.cumsum(runs) - runs), runs) + np.arange(int(runs.sum()))
    size = np.repeat(np.minimum(count, shingle), runs)
    hashed = xxhash.xxh64_intdigest
    hashes = np.fromiter([hashed(text[a:b], SEED) for a, b in zip(begin[where].tolist(), stop[where + size - 1].tolist(), strict=True)], np.uint64, len(where))
    return hashes, runs


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each text."""
    return majority(*shingles_of(data, offsets, shingle))


def majority(hashes: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """The bits that over half of each run of hashes have."""
    out = np.zeros(len(runs), np.uint64)
    if not len(hashes):
        return out
    some = np.flatnonzero(runs)
    heads = (np.cumsum(runs) - runs)[some]
    votes = np.zeros((len(some), 64), np.int64)
    step = 1 << 16
    upto = np.append(heads, len(hashes))
    for a in range(0, len(hashes), step):  # bounded memory for long texts too
        part = hashes[a : a + step]
        lo = int(np.searchsorted(upto, a, "right")) - 1
        hi = int(np.searchsorted(upto, a + len(part), "left"))
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes[lo:hi] += np.add.reduceat(bits, np.maximum(heads[lo:hi] - a, 0), axis=0, dtype=np.int64)
    set_ = votes * 2 > runs[some][:, None]
    out[some] = np.packbits(set_, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprint(docs: DataFrame, text_col: str = "text", fp_col: str = "fp", shingle: int = SHINGLE, drop_text: bool = False) -> DataFrame:
    """docs with the fingerprint as a signed 64-bit integer."""
    at = place_of(docs, text_col, fp_col)

    def make():
        def each(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            data, offsets = ragged(batch.column(at))
            found = [fingerprints_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], shingle) for a, b in slices(offsets)]
            return {fp_col: pa.array(np.concatenate(found).view(np.int64))}

        return each

    return annotate(docs, make, [T.StructField(fp_col, T.LongType())], drop=(text_col,) if drop_text else ())


def _keys(fp: Column, n: int, radius: int) -> Column:
    """One (choice of blocks, bits of these blocks) for each bucket of a fingerprint."""
    m = radius + 1
    while m < radius + 4 and n > 64 << (64 * (m - radius) // m):
        m += 1
    edges = [64 * i // m for i in range(m + 1)]
    out = []
    for k, blocks in enumerate(combinations(range(m), m - radius)):
        mask = sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in blocks)
        out.append(F.struct(F.lit(k).alias("k"), fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("bits")))
    return F.array(*out)


def tile_pairs(rows: DataFrame, by: list[str], fp: str, radius: int, tile: int = TILE, share: Column | None = None, band: Column | None = None) -> DataFrame:
    """rows with `g`, a group for each pair of tiles that is to be compared, and `side`: 0 for a tile with itself, else 1 and 2.

    Within each `by`, a tile is of a band of population counts, radius + 1 wide, and bands are
    cut further where more than `tile` rows are in one (share: what each row takes of a tile, if
    not 1 / tile; band: whole numbers of which only neighbours are to meet, if not those bands). A tile meets itself, the others of its
    band, and those of the next: counts of farther bands differ by more than the radius. Rows
    that nothing can meet are gone."""
    band = F.floor(F.bit_count(fp) / (radius + 1)) if band is None else band
    banded = rows.withColumn("_band", band.cast("int"))
    share = F.lit(1 / tile) if share is None else share
    counts = banded.groupBy(*by, "_band").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.sum(share)).cast("int").alias("cut"))
    cuts = counts.groupBy(*by).agg(F.sum("n").alias("_n"), F.map_from_entries(F.collect_list(F.struct("_band", "cut"))).alias("_cut")).where("_n > 1")
    placed = banded.join(cuts, by)
    own = F.pmod(F.xxhash64(fp), F.element_at("_cut", F.col("_band"))).cast("int")

    def pairs(d: int) -> Column:
        """The pairs of this tile with those of the band that is d higher; none if there are no such."""
        n_q = F.coalesce(F.try_element_at("_cut", F.col("_band") + d), F.lit(0))
        tiles = F.when(n_q > 0, F.sequence(F.lit(0), n_q - 1)).otherwise(F.array().cast("array<int>"))

        def pair(j: Column) -> Column:
            here, there = (F.col("_band"), own), (F.col("_band") + d, j)
            same = F.lit(d == 0) & (own == j)
            first = F.lit(d > 0) | (F.lit(d == 0) & (own <= j))
            low = [F.when(first, x).otherwise(y) for x, y in zip(here, there, strict=True)]
            high = [F.when(first, y).otherwise(x) for x, y in zip(here, there, strict=True)]
            side = F.when(same, 0).when(first, 1).otherwise(2)
            return F.struct(low[0].alias("p"), low[1].alias("i"), high[0].alias("q"), high[1].alias("j"), side.alias("side"))

        return F.transform(tiles, pair)

    every = F.concat(*[pairs(d) for d in (-1, 0, 1)])
    group = F.xxhash64(*by, "_t.p", "_t.i", "_t.q", "_t.j")
    return placed.withColumn("_t", F.explode(every)).select(*rows.columns, group.alias("g"), F.col("_t.side").alias("side"))


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of rows that are sorted by their first one, in runs of whole groups."""
    held: list[list[np.ndarray]] = []
    size = weight = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        size += batch.num_rows
        weight += batch.nbytes
        if size >= ROWS or weight >= BYTES:
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            cut = int(np.searchsorted(columns[0], columns[0][-1]))
            if cut:
                yield [c[:cut] for c in columns]
            held = [[c[cut:] for c in columns]]
            weight = weight * (size - cut) // size
            size -= cut
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def strips(group: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows (a, b) that belong together, from rows sorted by group and side: each row of a tile against those after it in the same tile, or against the other tile."""
    n = len(group)
    end = np.searchsorted(group, group, "right")
    # where side 2 begins in each group
    other = np.searchsorted(group, group) + np.bincount(np.searchsorted(group, group), side < 2, n).astype(np.int64)[np.searchsorted(group, group)]
    low = np.where(side == 0, np.arange(n) + 1, np.where(side == 1, other, end))
    upto = np.concatenate(([0], np.cumsum(end - low)))
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(upto, upto[a] + STRIP, "right")) - 1)
        count = end[a:b] - low[a:b]
        left = np.repeat(np.arange(a, b), count)
        yield left, spread(low[a:b], count)
        a = b


def compare_tiles(group: np.ndarray, side: np.ndarray, fp: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows (a, b) of strips that are within the radius."""
    for left, right in strips(group, side):
        hit = np.flatnonzero(np.bitwise_count(fp[left] ^ fp[right]) <= radius)
        if len(hit):
            yield left[hit], right[hit]


def _forest(radius: int):
    """Rows (group, side, fp), sorted by group and side, to links of a spanning forest of each group."""

    def links(group: np.ndarray, side: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(fp)
        a_s, b_s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in compare_tiles(group, side, fp, radius):
            if len(a) > 4 * n:  # a dense strip is thinned at once
                root = roots(n, a, b)
                a = np.flatnonzero(root != np.arange(n))
                b = root[a]
            a_s.append(a)
            b_s.append(b)
        root = roots(n, np.concatenate(a_s), np.concatenate(b_s))
        own = np.flatnonzero(root != np.arange(n))
        return fp[own], fp[root[own]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, side, fp in whole_groups(batches):
            a, b = links(group, side, fp.view(np.uint64))
            yield _pairs([a], [b])

    return run


def _pairs(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], names=["a", "b"])


def links(fps: DataFrame, n: int, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b): links that connect what distinct fingerprints within the radius connect; n: about how many there are."""
    keyed = fps.select("fp", F.explode(_keys(F.col("fp"), n, radius)).alias("key")).select("fp", "key.k", "key.bits")
    tiles = tile_pairs(keyed, ["k", "bits"], "fp", radius, tile).select("g", "side", "fp")
    tiles = tiles.repartition("g").sortWithinPartitions("g", "side", "fp")
    return tiles.mapInArrow(_forest(radius), "a long, b long").distinct()


def components(edges: DataFrame, scratch: Scratch, *needed: DataFrame) -> DataFrame:
    """(node, root): the smallest node that links a-b reach; only nodes that have links. needed: tables of scratch that others still read."""
    both = scratch.save(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).union(edges.select("b", "a")).where("x <> y").distinct())
    labels = scratch.save(both.groupBy(F.col("x").alias("node")).agg(F.min(F.least("x", "y")).alias("root")))
    while True:
        seen = both.join(labels, both.y == labels.node).groupBy("x").agg(F.min("root").alias("near"))
        step = labels.join(seen, labels.node == seen.x).select("node", "root", F.least("root", "near").alias("low"))
        up = labels.select(F.col("node").alias("n2"), F.col("root").alias("r2"))
        step = step.join(up, step.low == up.n2, "left").select("node", F.col("root").alias("was"), F.least("low", F.coalesce("r2", "low")).alias("root"))
        step = scratch.save(step)
        scratch.keep(both, step, *needed)
        moved = step.where("was <> root").limit(1).count()
        labels = step.select("node", "root")
        if not moved:
            return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(id, fp, component): component is the smallest id of all documents that links reach."""
    scratch = scratch or Scratch(docs.sparkSession, "simhash")
    marked = scratch.save(fingerprint(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), drop_text=True))
    distinct = scratch.save(marked.groupBy("fp").agg(F.min("id").alias("least")))
    n = distinct.count()
    labels = components(links(distinct.select("fp"), n), scratch, marked, distinct)
    rooted = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    of_fp = rooted.join(least, "root").select("fp", "component")
    return marked.join(of_fp, "fp").select(F.col("id").alias(id_col), "fp", "component")


#: Dropped ids (8 bytes each) up to which they are broadcast.
BROADCAST_IDS = 1_000_000


def rows_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _h1, _h2, _text): the id and two hashes of the text, which tell rows apart, and the text."""
    text = F.col(text_col)
    h1, h2 = text_hashes(text)
    return docs.select(F.col(id_col).alias("_id"), h1.alias("_h1"), h2.alias("_h2"), text.alias("_text"))


ROW = ["_id", "_h1", "_h2"]


def keep_least(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with the rows that are `least` in found (_id, _h1, _h2, least: a struct of these three), once each.

    found is a saved table. Rows go by id and text, not by id, so that rows which repeat an id
    or have none are judged each by its own text. Of rows that repeat both, one stays."""
    names = [unused(docs, c) for c in ("_id", "_h1", "_h2")]
    is_least = F.struct(*ROW).eqNullSafe(F.col("least"))
    gone = found.where(~is_least).select(*ROW).distinct().toDF(*names)
    few = gone.count() <= BROADCAST_IDS

    def same(df: DataFrame, other: DataFrame) -> Column:
        h1, h2 = text_hashes(df[text_col])
        return df[id_col].eqNullSafe(other[names[0]]) & (h1 == other[names[1]]) & (h2 == other[names[2]])

    one = docs.join(F.broadcast(gone) if few else gone, same(docs, gone), "left_anti")
    repeats = found.where(is_least).groupBy(*ROW).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*ROW).toDF(*names)
    some = repeats.count()
    if not some:
        return one
    repeats = F.broadcast(repeats) if some <= BROADCAST_IDS else repeats
    again = one.join(repeats, same(one, repeats), "left_semi").dropDuplicates([id_col, text_col])
    return one.join(repeats, same(one, repeats), "left_anti").unionByName(again)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document, the least by id and hashes of its text, of each component."""
    scratch = Scratch(docs.sparkSession, "kept")
    rows = rows_of(docs, id_col, text_col).select(F.struct(*ROW).alias("row"), F.col("_text").alias("text"))
    found = near_duplicates(rows, "row", "text", scratch)
    found = scratch.save(found.select("row.*", F.col("component").alias("least")))
    scratch.keep(found)
    return keep_least(docs, found, id_col, text_col)

"""Baskets as postings (stock, basket_id): counts, itemsets and their supports."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .ranks import with_place

#: Baskets of one bitmap, as Spark's bitmap functions have it.
BUCKET = 32_768
#: Itemsets of a level up to which they are broadcast.
BROADCAST_SETS = 100_000


def postings(baskets: DataFrame, basket_col: str = "basket_id", items_col: str = "items") -> DataFrame:
    """Distinct (stock, basket_id) of baskets with an array of codes."""
    return baskets.select(F.explode(items_col).alias("stock"), F.col(basket_col).alias("basket_id")).distinct()


def posting_sets(index: DataFrame) -> DataFrame:
    """(stock, basket_ids): the inverted index, materialised."""
    return index.groupBy("stock").agg(F.array_sort(F.collect_set("basket_id")).alias("basket_ids"))


def numbered(index: DataFrame) -> DataFrame:
    """index with basket_id as numbers from 1 without gaps, in the order of the ids, so that bitmaps are dense whatever the ids are."""
    places = with_place(index.select("basket_id").distinct(), "basket_id", name="number")
    return index.join(places, "basket_id").select("stock", F.col("number").alias("basket_id"))


def posting_bitmaps(index: DataFrame) -> DataFrame:
    """(stock, bucket, bits): the inverted index as bitmaps of 32,768 whole-numbered baskets each. A hot stock has as many rows as there are buckets, each of 4 KB, whatever its count."""
    place = F.bitmap_bit_position("basket_id")
    return index.groupBy("stock", F.bitmap_bucket_number("basket_id").alias("bucket")).agg(F.bitmap_construct_agg(place).alias("bits"))


def bitmap_counts(bitmaps: DataFrame) -> DataFrame:
    """(stock, n)."""
    return bitmaps.groupBy("stock").agg(F.sum(F.bitmap_count("bits")).alias("n"))


def count_in_bitmaps(bitmaps: DataFrame, items: list[str]) -> DataFrame:
    """One row n, as count_itemset: bitmaps of a bucket are intersected, and buckets without one of the items add nothing."""
    wanted = sorted(set(items))
    met = bitmaps.where(F.col("stock").isin(wanted)) if wanted else bitmaps.limit(0)
    each = met.groupBy("bucket").agg(F.count(F.lit(1)).alias("k"), F.bitmap_and_agg("bits").alias("bits")).where(F.col("k") == len(wanted))
    return each.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).cast("long").alias("n"))


def bitmap_ids(bitmaps: DataFrame) -> DataFrame:
    """(stock, bucket, basket_ids): the ids of each bitmap in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.unpackbits(np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(batch.num_rows, -1), axis=1, bitorder="little")
            row, place = np.nonzero(bits)
            bucket = batch.column(1).to_numpy()[row]
            # bucket 1 begins at 1; bucket 0 and below count down from 0
            ids = np.where(bucket > 0, (bucket - 1) * BUCKET + place + 1, bucket * BUCKET - place)
            ids = ids[np.lexsort((ids, row))]
            offsets = np.concatenate([[0], np.cumsum(bits.sum(1, dtype=np.int64))])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int64()))], names=["stock", "bucket", "basket_ids"])

    kind = bitmaps.schema["stock"].dataType.simpleString()
    return bitmaps.select("stock", "bucket", "bits").mapInArrow(run, f"stock {kind}, bucket long, basket_ids array<long>")


def dedupe(items: str | Column) -> Column:
    """Codes once each, in order of first appearance."""
    return F.array_distinct(items)


def item_counts(index: DataFrame) -> DataFrame:
    return index.groupBy("stock").agg(F.count(F.lit(1)).alias("n"))


def count_itemset(index: DataFrame, items: list[str]) -> DataFrame:
    """One row n: baskets that hold all items; 0 for no items or an unknown one."""
    wanted = sorted(set(items))
    if not wanted:
        return index.sparkSession.range(1).select(F.lit(0).cast("long").alias("n"))
    full = index.where(F.col("stock").isin(wanted)).distinct().groupBy("basket_id").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") == len(wanted))
    return full.agg(F.count(F.lit(1)).alias("n"))


def least_count(min_support: float, n: int) -> int:
    """The smallest count c with c / n >= min_support in floating point."""
    c = max(1, int(min_support * n) - 1)
    while c / n < min_support:
        c += 1
    while c > 1 and (c - 1) / n >= min_support:
        c -= 1
    return c


def frequent_itemsets(baskets: DataFrame, min_support: float, items_col: str = "items") -> DataFrame:
    """(items, count, support): all itemsets with count / n >= min_support, items sorted.

    FP-growth rounds its threshold up after a multiplication that may be inexact; half a
    count less than the least count that qualifies keeps exactly those."""
    distinct = baskets.select(F.array_distinct(items_col).alias("items"))
    n = distinct.count()
    if not n:
        return distinct.sparkSession.createDataFrame([], "items array<string>, count bigint, support double")
    c = least_count(min_support, n)
    model = FPGrowth(itemsCol="items", minSupport=(c - 0.5) / n).fit(distinct)
    found = model.freqItemsets.select(F.array_sort("items").alias("items"), F.col("freq").alias("count"), (F.col("freq") / F.lit(n)).alias("support"))
    return found.where(F.col("support") >= min_support)


def small_itemsets(index: DataFrame, n: int, min_support: float, size: int = 3) -> DataFrame:
    """(items, count, support) of itemsets up to a size, one level from the one before it.

    See small_itemsets_of; the postings are gathered by basket once."""
    baskets = index.groupBy("basket_id").agg(F.collect_set("stock").alias("items")).select("items")
    return small_itemsets_of(Scratch(index.sparkSession, "baskets").save(baskets), n, min_support, size)


def small_itemsets_of(baskets: DataFrame, n: int, min_support: float, size: int = 3, items_col: str = "items") -> DataFrame:
    """(items, count, support) of itemsets up to a size in n baskets (a saved table, as each level reads it) with arrays of codes.

    A level's candidates are the sets of the level before it that are frequent, each with one later
    frequent item of the same basket, so they are made and counted where the basket is, and only counts
    are shuffled; a level's list is broadcast, if it is short."""
    scratch = Scratch(baskets.sparkSession, "itemsets")
    c = least_count(min_support, n) if n else 1
    codes = baskets.select(F.array_sort(F.array_distinct(items_col)).alias("own"))
    single = scratch.save(_counted(codes.select(F.explode(F.transform("own", lambda x: F.array(x))).alias("items")), c))
    levels, rows = [single], codes.select(F.posexplode("own").alias("at", "last"), "own").select(F.array("last").alias("items"), _later("own", "at").alias("rest"))
    frequent = _short(single.select(F.col("items")[0].alias("next")))
    for _ in range(1, size):
        alive = rows.where(F.size("rest") > 0).join(_short(levels[-1].select("items")), "items", "left_semi")
        grown = alive.select("items", "rest", F.posexplode("rest").alias("at", "next")).join(frequent, "next", "left_semi")
        rows = grown.select(F.concat("items", F.array("next")).alias("items"), _later("rest", "at").alias("rest"))
        levels.append(scratch.save(_counted(rows, c)))
    every = reduce(DataFrame.unionAll, levels)
    return every.select("items", "count", (F.col("count") / F.lit(n)).alias("support"))


def _short(sets: DataFrame) -> DataFrame:
    return F.broadcast(sets) if sets.count() <= BROADCAST_SETS else sets


def _counted(rows: DataFrame, least: int) -> DataFrame:
    return rows.groupBy("items").agg(F.count(F.lit(1)).alias("count")).where(F.col("count") >= least)


def _later(items: str, at: str) -> Column:
    """The items after a place that counts from 0."""
    return F.slice(items, F.col(at) + 2, F.size(items))

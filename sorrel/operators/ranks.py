"""Places of all rows in one order, counted by ranges in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch

#: Rows of one partition in Spark's row numbers.
SHIFT = 33


def with_place(rows: DataFrame, *order: Column | str, name: str = "place", first: int = 1) -> DataFrame:
    """rows with their place in the order, from `first`; equal rows get places next to each other.

    Rows are dealt out by ranges of the order and sorted inside them, once; each range is counted,
    and the counts of the ranges before it (one number a range on the driver) give where it begins.
    The numbered rows are saved, so that places do not change when a task runs again."""
    scratch = Scratch(rows.sparkSession, "places")
    taken = {c.lower() for c in rows.columns}
    number = "_number"
    while number in taken:
        number = f"_{number}"
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(number, F.monotonically_increasing_id())
    saved = scratch.save(dealt)
    counts = saved.groupBy(F.shiftright(number, SHIFT).cast("int").alias("range")).agg(F.count(F.lit(1)).alias("n")).collect()
    begins, total = [], first
    for r in sorted(counts, key=lambda r: r["range"]):
        begins.append((r["range"], total))
        total += r["n"]
    starts = rows.sparkSession.createDataFrame(begins, "range int, begins long")
    inside = F.col(number).bitwiseAND(F.lit((1 << SHIFT) - 1))
    placed = saved.join(F.broadcast(starts), F.shiftright(number, SHIFT).cast("int") == F.col("range"))
    return placed.select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("begins") + inside).alias(name))

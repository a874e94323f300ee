"""Shared plumbing of the text operators: Arrow batches, column annotation, and joins with totals."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import Scratch, checkpoint_dir, delete

__all__ = ["Scratch", "annotate", "arrow_rows", "checkpoint_dir", "delete", "keeping", "place_of", "table", "text_hashes", "unused", "with_totals"]

#: Rows that Spark puts in one Arrow batch for a Python worker; the workers cut batches further by bytes.
ARROW_ROWS = 500
#: Bytes of text that the array code handles at once.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data folder, by any path Spark can read."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def arrow_rows(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Keep Arrow batches small: texts can be long, and the default of 10,000 rows could be gigabytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def unused(df: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as it takes to be no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def keeping(docs: DataFrame, names: list[str], f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The columns of docs in f(docs), where f adds columns of these names: docs' own ones of these names are put aside and come back."""
    added = {n.lower() for n in names}
    aside = {c: unused(docs, f"_own_{k}") for k, c in enumerate(docs.columns) if c.lower() in added}
    out = f(docs.withColumnsRenamed(aside) if aside else docs)
    return out.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def text_hashes(text: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes that tell texts apart; null is no empty text."""
    return F.xxhash64(text), F.xxhash64(F.lit("second"), text)


def place_of(df: DataFrame, column: str, *added: str | None) -> int:
    """Where `column` is in the batches that annotate hands on, when columns of the names in `added` have given way."""
    gone = {n.lower() for n in added if n}
    return [c for c in df.columns if c.lower() not in gone].index(column)


def annotate(
    df: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], dict[str, pa.Array] | tuple[dict[str, pa.Array], np.ndarray | None]]],
    fields: list[T.StructField],
    drop: tuple[str, ...] = (),
) -> DataFrame:
    """Append columns computed per Arrow batch.

    make() runs once per task and returns the function that maps a batch to its new
    columns, in the order of `fields`, or to those and a mask of rows to keep. Columns
    of df with the new names give way; columns in `drop` are left out.
    """
    named = {f.name.lower() for f in fields}
    clash = [c for c in df.columns if c.lower() in named]
    df = df.drop(*clash) if clash else df
    kept = [f for f in df.schema.fields if f.name not in drop]
    keep_at = [i for i, f in enumerate(df.schema.fields) if f.name not in drop]
    names = [f.name for f in kept] + [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            if not batch.num_rows:
                continue
            got = each(batch)
            new, mask = got if isinstance(got, tuple) else (got, None)
            out = pa.RecordBatch.from_arrays([batch.column(i) for i in keep_at] + [new[f.name] for f in fields], names=names)
            yield out if mask is None else out.filter(pa.array(mask))

    return df.mapInArrow(run, T.StructType(kept + fields))


#: Keys whose totals are broadcast; more are joined by a shuffle, with salts.
BROADCAST_KEYS = 100_000
SALTS = 32


def with_totals(rows: DataFrame, totals: DataFrame, keys: list[str], by: str, limit: int = BROADCAST_KEYS, how: str = "inner") -> DataFrame:
    """rows with the other columns of totals, which has one row for each value of keys; nulls equal each other.

    Up to `limit` totals, as counted, are broadcast. More are repeated for each of SALTS salts, and
    rows take theirs from a hash of `by`, so that a key with a third of all rows is many keys."""
    totals = Scratch(rows.sparkSession, "totals").save(totals)
    salt, aside = unused(rows, "_salt"), [unused(rows, f"_key{k}") for k in range(len(keys))]
    totals = totals.withColumnsRenamed(dict(zip(keys, aside)))
    if totals.count() <= limit:
        totals, equal = F.broadcast(totals), []
    else:
        rows = rows.withColumn(salt, F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
        totals = totals.withColumn(f"{salt}2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        equal = [F.col(salt) == F.col(f"{salt}2")]
    met = [F.col(k).eqNullSafe(F.col(a)) for k, a in zip(keys, aside)] + equal
    return rows.join(totals, met, how).drop(*aside, salt, f"{salt}2")

"""Tables in the shared folder that cut the lineage of iterative operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one only where none is set (tests, local mode)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = getattr(checkpoint_dir, "own", None)
    if own is None:
        own = checkpoint_dir.own = tempfile.mkdtemp(prefix="scratch-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return f"file://{own}"


def use_checkpoints(spark: SparkSession) -> None:
    """Let checkpoints go to the shared folder, unless the caller has named another."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder by Spark's file systems, if the driver still runs."""
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Seconds that pass at least between two collections after saved tables.
COLLECT_S = 2


def collect(spark: SparkSession) -> None:
    """Let the driver's collector run: the cleaner then deletes shuffles it finds dead, and the heap, which jobs fill with garbage up to its limit before the JVM would shrink it, goes back to some times what lives."""
    spark._jvm.System.gc()
    collect.last = time.monotonic()


collect.last = 0.0


class Scratch:
    """Tables written to the shared folder to cut lineage; those that nothing reads any more are deleted, the rest when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.made: list[tuple[DataFrame | None, str]] = []
        self.n = 0
        atexit.register(self._end)

    def save(self, df: DataFrame) -> DataFrame:
        """Write the rows and give them back as a table without their lineage."""
        path = f"{self.base}/{self.n}"
        self.n += 1
        df.write.option("compression", "zstd").parquet(path)
        # plans and shuffles of the table are dead now
        if time.monotonic() - collect.last >= COLLECT_S:
            collect(self.spark)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.made.append((out, path))
        return out

    def folder(self, name: str) -> str:
        """A path for files of any kind, deleted when the driver ends."""
        path = f"{self.base}/{name}"
        self.made.append((None, path))
        return path

    def keep(self, *tables: DataFrame) -> None:
        """Delete all tables but these, and let Spark delete the shuffle files of jobs that nothing refers to any more."""
        for out, path in self.made:
            if not any(out is t for t in tables):
                delete(self.spark, path)
        self.made = [(out, path) for out, path in self.made if any(out is t for t in tables)]
        collect(self.spark)

    def _end(self) -> None:
        if self.made:
            delete(self.spark, self.base)

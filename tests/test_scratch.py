"""Scratch tables and the driver's memory."""

import gc

from sorrel import scratch


def test_a_saved_table_lets_the_driver_collect_its_garbage(spark, monkeypatch):
    """What jobs leave on the driver's heap is gone after the next saved table, without `keep`."""
    monkeypatch.setattr(scratch.collect, "last", 0.0)
    jvm = spark._jvm
    dead = jvm.java.lang.ref.WeakReference(jvm.java.util.ArrayList())
    gc.collect()
    rows = scratch.Scratch(spark, "t").save(spark.range(10))
    assert rows.count() == 10 and dead.get() is None


def test_collections_keep_a_distance(spark, monkeypatch):
    ran = []
    monkeypatch.setattr(scratch, "collect", lambda s: ran.append(1) or setattr(scratch.collect, "last", scratch.time.monotonic()))
    scratch.collect.last = 0.0
    monkeypatch.setattr(scratch, "COLLECT_S", 1000)
    made = scratch.Scratch(spark, "t")
    for _ in range(3):
        made.save(spark.range(3))
    assert len(ran) == 1

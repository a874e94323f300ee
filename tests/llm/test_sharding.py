"""Even counts, gapless slots and few cut groups."""

import zlib
from collections import Counter, defaultdict

import pytest
from helpers import awkward, clashing
from pyspark.sql import functions as F

from sorrel.llm import sharding


def check(rows, n, shards):
    assert len(rows) == n
    counts = Counter(r["shard"] for r in rows)
    assert all(0 <= s < shards for s in counts)
    sizes = [counts.get(s, 0) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


@pytest.mark.parametrize(("n", "shards"), [(600, 40), (601, 7), (5, 40)])
def test_law_and_groups(spark, n, shards):
    text = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("pair "), F.floor(F.col("id") / 6).cast("string"))).otherwise(F.concat(F.lit("own "), F.col("id").cast("string")))
    docs = spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text"))
    rows = sharding.assign(docs, shards).collect()
    check(rows, n, shards)
    if n > 500:
        by = defaultdict(set)
        for r in rows:
            by[r["text_crc32"]].add(r["shard"])
        size = Counter(r["text_crc32"] for r in rows)
        cut = sum(len(by[k]) > 1 for k in size if size[k] == 2)
        assert cut <= 0.2 * sum(v == 2 for v in size.values())
        hot = zlib.crc32(b"hot")
        assert len(by[hot]) <= -(-size[hot] * shards // n) + 3  # whole shards, hardly more


def test_cut_links(spark):
    """The reported cuts are those of all pairs, and far fewer than hashing ids cuts."""
    size = F.pmod(F.xxhash64(F.floor(F.col("id") / 5)), F.lit(5)) + 1
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.floor(F.col("id") / 5), F.floor(F.col("id") % 5 / size)).alias("text"))
    rows = [r.asDict() for r in sharding.assign(docs, 9).collect()]
    hashed = {r["id"]: r["s"] for r in spark.range(900).select("id", F.pmod(F.xxhash64("id"), F.lit(9)).alias("s")).collect()}
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    links, cut, baseline = Counter(), Counter(), 0
    for a in rows:
        for b in rows:
            if a["doc_id"] != b["doc_id"] and text[a["doc_id"]] == text[b["doc_id"]]:
                links[a["doc_id"]] += 1
                cut[a["doc_id"]] += a["shard"] != b["shard"]
                baseline += hashed[a["doc_id"]] != hashed[b["doc_id"]]
    assert all((r["n_links"], r["n_cut"]) == (links[r["doc_id"]], cut[r["doc_id"]]) for r in rows)
    assert sum(links.values()) > 500
    assert sum(cut.values()) <= 0.2 * baseline


def test_awkward_rows(spark):
    docs = clashing(awkward(spark), "shard", "slot", "size", "key", "grp")
    rows = sharding.assign(docs, 3).collect()
    check(rows, docs.count(), 3)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert all(r["size"] == len(texts[r["doc_id"]].encode()) + 16 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in rows)
    assert sharding.assign(docs.limit(0), 3).count() == 0


def test_same_again(spark):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), (F.col("id") % 20).cast("string").alias("text"))
    first = sorted(tuple(r) for r in sharding.assign(docs, 8).collect())
    assert first == sorted(tuple(r) for r in sharding.assign(docs.repartition(7), 8).collect())

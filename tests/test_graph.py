"""PageRank and friends on the karate club graph."""

import pytest

from pyspark.sql import functions as F

from sorrel.operators import graph

# The edges of Zachary's karate club.
KARATE = [
    (1, 2), (1, 3), (1, 4), (1, 5), (1, 6), (1, 7), (1, 8), (1, 9), (1, 11), (1, 12), (1, 13), (1, 14), (1, 18),
    (1, 20), (1, 22), (1, 32), (2, 3), (2, 4), (2, 8), (2, 14), (2, 18), (2, 20), (2, 22), (2, 31), (3, 4), (3, 8),
    (3, 9), (3, 10), (3, 14), (3, 28), (3, 29), (3, 33), (4, 8), (4, 13), (4, 14), (5, 7), (5, 11), (6, 7), (6, 11),
    (6, 17), (7, 17), (9, 31), (9, 33), (9, 34), (10, 34), (14, 34), (15, 33), (15, 34), (16, 33), (16, 34), (19, 33), (19, 34),
    (20, 34), (21, 33), (21, 34), (23, 33), (23, 34), (24, 26), (24, 28), (24, 30), (24, 33), (24, 34), (25, 26), (25, 28), (25, 32),
    (26, 32), (27, 30), (27, 34), (28, 34), (29, 32), (29, 34), (30, 33), (30, 34), (31, 33), (31, 34), (32, 33), (32, 34), (33, 34),
]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(KARATE, "src int, dst int").cache()


@pytest.fixture(scope="module")
def ranks(edges):
    return graph.pagerank(edges).cache()


def test_pagerank(ranks):
    got = {r["id"]: r["score"] for r in ranks.collect()}
    assert len(got) == 34 and sum(got.values()) == pytest.approx(1)
    for node, score in {34: 0.100919, 1: 0.096997, 33: 0.071693, 3: 0.057079, 2: 0.052877, 24: 0.031523}.items():
        assert got[node] == pytest.approx(score, abs=1e-6)


@pytest.mark.parametrize(("node", "want"), [(1, [34, 33, 24]), (34, [1, 3, 2]), (12, [34, 33, 3])])
def test_friends(edges, ranks, node, want):
    assert [r["id"] for r in graph.friends(edges, ranks, node).collect()] == want


def test_adjacency_and_new_edges(edges):
    degree = {r["id"]: r["degree"] for r in graph.adjacency(edges).collect()}
    assert degree[1] == 16 and degree[34] == 17 and degree[12] == 1
    assert graph.add_edge(edges, 1, 34).count() == 79
    assert graph.add_edge(edges, 1, 2).count() == 78 == graph.add_edge(edges, 2, 1).count()


def test_friend_lists(edges, ranks):
    row = graph.friend_lists(edges, ranks).where("id = 12").first()
    assert row["friends"] == [1]


def test_hubs_lie_on_sub_vertices(spark):
    """A star: the hub's edges are dealt over all partitions, and ranks are those without a split."""
    n = 20_000
    star = spark.range(1, n).select(F.lit(0).alias("src"), F.col("id").cast("int").alias("dst")).union(spark.createDataFrame([(1, 2), (2, 3)], "src int, dst int"))
    links = graph._Links(star, 100).links
    sizes = sorted(r["count"] for r in links.groupBy(F.spark_partition_id().alias("p")).count().collect())
    assert len(sizes) > 1 and sizes[-1] < 2 * sizes[0]
    plain = {r["id"]: r["score"] for r in graph.pagerank(star, 4, hub=10**9).collect()}
    split = {r["id"]: r["score"] for r in graph.pagerank(star, 4, hub=100).collect()}
    assert plain.keys() == split.keys() and all(plain[i] == pytest.approx(split[i], abs=1e-12) for i in plain)
    chunks = graph.adjacency_chunks(star, 100).where("id = 0").collect()
    assert len(chunks) == 200 and sorted(i for r in chunks for i in r["neighbours"]) == list(range(1, n)) and {r["degree"] for r in chunks} == {n - 1}


def test_residuals_of_a_new_edge(edges):
    """Pushing from the old ranks gives what a full run gives; a new node starts at 0."""
    old = graph.pagerank(edges, 36, damping=0.5).cache()
    for ends in ((12, 27), (5, 99)):
        more = graph.add_edge(edges, *ends)
        full = {r["id"]: r["score"] for r in graph.pagerank(more, 36, damping=0.5).collect()}
        got = {r["id"]: r["score"] for r in graph.pagerank_update(more, old, damping=0.5, tolerance=1e-10).collect()}
        assert got.keys() == full.keys() and all(got[i] == pytest.approx(full[i], abs=1e-9) for i in full)


def test_a_step_sends_one_value_for_each_block_and_node(spark):
    """A crowd around a few hubs: what a step sends is far less than a value an edge, ranks are those of a plain loop, and names do as ids."""
    pairs = {(u, f"hub{h}") for u in (f"u{k:05d}" for k in range(3000)) for h in range(10)} | {("u00001", "u00002"), ("hub0", "hub1")}
    crowd = spark.createDataFrame(sorted(pairs) + [("u00005", None)], "src string, dst string")
    near = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    want = dict.fromkeys(near, 1 / len(near))
    for _ in range(3):
        sent = dict.fromkeys(near, 0.15 / len(near))
        for a, others in near.items():
            for b in others:
                sent[b] += 0.85 * want[a] / len(others)
        want = sent
    for hub in (100, 10**9):
        links = graph._Links(crowd, hub)
        assert links.blocks > 1
        messages = links.advance(links.first(value=1.0), lambda got, kept: (kept[0], kept, 0))
        assert messages.where("source >= 0").selectExpr("sum(length(values)) / 8").first()[0] < (len(near) + 100) * links.blocks < 2 * len(pairs)
        got = {r["id"]: r["score"] for r in graph.pagerank(crowd, 3, hub=hub).collect()}
        assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-12) for i in got)

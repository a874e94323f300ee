"""PageRank over undirected edges by blocks of nodes, and friend recommendations from it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..scratch import Scratch, use_checkpoints
from .ranks import with_place

#: A node is a hub with more edges than this and than all edges divided by MOST_HUBS.
HUB = 10_000
MOST_HUBS = 50_000
#: Edges for which a block of nodes is chosen, and of a block while there are few blocks.
BLOCK = 1_000_000
SMALL_BLOCK, FEW_BLOCKS = 20_000, 12

PACKED = "block int, source int, ids array<{kind}>, hubs binary, degrees binary, owners binary, sources binary, slots binary, counts binary, pulled binary, pulls binary"
WIRED = "block int, ids array<{kind}>, degrees binary, owners binary, sources binary, slots binary, counts binary, pulled binary, pulls binary, senders binary, places binary, ends binary, hubs binary, hub_ends binary"
MESSAGES = "block int, source int, values binary, open long"

#: From what a block's nodes were sent and what they kept to what they send, what they keep, and how many of them are still open.
Step = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, int]]


def undirected(edges: DataFrame) -> DataFrame:
    """(src, dst) in both directions, once each."""
    return edges.select("src", "dst").union(edges.select("dst", "src")).distinct()


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def in_order(ids: DataFrame) -> DataFrame:
    """(id, place): distinct ids with their place from 1. Sorted by ranges, so no task holds all of them."""
    return with_place(ids.select("id"), "id")


def adjacency(edges: DataFrame) -> DataFrame:
    """(id, neighbours, degree)."""
    return undirected(edges).groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list("dst")).alias("neighbours"), F.count(F.lit(1)).alias("degree"))


def add_edge(edges: DataFrame, src: int, dst: int) -> DataFrame:
    """edges with one more, unless it is there in either direction."""
    one = edges.sparkSession.createDataFrame([(src, dst)], "src int, dst int").select(*[F.col(c).cast(edges.schema[c].dataType) for c in ("src", "dst")])
    known = undirected(edges)
    return edges.select("src", "dst").union(one.join(known, ["src", "dst"], "left_anti"))


def adjacency_chunks(edges: DataFrame, size: int = HUB) -> DataFrame:
    """(id, chunk, neighbours, degree): like adjacency, with the neighbours of a hub in several rows of about `size`, in no order between chunks."""
    both, degree, hubs = _degrees(edges, size)
    placed = both.join(F.broadcast(hubs), "src", "left").select("src", "dst", _piece(F.col("dst")).alias("chunk"))
    each = placed.groupBy(F.col("src").alias("id"), "chunk").agg(F.array_sort(F.collect_list("dst")).alias("neighbours"))
    return each.join(degree.withColumnRenamed("src", "id"), "id").select("id", "chunk", "neighbours", "degree")


def _degrees(edges: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Saved: edges both ways, (src, degree), and the hubs (src, pieces), of more than `least` edges and a MOST_HUBS-th of all, so that there are at most MOST_HUBS."""
    scratch = Scratch(edges.sparkSession, "graph")
    both = scratch.save(undirected(edges))
    degree = scratch.save(both.groupBy("src").agg(F.count(F.lit(1)).alias("degree")))
    share = max(least, -(-both.count() // MOST_HUBS))
    hubs = scratch.save(degree.where(F.col("degree") > share).select("src", F.ceil(F.col("degree") / share).cast("int").alias("pieces")))
    return both, degree, hubs


def _piece(dst: Column) -> Column:
    """The sub-vertex of a hub that has this edge; 0 for other nodes."""
    return F.coalesce(F.pmod(F.xxhash64(dst), F.col("pieces")), F.lit(0)).cast("int")


class _Links:
    """Edges in blocks of nodes, each a row of arrays, and steps that send a value along all of them.

    A node lies in one block with its edges; per step a block adds up what it sends to a node
    elsewhere, and only these sums travel, in an order that both ends know. Edges out of a hub lie
    with its neighbours: the hub sends its value once to each block, so no block holds a hub's edges."""

    def __init__(self, edges: DataFrame, least: int):
        spark = edges.sparkSession
        use_checkpoints(spark)
        both, degree, hubs = _degrees(edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull()), least)
        self.scratch, self.kind = Scratch(spark, "links"), degree.schema["src"].dataType
        self.n, n_edges = degree.count(), both.count()
        self.blocks = max(1, min(FEW_BLOCKS, -(-n_edges // SMALL_BLOCK)), -(-n_edges // BLOCK))
        # at most MOST_HUBS rows
        hubs = self.scratch.save(hubs.select("src", (F.row_number().over(Window.orderBy("src")) - 1).alias("hub")))
        self.n_hubs = hubs.count()
        marked = both.join(F.broadcast(hubs), "src", "left")
        none = F.lit(None)
        linked = marked.select(
            F.when(F.col("hub").isNull(), F.col("src")).otherwise(F.col("dst")).alias("keeper"),
            F.when(F.col("hub").isNull(), F.col("dst")).alias("to"),
            F.when(F.col("hub").isNull(), self.block_of(F.col("dst"))).alias("to_block"),
            "hub",
            none.cast("long").alias("degree"),
        )
        own = degree.join(F.broadcast(hubs), "src", "left").select(F.col("src").alias("keeper"), none.cast(self.kind).alias("to"), none.cast("int").alias("to_block"), "hub", "degree")
        # hash() is what rows are dealt out by: a block is a partition
        self.links = linked.unionByName(own).repartition(self.blocks, "keeper").select(self.block_of(F.col("keeper")).alias("block"), "*")
        kind = self.kind.simpleString()
        packed = self.scratch.save(self.links.mapInArrow(_pack(self.blocks), PACKED.format(kind=kind)))
        wired = packed.repartition(self.parts, "block").groupBy("block").applyInArrow(_wire, WIRED.format(kind=kind))
        self.wired = self.scratch.save(wired)
        # dealt out once; it stays where it is through all steps
        self.dealt = self.wired.drop("ids").repartition(self.parts, "block").checkpoint()

    @property
    def parts(self) -> int:
        """Several for each block, as few blocks may share a partition."""
        return 2 * self.blocks

    def block_of(self, ids: Column) -> Column:
        return F.pmod(F.hash(ids.cast(self.kind)), F.lit(self.blocks))

    def first(self, values: DataFrame | None = None, value: float = 0.0) -> DataFrame:
        """Messages in which every node keeps a value and sends it: its own of (id, value), 0 without one, or the same for all."""
        if values is None:
            held = self.wired.select("block", F.lit(-1).alias("source"), F.array_repeat(F.lit(value), F.size("ids")).alias("held"))
            return held.mapInArrow(_as_messages, MESSAGES)
        given = values.where(F.col("id").isNotNull()).select(self.block_of(F.col("id")).alias("block"), F.col("id").cast(self.kind).alias("id"), F.col("value").cast("double").alias("value"))

        def run(key: tuple[pa.Scalar, ...], names: pa.Table, given: pa.Table) -> pa.Table:
            if not names.num_rows:
                return pa.Table.from_pylist([], schema=_MESSAGES)
            ids = names.column("ids")[0].values.to_numpy(zero_copy_only=False)
            out = np.zeros(len(ids))
            who = given.column("id").to_numpy()
            at = np.minimum(np.searchsorted(ids, who), len(ids) - 1)
            out[at[ids[at] == who]] = given.column("value").to_numpy()[ids[at] == who]
            return pa.table({"block": [key[0].as_py()], "source": [-1], "values": [out.tobytes()], "open": [len(ids)]}, schema=_MESSAGES)

        return self.wired.select("block", "ids").groupBy("block").cogroup(given.groupBy("block")).applyInArrow(run, MESSAGES)

    def advance(self, messages: DataFrame, step: Step) -> DataFrame:
        """Messages after one step."""
        return self.dealt.groupBy("block").cogroup(messages.repartition(self.parts, "block").groupBy("block")).applyInArrow(_advance(step, self.n_hubs), MESSAGES)

    def kept(self, messages: DataFrame) -> DataFrame:
        """(id, value): the first of the values that nodes keep."""
        kind = to_arrow_type(self.kind)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    ids = batch.column(0)[k].values
                    yield pa.RecordBatch.from_arrays([ids.cast(kind), pa.array(np.frombuffer(batch.column(1)[k].as_py())[: len(ids)])], names=["id", "value"])

        own = messages.where(F.col("source") == -1).select("block", "values")
        return self.wired.select("block", "ids").join(own, "block").select("ids", "values").mapInArrow(run, f"id {self.kind.simpleString()}, value double")


_MESSAGES = pa.schema([("block", pa.int32()), ("source", pa.int32()), ("values", pa.binary()), ("open", pa.int64())])


def _as_messages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held = [row.values.to_numpy() for row in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([h.tobytes() for h in held], pa.binary()), pa.array([len(h) for h in held], pa.int64())], schema=_MESSAGES)


def _pack(blocks: int):
    """A partition of links to its block's row, and a row for each other block with what will be sent there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows)
        block = table.column("block")[0].as_py()
        node = table.filter(pc.is_valid(table.column("degree")))
        ids = node.column("keeper").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, degrees = ids[order], node.column("degree").to_numpy()[order]
        hubs = pc.fill_null(node.column("hub"), -1).to_numpy().astype(np.int32)[order]
        owners = np.flatnonzero(hubs >= 0).astype(np.int32)
        push = table.filter(pc.is_valid(table.column("to")))
        pull = table.filter(pc.and_(pc.is_valid(table.column("hub")), pc.is_null(table.column("degree"))))
        to, first, slot = np.unique(push.column("to").to_numpy(), return_index=True, return_inverse=True)
        target = push.column("to_block").to_numpy()[first]
        by_block = np.argsort(target, kind="stable")
        place = np.empty(len(to), np.int32)
        place[by_block] = np.arange(len(to))
        to, counts = to[by_block], np.bincount(target, minlength=blocks).astype(np.int32)
        own = {
            "block": block, "source": -1, "ids": ids, "hubs": b"", "degrees": degrees.astype(np.float64).tobytes(), "owners": owners.tobytes(),
            "sources": np.searchsorted(ids, push.column("keeper").to_numpy()).astype(np.int32).tobytes(), "slots": place[slot].tobytes(), "counts": counts.tobytes(),
            "pulled": np.searchsorted(ids, pull.column("keeper").to_numpy()).astype(np.int32).tobytes(), "pulls": pull.column("hub").to_numpy().astype(np.int32).tobytes(),
        }
        ends = np.concatenate([[0], np.cumsum(counts)])
        sent = [{"block": c, "source": block, "ids": to[ends[c] : ends[c + 1]], "hubs": hubs[owners].tobytes()} for c in range(blocks) if counts[c] or len(owners)]
        kind = table.schema.field("keeper").type
        names = [c.split()[0] for c in PACKED.split(", ")]
        kinds = dict.fromkeys(names, pa.binary()) | {"block": pa.int32(), "source": pa.int32(), "ids": pa.list_(kind)}
        for row in (own, *sent):
            yield pa.RecordBatch.from_arrays([pa.array([row.get(c)], kinds[c]) for c in names], names=names)

    return run


def _wire(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """A block's row, with the places of its nodes in what each other block will send."""
    sources = rows.column("source").to_numpy()
    at = np.flatnonzero(sources == -1)
    if not len(at):
        at = np.array([], np.int64)
    own = rows.take(pa.array(at))
    names = ["block", "ids", "degrees", "owners", "sources", "slots", "counts", "pulled", "pulls"]
    senders = [k for k in np.argsort(sources, kind="stable") if sources[k] >= 0]
    out = own.select(names)
    if not out.num_rows:
        extra = [pa.array([], pa.binary())] * 5
    else:
        ids = own.column("ids")[0].values.to_numpy(zero_copy_only=False)
        places = [np.searchsorted(ids, rows.column("ids")[int(k)].values.to_numpy(zero_copy_only=False)).astype(np.int32) for k in senders]
        hubs = [np.frombuffer(rows.column("hubs")[int(k)].as_py(), np.int32) for k in senders]
        flat = lambda parts: np.concatenate([np.zeros(0, np.int32), *parts]).tobytes()
        extra = [pa.array([x], pa.binary()) for x in (sources[senders].astype(np.int32).tobytes(), flat(places), np.cumsum([0, *map(len, places)]).astype(np.int64).tobytes(), flat(hubs), np.cumsum([0, *map(len, hubs)]).astype(np.int64).tobytes())]
    for name, column in zip(("senders", "places", "ends", "hubs", "hub_ends"), extra):
        out = out.append_column(name, column)
    return out


def _advance(step: Step, n_hubs: int):
    def run(key: tuple[pa.Scalar, ...], own: pa.Table, messages: pa.Table) -> pa.Table:
        if not own.num_rows:
            return pa.Table.from_pylist([], schema=_MESSAGES)
        block = key[0].as_py()
        get = lambda name, kind=np.int32: np.frombuffer(own.column(name)[0].as_py(), kind)
        degrees, places, ends, hubs, hub_ends = get("degrees", np.float64), get("places"), get("ends", np.int64), get("hubs"), get("hub_ends", np.int64)
        n = len(degrees)
        values = dict(zip(messages.column("source").to_pylist(), messages.column("values")))
        got, hub_values = np.zeros(n), np.zeros(n_hubs)
        for k, sender in enumerate(get("senders")):
            if int(sender) in values:
                sums = np.frombuffer(values[int(sender)].as_py())
                here, theirs = places[ends[k] : ends[k + 1]], hubs[hub_ends[k] : hub_ends[k + 1]]
                # each node once in a message
                got[here] += sums[: len(here)]
                hub_values[theirs] = sums[len(here) :]
        got += np.bincount(get("pulled"), hub_values[get("pulls")], n)
        sent, kept, still = step(got, np.frombuffer(values[-1].as_py()).reshape(-1, n))
        each, counts = sent / degrees, get("counts")
        sums = np.bincount(get("slots"), each[get("sources")], counts.sum())
        stops, mine = np.concatenate([[0], np.cumsum(counts)]), each[get("owners")]
        out = [(c, np.concatenate([sums[stops[c] : stops[c + 1]], mine])) for c in range(len(counts)) if counts[c] or len(mine)]
        return pa.table({"block": [block, *(c for c, _ in out)], "source": [-1] + [block] * len(out), "values": [kept.tobytes(), *(v.tobytes() for _, v in out)], "open": [still] + [0] * len(out)}, schema=_MESSAGES)

    return run


def _normal(ranks: DataFrame) -> DataFrame:
    total = ranks.agg(F.sum("value").alias("total"))
    return ranks.join(F.broadcast(total)).select("id", (F.col("value") / F.col("total")).alias("score"))


def pagerank(edges: DataFrame, steps: int = 50, damping: float = 0.85, cut_every: int = 10, hub: int = HUB) -> DataFrame:
    """(id, score), scores summing to 1. Lineage is cut by tables in the folder of spark.checkpoint.dir.

    Every node has a neighbour, as nodes come from edges, so no mass is lost on the way; a step sends
    one sum for each block and node that it touches. Edges are dealt out once, those of a node with
    more than `hub` of them with its neighbours, so that no task holds a hub. Edges without one end are none."""
    links = _Links(edges, hub)
    scratch = Scratch(edges.sparkSession, "ranks")
    start = 1.0 / links.n if links.n else 0.0
    base = (1 - damping) * start

    def first(got: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        return kept[0], kept, 0

    def step(got: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        value = damping * got + base
        return value, value[None], 0

    messages = links.advance(links.first(value=start), first)
    for k in range(steps):
        messages = links.advance(messages, step)
        if (k + 1) % cut_every == 0:
            messages = scratch.save(messages)
            scratch.keep(messages)
    return _normal(scratch.save(links.kept(messages)))


def pagerank_update(edges: DataFrame, old: DataFrame, damping: float = 0.85, tolerance: float = 1e-12, most: int = 400, cut_every: int = 10, hub: int = HUB) -> DataFrame:
    """(id, score): the ranks of changed edges, from the ranks (id, score) of before.

    One pass over all edges gives the residual of the old ranks, what they lack to be a fixed point.
    Then only residuals above the tolerance are pushed: a node adds its own to its rank and sends a
    share to its neighbours, until none is left. Nodes that are gone lose their rank, new ones start at 0."""
    links = _Links(edges, hub)
    scratch = Scratch(edges.sparkSession, "ranks")
    base = (1 - damping) / links.n if links.n else 0.0

    def first(got: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        return kept[0], kept, 0

    def push(rank: np.ndarray, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        active = np.where(np.abs(residual) > tolerance, residual, 0.0)
        return active, np.stack([rank + active, residual - active]), int(np.count_nonzero(active))

    def lacking(got: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        return push(kept[0], damping * got + base - kept[0])

    def step(got: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        return push(kept[0], kept[1] + damping * got)

    messages = links.advance(links.advance(links.first(old.select("id", F.col("score").alias("value"))), first), lacking)
    for k in range(most):
        if k % cut_every == 0:
            messages = scratch.save(messages)
            scratch.keep(messages)
            if not messages.agg(F.max("open")).first()[0]:
                break
        messages = links.advance(messages, step)
    return _normal(scratch.save(links.kept(messages)))


def friends(edges: DataFrame, ranks: DataFrame, node: int, k: int = 3) -> DataFrame:
    """(id, score): the k highest-ranked nodes that are neither the node nor its neighbours; ties by id."""
    near = undirected(edges).where(F.col("src") == node).select(F.col("dst").alias("id"))
    return ranks.where(F.col("id") != node).join(near, "id", "left_anti").orderBy(F.desc(F.round("score", 12)), "id").limit(k)


def friend_lists(edges: DataFrame, ranks: DataFrame) -> DataFrame:
    """(id, score, friends): every node with its neighbours."""
    return ranks.join(adjacency(edges).select("id", F.col("neighbours").alias("friends")), "id", "left")

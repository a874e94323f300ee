"""Sharding by balanced label propagation.

Every document starts in the shard that a hash of its id names. Documents of one group
(here: of equal text) are linked, all with all; a link whose ends lie in different shards is
cut. In each round, Spark joins give every linked document the shard that most of its group
is in, as far as that shard has room: quotas are set from the shards' loads, and a share of
the would-be movers, picked by hash, is let in, so that a shard's linked documents fill it at
most. A group larger than a part of a shard cannot be whole in one without crowding it out;
such groups, whose number the quota bounds, are laid over whole shards first, largest
first, and their documents go there by rank.

Groups are never expanded to pairs: a group's documents are counted by shard.

The law is `rows`: at the end the counts of any two shards differ by at most one. Shards over
their quota give their surplus, documents without links first, to those under it.
Ranks and slots come from counts by (shard, bucket) and ranks inside a bucket, so no task
sorts a whole shard.

Cases: null and empty texts are groups like any other text (null ones: one group); rows
that repeat an id are separate documents; an empty table gives no rows; fewer documents
than shards leave shards with one or none. Other columns of the input do not come through;
join them by id.

What was achieved is in the output: `n_links` is the number of documents that a document is
linked to, `n_cut` how many of these are in other shards. Half of the sum of `n_cut` is the
number of cut links.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

SHARDS = 40
ROUNDS = 4
#: A group over this part of a shard's quota is laid out first.
LARGE = 8
#: A shard that laid-out groups fill to this part takes no others.
FULL = 0.95
#: Rows that a bucket holds on average when rows are ranked.
BUCKET_ROWS = 20_000


def _unit(*cols: Column | str | int) -> Column:
    """A number in [0, 1) by hash."""
    return F.pmod(F.xxhash64(*[F.lit(c) if isinstance(c, int) else c for c in cols]), F.lit(1 << 30)) / F.lit(float(1 << 30))


def ranked(df: DataFrame, by: list[str], order: list[str], name: str, buckets: int) -> DataFrame:
    """df with a number from 0 without gaps within each `by`: by bucket (a hash of `order`), then `order`."""
    df = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = df.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    ahead = counts.withColumn("_o", F.sum("_n").over(Window.partitionBy(*by).orderBy("_b")) - F.col("_n")).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*by, "_b").orderBy(*order))
    return df.withColumn("_r", inside).join(ahead, [*by, "_b"]).withColumn(name, (F.col("_o") + F.col("_r") - 1).cast("long")).drop("_b", "_r", "_o")


def _spread(counts: list[int]) -> list[int]:
    """Running totals before each entry."""
    return [sum(counts[:i]) for i in range(len(counts))]


def _pick(index: Column, values: list) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index + 1)


def _in_ranges(x: Column, edges: list[float], labels: list[int]) -> Column:
    """The label of the last edge that is not above x."""
    return reduce(lambda out, e: F.when(x >= e[0], F.lit(e[1])).otherwise(out), list(zip(edges, labels, strict=True))[1:], F.lit(labels[0]))


def _lay_large(sizes: list[tuple[int, int]], target: list[int]) -> dict[int, list[tuple[int, int]]]:
    """group number -> [(first document, shard)]: groups, largest first, fill the emptiest shards."""
    room = dict(enumerate(target))
    out = {}
    for number, n in sizes:
        left, edge, pieces = n, 0, []
        while left > 0:
            s = max(room, key=lambda k: (room[k], -k))
            take = min(left, max(room[s], 1))
            pieces.append((edge, s))
            room[s] -= take
            left -= take
            edge += take
        out[number] = pieces
    return out


def propagate(nodes: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """nodes (key, grp) -> (key, grp, linked, shard) with the counts of any two shards at most one apart. key: unique, one column."""
    scratch = Scratch(nodes.sparkSession, "sharding")
    groups = nodes.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = scratch.save(groups)
    state = nodes.join(groups, "grp", "left").select("key", "grp", F.col("n").isNotNull().alias("linked"), F.coalesce("n", F.lit(1)).alias("n"), F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"))
    state = scratch.save(state)
    total = state.count()
    quota, extra = divmod(total, shards)
    target = [quota + (s < extra) for s in range(shards)]
    # groups too large to move as one: at most LARGE * shards of them
    limit = max(2, quota // LARGE)
    large = groups.where(F.col("n") > limit).orderBy(F.desc("n"), "grp").limit(LARGE * shards + shards).collect()
    laid = _lay_large([(i, r["n"]) for i, r in enumerate(large)], target) if large and quota else {}
    if laid:
        spark = nodes.sparkSession
        rows = [(large[i]["grp"], [e for e, _ in p], [s for _, s in p]) for i, p in laid.items()]
        lay = spark.createDataFrame(rows, f"grp {nodes.schema['grp'].dataType.simpleString()}, edges array<bigint>, to array<int>")
        own = ranked(state.join(F.broadcast(lay), "grp"), ["grp"], ["key"], "place", max(1, total // BUCKET_ROWS))
        at = F.size(F.filter("edges", lambda e: e <= F.col("place")))
        own = own.select("key", "grp", "linked", "n", F.element_at("to", at).alias("shard"), F.lit(True).alias("laid"))
        rest = state.join(F.broadcast(lay.select("grp")), "grp", "left_anti").select("key", "grp", "linked", "n", "shard", F.lit(False).alias("laid"))
        state = scratch.save(own.unionByName(rest))
    else:
        state = state.withColumn("laid", F.lit(False))
    moving = scratch.save(state.where("linked"))
    single = state.where("not linked")
    for k in range(rounds):
        by_shard = moving.groupBy("grp", "shard", "laid").agg(F.count(F.lit(1)).alias("c"))
        load = {r["shard"]: r["c"] for r in by_shard.groupBy("shard").agg(F.sum("c").alias("c")).collect()}
        fixed = {r["shard"]: r["c"] for r in by_shard.where("laid").groupBy("shard").agg(F.sum("c").alias("c")).collect()}
        full = [fixed.get(s, 0) >= FULL * target[s] for s in range(shards)]
        free = [s for s in range(shards) if not full[s]] or [0]
        # the plurality shard of each group among those not full; ties by hash, so that no shard draws all of them
        votes = F.when(_pick(F.col("shard"), full), 0).otherwise(F.col("c"))
        best = by_shard.where("not laid").groupBy("grp").agg(F.max_by("shard", F.struct(votes, F.xxhash64("grp", "shard"), "shard")).alias("best"))
        best = best.withColumn("best", F.when(_pick(F.col("best"), full), _pick(F.pmod(F.xxhash64("grp"), F.lit(len(free))).cast("int"), free)).otherwise(F.col("best")))
        wish = by_shard.where("not laid").join(best, "grp").where("shard <> best").groupBy(F.col("shard").alias("a"), F.col("best").alias("b")).agg(F.sum("c").alias("c")).collect()
        if not wish:
            break
        into = {s: sum(r["c"] for r in wish if r["b"] == s) for s in range(shards)}
        room = {s: max(0, target[s] - load.get(s, 0)) for s in range(shards)}
        share = [min(1.0, room[s] / into[s]) if into[s] else 0.0 for s in range(shards)]
        moving = moving.join(best, "grp", "left").withColumn("go", F.col("best").isNotNull() & (F.col("best") != F.col("shard")) & (_unit("grp", k) < _pick(F.col("best"), share)))
        moving = scratch.save(moving.select("key", "grp", "linked", "n", F.when(F.col("go"), F.col("best")).otherwise(F.col("shard")).alias("shard"), "laid"))
    every = scratch.save(moving.unionByName(single))
    scratch.keep(every)
    counts = {r["shard"]: r["c"] for r in every.groupBy("shard").agg(F.count(F.lit(1)).alias("c")).collect()}
    surplus = [max(0, counts.get(s, 0) - target[s]) for s in range(shards)]
    lack = [max(0, target[s] - counts.get(s, 0)) for s in range(shards)]
    if not sum(surplus):
        return every.select("key", "grp", "linked", "shard")
    # in each shard the least linked leave first; class: size of the group, in powers of two
    sort = every.withColumn("_c", F.when(F.col("linked"), F.floor(F.log2(F.col("n").cast("double"))) + 1).otherwise(F.lit(0)).cast("int"))
    classes = sort.groupBy("shard", "_c").agg(F.count(F.lit(1)).alias("m"))
    classes = classes.withColumn("before", F.sum("m").over(Window.partitionBy("shard").orderBy("_c")) - F.col("m"))
    leaving = classes.where(F.col("before") < _pick(F.col("shard"), surplus)).select("shard", "_c", "before")
    candidates = sort.join(F.broadcast(leaving), ["shard", "_c"])
    candidates = ranked(candidates, ["shard", "_c"], ["key"], "place", max(1, total // BUCKET_ROWS))
    place = F.col("before") + F.col("place")
    go = candidates.where(place < _pick(F.col("shard"), surplus)).select("key", (place + _pick(F.col("shard"), _spread(surplus))).alias("ticket"))
    taker = [s for s in range(shards) if lack[s]]
    go = go.select("key", _in_ranges(F.col("ticket"), _spread([lack[s] for s in taker]), taker).alias("new"))
    return every.join(go, "key", "left").select("key", "grp", "linked", F.coalesce("new", "shard").alias("shard"))


def with_cuts(placed: DataFrame) -> DataFrame:
    """placed (key, grp, linked, shard) with n_links and n_cut, from counts by group and shard."""
    here = placed.where("linked").groupBy("grp", "shard").agg(F.count(F.lit(1)).alias("_here"))
    here = here.withColumn("_n", F.sum("_here").over(Window.partitionBy("grp")))
    links, cut = F.col("_n") - 1, F.col("_n") - F.col("_here")
    counted = placed.where("linked").join(here, ["grp", "shard"]).select(*placed.columns, links.alias("n_links"), cut.alias("n_cut"))
    zero = F.lit(0).cast("long")
    return counted.unionByName(placed.where("not linked").select("*", zero.alias("n_links"), zero.alias("n_cut")))


def assign(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot, linked, n_links, n_cut): size is the UTF-8 bytes of the text plus 16; slots are gapless from 0 in each shard."""
    scratch = Scratch(docs.sparkSession, "shards")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.when(F.col(text_col).isNull(), F.lit("null")).otherwise(F.sha2(F.col(text_col), 256)).alias("grp"),
    )
    # rows that repeat an id are told apart by a number among the equal ones
    rows = scratch.save(rows)
    again = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    if again:
        rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("grp")))
    else:
        rows = rows.withColumn("nth", F.lit(1))
    key = F.struct("id", "nth")
    rows = scratch.save(rows.withColumn("key", key).drop("nth"))
    scratch.keep(rows)
    n = rows.count()
    placed = with_cuts(scratch.save(propagate(rows.select("key", "grp"), shards, rounds))).drop("grp")
    out = rows.join(placed, "key").select("key", "size", "text_crc32", "shard", "linked", "n_links", "n_cut")
    out = ranked(out, ["shard"], ["key"], "slot", max(1, n // (shards * BUCKET_ROWS // 4)))
    return out.select(F.col("key.id").alias(id_col), "size", "text_crc32", "shard", "slot", "linked", "n_links", "n_cut")

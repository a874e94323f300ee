"""Line dedup by a segment-partition edit join, with DataFrame functions only.

A line is dropped if a line before it, in the order of (doc_id, hashes of the text, line
number), is equal to it or within THRESHOLD edits of it (code points inserted, deleted or
replaced). The first line of its kind always stays. Lines under LEAST_CHARS are judged by
equality only, as two edits make any short lines near (`short_lines=False`: not at all);
blank lines stay.

Equal lines are found by two 64-bit hashes; the join works on distinct lines. Each is cut into
THRESHOLD + 1 segments; a line within the threshold holds at least one of them unchanged, at a
place that the two lengths and the segment's number bound. So each line enters its segments
under (length, number, segment), and looks up, for each length it may match, only the
substrings at those places. What meets is verified by a banded bit-parallel edit distance:
the band of the dynamic programme, 2 * THRESHOLD + 1 diagonals, is one integer per column.
Candidates travel by one of the hashes; the verified pairs are of lines, with both.

Before that, pairs are thinned by the parities of the lines' character pairs: 64 bits, of which
an edit changes at most four.

A segment that many lines of one length share (as the variants of a much copied line do)
would meet in all pairs. Up to HOT lines, a look-up meets each of them. For a segment with
more, the rows of that segment alone are dealt into tiles, TILE lines that look up against
TILE that are offered, and each pair of tiles is a join of its own under the condition on
parities, so that no task gets a whole segment and only pairs that pass leave the join.
Segments are counted by map-side sums; no window runs over one.

Cases: a null text stays null, an empty one empty; a document whose lines all go becomes
empty and stays as a row; rows are told apart by id and text, so rows that repeat an id, or
have none, are judged each by its own text, and rows that repeat both are one document and
judged alike; lines may be of any length; columns of any name pass through; an empty table
gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, text_hashes, unused

THRESHOLD = 2
LEAST_CHARS = 20
#: What a short line must hold to be judged.
NOT_BLANK = r"(?U)\S"
#: Lines of one length that share a segment before the pair condition moves into the join, and lines in a tile of such a join.
HOT = 16
TILE = 2048
#: Distinct lines in candidate pairs (8 bytes each) up to which their ids are broadcast.
BROADCAST_IDS = 1_000_000


def _segment(length: Column, i: int, k: int) -> tuple[Column, Column]:
    """(start from 0, size) of segment i of k: the last ones are one longer where the length does not divide."""
    short = F.lit(k) - length % k
    size = F.floor(length / k).cast("int")
    return size * i + F.greatest(F.lit(i) - short, F.lit(0)), size + F.when(F.lit(i) >= short, 1).otherwise(0)


def _key(length: Column, i: int, text: Column, start: Column, size: Column) -> Column:
    return F.xxhash64(length, F.lit(i), F.substring(text, start + 1, size))


def segment_keys(text: Column, n: Column, threshold: int) -> Column:
    """What a line is found by: a key for each segment."""
    return F.array(*[_key(n, i, text, *_segment(n, i, threshold + 1)) for i in range(threshold + 1)])


def probe_steps(threshold: int) -> list[tuple[int, int, int]]:
    """(how much shorter the other line is, its segment, how far that lies from the same place in the own line) of everything that is looked up."""
    out = []
    for shorter in range(threshold + 1):
        for i in range(threshold + 1):
            low = max(-i, shorter - (threshold - i))
            high = min(i, shorter + (threshold - i))
            out += [(shorter, i, shift) for shift in range(low, high + 1)]
    return out


def probe_keys(lines: DataFrame, threshold: int) -> DataFrame:
    """(h1, key) from lines (h1, n, line): what a line looks up: keys of the substrings that a segment of an equally long or shorter line may equal.

    The places are rows of a small constant array, so that the generated code holds one of them and stays small enough to be compiled."""
    k = threshold + 1
    steps = F.array(*[F.struct(*[F.lit(x).alias(c) for x, c in zip(step, ("shorter", "i", "shift"), strict=True)]) for step in probe_steps(threshold)])
    each = lines.select("h1", "n", "line", F.explode(steps).alias("p")).select("h1", "n", "line", (F.col("n") - F.col("p.shorter")).alias("length"), "p.i", "p.shift")
    each = each.where(F.col("length") > threshold).withColumns({"least": F.expr(f"int(length div {k})"), "short": F.expr(f"{k} - length % {k}")})
    each = each.withColumns({"at": F.col("least") * F.col("i") + F.greatest(F.col("i") - F.col("short"), F.lit(0)) + F.col("shift"), "size": F.col("least") + (F.col("i") >= F.col("short")).cast("int")})
    each = each.where((F.col("at") >= 0) & (F.col("at") + F.col("size") <= F.col("n")))
    return each.select("h1", F.xxhash64("length", "i", F.substring("line", F.col("at") + 1, F.col("size"))).alias("key"))


def edit_distance(a: Column, b: Column, threshold: int) -> Column:
    """The edit distance of a and b, if it is within the threshold; else any number above it. A band of diagonals moves along b; bit p of column j is row j - threshold + p."""
    width = 2 * threshold + 1
    mask = F.lit((1 << width) - 1).cast("long")
    long, short = F.when(F.char_length(a) >= F.char_length(b), a).otherwise(b), F.when(F.char_length(a) >= F.char_length(b), b).otherwise(a)

    def run(s: Column) -> Column:
        rows, columns = s["rows"], s["columns"]
        more = F.size(rows) - F.size(columns)
        own = F.call_function("shiftleft", F.lit(1).cast("long"), (more + threshold).cast("int"))  # the diagonal of the last cell

        def step(acc: Column, j: Column) -> Column:
            c = F.get(columns, j)
            match = F.lit(0).cast("long")
            for p in range(width):
                match = match.bitwiseOR(F.when((j - threshold + p >= 0) & (F.get(rows, j - threshold + p) == c), F.lit(1 << p).cast("long")).otherwise(F.lit(0).cast("long")))
            vp, vn = acc["vp"], acc["vn"]

            def column(m: Column) -> Column:
                d0 = ((m.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(m).bitwiseOR(vn).bitwiseAND(mask)

                def rest(d: Column) -> Column:
                    hp = vn.bitwiseOR(F.bitwise_not(d.bitwiseOR(vp))).bitwiseAND(mask)
                    hn = d.bitwiseAND(vp)
                    down = F.shiftrightunsigned(d, 1)
                    return F.struct(
                        hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(hp))).bitwiseAND(mask).alias("vp"),
                        down.bitwiseAND(hp).alias("vn"),
                        (acc["d"] + F.when(d.bitwiseAND(own) == 0, 1).otherwise(0)).alias("d"),
                    )

                return F.transform(F.array(d0), rest)[0]

            return F.transform(F.array(match), column)[0]

        below = ((1 << width) - 1) ^ ((1 << threshold) - 1)
        start = F.struct(F.lit(below).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), more.cast("int").alias("d"))
        steps = F.when(F.size(columns) > 0, F.sequence(F.lit(0), F.size(columns) - 1)).otherwise(F.array().cast("array<int>"))
        return F.when(more > threshold, F.lit(threshold + 1)).otherwise(F.aggregate(steps, start, step, lambda x: x["d"]))

    chars = lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, ""))
    return F.transform(F.array(F.struct(chars(long).alias("rows"), chars(short).alias("columns"))), run)[0]


def parities(text: Column) -> Column:
    """64 bits: bit h is the parity of the number of character pairs that hash to h."""

    def of(c: Column) -> Column:
        pairs = F.when(F.size(c) > 1, F.sequence(F.lit(0), F.size(c) - 2)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(pairs, F.lit(0).cast("long"), lambda x, i: x.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(F.get(c, i), F.get(c, i + 1)), F.lit(64)).cast("int"))))

    return F.transform(F.array(F.split(text, "")), of)[0]


#: What tells documents apart: the id and two hashes of the text.
ROW = ["id", "t1", "t2"]


def row_key(id_col: str, text_col: str) -> list[Column]:
    t1, t2 = text_hashes(F.col(text_col))
    return [F.col(id_col).alias("id"), t1.alias("t1"), t2.alias("t2")]


def same_row(a: DataFrame, b: DataFrame, names: list[str] = ROW) -> Column:
    """The rows' keys are equal; null ids are equal to each other."""
    return a[names[0]].eqNullSafe(b["id"]) & (a[names[1]] == b["t1"]) & (a[names[2]] == b["t2"])


def places(docs: DataFrame, id_col: str, text_col: str, short_lines: bool = True) -> DataFrame:
    """(id, t1, t2, at, line, h1, h2): every line that is judged, with its document, number and two hashes."""
    each = docs.select(*row_key(id_col, text_col), F.posexplode(F.split(F.col(text_col), "\n")).alias("at", "line"))
    each = each.where((F.char_length("line") >= LEAST_CHARS) | (F.lit(short_lines) & F.col("line").rlike(NOT_BLANK)))
    h1, h2 = text_hashes(F.col("line"))
    return each.withColumns({"h1": h1, "h2": h2})


def _tiles(n: str) -> Column:
    return F.ceil(F.col(n) / TILE).cast("int")


def _meet_in_tiles(asking: DataFrame, offered: DataFrame, condition: Column) -> DataFrame:
    """asking (key, h1, ...) and offered (key, to, ...) that share a key and meet the condition; the rows of one key are dealt into pairs of tiles."""
    sizes = asking.groupBy("key").agg(F.count(F.lit(1)).alias("n_a")).join(offered.groupBy("key").agg(F.count(F.lit(1)).alias("n_b")), "key")
    own = lambda c, n: F.pmod(F.xxhash64(c), _tiles(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), _tiles(n) - 1))
    a = asking.join(sizes, "key").withColumn("i", own("h1", "n_a")).withColumn("j", every("n_b")).drop("n_a", "n_b")
    b = offered.join(sizes, "key").withColumn("j", own("to", "n_b")).withColumn("i", every("n_a")).drop("n_a", "n_b")
    return a.join(b, (a["key"] == b["key"]) & (a["i"] == b["i"]) & (a["j"] == b["j"]) & condition)


def linked_lines(lines: DataFrame, scratch: Scratch, threshold: int = THRESHOLD) -> DataFrame:
    """(a1, a2, b1, b2): pairs of distinct lines (h1, h2, n, line) within the threshold, once each, by both hashes."""
    index = scratch.save(lines.select(F.col("h1").alias("to"), F.explode(segment_keys(F.col("line"), F.col("n"), threshold)).alias("key")))
    hot = scratch.save(index.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > HOT).select("key"))
    cold = index.join(hot, "key", "left_anti").select("key", "to")
    meet = cold.unionByName(hot.select("key", F.lit(None).cast("long").alias("to")))
    met = probe_keys(lines, threshold).join(meet.hint("shuffle_hash"), "key").where(F.col("to").isNull() | (F.col("to") != F.col("h1")))
    met = scratch.save(met.select("h1", "to", F.when(F.col("to").isNull(), F.col("key")).alias("key")))
    pairs = met.where("to is not null").select(F.least("h1", "to").alias("a"), F.greatest("h1", "to").alias("b")).distinct()
    asking = met.where("to is null").select("key", "h1").distinct()
    offered = index.join(hot, "key", "left_semi").select("key", "to").distinct()
    ids = reduce(DataFrame.union, [pairs.select("a"), pairs.select("b"), asking.select("h1"), offered.select("to")]).toDF("h1").distinct()
    texts = scratch.save(_of(lines, ids).select("h1", "h2", "line", parities(F.col("line")).alias("sign")))
    signs = lambda name: texts.select(F.col("h1").alias(name), F.col("sign").alias(f"sign_{name}"))
    alike = lambda x, y: F.bit_count(F.col(f"sign_{x}").bitwiseXOR(F.col(f"sign_{y}"))) <= 4 * threshold
    if hot.limit(1).count():
        asking, offered = asking.join(signs("h1"), "h1"), offered.join(signs("to"), "to")
        close = _meet_in_tiles(asking, offered, alike("h1", "to") & (F.col("h1") != F.col("to")))
        pairs = pairs.union(close.select(F.least("h1", "to").alias("a"), F.greatest("h1", "to").alias("b"))).distinct()
    near = pairs.join(signs("a"), "a").join(signs("b"), "b").where(alike("a", "b")).select("a", "b")
    line = lambda name: texts.select(F.col("h1").alias(name), F.col("h2").alias(f"h2_{name}"), F.col("line").alias(f"line_{name}"))
    both = scratch.save(near.distinct()).join(line("a"), "a").join(line("b"), "b")
    both = both.where(edit_distance(F.col("line_a"), F.col("line_b"), threshold) <= threshold)
    return both.select(F.col("a").alias("a1"), F.col("h2_a").alias("a2"), F.col("b").alias("b1"), F.col("h2_b").alias("b2"))


def _of(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """The lines whose h1 is among the ids, which are broadcast if they are few."""
    few = ids.count() <= BROADCAST_IDS
    return lines.join(F.broadcast(ids) if few else ids, "h1", "left_semi")


def judged_lines(docs: DataFrame, scratch: Scratch, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", short_lines: bool = True) -> DataFrame:
    """(id, t1, t2, dropped, n_links): for each document with lines that have equal or near ones: the numbers of the lines to drop, and its lines' links to other distinct lines."""
    every = places(docs, id_col, text_col, short_lines)
    lines = every.groupBy("h1", "h2").agg(F.min(F.struct(*ROW, "at")).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("line").alias("line"))
    lines = scratch.save(lines.withColumn("n", F.char_length("line")))
    pairs = scratch.save(linked_lines(lines.where(F.col("n") >= LEAST_CHARS).select("h1", "h2", "n", "line"), scratch, threshold))
    scratch.keep(lines, pairs)
    ends = pairs.union(pairs.select("b1", "b2", "a1", "a2")).toDF("h1", "h2", "o1", "o2")
    firsts = lines.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("first").alias("near"))
    near = ends.join(firsts, ["o1", "o2"]).groupBy("h1", "h2").agg(F.min("near").alias("near"), F.count(F.lit(1)).alias("links"))
    known = lines.select("h1", "h2", "first", "copies").join(near, ["h1", "h2"], "left").where("copies > 1 or links is not null")
    known = scratch.save(known.select("h1", "h2", F.least("first", "near").alias("first"), F.coalesce("links", F.lit(0)).alias("links")))
    scratch.keep(known)
    found = every.drop("line").join(known, ["h1", "h2"])
    # a set of lines, so that rows that repeat id and text give each line once
    line = F.struct("at", (F.struct(*ROW, "at") > F.col("first")).alias("drop"), "links")
    marked = found.groupBy(*ROW).agg(F.collect_set(line).alias("lines"))
    dropped = F.array_sort(F.transform(F.filter("lines", lambda x: x["drop"]), lambda x: x["at"]))
    return marked.select(*ROW, dropped.alias("dropped"), F.aggregate("lines", F.lit(0).cast("long"), lambda n, x: n + x["links"]).alias("n_links"))


def line_report(docs: DataFrame, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", short_lines: bool = True) -> DataFrame:
    """(id, n_lines, n_dropped, n_links, dropped_lines) of each document; the text stays where it is."""
    scratch = Scratch(docs.sparkSession, "lines")
    found = judged_lines(docs, scratch, threshold, id_col, text_col, short_lines)
    t1, t2 = text_hashes(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("_i"), t1.alias("_t1"), t2.alias("_t2"), F.coalesce(F.size(F.split(F.col(text_col), "\n")), F.lit(0)).cast("long").alias("n_lines"))
    out = rows.join(found, same_row(rows, found, ["_i", "_t1", "_t2"]), "left")
    dropped = F.coalesce("dropped", F.array().cast("array<int>"))
    return out.select(F.col("_i").alias(id_col), "n_lines", F.size(dropped).cast("long").alias("n_dropped"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), dropped.alias("dropped_lines"))


def without_lines(text: Column, gone: Column) -> Column:
    """text without the lines of these numbers, in time linear in its lines: the numbers that stay are a difference of sets, and each takes its line by place."""
    lines = F.split(text, "\n")
    stay = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x) - 1), gone.cast("array<int>"))
    # a transform of one value binds the lines, so that they are split once
    return F.transform(F.array(lines), lambda x: F.array_join(F.transform(stay(x), lambda k: F.get(x, k)), "\n"))[0]


def drop_lines(docs: DataFrame, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", short_lines: bool = True) -> DataFrame:
    """docs with their texts without the dropped lines."""
    scratch = Scratch(docs.sparkSession, "lines")
    found = judged_lines(docs, scratch, threshold, id_col, text_col, short_lines).where(F.size("dropped") > 0).drop("n_links")
    i, h1, h2, gone = (unused(docs, f"_line_{c}") for c in ("id", "t1", "t2", "dropped"))
    found = found.select(F.col("id").alias(i), F.col("t1").alias(h1), F.col("t2").alias(h2), F.col("dropped").alias(gone))
    t1, t2 = text_hashes(docs[text_col])
    out = docs.join(found, docs[id_col].eqNullSafe(found[i]) & (t1 == found[h1]) & (t2 == found[h2]), "left")
    text = without_lines(F.col(text_col), F.col(gone))
    return out.withColumn(text_col, F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(text)).select(*docs.columns)

"""Exact dedup: local, salted and global combining of texts that are equal but for white space.

Texts are equal when they are identical without the characters \\x20 and \\x09-\\x0D. Of equal
texts the row with the most code points in its own text stays, then the one of the smallest id.

1. Local: rows are grouped by digest, salt and the whole content; Spark's map-side aggregation
   combines the copies of a partition before anything is shuffled.
2. Salted: a digest with more than a twenty-thousandth of all rows is hot and gets salts, by the
   partition its rows were read from, so that its groups meet in many tasks.
3. Global: the winners of the salts of hot digests are grouped by digest and content.

Every stage has the content in its key, so a digest only deals rows out and never decides. What
travels is one content for each partition and text, with the ids of its copies; the contents of
hot digests travel once more, one for each salt.

Cases: a null text is an empty one, and texts of white space alone equal it; a null id comes
after every other; rows that repeat an id are documents of their own, and of those that tie in
length and id exactly one is `kept`; an empty table gives an empty table; other columns are not
read by `match_copies` and pass through `keep_one` under any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

BLANKS = " \t\n\x0b\x0c\r"
#: A digest is hot above both of these: so many rows, and all rows divided by MOST_HOT. So there are fewer hot digests than MOST_HOT, which bounds their broadcast.
LEAST_HOT = 1_000
MOST_HOT = 20_000


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def _rows(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column], row: Column | None) -> DataFrame:
    """(digest, content, member, part): member orders equal texts, the one that stays first."""
    content = normalised(F.col(text_col))
    length = F.char_length(F.coalesce(F.col(text_col), F.lit("")))
    member = F.struct((-length).alias("shorter"), F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"))
    out = docs.select(content.alias("content"), member.alias("member"), F.spark_partition_id().alias("part"), *([] if row is None else [row.alias("row")]))
    return out.withColumn("digest", digest(F.col("content")))


def _hot(rows: DataFrame, n: int, least: int) -> DataFrame:
    """(digest, salts) of the digests with more than their share of the rows, fewer than MOST_HOT."""
    share = max(least, -(-n // MOST_HOT))
    return rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > share).select("digest", F.ceil(F.col("n") / share).cast("int").alias("salts"))


def _salted(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """rows with salts (null unless hot) and salt."""
    placed = rows.join(F.broadcast(hot), "digest", "left")
    return placed.withColumn("salt", F.coalesce(F.pmod("part", "salts"), F.lit(0)))


def match_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, least_hot: int = LEAST_HOT) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256), one row for each row of docs."""
    scratch = Scratch(docs.sparkSession, "exact")
    rows = _rows(docs, id_col, text_col, digest, None)
    hot = scratch.save(_hot(rows, docs.count(), least_hot))
    groups = _salted(rows, hot).groupBy("digest", "salt", "salts", "content").agg(F.array_sort(F.collect_list("member")).alias("members"))
    sha = F.col("digest") if digest is sha256 else sha256(F.col("content"))
    # contents are needed once more for hot digests only
    met = scratch.save(groups.select("digest", "salt", F.when(F.col("salts").isNotNull(), F.col("content")).alias("content"), "members", sha.alias("text_sha256")))
    alone = met.where(F.col("content").isNull()).select("members", "text_sha256", F.col("members")[0]["id"].alias("keep_id"), F.size("members").cast("long").alias("group_size"), F.lit(True).alias("best"))
    dealt = met.where(F.col("content").isNotNull())
    winners = dealt.groupBy("digest", "content").agg(F.min(F.struct(F.col("members")[0].alias("member"), "salt")).alias("winner"), F.sum(F.size("members")).alias("group_size"))
    together = dealt.join(winners, ["digest", "content"]).select("members", "text_sha256", F.col("winner.member.id").alias("keep_id"), "group_size", (F.col("salt") == F.col("winner.salt")).alias("best"))
    each = alone.unionByName(together).select(F.posexplode("members").alias("place", "member"), "keep_id", "group_size", "best", "text_sha256")
    return each.select(F.col("member.id").alias(id_col), "keep_id", "group_size", (F.col("best") & (F.col("place") == 0)).alias("kept"), "text_sha256")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, least_hot: int = LEAST_HOT) -> DataFrame:
    """The rows of docs, one of each group of equal texts, with all their columns. The best row of a partition travels with its content, other copies do not."""
    scratch = Scratch(docs.sparkSession, "exact")
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)])
    rows = _rows(docs, id_col, text_col, digest, row)
    hot = scratch.save(_hot(rows, docs.count(), least_hot))
    best = (F.min("member").alias("member"), F.min_by("row", "member").alias("row"))
    met = scratch.save(_salted(rows, hot).groupBy("digest", "salt", "salts", "content").agg(*best))
    one = met.where(F.col("salts").isNotNull()).groupBy("digest", "content").agg(*best)
    left = met.where(F.col("salts").isNull()).select("row").unionByName(one.select("row"))
    return left.select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(docs.columns)])

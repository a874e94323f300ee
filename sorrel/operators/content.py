"""Content-based recommendation: Jaccard similarity of genre sets, and the list of titles to choose from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import jaccard
from .ranks import with_place


def similar_to(items: DataFrame, liked_id: Column | int, k: int = 2, id_col: str = "id", set_col: str = "genres") -> DataFrame:
    """(id, title, score): the k items nearest to one; ties by id. One row is broadcast against the table."""
    liked = items.where(F.col(id_col) == liked_id).select(F.col(id_col).alias("_liked"), F.col(set_col).alias("_set")).limit(1)
    scored = items.join(F.broadcast(liked), F.col(id_col) != F.col("_liked")).select(*[c for c in items.columns if c != set_col], jaccard(F.col("_set"), F.col(set_col)).alias("score"))
    return scored.orderBy(F.desc("score"), id_col).limit(k)


def by_title(items: DataFrame, id_col: str = "id", title_col: str = "title") -> DataFrame:
    """(id, title, place): all items, with their place from 1 in the order of titles, then ids. Sorted by ranges, so no task holds all items."""
    rows = items.select(F.col(id_col).alias("id"), F.col(title_col).alias("title"))
    return with_place(rows, F.expr("title COLLATE UNICODE"), "id")

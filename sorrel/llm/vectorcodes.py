"""Vector code compression: product codes from Lloyd rounds with Elkan's bounds, all in integers.

Each component x becomes floor(1024 * x); a vector is cut into equal consecutive parts, and each
part position has a codebook. A round assigns every part to its nearest entry (ties to the lower
index) and replaces each entry by the floor of its parts' mean; entries without parts stay.

For every vector and part, an upper bound of the distance to its entry and a lower bound for each
entry are kept from round to round, in a table in the shared folder. Movement of the entries shifts
both. An entry is passed over only if its lower bound, or half its distance from the own entry, is
strictly above the upper bound; what is left is compared by exact integers, so that ties are real
ties. Bounds are rounded away from the distance at every step. A lower bound is written as the gap
above the upper bound, in sixteen steps of an eighth of it, always down: half a byte an entry.

A task sums its parts by entry while it assigns them, so a round is one pass over the table and one
aggregation of `parts * entries` rows a task. On the driver are only the codebooks, whose size is a
parameter.

Cases: vectors that are null, or hold a null or non-finite component, have no row in the result;
null ids come last where codebooks start, equal ids in the order of their vectors; null labels are
one label; repeated rows count each; with fewer vectors than entries, codebooks are that short; an
empty table gives an empty table; other columns are not read. Vectors of different lengths, a length
that `parts` does not divide, and components whose squared distances do not fit 64 bits are errors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import Scratch, with_totals

SCALE = 1024
PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: A lower bound is stored as so many eighths of the upper bound above it; 0 stands for no bound.
STEPS = 8
HIGHEST = 15


@dataclass(frozen=True)
class Compressed:
    """codes: (id, label, code binary, error long). entries: integers by part, entry and position. distances: how many distances each assignment computed, of how many pairs."""

    codes: DataFrame
    entries: np.ndarray
    distances: list[tuple[int, int]]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.nextafter(x, np.inf), np.inf)


def down(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(np.nextafter(x, -np.inf), -np.inf), 0)


def between_all(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to all of c; by a product of matrices where doubles hold every sum."""
    if x.size and c.size and x.shape[1] * (2.0 * max(np.abs(x).max(), np.abs(c).max())) ** 2 < 2.0**53:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None]).astype(np.int64)
    out = np.zeros((len(x), len(c)), np.int64)
    for k in range(x.shape[1]):
        out += (x[:, k, None] - c[None, :, k]) ** 2
    return out


def between(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances row by row."""
    return ((x - c) ** 2).sum(1)


@dataclass
class Bounds:
    """Of one part of a batch: own entry, upper bound by row, lower bound by row and entry."""

    own: np.ndarray
    upper: np.ndarray
    lower: np.ndarray
    computed: int


def first_bounds(x: np.ndarray, c: np.ndarray) -> Bounds:
    squares = between_all(x, c)
    own = squares.argmin(1)
    far = np.sqrt(squares.astype(np.float64))
    return Bounds(own, up(far[np.arange(len(x)), own]), down(far), squares.size)


@dataclass(frozen=True)
class Moved:
    """A codebook after a round: its entries, how far each moved at most, and half their distances from each other at least."""

    entries: np.ndarray
    moves: np.ndarray
    half: np.ndarray

    @classmethod
    def of(cls, old: np.ndarray, new: np.ndarray) -> Moved:
        return cls(new, up(np.sqrt(between(old, new).astype(np.float64))), down(np.sqrt(between_all(new, new).astype(np.float64)) / 2))


def next_bounds(x: np.ndarray, before: Bounds, book: Moved) -> Bounds:
    """Own entries and bounds against the moved codebook; distances are computed only where bounds leave a doubt."""
    own = before.own.copy()
    upper = up(before.upper + book.moves[own])
    lower = down(before.lower - book.moves[None])
    every = np.arange(len(x))
    doubt = (lower <= upper[:, None]) & (book.half[own] <= upper[:, None])
    doubt[every, own] = False
    rows = np.flatnonzero(doubt.any(1))
    squares = between(x[rows], book.entries[own[rows]])
    upper[rows] = up(np.sqrt(squares.astype(np.float64)))
    tight = upper[rows][:, None]
    at, entry = np.nonzero(doubt[rows] & (lower[rows] <= tight) & (book.half[own[rows]] <= tight))
    others = between(x[rows[at]], book.entries[entry])
    lower[rows[at], entry] = down(np.sqrt(others.astype(np.float64)))
    lower[rows, own[rows]] = down(np.sqrt(squares.astype(np.float64)))
    # the nearest by (distance, index), own entries among the others
    at, entry, found = np.concatenate([at, np.arange(len(rows))]), np.concatenate([entry, own[rows]]), np.concatenate([others, squares])
    order = np.lexsort((entry, found, at))
    best = order[np.flatnonzero(np.diff(at[order], prepend=-1))]
    own[rows] = entry[best]
    upper[rows] = up(np.sqrt(found[best].astype(np.float64)))
    return Bounds(own, upper, lower, len(found))


def pack(b: Bounds) -> tuple[np.ndarray, np.ndarray]:
    """(upper as 32-bit floats, gaps as half bytes), both on the safe side."""
    upper = np.nextafter(b.upper.astype(np.float32), np.float32(np.inf))
    wide = upper.astype(np.float64)[:, None]
    step = np.maximum(wide, 1) / STEPS
    level = np.clip(np.floor((b.lower - wide) / step) + 1, 0, HIGHEST)
    level -= (level > 0) & (wide + (level - 1) * step > b.lower)
    level = level.astype(np.uint8)
    if level.shape[1] % 2:
        level = np.pad(level, ((0, 0), (0, 1)))
    return upper, level[:, ::2] | level[:, 1::2] << 4


def unpack(upper: np.ndarray, gaps: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """(upper, lower) as doubles."""
    wide = upper.astype(np.float64)
    level = np.stack([gaps & 15, gaps >> 4], axis=2).reshape(len(gaps), -1)[:, :entries].astype(np.float64)
    lower = np.where(level > 0, down(wide[:, None] + (level - 1) * (np.maximum(wide, 1) / STEPS)[:, None]), 0.0)
    return wide, lower


def finite(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~bad


def _bytes(rows: np.ndarray) -> pa.Array:
    """One binary value a row."""
    data = np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1)
    offsets = np.arange(len(rows) + 1, dtype=np.int64) * data.shape[1]
    return pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())]).cast(pa.binary())


def _matrix(column: pa.Array, n: int, kind: type) -> np.ndarray:
    """Rows of a binary column of equal lengths."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(n, -1)


class _Pass:
    """One assignment of all vectors in one task: bounds of the round before in, bounds of this one and sums by entry out."""

    def __init__(self, books: list[Moved], first: bool, last: bool, kinds: dict[str, pa.DataType]):
        self.books, self.first, self.last, self.kinds = books, first, last, kinds
        self.entries = len(books[0].entries)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, sub = len(self.books), self.books[0].entries.shape[1]
        counts = np.zeros((parts, self.entries), np.int64)
        sums = np.zeros((parts, self.entries, sub), np.int64)
        computed = 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            x = col["x"].flatten().to_numpy().reshape(n, parts, sub) if self.first else _matrix(col["x"], n, np.int32).astype(np.int64).reshape(n, parts, sub)
            if not self.first:
                code, uppers = _matrix(col["code"], n, np.uint8), _matrix(col["upper"], n, np.float32)
                gaps = _matrix(col["gaps"], n, np.uint8).reshape(n, parts, -1)
            out = []
            for p, book in enumerate(self.books):
                v = np.ascontiguousarray(x[:, p])
                if self.first:
                    b = first_bounds(v, book.entries)
                else:
                    b = next_bounds(v, Bounds(code[:, p].astype(np.int64), *unpack(uppers[:, p], gaps[:, p], self.entries), 0), book)
                computed += b.computed
                counts[p] += np.bincount(b.own, minlength=self.entries)
                np.add.at(sums[p], b.own, v)
                out.append(b)
            owns = np.stack([b.own for b in out], 1)
            made = {"id": col["id"], "label": col["label"], "code": _bytes(owns.astype(np.uint8))}
            if self.last:
                made["error"] = pa.array(sum(between(x[:, p], book.entries[owns[:, p]]) for p, book in enumerate(self.books)))
            else:
                packed = [pack(b) for b in out]
                made |= {"x": _bytes(x.reshape(n, -1).astype(np.int32)), "upper": _bytes(np.stack([u for u, _ in packed], 1)), "gaps": _bytes(np.concatenate([g for _, g in packed], 1))}
            yield self._rows(made, n)
        p, e = np.nonzero(counts)
        yield self._rows({"part": pa.array(p, pa.int32()), "entry": pa.array(e, pa.int32()), "n": pa.array(counts[p, e]), "sums": pa.array(list(sums[p, e]), pa.list_(pa.int64()))}, len(p))
        yield self._rows({"part": pa.array([-1], pa.int32()), "n": pa.array([computed])}, 1)

    def _rows(self, made: dict[str, pa.Array], n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([made[c].cast(k) if c in made else pa.nulls(n, k) for c, k in self.kinds.items()], names=list(self.kinds))


def compress(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Compressed:
    """Codes and errors of all finite vectors, after `rounds` rounds and a last assignment."""
    if not 0 < entries <= 256:
        raise ValueError("entries must be 1 .. 256")
    spark = rows.sparkSession
    scratch = Scratch(spark, "codes")
    integers = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    kept = scratch.save(rows.where(finite(F.col(vector_col))).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), integers.alias("x")))
    largest = F.greatest(F.abs(F.array_max("x").cast("double")), F.abs(F.array_min("x").cast("double")))
    seen = kept.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most"), F.max(largest).alias("largest")).first()
    width = seen["most"] or 0
    if (seen["least"] or 0) != width or width % parts:
        raise ValueError(f"vectors have {seen['least']} to {width} components; all must have the same number, divisible by {parts}")
    if width * (2.0 * (seen["largest"] or 0) + 2) ** 2 >= 2.0**63:
        raise ValueError("squared distances of these vectors do not fit 64 bits")
    sub = width // parts
    start = kept.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    books = np.array([r["x"] for r in start], np.int64).reshape(len(start), parts, sub).transpose(1, 0, 2).copy()

    own = [T.StructField("id", kept.schema["id"].dataType), T.StructField("label", kept.schema["label"].dataType), T.StructField("code", T.BinaryType())]
    bounds = [T.StructField(c, T.BinaryType()) for c in ("x", "upper", "gaps")]
    partial = [T.StructField("part", T.IntegerType()), T.StructField("entry", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("sums", T.ArrayType(T.LongType()))]
    moved = [Moved.of(b, b) for b in books]
    state, distances = kept, []
    for k in range(rounds + 1):
        last = k == rounds
        schema = T.StructType(own + ([T.StructField("error", T.LongType())] if last else bounds) + partial)
        kinds = {f.name: to_arrow_type(f.dataType) for f in schema.fields}
        saved = scratch.save(state.mapInArrow(_Pass(moved, k == 0, last, kinds), schema) if len(start) else spark.createDataFrame([], schema))
        scratch.keep(saved)
        state = saved.where("part is null").select(*[f.name for f in schema.fields[: -len(partial)]])
        # one row for each part and entry, and the count of distances
        found = saved.where("part is not null").groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(sub)]).alias("sums")).collect()
        distances.append((sum(r["n"] for r in found if r["part"] < 0), seen["n"] * parts * len(start)))
        if not last:
            new = books.copy()
            for r in found:
                if r["part"] >= 0:
                    new[r["part"], r["entry"]] = np.array(r["sums"], np.int64) // r["n"]
            moved, books = [Moved.of(b, c) for b, c in zip(books, new)], new
    return Compressed(state, books, distances)


def with_label_errors(codes: DataFrame) -> DataFrame:
    """codes with label_error, the errors summed over equal labels, nulls together."""
    totals = codes.groupBy("label").agg(F.sum("error").alias("label_error"))
    return with_totals(codes, totals, ["label"], "id")

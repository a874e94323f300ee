"""Toxicity by a convolutional text classifier over hashed words, in numpy.

Words (runs of digits, letters and non-ASCII characters, A-Z lower-cased) are hashed into
four tables of embeddings: the whole word twice, by independent hashes, so that a word which
shares one bucket with another differs in the other, and its first 4 and 6 bytes, so that
inflected forms share what their stem has learned. A word is its four rows side by side.
Filters over 1, 2 and 3 words, a rectifier and max pooling over the whole text give the
features of a logistic output. All weights start at random. In training a text's feature is
the weighted mean of its windows, all alike at first and ever more the largest alone, so that
early steps reach every word and late ones those that max pooling picks. Steps are by Adagrad,
sparse in the tables; buckets that fewer than SUPPORT training rows have stay zero.

Labels are learned only from rows with crc32(id) mod 3 other than 1. From these, at most
TRAIN_ROWS rows and TRAIN_BYTES bytes of text are taken, by the order of a hash of the id, a quarter
of both toxic where there are enough (a text over TRAIN_LONGEST, or that does not fit in what is left, is passed over; the
lengths are looked up first, so only texts that are taken are dealt to the one task that trains); a fifth is kept to calibrate: the output's offset, so that 0.7 separates best, and a
threshold for each language of the calibration rows.

Cases: null and empty texts get the score of a text without words; languages without enough
calibration rows use the common threshold; null labels teach nothing; without any label of a
kind, every score is 0; long texts are scored whole, in bounded pieces; rows that repeat an id
are scored alike, and teach once.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import LOWER, borders, byte_class, ragged, slices, span_hashes, spread
from .common import annotate, place_of

#: Bounds of the training sample: rows, bytes of text, and bytes of one text.
TRAIN_ROWS = 6_000
TRAIN_BYTES = 32 << 20
TRAIN_LONGEST = 1 << 18
BUCKETS = 1 << 16
DIM = 4
TABLES = 4
STEMS = (4, 6)
SUPPORT = 4
FILTERS = 8
WIDTHS = (1, 2, 3)
CUT = 0.7
#: Rows seen in training, over all epochs; the rate of Adagrad; the deviation of embeddings at the start; how sharply pooling ends.
#: The best F1 of seven settings in three-fold cross-validation inside the training rows of a labelled table; held-out rows had no say.
SEEN = 40_000
RATE = 0.2
SPREAD = 0.1
SHARP = 30.0
#: Rows and words of a step.
BATCH = 48
BATCH_WORDS = 30_000
#: One text without words, of label 0, is shown for so many training rows.
BLANK = 25
#: A language needs so many calibration rows of each label for a threshold of its own.
ENOUGH = 20


def held_out(id_col: Column) -> Column:
    """Rows whose labels must not be learned from."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(3)) == 1


@dataclass
class Words:
    """Texts as bucket numbers with two empty places after each text; a column for each table."""

    buckets: np.ndarray
    first: np.ndarray


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """The words of all texts, made slice by slice: only the bucket numbers exist for all of them at once."""
    parts = [_words_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in slices(offsets)]
    if len(parts) == 1:
        return parts[0]
    first = np.concatenate([[0], *[np.diff(p.first) for p in parts]]).cumsum()
    buckets = np.concatenate([p.buckets for p in parts]) if parts else np.zeros((0, TABLES), np.int32)
    return Words(buckets, first)


def _words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    low = LOWER[data]
    starts, ends, first = borders(low, offsets, byte_class("alnum"))
    hashes = span_hashes(low, starts, ends)
    pad = len(WIDTHS) - 1
    n = len(offsets) - 1
    out = np.full((len(hashes) + pad * n, TABLES), BUCKETS, np.int32)  # BUCKETS: no word
    place = np.arange(len(hashes)) + pad * np.repeat(np.arange(n), np.diff(first))
    out[place, 0] = (hashes & np.uint64(BUCKETS - 1)).astype(np.int32)
    out[place, 1] = ((hashes >> np.uint64(40)) & np.uint64(BUCKETS - 1)).astype(np.int32)
    for t, size in enumerate(STEMS, 2):
        stem = span_hashes(low, starts, np.minimum(ends, starts + size)) if len(starts) else hashes
        out[place, t] = (stem & np.uint64(BUCKETS - 1)).astype(np.int32)
    return Words(out, first + pad * np.arange(n + 1))


@dataclass
class Model:
    tables: np.ndarray  # TABLES, BUCKETS + 1, DIM
    filters: list[np.ndarray]  # per width: width, TABLES * DIM, FILTERS
    bias: np.ndarray
    out: np.ndarray
    offset: float
    threshold: float = CUT
    thresholds: dict[str, float] = field(default_factory=dict)

    def features(self, words: Words) -> np.ndarray:
        """Max-pooled features of each text."""
        x = np.concatenate([own[words.buckets[:, t]] for t, own in enumerate(self.tables)], axis=1)
        pooled = []
        for filters in self.filters:
            y = x @ filters[0]
            for k in range(1, len(filters)):
                y[:-k] += x[k:] @ filters[k]
            pooled.append(np.maximum.reduceat(y, words.first[:-1], axis=0))
        return np.maximum(np.concatenate(pooled, axis=1) + self.bias, 0)

    def logits(self, data: np.ndarray, offsets: np.ndarray, block: int = 1 << 17) -> np.ndarray:
        """One number per text; a text of more words than a block is pooled over overlapping blocks."""
        words = words_of(data, offsets)
        n = len(offsets) - 1
        pooled = np.full((n, len(self.bias)), -np.inf, np.float32)
        size = np.diff(words.first)
        a = 0
        while a < n:
            b = max(a + 1, int(np.searchsorted(words.first, words.first[a] + block, "right")) - 1)
            if b == a + 1 and size[a] > block:
                lo, hi, step = words.first[a], words.first[a + 1], block - len(WIDTHS)
                for s in range(int(lo), int(hi), step):
                    e = min(s + block, int(hi))
                    pooled[a] = np.maximum(pooled[a], self.features(Words(words.buckets[s:e], np.array([0, e - s])))[0])
            else:
                lo = words.first[a]
                pooled[a:b] = self.features(Words(words.buckets[lo : words.first[b]], words.first[a : b + 1] - lo))
            a = b
        return pooled @ self.out + self.offset

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(data, offsets), -30, 30)))


def _supported(words: Words, n: int) -> np.ndarray:
    """Buckets that at least SUPPORT of the n texts have; the place of no word is none."""
    text_of = np.repeat(np.arange(n), np.diff(words.first))
    out = np.zeros((TABLES, BUCKETS + 1), bool)
    for t in range(TABLES):
        seen = np.unique(words.buckets[:, t].astype(np.int64) * n + text_of)
        out[t] = np.bincount(seen // n, minlength=BUCKETS + 1) >= SUPPORT
    out[:, BUCKETS] = False
    return out


def _batches(rows: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """The rows in order, at most BATCH at once and, if there are several, at most BATCH_WORDS words."""
    a, upto = 0, np.concatenate(([0], np.cumsum(size[rows])))
    while a < len(rows):
        b = max(a + 1, min(a + BATCH, int(np.searchsorted(upto, upto[a] + BATCH_WORDS, "right")) - 1))
        yield rows[a:b]
        a = b


def _pool_softly(y: np.ndarray, heads: np.ndarray, text_of: np.ndarray, sharp: float) -> np.ndarray:
    """The weight of each window in its text's pooled feature: all alike for sharp = 0, the largest alone in the limit."""
    e = np.exp(np.clip(sharp * (y - np.maximum.reduceat(y, heads, axis=0)[text_of]), -60, 0))
    return e / np.add.reduceat(e, heads, axis=0)[text_of]


def train(texts: list[str], labels: np.ndarray, langs: list[str | None], seed: int = 7) -> Model:
    """A model of the texts with labels 0 and 1; a fifth of them calibrates."""
    rng = np.random.default_rng(seed)
    n = len(texts)
    order = rng.permutation(n)
    hold = order[: n // 5]
    fit = order[n // 5 :]

    def arrays(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return ragged(pa.array([texts[i] for i in rows], pa.large_string()))

    blank = [""] * -(-len(fit) // BLANK)  # a text without known words is no toxic one
    words = words_of(*ragged(pa.array([*(texts[i] for i in fit), *blank], pa.large_string())))
    y = np.concatenate((labels[fit], np.zeros(len(blank), np.int64)))
    met = _supported(words, len(y))
    tables = (rng.normal(0, SPREAD, (TABLES, BUCKETS + 1, DIM)) * met[:, :, None]).astype(np.float32)
    filters = [rng.normal(0, 1 / math.sqrt(w * TABLES * DIM), (w, TABLES * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    m = Model(tables, filters, np.full(FILTERS * len(WIDTHS), 0.1, np.float32), rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32), 0.0)
    state = [np.full_like(x, 1e-3) for x in (m.tables, *m.filters, m.bias, m.out)]
    offset_state = 1e-3

    def step(value: np.ndarray, seen: np.ndarray, gradient: np.ndarray) -> None:
        seen += gradient * gradient
        value -= RATE * gradient / np.sqrt(seen)

    size = np.diff(words.first)
    epochs = min(40, max(6, SEEN // len(y)))
    for epoch in range(epochs):
        sharp = SHARP * (epoch / (epochs - 1)) ** 2
        for some in _batches(rng.permutation(len(y)), size):
            at = spread(words.first[some], size[some])
            text_of = np.repeat(np.arange(len(some)), size[some])
            buckets = words.buckets[at]
            heads = np.cumsum(size[some]) - size[some]
            x = np.concatenate([own[buckets[:, t]] for t, own in enumerate(m.tables)], axis=1)
            pooled, weights = [], []
            for f in m.filters:
                v = x @ f[0]
                for k in range(1, len(f)):
                    v[:-k] += x[k:] @ f[k]
                w = _pool_softly(v, heads, text_of, sharp)
                weights.append(w)
                pooled.append(np.add.reduceat(w * v, heads, axis=0))
            z = np.maximum(np.concatenate(pooled, axis=1) + m.bias, 0)
            p = 1 / (1 + np.exp(-np.clip(z @ m.out + m.offset, -30, 30)))
            g = ((p - y[some]) / len(some)).astype(np.float32)
            back = g[:, None] * m.out[None, :] * (z > 0)
            row_gradient = np.zeros_like(x)
            for k, (f, w) in enumerate(zip(m.filters, weights, strict=True)):
                g_v = w * back[text_of, k * FILTERS : (k + 1) * FILTERS]
                g_f = np.empty_like(f)
                for j in range(len(f)):
                    own = g_v[: len(g_v) - j]
                    g_f[j] = x[j:].T @ own
                    row_gradient[j:] += own @ f[j].T
                step(f, state[1 + k], g_f + 1e-4 * f)
            for t in range(TABLES):
                own, inverse = np.unique(buckets[:, t], return_inverse=True)
                total = np.stack([np.bincount(inverse, row_gradient[:, c], len(own)) for c in range(t * DIM, (t + 1) * DIM)], axis=1).astype(np.float32)
                keep = met[t, own]
                own, total = own[keep], total[keep]
                state[0][t, own] += total * total
                m.tables[t, own] -= RATE * total / np.sqrt(state[0][t, own])
            step(m.bias, state[-2], back.sum(0))
            step(m.out, state[-1], z.T @ g + 1e-4 * m.out)
            offset_state += float(g.sum()) ** 2
            m.offset -= RATE * float(g.sum()) / math.sqrt(offset_state)
    _calibrate(m, m.logits(*arrays(hold)), labels[hold], [langs[i] for i in hold])
    return m


def _best_cut(logits: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the best gap between kept and rejected rows, by the F1 of label 1."""
    order = np.argsort(-logits, kind="stable")
    x, y = logits[order], labels[order]
    hit = np.cumsum(y)
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    ends = np.append(x[1:] < x[:-1], True)  # equal logits stay together
    f1[~ends] = -1
    k = int(np.argmax(f1))
    return float((x[k] + x[k + 1]) / 2) if k + 1 < len(x) else float(x[k] - 1)


def _calibrate(m: Model, logits: np.ndarray, labels: np.ndarray, langs: list[str | None]) -> None:
    """Move the output so that the common cut lies at CUT; then a threshold for each language."""
    if labels.min(initial=1) == labels.max(initial=0):
        return
    shift = math.log(CUT / (1 - CUT)) - _best_cut(logits, labels)
    m.offset += shift
    logits = logits + shift
    for lang in {x for x in langs if x is not None}:
        own = np.array([x == lang for x in langs])
        y = labels[own]
        if min((y == 0).sum(), (y == 1).sum()) >= ENOUGH:
            m.thresholds[lang] = 1 / (1 + math.exp(-_best_cut(logits[own], y)))


def sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", lang_col: str = "lang") -> DataFrame:
    """(id, text, y, lang): at most `rows` labelled rows, a quarter of them of label 1 where there are enough, and at most `size` bytes of text."""
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1)").where(~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.max("y").alias("y")).withColumn("h", F.xxhash64("id"))
    kind = known.schema["id"].dataType.simpleString()
    chosen: list[tuple] = []
    for y, most in ((1, rows // 4), (0, rows - rows // 4)):
        chosen += [tuple(r) for r in known.where(F.col("y") == y).orderBy("h", "id").limit(most).collect()]
    lang = F.col(lang_col) if lang_col in docs.columns else F.lit(None).cast("string")
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), lang.alias("lang"))
    ids = F.broadcast(spark.createDataFrame([(i,) for i, _, _ in chosen], f"id {kind}"))
    # of rows that repeat an id, one teaches
    lengths = texts.join(ids, "id").groupBy("id").agg(F.min(F.struct(F.xxhash64("text"), F.octet_length("text"))).alias("own"))
    own = {r["id"]: tuple(r["own"]) for r in lengths.collect()}
    left, picked = {1: size // 4, 0: size - size // 4}, []
    for i, y, _ in chosen:
        if i in own and own[i][1] <= min(left[y], TRAIN_LONGEST):
            left[y] -= own[i][1]
            picked.append((i, own[i][0], y))
    want = F.broadcast(spark.createDataFrame(picked, f"id {kind}, t long, y int"))
    found = texts.withColumn("t", F.xxhash64("text")).join(want, ["id", "t"]).groupBy("id", "y").agg(F.first("text").alias("text"), F.min("lang").alias("lang"))
    return found.select("id", "text", "y", "lang")


def training_rows(docs: DataFrame, labels: DataFrame, **kw) -> list[tuple[str, int, str | None]]:
    """The sample on the driver, in the order of ids."""
    return [(r["text"], r["y"], r["lang"]) for r in sorted(sample(docs, labels, **kw).toLocalIterator(), key=lambda r: r["id"])]


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of the sample to one row: the pickled model, or nothing without labels of both kinds."""
    rows = sorted((r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)), key=lambda r: r[0])
    y = np.array([r[2] for r in rows], np.int64)
    if len(set(y.tolist())) < 2:
        return
    texts, langs = [r[1] for r in rows], [r[3] for r in rows]
    del rows
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(texts, y, langs))], pa.binary())], names=["model"])


def fit(docs: DataFrame, labels: DataFrame, **kw) -> Model:
    """A model from the labelled documents, trained in one task on the bounded sample; only its weights come to the driver."""
    got = sample(docs, labels, **kw).repartition(1).mapInArrow(_fitted, "model binary").first()
    if got is not None:
        return pickle.loads(got["model"])
    n = FILTERS * len(WIDTHS)
    return Model(np.zeros((TABLES, BUCKETS + 1, DIM), np.float32), [np.zeros((w, TABLES * DIM, FILTERS), np.float32) for w in WIDTHS], np.zeros(n, np.float32), np.zeros(n, np.float32), -30.0)


def score(docs: DataFrame, model: Model, text_col: str = "text", drop_text: bool = False) -> DataFrame:
    """docs with a column score, 0 to 1, from the text alone."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = place_of(docs, text_col, "score")

    def make():
        m = sent.value

        def each(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            data, offsets = ragged(batch.column(at))
            got = [m.scores(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in slices(offsets)]
            return {"score": pa.array(np.concatenate(got).astype(np.float64))}

        return each

    return annotate(docs, make, [T.StructField("score", T.DoubleType())], drop=(text_col,) if drop_text else ())


def rejected(model: Model, score_col: Column, lang_col: Column) -> Column:
    """True where the score reaches the threshold of the row's language."""
    limit = F.lit(model.threshold)
    for lang, t in sorted(model.thresholds.items()):
        limit = F.when(lang_col == lang, F.lit(t)).otherwise(limit)
    return score_col >= limit

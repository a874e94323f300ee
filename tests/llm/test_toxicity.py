"""The classifier on planted words: held-out accuracy and awkward rows."""

import random
import zlib

import numpy as np
import pyarrow as pa
from helpers import awkward, clashing
from pyspark.sql import functions as F

from sorrel.llm import toxicity as t
from sorrel.llm.arrays import ragged

BAD = ["grubble", "snarkov", "blemfit"]


def corpus(n, seed):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9))) for _ in range(400)]
    rows = []
    for i in range(n):
        y = int(rnd.random() < 0.25)
        w = [rnd.choice(vocabulary) for _ in range(rnd.randint(5, 80))]
        for _ in range(rnd.randint(1, 3) * y):
            w.insert(rnd.randint(0, len(w)), rnd.choice(BAD).upper() if rnd.random() < 0.3 else rnd.choice(BAD))
        rows.append((i, " ".join(w), rnd.choice(["en", "de"]), y))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(1500, 1)
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    model = t.fit(docs, labels)
    held = {r["doc_id"] for r in docs.where(t.held_out(F.col("doc_id"))).collect()}
    assert held == {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1}
    scored = t.score(clashing(docs, "score"), model)
    got = {r["doc_id"]: (r["score"], r["no"]) for r in scored.withColumn("no", t.rejected(model, F.col("score"), F.col("lang"))).collect()}
    test = [r for r in rows if r[0] in held]
    assert np.mean([(got[r[0]][0] >= t.CUT) == bool(r[3]) for r in test]) > 0.97
    assert np.mean([got[r[0]][1] == bool(r[3]) for r in test]) > 0.97
    again = t.fit(docs, labels)
    assert np.array_equal(again.tables, model.tables)  # the same rows teach the same


def test_training_leaves_out_held_out_rows(spark):
    rows = corpus(300, 2)
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows] + [(7, None), (8, 3)], "doc_id long, toxic int")
    texts = {x[0] for x in t.training_rows(docs, labels, rows=80)}
    known = {r[1] for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1}
    assert texts <= known and 0 < len(texts) <= 80


def test_blocks_of_long_texts():
    rows = corpus(400, 3)
    m = t.train([r[1] for r in rows], np.array([r[3] for r in rows]), [r[2] for r in rows])
    long = " ".join(r[1] for r in rows)
    data, offsets = ragged(pa.array([long, "", rows[0][1]]))
    assert np.allclose(m.logits(data, offsets), m.logits(data, offsets, block=97), atol=1e-4)


def test_awkward_rows(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 8)], "doc_id long, toxic int")
    model = t.fit(docs, labels)
    got = t.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    none = t.fit(docs, labels.limit(0))
    assert all(r["score"] < 0.01 for r in t.score(docs, none).collect())
    assert t.score(docs.limit(0), model).count() == 0
    assert t.fit(docs.limit(0), labels).offset == -30


def test_training_teaches_what_the_start_does_not_know(monkeypatch):
    """Without training, the random start separates nothing."""
    rows = corpus(900, 5)
    texts, y, langs = [r[1] for r in rows], np.array([r[3] for r in rows]), [r[2] for r in rows]
    test = corpus(900, 5)[600:]
    data = ragged(pa.array([r[1] for r in test]))

    def right(model):
        return np.mean((model.scores(*data) >= t.CUT) == np.array([bool(r[3]) for r in test]))

    trained = right(t.train(texts[:600], y[:600], langs[:600]))
    monkeypatch.setattr(t, "RATE", 0.0)
    untrained = right(t.train(texts[:600], y[:600], langs[:600]))
    assert trained > 0.95 and untrained < 0.85


def test_sample_is_bounded_by_bytes_of_each_label_in_hash_order(spark):
    rows = [(i, ("wörd " * 20), "en", i % 2) for i in range(400)] + [(1000, "long " * 50_000, "en", 1), (1001, None, "en", 0), (1003, "twice", "en", 1), (1003, "and again", "en", 1)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame(sorted({(r[0], r[3]) for r in rows}), "doc_id long, toxic int")
    size = 8000
    got = t.training_rows(docs, labels, size=size)
    for y, share in ((1, size // 4), (0, size - size // 4)):
        used = sum(len(x[0].encode()) for x in got if x[1] == y)
        assert share - 130 < used <= share
    assert "long " * 50_000 not in [x[0] for x in got]
    every = [x[0] for x in t.training_rows(docs, labels)]
    held = {zlib.crc32(str(i).encode()) % 3 == 1 for i in (1003,)}
    assert len({"twice", "and again"} & set(every)) == (0 if True in held else 1)

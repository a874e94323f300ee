"""One document of each group of near copies, against brute force."""

import random

import numpy as np
import pytest
from helpers import awkward, clashing
from test_simhash import clustered, groups, signed

import corpus_pipeline
from sorrel.llm import nearcopies, simhash
from sorrel.llm.common import Scratch


def shingles(t):
    w = (t or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()


def alike(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def kept(rows):
    """The least id of each component."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [rows[i][0] for i in range(len(rows)) if find(i) == i]


def planted(seed, words=200):
    """Texts with copies of 0.7 to 1.0 five-word similarity, and one large group of copies."""
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(5000)}"
    texts = []
    for g in range(40):
        base = [word() for _ in range(words)]
        texts.append(base)
        for k in range(60 if g == 0 else rnd.randint(1, 3)):
            copy = list(base)
            for i in rnd.sample(range(words), rnd.randint(1, 6)):
                copy[i] = word()
            texts.append(copy)
    texts = [" ".join(t) for t in texts] + ["one two", "one two", "one three", "", None, " \n"]
    rnd.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_stage_finds_all_copies_at_0_8(spark, seed):
    rows = planted(seed)
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r["doc_id"] for r in corpus_pipeline.simhash_stage(spark, docs, "").collect())
    assert got == kept(rows)


def test_rows_of_one_id_are_judged_alone(spark):
    a, b = planted(3)[0][1] or "x y", "a text of its own that nothing else here resembles at all"
    docs = spark.createDataFrame([(1, a), (None, a), (None, b), (7, a), (7, "another text that stands alone among all these rows")], "doc_id long, text string")
    texts = [r["text"] for r in nearcopies.keep_one(docs).collect()]
    assert len(texts) == 3 and len(set(texts)) == 3


def test_awkward_rows(spark):
    docs = clashing(awkward(spark), "s", "n", "h", "least")
    got = nearcopies.keep_one(docs)
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == [1, 3, 6, 7]
    assert nearcopies.keep_one(docs.limit(0)).count() == 0


def test_links_honour_their_radius(spark):
    fps = clustered(200, 4)
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    for radius in (1, 4):
        labels = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, len(fps), radius), Scratch(spark, "t")).collect()}
        want = groups(fps, radius)
        assert {(labels.get(signed(f), signed(f)) == labels.get(signed(g), signed(g))) == (want[f] == want[g]) for f in fps for g in fps} == {True}


def test_a_phrase_that_many_unlike_texts_share(spark, monkeypatch):
    """Its bucket is compared in tiles, and only the copies in it link."""
    monkeypatch.setattr(nearcopies, "TILE", 16)
    rnd = random.Random(8)
    word = lambda: f"w{rnd.randrange(9000)}"
    phrase = " ".join(f"p{k}" for k in range(30))
    texts = [f"{phrase} {' '.join(word() for _ in range(20))}" for _ in range(150)]
    texts += [t.rsplit(" ", 1)[0] + " other" for t in texts[::10]]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in nearcopies.keep_one(docs).collect()) == kept(rows)


def test_rows_that_repeat_an_id_and_rows_without_one(spark):
    a, b, c, d = (f"{x} text whose words are its own and which goes on {x} for a while {x}" for x in "abcd")
    docs = spark.createDataFrame([(1, a), (3, a), (3, b), (4, c), (4, d), (None, a), (None, c), (None, c)], "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["text"]) for r in nearcopies.keep_one(clashing(docs, "_id", "_h1", "_text", "h", "g", "side")).collect()))
    assert got == sorted([(0, a), (3, b), (0, c), (4, d)])


@pytest.mark.parametrize("cells", [1, 1 << 25])
def test_sets_of_tiles_are_compared_exactly(monkeypatch, cells):
    """In blocks of columns of any width, for groups whose hashes overlap."""
    monkeypatch.setattr(nearcopies, "CELLS", cells)
    rnd = random.Random(5)
    sets, group = [], []
    for g in (-7, 3, 9):
        base = rnd.sample(range(-500, 500), 180)
        for _ in range(25):
            own = set(base) - set(rnd.sample(base, rnd.randint(0, 40))) | set(rnd.sample(range(500, 700), rnd.randint(0, 9)))
            sets.append(np.array(sorted(own), np.int64))
            group.append(g)
    n = np.array([len(x) for x in sets])
    boxed = np.empty(len(sets), object)
    boxed[:] = sets
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if group[i] == group[j]]
    a, b = np.array(pairs).T
    want = [5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j])) for i, j in pairs]
    assert 0 < sum(want) < len(want)
    assert nearcopies.alike(np.array(group), n, boxed, a, b).tolist() == want


def test_folded_vectors_never_differ_in_more_than_the_sets():
    """At every width, also of sets far longer than their vectors; equal sets do not differ."""
    rnd = np.random.default_rng(6)
    for n in (0, 1, 5, 63, 64, 65, 700, 200_000):
        base = rnd.integers(0, 1 << 63, n, np.int64).astype(np.uint64)
        other = np.concatenate((base[: n - n // 10], rnd.integers(0, 1 << 63, n // 12 + 1, np.int64).astype(np.uint64)))
        bits = np.empty(2, object)
        bits[:] = [nearcopies.folded(base), nearcopies.folded(other)]
        assert all(len(x) % 8 == 0 and len(x) * 8 <= nearcopies.MOST_BITS for x in bits)
        for words in {1, min(map(len, bits)) // 8}:
            a, b = nearcopies.in_words(bits, words)
            assert int(np.bitwise_count(a ^ b).sum()) <= len(np.setxor1d(base, other))
            assert int(np.bitwise_count(a ^ a).sum()) == 0


def test_links_at_exactly_4_of_5_are_found(spark):
    """Pairs of sets of n hashes with 8 n / 9 of them in common, of many sizes; one hash fewer is no link."""
    rows, want = [], []
    for k, n in enumerate((9, 18, 45, 90, 900)):
        words = [f"{k}x{i}" for i in range(n + 4)]
        for j, lost in enumerate((n // 9, n // 9 + 1)):
            # the last words are others, so that `lost` of n runs are
            tail = [f"{k}y{j}y{i}" for i in range(lost)]
            first = [f"{j}z{w}" for w in words]
            rows += [(100 * k + 10 * j, " ".join(first)), (100 * k + 10 * j + 1, " ".join(first[: n + 4 - lost] + tail))]
            want += [100 * k + 10 * j] + [100 * k + 10 * j + 1] * j
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r["doc_id"] for r in nearcopies.keep_one(docs).collect())
    assert got == sorted(want) == kept(rows)

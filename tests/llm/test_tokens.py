"""Encoding, decoding and counting against the tokenizers library."""

import hashlib

import numpy as np
import pytest
from helpers import awkward, clashing
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sorrel.llm import bpe, pretokens, tokencount
from sorrel.llm.queries import vocabulary_path

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(vocabulary_path())


PIECES = st.sampled_from(["a", "'s", "'ll", "'", "'re", "'t", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", "1", "23", "٣", "!", "?!", "<|endoftext|>", "<|", "é", "中", "\U0001f600", "the", "ing", "AA", "́", "‍"])
TEXTS = st.one_of(st.lists(PIECES, max_size=25).map("".join), st.text(st.characters(exclude_categories=["Cs"]), max_size=30))


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=4))
def test_same_as_the_library(texts):
    lib = tokenizers.Tokenizer.from_file(vocabulary_path()) if not hasattr(test_same_as_the_library, "lib") else test_same_as_the_library.lib
    test_same_as_the_library.lib = lib
    codec, counter = bpe.codec(vocabulary_path()), tokencount.counter(vocabulary_path())
    want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
    ids, offsets = codec.encode_all(texts)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == want
    assert counter.count(texts).tolist() == [len(w) for w in want]
    for w in want:
        assert codec.decode(np.array(w, np.int64)).decode("utf-8", "replace") == lib.decode(w, skip_special_tokens=False)


def test_merges_of_random_words(library):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghijklmnoprstuvw"), rng.integers(1, 30))) for _ in range(3000)] + ["a" * 999, "aba" * 500]
    want = [len(library.encode(w, add_special_tokens=False).ids) for w in words]
    merger = tokencount.counter(vocabulary_path()).merger
    assert merger.counts([w.encode() for w in words]).tolist() == want
    encoder = bpe.codec(vocabulary_path()).encoder
    assert [len(encoder.ranks(w.encode())) for w in words] == want
    assert merger.counts([]).tolist() == [] and merger.counts([b""]).tolist() == [0]


def test_long_texts_are_cut_where_no_word_spans(monkeypatch):
    monkeypatch.setattr(pretokens, "PART_CHARS", 50)
    text = "some words,  then\n\n more'll <|endoftext|> come " * 40
    lookup = pretokens.Lookup(["<|endoftext|>"], 10)
    seen = []
    values, offsets = lookup.values([text, None, "", text], lambda words: (seen.extend(words), np.arange(len(seen) - len(words), len(seen)))[1])
    whole = [w for i, part in enumerate(text.split("<|endoftext|>")) for w in ([] if not i else ["<|endoftext|>"]) + pretokens.split(part)]
    assert [seen[v] for v in values[: offsets[1]]] == whole
    assert offsets.tolist() == [0, len(whole), len(whole), len(whole), 2 * len(whole)]


def thue_morse(n, letters="th"):
    """Words of which one and its complement share every polynomial hash modulo 2**64 from 1,024 letters on."""
    return "".join(letters[i.bit_count() % 2] for i in range(n))


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_words_that_share_a_hash(library, n):
    a, b = thue_morse(n), thue_morse(n, "ht")
    for texts in ([a, b], [f"x {a} {b} {a}"], [b], [f"{b} {a}\n", a]):
        codec, counter = bpe.codec(vocabulary_path()), tokencount.counter(vocabulary_path())
        want = [library.encode(t, add_special_tokens=False).ids for t in texts]
        ids, offsets = codec.encode_all(texts)
        assert [ids[s:e].tolist() for s, e in zip(offsets, offsets[1:], strict=False)] == want
        assert counter.count(texts).tolist() == [len(w) for w in want]
        assert [codec.decode(ids[s:e]).decode() for s, e in zip(offsets, offsets[1:], strict=False)] == texts


@pytest.mark.parametrize("distinct", [1, 7])
def test_any_hash_will_do(library, monkeypatch, distinct):
    """With a hash of a few values only, results stay the same: words are told apart by their characters."""
    monkeypatch.setattr(pretokens, "span_hashes", lambda text, starts, ends: (text[starts].astype(np.uint64) * np.uint64(31) + (ends - starts).astype(np.uint64)) % np.uint64(distinct))
    rng = np.random.default_rng(5)
    codec, counter = bpe.Codec(vocabulary_path()), tokencount.Counter(vocabulary_path())
    for _ in range(5):
        texts = [" ".join("".join(rng.choice(list("abcé中"), rng.integers(1, 6))) for _ in range(rng.integers(0, 40))) for _ in range(20)]
        want = [library.encode(t, add_special_tokens=False).ids for t in texts]
        ids, offsets = codec.encode_all(texts)
        assert [ids[s:e].tolist() for s, e in zip(offsets, offsets[1:], strict=False)] == want
        assert counter.count(texts).tolist() == [len(w) for w in want]


def test_awkward_rows(spark, library):
    docs = awkward(spark)
    rows = docs.collect()
    want = sorted((r["doc_id"], len(library.encode(r["text"] or "", add_special_tokens=False).ids), hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in rows)
    got = bpe.digests(docs, vocabulary_path()).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in got) == want
    counted = tokencount.count_tokens(clashing(docs, "n_tokens", "over_limit"), vocabulary_path())
    assert sorted((r["doc_id"], r["n_tokens"]) for r in counted.collect()) == [w[:2] for w in want]
    assert all(r["over_limit"] == (r["n_tokens"] > 512) and r["n_bytes"] == len((r["text"] or "").encode()) for r in counted.collect())
    back = bpe.decode(bpe.encode(clashing(docs, "ids", "decoded"), vocabulary_path()), vocabulary_path())
    assert all(r["decoded"] == (r["text"] or "") for r in back.collect())
    empty = docs.limit(0)
    assert bpe.digests(empty, vocabulary_path()).count() == 0 and tokencount.count_tokens(empty, vocabulary_path()).count() == 0


def test_ids_that_are_no_utf8(spark):
    path = vocabulary_path()
    ids = bpe.codec(path).encode("中").tolist()
    row = spark.createDataFrame([(ids[:1],), (None,)], "ids array<int>")
    assert [r["decoded"] for r in bpe.decode(row, path).orderBy(F.col("ids").isNull()).collect()] == ["�", ""] or len(ids) == 1

"""Token counts by rank-synchronous merging of ragged arrays.

The pre-tokens of a batch of texts that no cache knows lie end to end in one array of
symbols, their lengths in another. In each round every pre-token applies its own
lowest-ranked pair, at all its places, in the same few numpy calls; pre-tokens without a
mergeable pair leave the arrays with their number of surviving symbols.

Cases: a null or empty text has 0 bytes and 0 tokens; a special string counts as one
token, as the library's default; repeated rows give repeated rows; long texts are split
piece by piece.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrays import ragged, slices
from .common import annotate, place_of
from .pretokens import Lookup, Vocabulary

#: Pre-tokens that a worker keeps with their counts, and symbols that are merged at once.
CACHED = 1_000_000
AT_ONCE = 1 << 20
NONE = np.int64(1 << 40)


class Merger:
    """Counts of surviving symbols of many words at once."""

    def __init__(self, vocabulary: Vocabulary):
        n = self.n = len(vocabulary.tokens)
        keys = np.array([a * n + b for a, b in vocabulary.split[256:]], np.int64)
        self.bits = 18
        self.factor = np.uint64(0x9E3779B97F4A7C15)
        # open hashing: bucket -> its few keys side by side
        slot = self._slot(keys)
        order = np.argsort(slot, kind="stable")
        slot, place = slot[order], np.arange(len(keys))
        place = place - np.searchsorted(slot, slot)
        self.width = int(place.max()) + 1
        self.keys = np.full((self.width, 1 << self.bits), -1, np.int64)
        self.ranks = np.full((self.width, 1 << self.bits), NONE, np.int64)
        self.keys[place, slot] = keys[order]
        self.ranks[place, slot] = order + 256

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * self.factor) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; NONE if it never merges."""
        keys = left * self.n + right
        slot = self._slot(keys)
        out = np.full(len(keys), NONE, np.int64)
        rest = np.arange(len(keys))
        for w in range(self.width):
            there = self.keys[w][slot]
            hit = there == keys
            out[rest[hit]] = self.ranks[w][slot[hit]]
            go = ~hit & (there >= 0)
            if not go.any():
                break
            rest, slot, keys = rest[go], slot[go], keys[go]
        return out

    def counts(self, words: list[bytes]) -> np.ndarray:
        """The number of tokens of each word."""
        out = np.empty(len(words), np.int64)
        a, size = 0, 0
        for b, w in enumerate(words):
            size += len(w)
            if size >= AT_ONCE or b == len(words) - 1:
                out[a : b + 1] = self._counts(words[a : b + 1])
                a, size = b + 1, 0
        return out

    def _counts(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros(len(words), np.int64)
        symbols = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        who = np.flatnonzero(lengths)
        lengths = lengths[who]
        firsts = np.cumsum(lengths) - lengths
        # ranks[i]: of the pair (i, i + 1); NONE at a word's last symbol
        ranks = np.full(len(symbols), NONE, np.int64)
        ranks[:-1] = self.rank(symbols[:-1], symbols[1:])
        ranks[firsts + lengths - 1] = NONE
        while len(who):
            low = np.minimum.reduceat(ranks, firsts)
            done = low == NONE
            if done.any():
                out[who[done]] = lengths[done]
                keep = ~done
                mask = np.repeat(keep, lengths)
                symbols, ranks = symbols[mask], ranks[mask]
                who, lengths, low = who[keep], lengths[keep], low[keep]
                if not len(who):
                    break
                firsts = np.cumsum(lengths) - lengths
            word = np.repeat(np.arange(len(who)), lengths)
            hit = ranks == low[word]
            at = np.flatnonzero(hit)
            # of places in a row (x x x), every other one merges, from the left
            new_run = np.ones(len(at), bool)
            new_run[1:] = np.diff(at) != 1
            run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run_start) % 2 == 0]
            symbols[at] = ranks[at]  # a merged symbol is its rank
            gone = np.zeros(len(symbols), bool)
            gone[at + 1] = True
            lengths = lengths - np.bincount(word[at], minlength=len(who))
            # a merge changes the pairs before and after it
            stays = np.flatnonzero(~gone)
            where = np.searchsorted(stays, at)
            last = np.cumsum(lengths) - 1
            symbols, ranks = symbols[stays], ranks[stays]
            ends = np.zeros(len(symbols), bool)
            ends[last] = True
            near = np.unique(np.concatenate((where, where[where > 0] - 1)))
            near = near[near < len(symbols)]
            ranks[near] = NONE
            inner = near[~ends[near]]
            ranks[inner] = self.rank(symbols[inner], symbols[inner + 1])
            firsts = last - lengths + 1
        return out


class Counter:
    """Token counts of texts, for the workers."""

    def __init__(self, path: str):
        vocabulary = Vocabulary(path)
        self.special = set(vocabulary.special)
        self.merger = Merger(vocabulary)
        self.lookup = Lookup(list(self.special), CACHED)

    def _make(self, words: list[str]) -> np.ndarray:
        out = self.merger.counts([w.encode("utf-8", "surrogatepass") for w in words])
        for i, w in enumerate(words):
            if w in self.special:
                out[i] = 1
        return out

    def count(self, texts: list[str | None]) -> np.ndarray:
        if self.lookup.full():
            self.lookup.clear()
        values, offsets = self.lookup.values(texts, self._make)
        upto = np.concatenate(([0], np.cumsum(values)))
        return np.diff(upto[offsets])


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 512, text_col: str = "text", drop_text: bool = False) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit (n_tokens > limit)."""
    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    at = place_of(docs, text_col, *[f.name for f in fields])

    def make():
        c = counter(path)

        def each(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            column = batch.column(at)
            _, offsets = ragged(column)
            n = np.concatenate([c.count(column.slice(a, b - a).to_pylist()) for a, b in slices(offsets)])
            return {"n_bytes": pa.array(np.diff(offsets)), "n_tokens": pa.array(n), "over_limit": pa.array(n > limit)}

        return each

    return annotate(docs, make, fields, drop=(text_col,) if drop_text else ())

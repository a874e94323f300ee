"""BPE encoding and decoding: a backtracking encoder in linear time, and a decoder over an offset table.

Encoding walks a pre-token from left to right. At each place it tries the longest
vocabulary token that starts there (found for all places in one Aho-Corasick pass), then
that token's next shorter prefix tokens. A token is taken if it may follow the one before
it: `Pairs` holds, for two tokens, whether merging could ever join bytes across their
border; if it could, exact BPE would not put that border there. With no token left the
walk goes back one token and marks the place as dead, so each place is tried once. The
result equals merging by rank, because exactly one sequence of tokens has only compatible
neighbours.

Decoding keeps all token bytes in one array with an offset table: lengths of a batch's
ids, their running sums, and one gather give the bytes of all texts.

Cases: a null or empty text has no ids and decodes to the empty text; special strings
inside a text become their own id, as the library's default; rows that repeat give
repeated rows; long texts are split piece by piece; other columns pass through.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrays import ragged, slices, spread
from .common import annotate, place_of
from .pretokens import Lookup, Vocabulary

#: Pre-tokens that a worker keeps with their ids, and pairs with their answer.
CACHED = 250_000
PAIRS = 250_000


class Pairs(dict):
    """The pair-compatibility table, filled as pairs are met: (left * n + right) -> whether the border between them holds."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.split, self.n = vocabulary.split, len(vocabulary.tokens)
        self.joined = {a * self.n + b: r for r, (a, b) in enumerate(vocabulary.split) if r > 255}

    def __missing__(self, key: int) -> bool:
        if len(self) > PAIRS:
            self.clear()
        left, right = divmod(key, self.n)
        # Undo merges on both sides, latest first. At any time a merge of what now touches the
        # border wins over the border if it comes before the merges that were undone there.
        bound = 1 << 60
        ok = True
        while True:
            made = self.joined.get(left * self.n + right)
            if made is not None and made < bound:
                ok = False
                break
            if left > right or right < 256:
                if left < 256:
                    break
                bound, left = left, self.split[left][1]
            else:
                bound, right = right + 1, self.split[right][0]
        self[key] = ok
        return ok


class Encoder:
    """Exact BPE of pre-tokens by backtracking."""

    def __init__(self, vocabulary: Vocabulary):
        self.rank = {t.decode("latin-1"): r for r, t in enumerate(vocabulary.tokens)}
        self.length = [len(t) for t in vocabulary.tokens]
        self.matches = ahocorasick.Automaton()
        for s, r in self.rank.items():
            self.matches.add_word(s, (len(s), r))
        self.matches.make_automaton()
        self.shorter = [-1] * len(vocabulary.tokens)  # the longest proper prefix that is a token
        for s, r in self.rank.items():
            for k in range(len(s) - 1, 0, -1):
                if (p := self.rank.get(s[:k])) is not None:
                    self.shorter[r] = p
                    break
        self.pairs = Pairs(vocabulary)

    def ranks(self, data: bytes) -> list[int]:
        text, n = data.decode("latin-1"), len(data)
        longest = [0] * n
        size = [0] * n
        for end, (k, r) in self.matches.iter(text):
            at = end - k + 1
            if k > size[at]:
                size[at], longest[at] = k, r
        out: list[int] = []
        alive = bytearray(b"\x01") * (n + 1)
        pairs, length, shorter, m = self.pairs, self.length, self.shorter, self.pairs.n
        at, token = 0, longest[0] if n else -1
        while at < n:
            end = at + length[token]
            if alive[end] and (not out or pairs[out[-1] * m + token]):
                out.append(token)
                at = end
                if at < n:
                    token = longest[at]
                continue
            token = shorter[token]
            while token < 0:  # nothing fits here: go back
                alive[at] = 0
                token = out.pop()
                at -= length[token]
                token = shorter[token]
        return out


class Codec:
    """Texts to ids and back, for the workers."""

    def __init__(self, path: str):
        vocabulary = Vocabulary(path)
        self.special, self.ids = vocabulary.special, vocabulary.ids
        self.encoder = Encoder(vocabulary)
        self.lookup = Lookup(list(self.special), CACHED)
        self.reset()
        top = max(vocabulary.by_id) + 1
        parts = [vocabulary.by_id.get(i, b"") for i in range(top)]
        self.offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)

    def reset(self) -> None:
        """Forget the known words: their ids lie end to end in `flat`."""
        self.lookup.clear()
        self.flat, self.used = np.empty(1 << 20, np.uint32), 0
        self.at = np.zeros(1 << 18, np.int64)  # where a word's ids start
        self.size = np.zeros(1 << 18, np.int64)
        self.words = 0

    def _make(self, words: list[str]) -> np.ndarray:
        ranks, ids = self.encoder.ranks, self.ids
        got = [[self.special[w]] if w in self.special else [ids[r] for r in ranks(w.encode("utf-8", "surrogatepass"))] for w in words]
        size = np.fromiter(map(len, got), np.int64, len(got))
        total = int(size.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate((self.flat, np.empty_like(self.flat)))
        while self.words + len(got) > len(self.at):
            self.at, self.size = np.concatenate((self.at, np.zeros_like(self.at))), np.concatenate((self.size, np.zeros_like(self.size)))
        self.flat[self.used : self.used + total] = [i for x in got for i in x]
        where = np.arange(self.words, self.words + len(got))
        self.at[where], self.size[where] = self.used + np.cumsum(size) - size, size
        self.used += total
        self.words += len(got)
        return where

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, offsets by text)."""
        if self.lookup.full():
            self.reset()
        words, offsets = self.lookup.values(texts, self._make)
        size = self.size[words]
        upto = np.concatenate(([0], np.cumsum(size)))
        return self.flat[spread(self.at[words], size)], upto[offsets]

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray, block: int = 1 << 19) -> bytes:
        out = []
        for a in range(0, len(ids), block):
            some = ids[a : a + block].astype(np.int64)
            starts = self.offsets[some]
            out.append(self.bytes[spread(starts, self.offsets[some + 1] - starts)].tobytes())
        return b"".join(out)


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One per worker process and vocabulary: its caches outlive a task."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", same_col: str | None = None) -> DataFrame:
    """docs with their ids as an array column; path: a byte-level BPE vocabulary file present on every machine.

    same_col: the name of a column that says whether the ids decode to the text, decoded in the same pass."""
    at = place_of(docs, text_col, ids_col, same_col)
    fields = [T.StructField(ids_col, T.ArrayType(T.IntegerType()))] + ([T.StructField(same_col, T.BooleanType())] if same_col else [])

    def make():
        c = codec(path)

        def each(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            data, borders = ragged(batch.column(at))
            parts, sizes, same = [], [], []
            for a, b in slices(borders):
                ids, offsets = c.encode_all(batch.column(at).slice(a, b - a).to_pylist())
                parts.append(ids)
                sizes.append(np.diff(offsets))
                if same_col:
                    same += [c.decode(ids[s:e]) == data[borders[a + k] : borders[a + k + 1]].tobytes() for k, (s, e) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))]
            offsets = np.concatenate(([0], np.cumsum(np.concatenate(sizes)))).astype(np.int32)
            out = {ids_col: pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts).astype("<u4").view(np.int32)))}
            return out | ({same_col: pa.array(same)} if same_col else {})

        return each

    return annotate(docs, make, fields)


def decode(rows: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """rows with the text of their ids; bytes that are no UTF-8 become U+FFFD."""
    at = place_of(rows, ids_col, text_col)

    def make():
        c = codec(path)

        def each(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            return {text_col: pa.array([c.decode(np.asarray(x.values)).decode("utf-8", "replace") if x.is_valid else "" for x in batch.column(at)], pa.string())}

        return each

    return annotate(rows, make, [T.StructField(text_col, T.StringType())])


def as_utf8(text: bytes) -> bytes:
    """What is no UTF-8 becomes U+FFFD."""
    try:
        text.decode("utf-8")
    except UnicodeDecodeError:
        return text.decode("utf-8", "replace").encode()
    return text


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): both directions in one pass, without ids or texts leaving the worker."""
    rows = docs.select(id_col, text_col)

    def make():
        c = codec(path)

        def each(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            column = batch.column(1)
            _, borders = ragged(column)
            count, hashed, back = [], [], []
            for a, b in slices(borders):
                ids, offsets = c.encode_all(column.slice(a, b - a).to_pylist())
                packed = ids.astype("<u4").tobytes()
                for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    count.append(e - s)
                    hashed.append(hashlib.sha256(packed[4 * s : 4 * e]).hexdigest())
                    text = c.decode(ids[s:e])
                    back.append(hashlib.sha256(as_utf8(text)).hexdigest())
            return {"n_tokens": pa.array(count, pa.int64()), "ids_sha256": pa.array(hashed, pa.string()), "decoded_sha256": pa.array(back, pa.string())}

        return each

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return annotate(rows, make, fields, drop=(text_col,))

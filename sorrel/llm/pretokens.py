"""Byte-level BPE vocabularies, the split of texts into pre-tokens in numpy, and bounded tables of known pre-tokens."""

from __future__ import annotations

import json

import numpy as np
import regex

from .arrays import span_hashes, spread

#: The word split of byte-level vocabularies (a fixed, public pattern).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabulary files, by rule: printable bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens by merge rank: the 256 bytes first, then one token per merge; with the file's ids and special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        model = spec["model"]
        ids: dict[str, int] = model["vocab"]
        self.tokens: list[bytes] = [bytes([b]) for b in range(256)]
        by_byte = {b: ids[c] for c, b in letters.items()}
        self.ids: list[int] = [by_byte[b] for b in range(256)]
        self.split: list[tuple[int, int]] = [(b, b) for b in range(256)]
        rank = {c: b for c, b in letters.items()}
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            if a + b in rank:
                raise ValueError(f"two merges make the same token: {a + b!r}")
            rank[a + b] = len(self.tokens)
            self.split.append((rank[a], rank[b]))
            self.tokens.append(bytes(letters[c] for c in a + b))
            self.ids.append(ids[a + b])
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.by_id: dict[int, bytes] = {i: t for i, t in zip(self.ids, self.tokens, strict=True)} | {i: s.encode() for s, i in self.special.items()}


def split(text: str) -> list[str]:
    """The pre-tokens of one text by the pattern itself; `Splitter` gives the same for many texts at once."""
    return regex.findall(PATTERN, text)


LETTER, NUMBER, SPACE, OTHER = range(4)
#: Longer texts are cut into parts before white space, where no pre-token spans the cut.
PART_CHARS = 1 << 19


class Splitter:
    """Pre-tokens of many texts at once, from runs of character classes.

    A run of letters, of numbers or of other characters is a pre-token, with a blank
    before it if there is one. Of white space, all but the last character goes alone if
    something follows. An apostrophe that stands alone takes one of a few endings with it.
    """

    def __init__(self, special: list[str]):
        self.special = special
        self.whole = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        self.kind = np.full(0x110000, OTHER, np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pattern, every):
                self.kind[ord(m[0][0]) : ord(m[0][-1]) + 1] = kind
        self.kind[0xD800:0xE000] = OTHER

    def parts(self, texts: list[str | None]) -> tuple[list[str], list[int], list[int]]:
        """(parts, owners, special): texts cut at special strings and, if long, before white space."""
        parts: list[str] = []
        owners: list[int] = []
        special: list[int] = []
        for i, text in enumerate(texts):
            if not text:
                continue
            cuts = self.whole.split(text) if self.whole and any(s in text for s in self.special) else [text]
            for k, part in enumerate(cuts):
                if k % 2:
                    special.append(len(parts))
                a = 0
                while not k % 2 and len(part) - a > PART_CHARS and (m := regex.compile(r"(?<=\S)\s").search(part, a + PART_CHARS)):
                    parts.append(part[a : m.start()])
                    owners.append(i)
                    a = m.start()
                if a < len(part):
                    parts.append(part[a:])
                    owners.append(i)
        return parts, owners, special

    def starts(self, parts: list[str], special: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(code points, first characters of pre-tokens, offsets of the parts)."""
        text = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        offsets = np.concatenate(([0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))))
        n = len(text)
        kind = self.kind[text]
        change = np.ones(n, bool)
        change[1:] = kind[1:] != kind[:-1]
        change[offsets[:-1]] = True
        head = np.zeros(n + 1, bool)
        head[offsets] = True
        run = np.flatnonzero(change)
        end = np.append(run[1:], n)
        space = kind[run] == SPACE
        start = change  # each run, but for those that a blank before them joins
        blank = np.zeros(n, bool)
        blank[1:] = text[:-1] == 0x20
        blank[offsets[:-1]] = False
        start[run[~space & blank[run]]] = False
        start[end[space & ~head[end]] - 1] = True
        # apostrophes
        one = np.flatnonzero((end - run == 1) & (text[run] == 0x27) & ~blank[run] & ~head[end])
        one = one[kind[end[one]] == LETTER] if len(one) else one
        if len(one):
            at, stop = end[one], end[one + 1]
            c = text[at]
            d = np.where(at + 1 < stop, text[np.minimum(at + 1, n - 1)], 0)
            is_ = lambda x, *of: np.isin(x, [ord(y) for y in of])
            took = np.where(is_(c, "s", "t", "m", "d"), 1, np.where((is_(c, "r", "v") & is_(d, "e")) | (is_(c, "l") & is_(d, "l")), 2, 0))
            at, stop, took = at[took > 0], stop[took > 0], took[took > 0]
            start[at] = False
            rest = at + took < stop
            start[(at + took)[rest]] = True
        for k in special:
            start[offsets[k] + 1 : offsets[k + 1]] = False
        return text, np.flatnonzero(start), offsets


class Known:
    """A bounded table from words, as runs of code points, to integers. Words are found by a 64-bit key and confirmed by their characters."""

    def __init__(self, limit: int):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        none = np.zeros(0, np.int64)
        self.sides = [(np.zeros(0, np.uint64), none)] * 2  # keys and entries: many, and the latest few
        self.chars, self.used, self.n = np.empty(1 << 16, np.uint32), 0, 0
        self.at, self.size, self.value = (np.empty(1 << 12, np.int64) for _ in range(3))

    def full(self) -> bool:
        """More words than the limit, or more than 16 characters a word on average."""
        return self.n > self.limit or self.used > 16 * self.limit

    def find(self, keys: np.ndarray, text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value of each word, -1 for an unknown one; whether its key is taken, by itself or another word)."""
        entry = np.full(len(keys), -1, np.int64)
        for have, entries in self.sides:
            if len(have):
                place = np.minimum(np.searchsorted(have, keys), len(have) - 1)
                hit = have[place] == keys
                entry[hit] = entries[place[hit]]
        taken = entry >= 0
        which = np.flatnonzero(taken)
        same = same_spans(text, starts[which], sizes[which], self.chars, self.at[entry[which]], self.size[entry[which]])
        out = np.full(len(keys), -1, np.int64)
        out[which[same]] = self.value[entry[which[same]]]
        return out, taken

    def add(self, keys: np.ndarray, text: np.ndarray, starts: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> None:
        """keys: none of them taken."""
        total, n = int(sizes.sum()), len(keys)
        self.chars = _grown(self.chars, self.used + total)
        self.at, self.size, self.value = (_grown(x, self.n + n) for x in (self.at, self.size, self.value))
        self.chars[self.used : self.used + total] = text[spread(starts, sizes)]
        own = np.arange(self.n, self.n + n)
        self.at[own], self.size[own], self.value[own] = self.used + np.cumsum(sizes) - sizes, sizes, values
        self.used, self.n = self.used + total, self.n + n
        (many, me), (few, fe) = self.sides
        few, fe = np.concatenate((few, keys)), np.concatenate((fe, own))
        if len(few) > 50_000:
            many, me, few, fe = np.concatenate((many, few)), np.concatenate((me, fe)), few[:0], fe[:0]
            order = np.argsort(many)
            many, me = many[order], me[order]
        order = np.argsort(few)
        self.sides = [(many, me), (few[order], fe[order])]


def _grown(x: np.ndarray, least: int) -> np.ndarray:
    """x, or a longer copy with room for `least` entries."""
    if least <= len(x):
        return x
    out = np.empty(max(least, 2 * len(x)), x.dtype)
    out[: len(x)] = x
    return out


def same_spans(x: np.ndarray, x_at: np.ndarray, x_size: np.ndarray, y: np.ndarray, y_at: np.ndarray, y_size: np.ndarray) -> np.ndarray:
    """Whether each span of x has the same units as the span of y beside it."""
    same = x_size == y_size
    which = np.flatnonzero(same & (x_size > 0))
    if len(which):
        size = x_size[which]
        differ = x[spread(x_at[which], size)] != y[spread(y_at[which], size)]
        if differ.any():
            same[which] = np.add.reduceat(differ, np.cumsum(size) - size, dtype=np.int64) == 0
    return same


class Lookup:
    """Texts to the values of their pre-tokens. Each distinct pre-token of a slice is looked up once;
    make() gets the unknown ones.

    Equal pre-tokens are found by a 64-bit hash and compared by their characters. Those that share
    the hash of another one get their values from make() each time, by themselves."""

    def __init__(self, special: list[str], limit: int):
        self.splitter, self.known = Splitter(special), Known(limit)
        self.alone = 0

    def full(self) -> bool:
        return self.known.full() or self.alone > self.known.limit

    def clear(self) -> None:
        self.known.clear()
        self.alone = 0

    def values(self, texts: list[str | None], make) -> tuple[np.ndarray, np.ndarray]:
        """(value of every pre-token, offsets by text)."""
        parts, owners, special = self.splitter.parts(texts)
        if not parts:
            return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        out, sizes = [], np.zeros(len(texts), np.int64)
        a, chars = 0, 0
        marked = set(special)
        for b in range(len(parts)):
            chars += len(parts[b])
            if chars >= PART_CHARS or b == len(parts) - 1:
                v, count = self._values(parts[a : b + 1], [k - a for k in range(a, b + 1) if k in marked] if marked else [], make)
                out.append(v)
                np.add.at(sizes, owners[a : b + 1], count)
                a, chars = b + 1, 0
        return np.concatenate(out), np.concatenate(([0], np.cumsum(sizes)))

    def _values(self, parts: list[str], special: list[int], make) -> tuple[np.ndarray, np.ndarray]:
        text, starts, offsets = self.splitter.starts(parts, special)
        sizes = np.diff(np.append(starts, len(text)))
        keys, first, inverse = np.unique(span_hashes(text, starts, starts + sizes), return_index=True, return_inverse=True)
        rep = first[inverse]
        # pre-tokens tile the text, so those of one key are compared in one go
        if (sizes == sizes[rep]).all() and (text == text[spread(starts[rep], sizes)]).all():
            own = rep[:0]
        else:
            own = np.flatnonzero(~same_spans(text, starts, sizes, text, starts[rep], sizes[rep]))  # not what their key stands for
        values, taken = self.known.find(keys, text, starts[first], sizes[first])
        joined = text.tobytes()

        def words(at: np.ndarray) -> list[str]:
            return [joined[4 * i : 4 * (i + n)].decode("utf-32-le", "surrogatepass") for i, n in zip(starts[at].tolist(), sizes[at].tolist(), strict=True)]

        new = np.flatnonzero(values < 0)
        if len(new):
            values[new] = make(words(first[new]))
            fresh = new[~taken[new]]
            self.known.add(keys[fresh], text, starts[first[fresh]], sizes[first[fresh]], values[fresh])
            self.alone += len(new) - len(fresh)
        out = values[inverse]
        if len(own):
            out[own] = make(words(own))
            self.alone += len(own)
        return out, np.diff(np.searchsorted(starts, offsets))

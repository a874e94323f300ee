"""Chat formatting by columnar byte assembly.

Rows are dealt by conversation and sorted by turn; each Arrow batch is then one piece of
numpy work. Every row is a header (role), its text with control strings escaped, and a
footer. Segment lengths give cumulative offsets, offsets give scatter indices, and all
headers, texts and footers are copied into one preallocated Arrow buffer at once.

Template: `<|im_start|>` role `\\n` text `<|im_end|>` `\\n`. In texts a `<`, any number of
backslashes and a `|` get one more backslash after the `<`, so that no text holds a
control string; taking one away restores the text. Roles write `%`, `<` and newlines as
%XX. The loss mask covers the texts of assistant rows, without header and footer.

A conversation may be longer than one batch: it comes out in chunks, numbered, that belong
end to end; no task ever holds a whole long conversation. `read_back` parses the chunks in
order and needs no more memory either.

Cases: a null text is empty; a null role is empty; null turns come first; rows of equal turn
are ordered by role and text, and rows that repeat are all kept; rows of a null conv_id are
one conversation; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import ragged, slices, spread

START, END = b"<|im_start|>", b"<|im_end|>"
LT, BAR, BACKSLASH = 0x3C, 0x7C, 0x5C
LOSS_ROLE = "assistant"
FORMATTED = "conv_id {}, chunk long, n_turns long, formatted string, loss_start array<long>, loss_stop array<long>"


def _role(role: str) -> bytes:
    return role.replace("%", "%25").replace("\n", "%0A").replace("<", "%3C").encode()


def _unrole(role: bytes) -> str:
    return role.decode().replace("%3C", "<").replace("%0A", "\n").replace("%25", "%")


def _guards(data: np.ndarray, offsets: np.ndarray, least: int) -> np.ndarray:
    """Places of each `<` that starts `<`, at least `least` backslashes, `|` within one text."""
    at = np.flatnonzero(data == LT)
    if not len(at):
        return at
    stop = offsets[np.searchsorted(offsets, at, "right")]
    look, depth = at + 1, np.zeros(len(at), np.int64)
    found = []
    while len(at):
        ok = look < stop
        at, look, stop, depth = at[ok], look[ok], stop[ok], depth[ok]
        c = data[look]
        found.append(at[(c == BAR) & (depth >= least)])
        more = c == BACKSLASH
        at, look, stop, depth = at[more], look[more] + 1, stop[more], depth[more] + 1
    return np.sort(np.concatenate(found)) if found else at


def escape(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = _guards(data, offsets, 0)
    if not len(at):
        return data, offsets
    return np.insert(data, at + 1, BACKSLASH), offsets + np.searchsorted(at, offsets)


def unescape(text: bytes) -> bytes:
    data = np.frombuffer(text, np.uint8)
    at = _guards(data, np.array([0, len(data)]), 1)
    return np.delete(data, at + 1).tobytes() if len(at) else text


def assemble(role: pa.Array, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets of the rows in them, start and stop of each text)."""
    data, offsets = escape(*ragged(text))
    roles = pc.fill_null(role, "").dictionary_encode()
    names = [START + _role(r) + b"\n" for r in roles.dictionary.to_pylist()]
    head_bytes = np.frombuffer(b"".join(names) + END + b"\n", np.uint8)
    head_size = np.array([len(x) for x in names], np.int64)
    head_at = np.cumsum(head_size) - head_size
    which = roles.indices.to_numpy()
    sizes = np.empty((len(role), 3), np.int64)  # header, text, footer
    sizes[:, 0], sizes[:, 1], sizes[:, 2] = head_size[which], np.diff(offsets), len(END) + 1
    ends = np.cumsum(sizes.ravel())
    begin = (ends - sizes.ravel()).reshape(-1, 3)
    out = np.empty(int(ends[-1]), np.uint8)
    out[spread(begin[:, 0], sizes[:, 0])] = head_bytes[spread(head_at[which], sizes[:, 0])]
    out[spread(begin[:, 1], sizes[:, 1])] = data
    foot = head_bytes[len(head_bytes) - len(END) - 1 :]
    out[(begin[:, 2][:, None] + np.arange(len(foot))).ravel()] = np.tile(foot, len(role))
    return out, np.append(begin[:, 0], len(out)), begin[:, 1], begin[:, 1] + sizes[:, 1]


def _chars(data: np.ndarray) -> np.ndarray:
    """Running number of code points before each byte."""
    return np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv_id, role, text) to chunks; a chunk's loss ranges are in code points."""
    last, chunk = object(), 0
    for whole in batches:
        if not whole.num_rows:
            continue
        _, sizes = ragged(whole.column(2))
        for a, b in slices(sizes):
            batch = whole.slice(a, b - a)
            out, rows, start, stop = assemble(batch.column(1), batch.column(2))
            conv = batch.column(0)
            same = pc.fill_null(pc.equal(conv[1:], conv[:-1]), False).to_numpy(zero_copy_only=False) | (conv[1:].is_null().to_numpy(zero_copy_only=False) & conv[:-1].is_null().to_numpy(zero_copy_only=False))
            heads = np.concatenate(([0], np.flatnonzero(~same) + 1))
            tails = np.append(heads[1:], len(conv))
            numbers = np.zeros(len(heads), np.int64)
            first, final = conv[0].as_py(), conv[len(conv) - 1].as_py()
            chunk = chunk + 1 if first == last else 0
            numbers[0] = chunk
            if len(heads) > 1:
                chunk = 0
            last = final
            chars = _chars(out)
            loss = pc.fill_null(pc.equal(batch.column(1), LOSS_ROLE), False).to_numpy(zero_copy_only=False) & (stop > start)
            base = np.repeat(chars[rows[heads]], tails - heads)
            upto = np.concatenate(([0], np.cumsum(loss)))
            offs = pa.array(np.append(upto[heads], upto[-1]).astype(np.int32))
            text = pa.Array.from_buffers(pa.large_string(), len(heads), [None, pa.py_buffer(np.append(rows[heads], rows[-1]).astype(np.int64)), pa.py_buffer(out)])
            yield pa.RecordBatch.from_arrays(
                [conv.take(pa.array(heads)), pa.array(numbers), pa.array(tails - heads), text.cast(pa.string()), pa.ListArray.from_arrays(offs, pa.array((chars[start] - base)[loss])), pa.ListArray.from_arrays(offs, pa.array((chars[stop] - base)[loss]))],
                names=["conv_id", "chunk", "n_turns", "formatted", "loss_start", "loss_stop"],
            )


def format_chats(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, chunk, n_turns, formatted, loss_start, loss_stop): the conversations, in chunks that follow each other in their partition."""
    picked = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    dealt = picked.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return dealt.mapInArrow(_format, FORMATTED.format(picked.schema["conv_id"].dataType.simpleString()))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in order to one row of digests per conversation."""
    now = None  # conv_id, turns, chars, loss chars, two running hashes
    done: list[tuple] = []

    def flush(kind: pa.DataType) -> pa.RecordBatch:
        rows = [(c, n, t.hexdigest(), k, h.hexdigest(), f) for c, n, f, k, t, h in done]
        done.clear()
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        kinds = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for conv, chunk, text, starts, stops in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5)), strict=True):
            if now is None or chunk == 0:
                if now is not None:
                    done.append(tuple(now))
                now = [conv, 0, 0, 0, hashlib.sha256(), hashlib.sha256()]
            now[2] += len(text)
            raw = text.encode()
            at = 0
            while at < len(raw):  # header, text, footer
                if not raw.startswith(START, at):
                    raise ValueError("the formatted text does not follow the template")
                line = raw.index(b"\n", at)
                stop = raw.index(END, line)
                now[4].update(_unrole(raw[at + len(START) : line]).encode() + b"\n" + unescape(raw[line + 1 : stop]) + b"\n")
                now[1] += 1
                at = stop + len(END) + 1
            for a, b in zip(starts, stops, strict=True):
                own = unescape(text[a:b].encode())
                now[3] += len(own.decode())
                now[5].update(own)
        if done:
            yield flush(kind)
    if now is not None:
        done.append(tuple(now))
        yield flush(kind)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what format_chats() wrote, from its output in its order: turns, and all text under the loss mask."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.mapInArrow(_read, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

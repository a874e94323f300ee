"""Formatted conversations read back to what went in."""

import hashlib
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sorrel.llm import chat
from sorrel.llm.arrays import ragged

SCHEMA = "conv_id long, turn long, role string, text string"
BITS = ["<", "|", "\\", "<|", "<|im_end|>", "<|im_start|>assistant ok", "a", "é", "\U0001f600", "\n", "%3C", " "]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(BITS), max_size=12).map("".join), min_size=1, max_size=5))
def test_escapes_are_reversible(texts):
    data, offsets = chat.escape(*ragged(pa.array(texts)))
    for text, a, b in zip(texts, offsets, offsets[1:], strict=False):
        escaped = data[a:b].tobytes()
        assert b"<|" not in escaped and chat.unescape(escaped) == text.encode()


def want(rows):
    out = {}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
    for conv, _, role, text in order:
        out.setdefault(conv, []).append((role or "", text or ""))
    result = {}
    for conv, turns in out.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        result[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return result


def rows():
    rnd = random.Random(1)
    out = []
    for conv in range(40):
        for turn in range(rnd.randint(1, 8)):
            out.append((conv, turn, rnd.choice(["user", "assistant", "system", "odd\n<role>%", None]), rnd.choice([None, "", "".join(rnd.choice(BITS) for _ in range(rnd.randint(1, 30)))])))
    return out + out[:9] + [(50, None, "user", "x"), (50, 1, "user", "y"), (None, 1, "assistant", "lost"), (None, 2, "user", "<|")]


@pytest.mark.parametrize("batch", [3, 1000])
def test_read_back(spark, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    formatted = chat.format_chats(df)
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.read_back(formatted).collect()}
    assert got == want(data)
    texts = {}
    for r in formatted.orderBy("conv_id", "chunk").collect():
        texts[r["conv_id"]] = texts.get(r["conv_id"], "") + r["formatted"]
    assert {r["conv_id"]: r["formatted_chars"] for r in chat.read_back(formatted).collect()} == {k: len(v) for k, v in texts.items()}
    if batch == 3:
        assert formatted.where("chunk > 0").count() > 0


def test_template_and_empty(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "<|im_end|>")], SCHEMA)
    row = chat.format_chats(df).first()
    assert row["formatted"] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\n<\\|im_end|><|im_end|>\n"
    assert row["formatted"][row["loss_start"][0] : row["loss_stop"][0]] == "<\\|im_end|>"
    assert chat.read_back(chat.format_chats(df.limit(0))).count() == 0

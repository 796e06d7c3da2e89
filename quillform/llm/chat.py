"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole (``<|im_start|>role<|im_sep|>text<|im_end|>`` per turn), encoded once with offsets, and
the sorted spans of assistant texts are intersected with the token spans by binary search: a token is under the loss
mask if it lies in such a span. The markers are special tokens of the encoder, so no token crosses a span's border.

Inside roles and texts every ``<``, any number of backslashes, ``|`` gets one more backslash before the bar: no marker
can be written there, and ``unescape`` takes it out again.

Rows are partitioned by conversation and sorted by turn; a task streams them and holds one segment: a conversation of up
to ``SEGMENT_CHARS`` characters is one, a longer one is cut between turns. Markers separate tokens, so its tokens and
masks are those of one encoding of the whole; only rows, and offsets in them, are by segment.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare
from .tokens import default_path, encoder

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
SEGMENT_CHARS = 1 << 20
#: Characters of segments that are handed on at a time.
BATCH_CHARS = 4 << 20
_OPEN = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(SEP) + "(.*?)" + re.escape(END), re.S)
_SPAN = "array<struct<start:int,end:int>>"
OUT = f"conv_id long, segment int, first_turn long, text string, loss_spans {_SPAN}, ids array<int>, loss_mask array<boolean>, masked_spans {_SPAN}"


def escape(text: str) -> str:
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def render(turns: list[tuple[str | None, str | None]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted text of (role, text) turns, and the sorted spans of texts whose role is ``learn``."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head, body = f"{START}{escape(role or '')}{SEP}", escape(text or "")
        if role == learn and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def align(spans: list[tuple[int, int]], offsets: np.ndarray) -> np.ndarray:
    """Which tokens (rows of begin and end) lie in one of the sorted spans."""
    if not spans or not len(offsets):
        return np.zeros(len(offsets), bool)
    starts, ends = np.array(spans).T
    k = np.searchsorted(starts, offsets[:, 0], "right") - 1
    return (k >= 0) & (offsets[:, 1] <= ends[np.maximum(k, 0)]) & (offsets[:, 0] < offsets[:, 1])


def covered(mask: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
    """Spans of characters under runs of masked tokens."""
    cut = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return [(int(offsets[a:b, 0].min()), int(offsets[a:b, 1].max())) for a, b in zip(cut[::2].tolist(), cut[1::2].tolist(), strict=True)]


def format_conversations(rows: DataFrame, path: str | None = None, learn: str = "assistant") -> DataFrame:
    """One row per segment of each conversation of ``rows`` (conv_id, turn, role, text), sorted within partitions.

    Null texts and roles are empty; turns with equal numbers (null first) come in order of role and text; rows with a
    null conv_id are one conversation; an empty table gives an empty result.
    """
    path = path or default_path()
    prepare(rows.sparkSession)
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        tok = encoder(path, (START, SEP, END))
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.string(), span, pa.list_(pa.int32()), pa.list_(pa.bool_()), span)
        names = [x.strip().split(" ")[0] for x in re.sub("<[^ ]*>", "", OUT).split(",")]
        pairs = lambda xs: [{"start": a, "end": b} for a, b in xs]
        state: dict = {"conv": object(), "segment": 0, "first": 0, "turns": [], "chars": 0, "seen": 0}
        ready: list[tuple] = []

        def close():
            if state["turns"]:
                text, spans = render(state["turns"], learn)
                ids, offsets = tok.encode_with_offsets(text)
                mask = align(spans, offsets)
                ready.append((state["conv"], state["segment"], state["first"], text, pairs(spans), ids.astype(np.int32), mask, pairs(covered(mask, offsets))))
            state["segment"] += 1
            state["first"] += len(state["turns"])
            state["turns"], state["chars"] = [], 0

        def batch():
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*ready, strict=True), kinds, strict=True)], names)
            ready.clear()
            return out

        for b in batches:
            for conv, role, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if conv != state["conv"]:
                    close()
                    state |= {"conv": conv, "segment": 0, "first": 0}
                elif state["chars"] >= SEGMENT_CHARS:
                    close()
                state["turns"].append((role, text))
                state["chars"] += len(role or "") + len(text or "")
                if sum(len(r[3]) for r in ready[-64:]) > BATCH_CHARS or len(ready) >= 2000:
                    yield batch()
        close()
        if ready:
            yield batch()

    return rows.mapInArrow(run, OUT)

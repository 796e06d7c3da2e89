"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of its documents' tokens, with a target share of the mixture. In each round every queue that
isn't dry adds its quantum, in proportion to its target, to its deficit; a token costs ``Rounds.cost``, and the queue is
served, in the order of names, while its deficit is more than half of that. What is left, positive or negative, is
carried to the next round, whatever windows and tasks end in between. Quanta are at most half the cost, so a visit serves
a token or none, and every window of ``length`` tokens holds the target shares to within a token or two of each queue.
A queue that runs dry leaves the rotation: the rounds get shorter and the others fill the windows in proportion to their
targets. Without targets a queue's target is its share of all tokens, so that all run dry together, at the end: the one
mixture that can be held until everything is packed.

After d rounds a queue of quantum w has been served (d * w, in costs, rounded to the nearest token) tokens, or all it
has. So ``served`` gives in closed form what every queue had been served before any window, and with it the deficits
that are carried into it: tasks fill their own windows without waiting for each other and agree exactly at their borders.

A window without its last tokens is cut into sequences whose lengths are powers of two, which need no padding; only
integers are used, so a retried task gives the same pieces. Queues are one row a source in the driver and in each worker
(some 100 bytes; their number isn't limited).
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize, prepare
from .tokens import default_path, encoder

LENGTH = 2048
END = 1
#: Elements of a matrix of windows and queues that is worked on at once.
BLOCK = 1 << 20
_TOKENS = "part int, first long, n long, ids binary"
_PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Rounds:
    """Deficit round-robin over queues with ``totals`` tokens each, cut into windows of ``length`` tokens.

    ``targets`` are weights of any scale; missing, zero and negative ones stand for the smallest quantum. Quanta are
    integers, the largest of as many bits as keep all arithmetic within 64.
    """

    def __init__(self, totals: list[int], length: int = LENGTH, targets: list[float] | None = None):
        self.length, self.total = length, sum(totals)
        most = max([1, *totals])
        weights = [float(w) if w and w > 0 else 0.0 for w in targets] if targets else totals
        top = max([*weights, 0]) or 1
        self.bits = min(60 - most.bit_length(), 30, most.bit_length() if not targets else 30)
        exact = not targets and most.bit_length() <= self.bits
        self.quanta = np.array([t if exact else max(1, round(w / top * (1 << self.bits))) for t, w in zip(totals, weights, strict=True)], np.int64)
        self.quanta = np.maximum(self.quanta, 1)
        self.totals = np.array(totals, np.int64)
        self.cost = 2 << self.bits
        #: Rounds after which each queue is dry.
        self.dry = -(-(((2 * self.totals - 1) << self.bits) + 1) // self.quanta)
        self.rounds = int(self.dry.max(initial=0))
        full, rest = divmod(self.total, length)
        powers = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        self.full, self.tail = full, np.cumsum([full * length, *powers], dtype=np.int64)

    def border(self, window: np.ndarray) -> np.ndarray:
        """Tokens served in all before each window; the tail's windows are powers of two."""
        return np.where(window < self.full, window * self.length, self.tail[np.clip(window - self.full, 0, len(self.tail) - 1)])

    def after(self, rounds: np.ndarray) -> np.ndarray:
        """Tokens of each queue that are served in the first so many rounds: rounds x queues."""
        credit = np.minimum(rounds[:, None], self.dry[None, :]) * self.quanta[None, :]
        return np.minimum((((credit - 1) >> self.bits) + 1) // 2, self.totals[None, :])

    def _rounds(self, window: np.ndarray) -> np.ndarray:
        """Whole rounds before each window."""
        goal = self.border(window)
        low, high = np.zeros(len(goal), np.int64), np.full(len(goal), self.rounds + 1, np.int64)
        while (high - low > 1).any():
            mid = (low + high) // 2
            fits = self.after(mid).sum(axis=1) <= goal
            low, high = np.where(fits, mid, low), np.where(fits, high, mid)
        return low

    def served(self, window: np.ndarray) -> np.ndarray:
        """What each queue has served before each window: windows x queues, rows adding up to the border."""
        whole = self._rounds(window)
        out = self.after(whole)
        # The round in which the window begins serves queues in their order until the window before is full.
        visit = self.after(whole + 1) - out
        room = (self.border(window) - out.sum(axis=1))[:, None]
        return out + np.clip(room - (np.cumsum(visit, axis=1) - visit), 0, visit)

    def deficits(self, window: np.ndarray) -> np.ndarray:
        """Deficits that are carried into each window, in tokens; 0 for dry queues."""
        served = self.served(window)
        owed = (self._rounds(window)[:, None] * self.quanta[None, :]) / self.cost - served
        return np.where(served < self.totals[None, :], owed, 0.0)

    def rank(self, queue: int, token: int) -> int:
        """Tokens that all queues serve before a token of a queue."""
        turn = ((2 * token + 1) << self.bits) // int(self.quanta[queue])
        before, after = self.after(np.array([turn, turn + 1]))
        return int(before.sum() + (after - before)[:queue].sum() + token - before[queue])

    def window(self, queue: int, token: int) -> int:
        rank = self.rank(queue, token)
        if rank < self.full * self.length:
            return rank // self.length
        return self.full + int(np.searchsorted(self.tail, rank, "right")) - 1


def tokenize(docs: DataFrame, path: str, text: str = "text", queue: str = "source", end: int = END) -> DataFrame:
    """``docs`` without the text, with each document's ids (and ``end``) as bytes and its place in its task's queue."""
    keep = [c for c in docs.columns if c != text and c not in ("part", "first", "n", "ids")]
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema
    for f in docs.sparkSession.createDataFrame([], _TOKENS).schema:
        schema = schema.add(f)

    def run(batches):
        part, upto, encode = TaskContext.get().partitionId(), {}, encoder(path).encode
        for b in batches:
            col = lambda c: b.column(b.schema.get_field_index(c))
            ids = [np.append(encode(x.as_py()), np.uint32(end)).astype("<u4") for x in col(text)]
            firsts = []
            for q, x in zip(col(queue).to_pylist(), ids, strict=True):
                firsts.append(upto.get(q, 0))
                upto[q] = firsts[-1] + len(x)
            new = [pa.array([part] * len(ids), pa.int32()), pa.array(firsts, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([_pack(x) for x in ids], pa.binary())]
            yield pa.RecordBatch.from_arrays([*(col(c) for c in keep), *new], schema.names)

    return docs.mapInArrow(run, schema)


def _pack(ids: np.ndarray) -> bytes:
    """A byte for the width, then the ids in two or four bytes each."""
    wide = len(ids) and int(ids.max()) > 0xFFFF
    return (b"\4" if wide else b"\2") + ids.astype("<u4" if wide else "<u2").tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u4" if raw[:1] == b"\4" else "<u2", offset=1)


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", path: str | None = None, length: int = LENGTH, targets: dict[str | None, float] | None = None) -> DataFrame:
    """One row for each piece: doc_id, p_source, start, length, ids_crc32, doc_tokens, sequence_id, offset and its ids.

    ``targets`` are shares (of any scale) by source; sources that it doesn't name have the smallest quantum, as those
    with 0; sources that have no tokens don't count. Null and empty texts are one piece of the end id; null sources are a
    queue of their own; null ids and repeated rows are documents like any other; an empty table has no pieces. Ids are
    unsigned 32-bit, little-endian, in ``ids``.
    """
    spark = docs.sparkSession
    prepare(spark)
    mine = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("p_source"), F.col(text).alias("p_text"))
    tokens = materialize(tokenize(mine, path or default_path(), "p_text", "p_source"), "pack-tokens")
    parts = materialize(tokens.groupBy("p_source", "part").agg(F.sum("n").alias("n")), "pack-parts")
    totals = {r[0]: int(r[1]) for r in parts.groupBy("p_source").agg(F.sum("n")).collect()}  # a row for each source
    names = sorted(totals, key=lambda q: (q is not None, str(q)))
    if not names:
        return tokens.selectExpr("doc_id", "p_source", *[f"cast(0 as bigint) {c}" for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")], "ids")
    rounds = Rounds([totals[q] for q in names], length, None if targets is None else [targets.get(q, 0) for q in names])
    sent = spark.sparkContext.broadcast((rounds, {q: k for k, q in enumerate(names)}))
    # Where a task's share of a queue begins: one row for each source and task.
    begin = F.coalesce(F.sum("n").over(W.partitionBy("p_source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    begins = parts.select(F.col("p_source").alias("b_source"), F.col("part").alias("b_part"), begin.cast("long").alias("begin"))
    rows = tokens.join(begins, tokens["p_source"].eqNullSafe(begins["b_source"]) & (tokens["part"] == begins["b_part"]))
    rows = rows.select("doc_id", "p_source", (F.col("begin") + F.col("first")).alias("at"), "n", "ids")
    schema = mine.select("doc_id", "p_source").schema
    for f in spark.createDataFrame([], _PIECES + ", ids binary").schema:
        schema = schema.add(f)

    def run(batches):
        rounds, number = sent.value
        step = max(10, min(2000, BLOCK // 25 // len(number)))
        for b in batches:
            for k in range(0, b.num_rows, step):
                yield from _pieces(b.slice(k, step), rounds, number, schema.names)

    return rows.mapInArrow(run, schema)


def shares(pieces: DataFrame) -> DataFrame:
    """(sequence_id, p_source, tokens, share): the mixture that each sequence of packed pieces got."""
    got = pieces.groupBy("sequence_id", "p_source").agg(F.sum("length").alias("tokens"))
    return got.select("*", (F.col("tokens") / F.sum("tokens").over(W.partitionBy("sequence_id"))).alias("share"))


def _pieces(b: pa.RecordBatch, rounds: Rounds, number: dict[str, int], names: list[str]):
    queue = np.array([number[q] for q in b.column(1).to_pylist()])
    at, n = b.column(2).to_numpy(), b.column(3).to_numpy()
    # The windows from each queue's first to last token here; a run of neighbours shares its borders.
    order = np.lexsort((at, queue))
    runs, spans = [], []
    for i in order.tolist():
        q, a, z = int(queue[i]), int(at[i]), int(at[i] + n[i])
        if spans and spans[-1][0] == q and spans[-1][2] == a:
            spans[-1][2] = z
            runs[-1].append(i)
        else:
            spans.append([q, a, z])
            runs.append([i])
    ranges = [(rounds.window(q, a), rounds.window(q, z - 1)) for q, a, z in spans]
    windows = np.unique(np.concatenate([np.arange(lo, hi + 2) for lo, hi in ranges]))
    step = max(1, BLOCK // len(rounds.totals))
    served = np.concatenate([rounds.served(windows[k : k + step]) for k in range(0, len(windows), step)])
    share = np.diff(served, axis=0) if len(windows) > 1 else served[:0]
    ahead = np.cumsum(share, axis=1) - share  # tokens of earlier queues in the window
    row, start, length, sequence, offset = [], [], [], [], []
    for (q, _, _), mine, (lo, hi) in zip(spans, runs, ranges, strict=True):
        k = int(np.searchsorted(windows, lo))
        borders, lead = served[k : k + hi - lo + 2, q], ahead[k : k + hi - lo + 1, q]
        for i in mine:
            a, z = int(at[i]), int(at[i] + n[i])
            w = int(np.searchsorted(borders, a, "right")) - 1
            while a < z:
                stop = min(z, int(borders[w + 1]))
                if stop > a:
                    row.append(i)
                    start.append(a - int(at[i]))
                    length.append(stop - a)
                    sequence.append(lo + w)
                    offset.append(int(lead[w]) + a - int(borders[w]))
                a, w = stop, w + 1
    ids = {i: _unpack(b.column(4)[i].as_py()).astype("<u4") for i in set(row)}
    raw = [ids[i][s : s + m].tobytes() for i, s, m in zip(row, start, length, strict=True)]
    take = pa.array(row, pa.int64())
    whole = [start, length, [zlib.crc32(x) for x in raw], n[row].tolist(), sequence, offset]
    yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), *(pa.array(x, pa.int64()) for x in whole), pa.array(raw, pa.binary())], names)

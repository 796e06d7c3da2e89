"""Repair of the turns of conversations at least cost, by a rank-compressed dynamic program.

The roles of a repaired conversation read ``(s?(ua)+)?`` by their initials. Every row is kept (0), given another role (3)
or deleted (4; what is blank or repeated must be); empty turns may be put in anywhere (3 each), and a truncated row that
stays costs 3. Among the cheapest repairs that with the least audit string (initials of the edits in order) is taken.

A *macro edit* is a run of insertions and the edit of the next row, coded ``I*`` and ``D``, ``K`` or ``R``. No code is the
beginning of another, so the audit strings of two ways through the same rows compare as their first different codes: a
layer (the four states behind a row: nothing yet, a system turn, a user turn, an assistant turn) needs for each state its
cost and its *rank* among the layer's strings, and a pointer to the state before; no string is built until the end.
Layers are normalised (costs less the least, states that are dominated by more than any repair left out), so there are
few and each step is made once per worker.

The program also splits: what a run of rows does from each of the four states to each other one is a table of costs and
ranks, and tables of neighbouring runs combine. A conversation is cut into chunks (by partition borders of the sorted
rows, by characters and by rows), so one that holds a third of all rows is dealt to many tasks; one task folds its tables,
a few numbers a chunk, and each chunk then reconstructs its own edits.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, prepare

INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
CHUNK_CHARS, CHUNK_ROWS = 1 << 20, 4096
START, SYSTEM, USER, ASSISTANT = range(4)
OK, CUT, GONE = range(3)
#: No continuation is worth more than a changed parity and a deleted system turn.
_SLACK = INSERT + DELETE
_BLANK = re.compile(r"[\x20\t-\r]*")
_ROLES = {USER: "user", ASSISTANT: "assistant"}
_EMPTY = (None,) * 4

Layer = tuple  # of (cost, rank) or None for each state


def kind_of(role: str, fault: int) -> int:
    """The class of a row that decides its edits: initial of the role, and fault."""
    return 0 if fault == GONE else 1 + 2 * "sua".find(role[:1] or "?") + (fault == CUT) if role[:1] in ("s", "u", "a") else 7 + (fault == CUT)


def _after_insert(state: int) -> int:
    return ASSISTANT if state == USER else USER


def _edits(state: int, kind: int):
    """(initial, cost, next state) of what may be done to a row of a kind behind a state."""
    yield "D", DELETE, state
    if kind == 0:
        return
    initial, late = (kind - 1) // 2, TRUNCATED * ((kind - 1) % 2)
    if initial == 0 and state == START:
        yield "K", late, SYSTEM
    want = _after_insert(state)
    if (initial == 1 and want == USER) or (initial == 2 and want == ASSISTANT):
        yield "K", late, want
    yield "R", REROLE + late, want


@functools.lru_cache(maxsize=1 << 16)
def step(layer: Layer, kind: int) -> tuple[int, Layer, tuple]:
    """Past one row: what the least cost rose by, the next layer, and each state's pointer (state before, code)."""
    best: dict[int, tuple] = {}
    for state, here in enumerate(layer):
        if here is None:
            continue
        at = state
        # Two insertions reach every state that insertions reach.
        for run in range(3):
            at = _after_insert(at) if run else at
            for edit, cost, to in _edits(at, kind):
                found = (here[0] + INSERT * run + cost, here[1], "I" * run + edit, state)
                best[to] = min(best.get(to, found), found)
    low = min(b[0] for b in best.values())
    kept = {q: b for q, b in best.items() if b[0] <= low + _SLACK}
    order = {x: k for k, x in enumerate(sorted({b[1:3] for b in kept.values()}))}
    return (
        low,
        tuple((kept[q][0] - low, order[kept[q][1:3]]) if q in kept else None for q in range(4)),
        tuple((kept[q][3], kept[q][2]) if q in kept else None for q in range(4)),
    )


def entered(state: int) -> Layer:
    return tuple((0, 0) if q == state else None for q in range(4))


def walk(state: int, kinds: list[tuple[int, int]]) -> tuple[int, Layer, list[tuple]]:
    """From one state past (kind, copies) rows: least cost, last layer, pointers of every layer."""
    total, layer, pointers = 0, entered(state), []
    for kind, copies in kinds:
        for _ in range(copies):
            low, layer, back = step(layer, kind)
            total += low
            pointers.append(back)
    return total, layer, pointers


#: Insertions that finish a conversation from each state.
_TAIL = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}


def finish(layer: Layer) -> tuple[int, int]:
    """The cheapest last state, and its cost with the insertions behind it."""
    cost, _, state = min((x[0] + INSERT * _TAIL[q], x[1], q) for q, x in enumerate(layer) if x is not None)
    return state, cost


def trace(pointers: list[tuple], state: int) -> str:
    """The audit string that leads to a state, along the pointers."""
    codes = []
    for back in reversed(pointers):
        state, code = back[state]
        codes.append(code)
    return "".join(reversed(codes))


def apply(state: int, turns: list[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    """The repaired (role, text) turns; the audit string decides them, for after the first turn roles alternate."""
    out, at = [], 0
    for edit in audit:
        if edit == "I":
            state = _after_insert(state)
            out.append((_ROLES[state], ""))
            continue
        role, text = turns[at]
        at += 1
        if edit == "D":
            continue
        state = SYSTEM if edit == "K" and role[:1] == "s" else _after_insert(state)
        out.append((role if edit == "K" else _ROLES[state], text))
    return out


def faults(rows: DataFrame) -> DataFrame:
    """Distinct rows of conversations with ``copies``, ``again`` (role and text stood in the conversation before) and ``digest``
    of the text, which decides the order of rows of equal turn and role.

    Counting comes first, so that a row repeated without end is one row. What stood first is found by a least turn per role and
    text and joined by the whole key: no key of either join or grouping has many rows.
    """
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit(" ")).alias("role"), F.coalesce(F.col("text"), F.lit(" ")).alias("text"))
    key = ["conv_id", "turn", "role", "digest"]
    each = rows.withColumn("digest", F.unhex(F.sha2("text", 256))).groupBy(*key).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    place = F.struct(F.col("turn").isNotNull().alias("a"), F.col("turn").alias("turn"))
    first = rows.select("conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest")).groupBy("conv_id", "role", "digest").agg(F.min(place).alias("first"))
    first = first.select("conv_id", F.col("first.turn").alias("turn"), "role", "digest", F.lit(False).alias("again"))
    same = [each[k].eqNullSafe(first[k]) for k in key]
    return each.join(first, functools.reduce(lambda a, b: a & b, same), "left").select(*[each[c] for c in (*key, "text", "copies")], F.coalesce(first["again"], F.lit(True)).alias("again"))


_TURNS = "array<struct<role:string,text:string,kind:int,copies:bigint>>"
_COUNTS = "blank long, duplicate long, truncated long, illegal long, turns_seen long, first_turn long, last_turn long, first_initial string, last_initial string"
_REPAIRED = "array<struct<role:string,text:string>>"


def _chunk_schema(conv: T.DataType) -> T.StructType:
    rest = f"part int, chunk long, alone boolean, costs array<long>, ranks array<int>, rows {_TURNS}, audit string, cost long, repaired {_REPAIRED}, {_COUNTS}"
    return T.StructType([T.StructField("conv_id", conv), *T._parse_datatype_string(rest).fields])


class _Chunk:
    """Rows of one conversation that follow each other; ``opens``: the conversation begins with them, for another lies before."""

    def __init__(self, conv, number: int, opens: bool):
        self.conv, self.number, self.opens = conv, number, opens
        self.turns: list[tuple] = []
        self.chars = self.count = 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.seen = 0
        self.first_turn = self.last_turn = self.first = self.last = None

    def add(self, turn, role: str, text: str, copies: int, again: bool) -> None:
        rest = text.rstrip("\x20\t\n\x0b\x0c\r")
        fault = GONE if again or not rest else CUT if rest[-1] not in ".!?" else OK
        if not rest:
            self.blank += copies
        elif again:
            self.duplicate += copies
        elif fault == CUT:
            self.truncated += copies
        self.turns.append((role, text if fault != GONE else "", kind_of(role, fault), copies))
        self.chars += len(text) if fault != GONE else 0
        self.count += copies
        if turn is not None and turn != self.last_turn:
            self.seen += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        initial = role[:1]
        if self.last is not None:
            self.illegal += self.last + initial not in ("su", "ua", "au")
        self.illegal += copies - 1
        self.first = initial if self.first is None else self.first
        self.last = initial

    def row(self, part: int, alone: bool) -> tuple:
        kinds = [(k, n) for _, _, k, n in self.turns]
        counts = (self.blank, self.duplicate, self.truncated, self.illegal, self.seen, self.first_turn, self.last_turn, self.first, self.last)
        if alone:
            total, layer, pointers = walk(START, kinds)
            state, more = finish(layer)
            audit = trace(pointers, state) + "I" * _TAIL[state]
            return (self.conv, part, self.number, True, None, None, None, audit, total + more, repaired(START, self.turns, audit), *counts)
        costs, ranks = [], []
        for entry in range(4):
            total, layer, _ = walk(entry, kinds)
            costs += [None if x is None else total + x[0] for x in layer]
            ranks += [None if x is None else x[1] for x in layer]
        rows = [{"role": r, "text": t, "kind": k, "copies": n} for r, t, k, n in self.turns]
        return (self.conv, part, self.number, False, costs, ranks, rows, None, None, None, *counts)


def repaired(state: int, turns: list[tuple], audit: str) -> list[dict]:
    """``apply`` for (role, text, kind, copies) rows."""
    flat = [(r, t) for r, t, _, n in turns for _ in range(n)]
    return [{"role": r, "text": t} for r, t in apply(state, flat, audit)]


def _batches(rows, schema: pa.Schema, chars: int = 4 << 20):
    """Tuples as Arrow batches of bounded text."""
    ready, size = [], 0
    for weight, row in rows:
        ready.append(row)
        size += weight
        if size > chars or len(ready) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*ready, strict=True), schema.types, strict=True)], schema=schema)
            ready, size = [], 0
    if ready:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*ready, strict=True), schema.types, strict=True)], schema=schema)


def _chunks(schema: pa.Schema):
    """Sorted rows of ``faults`` -> chunks; a conversation that others surround in the partition is whole and solved at once."""

    def run(batches):
        part = TaskContext.get().partitionId()

        def found():
            chunk: _Chunk | None = None
            number = 0
            for b in batches:
                col = [b.column(i).to_pylist() for i in range(6)]
                for conv, turn, role, text, copies, again in zip(*col, strict=True):
                    if chunk is None or conv != chunk.conv:
                        if chunk is not None:
                            yield chunk.chars, chunk.row(part, chunk.opens)
                        chunk = _Chunk(conv, number, chunk is not None)
                        number += 1
                    left, head = copies, True
                    while left:
                        if chunk.turns and (chunk.chars >= CHUNK_CHARS or chunk.count >= CHUNK_ROWS):
                            yield chunk.chars, chunk.row(part, False)
                            chunk = _Chunk(conv, number, False)
                            number += 1
                        # The first copy is judged; those behind it repeat it.
                        n = 1 if head else min(left, CHUNK_ROWS)
                        chunk.add(turn, role, text, n, again or not head)
                        left, head = left - n, False
            if chunk is not None:
                yield chunk.chars, chunk.row(part, False)

        yield from _batches(found(), schema)

    return run


def _fold(schema: pa.Schema):
    """Tables of each conversation's chunks in order -> where its best repair enters and leaves each."""

    def solve(conv, chunks: list[tuple]):
        layer, backs = entered(START), []
        for _, _, costs, ranks in chunks:
            best: dict[int, tuple] = {}
            for state, here in enumerate(layer):
                if here is None:
                    continue
                for to in range(4):
                    cost = costs[4 * state + to]
                    if cost is not None:
                        got = (here[0] + cost, here[1], ranks[4 * state + to], state)
                        best[to] = min(best.get(to, got), got)
            order = {x: k for k, x in enumerate(sorted({b[1:3] for b in best.values()}))}
            layer = tuple((best[q][0], order[best[q][1:3]]) if q in best else None for q in range(4))
            backs.append([best[q][3] if q in best else None for q in range(4)])
        state, total = finish(layer)
        tail, out = _TAIL[state], []
        for (part, number, _, _), back in zip(reversed(chunks), reversed(backs), strict=True):
            out.append((part, number, back[state], state, tail, total))
            state, tail, total = back[state], 0, 0
        return [(conv, *x) for x in reversed(out)]

    def run(batches):
        def found():
            conv, chunks = None, []
            for b in batches:
                for c, *rest in zip(*[b.column(i).to_pylist() for i in range(5)], strict=True):
                    if chunks and c != conv:
                        yield from ((0, x) for x in solve(conv, chunks))
                        chunks = []
                    conv = c
                    chunks.append(tuple(rest))
            if chunks:
                yield from ((0, x) for x in solve(conv, chunks))

        yield from _batches(found(), schema)

    return run


def _solved(schema: pa.Schema):
    """Chunks with their entry, exit and tail -> audit and repaired turns."""

    def run(batches):
        def found():
            for b in batches:
                for r in b.to_pylist():
                    turns = [(x["role"], x["text"], x["kind"], x["copies"]) for x in r["rows"]]
                    _, _, pointers = walk(r["entry"], [(k, n) for _, _, k, n in turns])
                    audit = trace(pointers, r["leaves"]) + "I" * r["tail"]
                    r |= {"audit": audit, "repaired": repaired(r["entry"], turns, audit), "cost": r["total"]}
                    yield sum(len(t) for _, t, _, _ in turns), tuple(r[n] for n in schema.names)

        yield from _batches(found(), schema)

    return run


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


_PIECE = ["conv_id", "part", "chunk", "alone", "audit", "cost", "repaired", *[x.split()[0] for x in _COUNTS.split(", ")]]


def repair(rows: DataFrame) -> DataFrame:
    """Pieces of repaired conversations: one row for each chunk, ordered by (part, chunk) within a conversation.

    ``audit`` and ``repaired`` of a conversation's pieces follow each other; its costs and counts add up (``illegal`` and
    ``turns_seen`` need the borders between pieces, see ``summary``). ``alone``: the piece is the whole conversation.

    ``rows`` has conv_id, turn, role and text; others are left out. Null roles and texts are one space, null turns come first,
    rows of equal turn in order of role and the text's SHA-256. Repeated rows are duplicates. Rows with a null conv_id are one
    conversation. Conversations without rows, and empty tables, have no pieces.
    """
    spark = rows.sparkSession
    prepare(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    flat = faults(rows)
    order = ["conv_id", "turn", "role", "digest"]
    flat = flat.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "copies", "again")
    schema = _chunk_schema(rows.schema["conv_id"].dataType)
    chunks = materialize(flat.mapInArrow(_chunks(_arrow(schema)), schema), "conversations")
    # The rest: conversations at the border of a partition, or of several chunks.
    cut = chunks.where(~F.col("alone"))
    way = T.StructType([schema["conv_id"], *T._parse_datatype_string("part int, chunk long, entry int, leaves int, tail int, total long").fields])
    tables = cut.select("conv_id", "part", "chunk", "costs", "ranks").repartition(parts, "conv_id").sortWithinPartitions("conv_id", "part", "chunk")
    ways = tables.mapInArrow(_fold(_arrow(way)), way).drop("conv_id")
    piece = T.StructType([schema[c] for c in _PIECE])
    solved = cut.drop("audit", "cost", "repaired").join(ways, ["part", "chunk"]).mapInArrow(_solved(_arrow(piece)), piece)
    return chunks.where("alone").select(*_PIECE).unionByName(solved)

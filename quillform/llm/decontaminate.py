"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of documents of at most ``SHARD_WORDS`` indexed words. Its text holds the maximal runs of words that
the benchmark knows at all, each closed by a terminator: no other word can be inside an occurrence, so nothing else is
indexed. The shard's suffixes are sorted by prefix doubling, its Burrows-Wheeler transform goes into a wavelet matrix,
test phrases (windows of ``WINDOW`` words; an item of fewer words is one window) are found by backward search through
its ranks, occurrences are located by walking to sampled suffix positions, and their word spans are merged.

Shards are local to a task: nothing is shuffled. Benchmark items are dealt into blocks of at most ``BLOCK_BYTES``; each
block is collected and broadcast by itself, whatever the size of the benchmark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, arrow_column, byte_size, materialize, packed, parts_for, prepare, unpacked

WINDOW = 10
SHARD_WORDS = 1 << 18
#: Every n-th text position keeps its suffix position.
SAMPLE = 8
#: Bytes of items that are searched for at once: some 40 times as much memory in the driver and in each worker.
BLOCK_BYTES = 1 << 20

#: Bytes of words stay, A-Z are lowered, all others separate.
_TO_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def split_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lowered."""
    return (text or "").encode().translate(_TO_WORDS).split()


class Phrases:
    """The distinct windows of a block of items, as word numbers from 2 (0 ends a shard, 1 a run); arrays, but for the words."""

    def __init__(self, items: list[tuple[int, str | None]], window: int = WINDOW):
        self.words: dict[bytes, int] = {}
        self.ids = [i for i, _ in items]
        tables, lengths, owners = [np.zeros((0, window), np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for k, (_, text) in enumerate(items):
            w = np.array([self.words.setdefault(x, len(self.words) + 2) for x in split_words(text)], np.int32)
            if not len(w):
                continue
            size = min(window, len(w))
            mine = np.zeros((len(w) - size + 1, window), np.int32)
            mine[:, :size] = np.lib.stride_tricks.sliding_window_view(w, size)
            tables.append(mine)
            lengths.append(np.full(len(mine), size, np.int32))
            owners.append(np.full(len(mine), k, np.int32))
        # Shorter windows end in zeros, which no word has: rows differ if windows do.
        self.table, first, back = np.unique(np.concatenate(tables), axis=0, return_index=True, return_inverse=True)
        self.lengths = np.concatenate(lengths)[first].astype(np.int64)
        pairs = np.unique(back.reshape(-1).astype(np.int64) * max(1, len(items)) + np.concatenate(owners))
        self.owner = (pairs % max(1, len(items))).astype(np.int32)
        self.upto = np.searchsorted(pairs // max(1, len(items)), np.arange(len(self.table) + 1))
        self.least = int(self.lengths.min()) if len(self.lengths) else 0

    def owners(self, phrase: int) -> list[int]:
        """Numbers of the items that have a window."""
        return self.owner[self.upto[phrase] : self.upto[phrase + 1]].tolist()


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``s``, whose last symbol is its only smallest, by prefix doubling."""
    n = len(s)
    order = np.argsort(s, kind="stable")
    value = s[order]
    place = np.arange(n)
    # A suffix's rank is the first place of its group; groups of one are done.
    head = np.concatenate(([True], value[1:] != value[:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, place, 0))
    at = np.flatnonzero(~(head & np.concatenate((head[1:], [True]))))
    step = 1
    while len(at):
        mine = order[at]
        after = mine + step
        key = rank[mine] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        fresh = np.argsort(key, kind="stable")
        mine, key = mine[fresh], key[fresh]
        order[at] = mine
        head = np.concatenate(([True], key[1:] != key[:-1]))
        rank[mine] = np.maximum.accumulate(np.where(head, at, 0))
        at = at[~(head & np.concatenate((head[1:], [True])))]
        step *= 2
    return order


class FMIndex:
    """Backward search and location over one sequence of symbols that ends in its only 0."""

    def __init__(self, s: np.ndarray, symbols: int, sample: int = SAMPLE):
        n = len(s)
        order = suffix_array(s)
        self.bwt = s[order - 1]
        self.before = np.concatenate(([0], np.cumsum(np.bincount(s, minlength=symbols))))
        self.levels = max(1, int(symbols - 1).bit_length())
        self.ranks, self.zeros, cur = [], [], self.bwt
        for level in range(self.levels - 1, -1, -1):
            bit = (cur >> level) & 1
            ones = np.zeros(n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ranks.append(ones)
            self.zeros.append(n - int(ones[-1]))
            cur = np.concatenate((cur[bit == 0], cur[bit == 1]))
        self.sampled = order % sample == 0
        self.sample_rank = np.cumsum(self.sampled) - 1
        self.samples = order[self.sampled]
        self.start = self._walk(np.arange(symbols), np.zeros(symbols, np.int64))

    def _walk(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, ones, zeros in zip(range(self.levels - 1, -1, -1), self.ranks, self.zeros, strict=True):
            r = ones[i].astype(np.int64)
            i = np.where((c >> level) & 1, zeros + r, i - r)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c is among the first i symbols of the transform, by the wavelet matrix."""
        return self._walk(c, i) - self.start[c]

    def search(self, table: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, low, high) of the phrases that occur, from their last word backwards."""
        who = np.arange(len(lengths))
        lo, hi = np.zeros(len(lengths), np.int64), np.full(len(lengths), len(self.bwt), np.int64)
        for back in range(1, table.shape[1] + 1):
            on = lengths[who] >= back
            c = table[who, np.maximum(lengths[who] - back, 0)].astype(np.int64)
            lo = np.where(on, self.before[c] + self.rank(c, lo), lo)
            hi = np.where(on, self.before[c] + self.rank(c, hi), hi)
            some = lo < hi
            who, lo, hi = who[some], lo[some], hi[some]
        return who, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the suffix order."""
        out, at, rows, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), rows.copy(), 0
        while len(at):
            hit = self.sampled[rows]
            out[at[hit]] = self.samples[self.sample_rank[rows[hit]]] + steps
            at, rows = at[~hit], rows[~hit]
            c = self.bwt[rows]
            rows = self.before[c] + self.rank(c, rows)
            steps += 1
        return out


def _spans(hit: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def search_shard(docs: list[np.ndarray], phrases: Phrases) -> dict[int, tuple[list[int], np.ndarray]]:
    """Document -> (numbers of items, hit words as booleans) of the documents (word numbers, 0 unknown) with occurrences."""
    pieces, owner, place = [], [], []
    for d, w in enumerate(docs):
        known = np.concatenate(([False], w > 0, [False]))
        edge = np.flatnonzero(known[1:] != known[:-1])
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a >= phrases.least:
                pieces += [w[a:b], _END]
                owner += [np.full(b - a + 1, d)]
                place += [np.arange(a, b + 1)]
    if not pieces:
        return {}
    s, owner_at, place_at = np.concatenate([*pieces, [0]]), np.concatenate(owner), np.concatenate(place)
    index = FMIndex(s, len(phrases.words) + 2)
    who, lo, hi = index.search(phrases.table, phrases.lengths)
    if not len(who):
        return {}
    count = hi - lo
    rows = np.repeat(lo - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
    which = np.repeat(who, count)
    at = index.locate(rows)
    edges = np.zeros(len(s) + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + phrases.lengths[which], -1)
    hit = np.flatnonzero(np.cumsum(edges)[: len(owner_at)] > 0)
    out: dict[int, tuple[list[int], np.ndarray]] = {}
    pairs = np.unique(owner_at[at] * len(phrases.lengths) + which)
    items: dict[int, set[int]] = {}
    for d, p in zip((pairs // len(phrases.lengths)).tolist(), (pairs % len(phrases.lengths)).tolist(), strict=True):
        items.setdefault(d, set()).update(phrases.owners(p))
    by = owner_at[hit]
    for d in items:
        flags = np.zeros(len(docs[d]), bool)
        flags[place_at[hit[np.searchsorted(by, d) : np.searchsorted(by, d, "right")]]] = True
        out[d] = (sorted(items[d]), flags)
    return out


_END = np.array([1])
_OUT = "n_words long, items array<long>, spans array<struct<first:long,last:long>>"


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str | None]]]:
    n = parts_for(byte_size(benchmark, "text"), BLOCK_BYTES)
    for k in range(n):
        part = benchmark.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else benchmark
        yield [(r[0], r[1]) for r in part.collect()]  # a block of bounded size


def _with_block(docs: DataFrame, text: str, items: list[tuple[int, str | None]]) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(Phrases(items))
    names = docs.columns
    schema = docs.selectExpr("*", "0L d_n_words", "array(0L) d_items", "array(named_struct('first', 0L, 'last', 0L)) d_spans").schema
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))]

    def run(batches):
        phrases: Phrases = sent.value
        get = phrases.words.get

        def shard(rows: pa.RecordBatch, docs: list[np.ndarray]):
            found = search_shard(docs, phrases)
            items = [list(dict.fromkeys(phrases.ids[k] for k in found[i][0])) if i in found else [] for i in range(len(docs))]
            spans = [[{"first": a, "last": b - 1} for a, b in _spans(found[i][1])] if i in found else [] for i in range(len(docs))]
            new = [pa.array([len(w) for w in docs], kinds[0]), pa.array(items, kinds[1]), pa.array(spans, kinds[2])]
            return pa.RecordBatch.from_arrays([*rows.columns, *new], [*names, "d_n_words", "d_items", "d_spans"])

        for batch in batches:
            texts, held, size, first = arrow_column(batch, text), [], 0, 0
            for i in range(batch.num_rows):
                w = split_words(texts[i].as_py())
                held.append(np.fromiter((get(x, 0) for x in w), np.int64, len(w)))
                size += int(np.count_nonzero(held[-1]))
                if size >= SHARD_WORDS:
                    yield shard(batch.slice(first, len(held)), held)
                    held, size, first = [], 0, i + 1
            if held:
                yield shard(batch.slice(first, len(held)), held)

    return docs.mapInArrow(run, schema)


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with d_n_words, d_items (ids of items with occurring windows) and d_spans.

    Spans are maximal runs of hit words (numbers of the first and last word). Null texts have no words; items without
    words have no windows; rows with equal item ids are one item, null ids one too; repeated rows are searched each; empty
    tables on either side give rows without hits, or none. Columns of ``docs`` keep their names and values, but for any
    that have one of the three names that are added: those are replaced.
    """
    found = _find(packed(docs), benchmark, f"{ROW}.{text}")
    return found.select(*[F.col(f"{ROW}.`{c}`") for c in docs.columns if c not in ("d_n_words", "d_items", "d_spans")], "d_n_words", "d_items", "d_spans")


def _find(docs: DataFrame, benchmark: DataFrame, text: str) -> DataFrame:
    """``find`` on rows in the struct ``ROW``."""
    prepare(docs.sparkSession)
    items = benchmark.select("item_id", "text")
    if parts_for(byte_size(items, "text"), BLOCK_BYTES) == 1:
        return _with_block(docs, text, next(_blocks(items)))
    # Several blocks: each searches the same stored rows, and the spans of a row are merged.
    rows = materialize(docs.withColumn("d_row", F.monotonically_increasing_id()), "decontaminate-docs")
    slim = rows.select("d_row", F.col(text).alias("text"))
    parts = None
    for block in _blocks(items):
        part = _with_block(slim, "text", block).filter(F.size("d_spans") > 0).select("d_row", "d_items", "d_spans")
        parts = part if parts is None else parts.union(part)
    merged = parts.groupBy("d_row").agg(F.array_distinct(F.flatten(F.collect_list("d_items"))).alias("d_items"), F.sort_array(F.flatten(F.collect_list("d_spans"))).alias("all"))
    joined = F.aggregate(
        "all",
        F.expr("cast(array() as array<struct<first:bigint,last:bigint>>)"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (x["first"] <= F.element_at(acc, -1)["last"] + 1),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.element_at(acc, -1)["first"].alias("first"), F.greatest(F.element_at(acc, -1)["last"], x["last"]).alias("last")))),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    merged = merged.select("d_row", "d_items", joined.alias("d_spans"))
    n = F.size(F.array_remove(F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+", " "), " "), ""))
    none = F.expr("cast(array() as array<bigint>)"), F.expr("cast(array() as array<struct<first:bigint,last:bigint>>)")
    out = rows.join(merged, "d_row", "left")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], n.cast("long").alias("d_n_words"), F.coalesce("d_items", none[0]).alias("d_items"), F.coalesce("d_spans", none[1]).alias("d_spans"))


def cut(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """``text`` without the characters from the first to the last word of each span."""
    if text is None or not spans:
        return text
    at = [m.span() for m in _WORD.finditer(text)]
    out, end = [], 0
    for a, b in spans:
        out.append(text[end : at[a][0]])
        end = at[b][1]
    return "".join([*out, text[end:]])


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` without any benchmark window, with the columns of ``docs``.

    Null and empty texts have no windows and stay; repeated rows stay or go together; an empty benchmark keeps all rows.
    """
    return unpacked(_find(packed(docs), benchmark, f"{ROW}.{text}").filter(F.size("d_spans") == 0))


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """All rows of ``docs``, with the merged spans of benchmark windows cut out of the texts.

    Null texts stay null; a text that is all window becomes what stands around its words; other columns keep their values.
    """
    found = _find(packed(docs), benchmark, f"{ROW}.{text}")
    out = found.select("*", F.lit(None).cast("string").alias("d_text")).schema

    def run(batches):
        for b in batches:
            texts = [cut(t, [(s["first"], s["last"]) for s in spans]) for t, spans in zip(arrow_column(b, f"{ROW}.{text}").to_pylist(), arrow_column(b, "d_spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, "d_text"])

    return unpacked(found.mapInArrow(run, out), **{text: F.col("d_text")})

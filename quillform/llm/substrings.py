"""Exact substring dedup by a depth-limited radix sort of suffixes.

A byte goes if a string of ``WINDOW`` = 50 bytes that covers it also starts in a document with a smaller id. Suffixes
are ordered only through their first 50 bytes, by most-significant-digit passes that drop every group of one:

1. First digit: a string's anchor, the ``GRAM``-byte piece with the smallest hash in it. Equal strings have equal
   anchors, and neighbouring strings share theirs, so an anchor stands for about 13 suffixes. Chunks of documents send
   each anchor once (40 bits of its hash within a bucket), and buckets return those seen in two documents.
2. Second digit: an anchor's whole context (all strings that share it, 75 bytes at most). A chunk sends each context
   once, with its smallest document; an equal context in a smaller document settles all its strings.
3. Contexts that differ around an anchor go through passes of eight bytes, string by string; what is equal after fifty
   bytes is a repeated string. An anchor with more than ``HOT`` contexts in all would be a group without bound: each of
   its strings goes to a bucket of its own digit instead (128 bits of two hashes), once per chunk.

Chunks and buckets hold a bounded number of bytes each, whatever the corpus; texts are shuffled once.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import bucket_of, pack_array, pack_bytes, pack_ints, pack_sorted, unpack_array, unpack_bytes, unpack_ints, unpack_sorted
from .common import byte_size, parts_for, prepare, spread

WINDOW = 50
GRAM = 24
#: Bytes of text in a chunk, and bytes of text whose anchors share a bucket.
CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20
#: Bytes that are hashed at a time, and strings that are sorted at a time.
SEGMENT = 1 << 18
STRINGS = 1 << 18
#: Contexts of one anchor, added up over chunks, above which its strings are dealt one by one.
HOT = 10_000

_POSITION = np.uint64((1 << 21) - 1)
_NOBODY = np.iinfo(np.int64).max  # a null id is smaller than none
_BASE = 0x9E3779B97F4A7C15 | 1
_SENT = "chunk long, bucket long, keys binary, several binary, contexts binary"
_SURVIVORS = "chunk long, bucket long, keys binary, hot binary"
_CONTEXTS = "chunk long, bucket long, keys binary, prints binary, docs binary, counts binary, leads binary, bytes binary"
_MASKS = "chunk long, bucket long, masks binary, least binary"


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    n = 2 * SEGMENT
    inverse = pow(_BASE, -1, 1 << 64)
    with np.errstate(over="ignore"):
        return tuple(np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, x, np.uint64)))) for x in (_BASE, inverse))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Anchors:
    """All anchors of a chunk's documents, in order: row, offset of the first string, strings, lead to the anchor, key, print."""

    def __init__(self, texts: list[bytes]):
        found: list[list[np.ndarray]] = []
        held: list[tuple[int, int, bytes]] = []
        size = 0
        for row, text in enumerate(texts):
            for a in range(0, len(text) - WINDOW + 1, SEGMENT // 2):
                part = text[a : a + SEGMENT // 2 + WINDOW - 1]
                if size + len(part) > SEGMENT and held:
                    found.append(self._segment(held))
                    held, size = [], 0
                held.append((row, a, part))
                size += len(part)
        if held:
            found.append(self._segment(held))
        kinds = (np.int64, np.int64, np.uint8, np.uint8, np.uint64, np.uint64)
        self.row, self.at, self.count, self.lead, self.key, self.print = (np.concatenate([f[k] for f in found]) if found else np.array([], kind) for k, kind in enumerate(kinds))

    @staticmethod
    def _segment(held: list[tuple[int, int, bytes]]) -> list[np.ndarray]:
        data = np.frombuffer(b"".join(p for _, _, p in held), np.uint8)
        n = len(data)
        power, inverse = _powers()
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
        key = _mix((sums[GRAM:] - sums[:-GRAM]) * inverse[: n - GRAM + 1])
        low = (key & ~_POSITION) | np.arange(len(key), dtype=np.uint64)
        span, have = WINDOW - GRAM + 1, 1
        while 2 * have <= span:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        if have < span:
            low = np.minimum(low[: n - WINDOW + 1], low[span - have :][: n - WINDOW + 1])
        lengths = np.array([len(p) for _, _, p in held])
        starts = np.cumsum(lengths) - lengths
        valid = np.ones(n, bool)
        for s, m in zip(starts.tolist(), lengths.tolist(), strict=True):
            valid[s + m - WINDOW + 1 : s + m] = False
        first = np.flatnonzero(valid)
        where = (low[first] & _POSITION).astype(np.int64)
        heads = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
        lo, anchor = first[heads], where[heads]
        count = np.diff(np.append(heads, len(first)))
        end = lo + count + WINDOW - 1
        context = _mix((sums[end] - sums[lo]) * inverse[lo]) ^ ((count.astype(np.uint64) << np.uint64(8)) | (anchor - lo).astype(np.uint64))
        part = np.searchsorted(starts, lo, "right") - 1
        rows, offsets = np.array([r for r, _, _ in held]), np.array([a for _, a, _ in held])
        # Anchors have small hashes by choice: mixed again, they spread evenly over buckets.
        return [rows[part], offsets[part] + lo - starts[part], count.astype(np.uint8), (anchor - lo).astype(np.uint8), _mix(key[anchor] + np.uint64(_BASE)), context]


def _small(key: np.ndarray) -> np.ndarray:
    """The 40 low bits that stand for a key within its bucket."""
    return (key & np.uint64((1 << 40) - 1)).astype(np.int64)


def _chunk(t: pa.Table) -> tuple[int, np.ndarray, list[bytes]]:
    """Number, ids and texts of a chunk, in an order that doesn't depend on how its rows came."""
    ids = t.column("doc_id").fill_null(_NOBODY).to_numpy()
    texts = t.column("text").to_pylist()
    order = sorted(range(len(texts)), key=lambda i: (int(ids[i]), texts[i]))
    return t.column("chunk")[0].as_py(), ids[order], [texts[i] for i in order]


def _send_keys(buckets: int):
    def run(t: pa.Table) -> pa.Table:
        chunk, ids, texts = _chunk(t)
        a = Anchors(texts)
        bucket, small, doc = bucket_of(a.key, buckets), _small(a.key), ids[a.row]
        order = np.lexsort((a.print, small, bucket))
        if not len(order):
            return _table([], "chunk bucket keys several contexts", 2)
        bucket, small, doc, shape = bucket[order], small[order], doc[order], a.print[order]
        new = np.concatenate(([True], (small[1:] != small[:-1]) | (bucket[1:] != bucket[:-1])))
        head = np.flatnonzero(new)
        several = np.minimum.reduceat(doc, head) != np.maximum.reduceat(doc, head)
        contexts = np.add.reduceat((new | np.concatenate(([True], shape[1:] != shape[:-1]))).astype(np.int64), head)
        cuts = np.searchsorted(bucket[head], np.arange(buckets + 1))
        rows = [(chunk, k, pack_sorted(small[head[x:y]]), np.packbits(several[x:y]).tobytes(), pack_ints(contexts[x:y])) for k, (x, y) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if y > x]
        return _table(rows, "chunk bucket keys several contexts", 2)

    return run


def _table(rows: list[tuple], names: str, ints: int) -> pa.Table:
    return pa.table({n: pa.array([r[k] for r in rows], pa.int64() if k < ints else pa.binary()) for k, n in enumerate(names.split())})


def _survivors(most: int):
    """Of a bucket's keys, those in two documents, for each chunk that has them; hot are those with more than ``most`` contexts."""

    def run(t: pa.Table) -> pa.Table:
        chunks, keys = t.column("chunk").to_pylist(), [unpack_sorted(x) for x in t.column("keys").to_pylist()]
        sizes = [len(k) for k in keys]
        several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool) for x, n in zip(t.column("several").to_pylist(), sizes, strict=True)])
        every = np.concatenate(keys)
        value, back, count = np.unique(every, return_inverse=True, return_counts=True)
        lives = count > 1
        lives[back[several]] = True
        hot = np.bincount(back, np.concatenate([unpack_ints(x) for x in t.column("contexts").to_pylist()]), len(value)) > most
        rows, at, bucket = [], 0, t.column("bucket")[0].as_py()
        for chunk, k in zip(chunks, keys, strict=True):
            mine = back[at : at + len(k)]
            on = lives[mine]
            if on.any():
                rows.append((chunk, bucket, pack_sorted(k[on]), np.packbits(hot[mine[on]]).tobytes()))
            at += len(k)
        return _table(rows, "chunk bucket keys hot", 2)

    return run


class Survivors:
    """A chunk's anchors that other documents have too: ``rep`` are the first of each context, by bucket and key."""

    def __init__(self, ids: np.ndarray, texts: list[bytes], kept: pa.Table, buckets: int):
        a = Anchors(texts)
        bucket, small = bucket_of(a.key, buckets), _small(a.key)
        live, hot = np.zeros(len(a.key), bool), np.zeros(len(a.key), bool)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for k, raw, bits in zip(kept.column("bucket").to_pylist(), kept.column("keys").to_pylist(), kept.column("hot").to_pylist(), strict=True):
            mine, told = order[cuts[k] : cuts[k + 1]], unpack_sorted(raw)
            place = np.minimum(np.searchsorted(told, small[mine]), len(told) - 1)
            live[mine] = told[place] == small[mine]
            hot[mine] = live[mine] & np.unpackbits(np.frombuffer(bits, np.uint8), count=len(told)).astype(bool)[place]
        at = np.flatnonzero(live)
        at = at[np.lexsort((a.at[at], ids[a.row[at]], a.print[at], small[at], bucket[at]))]
        self.row, self.at, self.count, self.lead, self.key, self.print, self.bucket = (x[at] for x in (a.row, a.at, a.count, a.lead, a.key, a.print, bucket))
        self.doc, hot = ids[self.row], hot[at]
        new = np.concatenate(([True], (self.key[1:] != self.key[:-1]) | (self.print[1:] != self.print[:-1]))) if len(at) else np.array([], bool)
        self.rep, self.group = np.flatnonzero(new), np.cumsum(new) - 1
        self.is_hot = hot[self.rep]
        self.cold = np.flatnonzero(~self.is_hot)  # among the representatives
        # Strings of hot anchors: whose they are, which of its strings, and the distinct ones by two hashes.
        mine = np.flatnonzero(self.is_hot)
        n = self.count[self.rep[mine]].astype(np.int64)
        self.hot_rep = np.repeat(mine, n)
        self.hot_string = np.arange(len(self.hot_rep)) - np.repeat(np.cumsum(n) - n, n)
        raw = b"".join(texts[i][p : p + c] for i, p, c in zip(self.row[self.rep[mine]].tolist(), self.at[self.rep[mine]].tolist(), (n + WINDOW - 1).tolist(), strict=True))
        first, second = _string_hashes(np.frombuffer(raw, np.uint8), np.repeat(np.cumsum(n + WINDOW - 1) - (n + WINDOW - 1), n) + self.hot_string)
        order = np.lexsort((self.doc[self.rep[self.hot_rep]], second, first))
        first, second = first[order], second[order]
        new = np.concatenate(([True], (first[1:] != first[:-1]) | (second[1:] != second[:-1]))) if len(order) else np.array([], bool)
        self.hot_of = np.empty(len(order), np.int64)
        self.hot_of[order] = np.cumsum(new) - 1
        self.hot_first, self.hot_second, self.hot_doc = first[new], second[new], self.doc[self.rep[self.hot_rep[order[new]]]]
        self.hot_bucket = bucket_of(self.hot_first, buckets)


def _cuts(bucket: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, begin, end) of the runs of sorted bucket numbers."""
    at = np.searchsorted(bucket, np.arange(buckets + 1)).tolist()
    return [(k, x, y) for k, (x, y) in enumerate(zip(at[:-1], at[1:], strict=True)) if y > x]


def _string_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each string of ``WINDOW`` bytes, in slices."""
    out = []
    for base in (_BASE, 0xD6E8FEB86659FD93):
        power = np.array([pow(base, k + 1, 1 << 64) for k in range(WINDOW)], np.uint64)
        parts = [_mix(((data[at[k : k + STRINGS // 8, None] + np.arange(WINDOW)].astype(np.uint64) + np.uint64(1)) * power).sum(axis=1, dtype=np.uint64)) for k in range(0, len(at), STRINGS // 8)] if len(at) else []
        out.append(np.concatenate(parts) if parts else np.array([], np.uint64))
    return out[0], out[1]


def _send_contexts(buckets: int):
    def run(docs: pa.Table, kept: pa.Table) -> pa.Table:
        names = "chunk bucket keys prints docs counts leads bytes"
        if not docs.num_rows or not kept.num_rows:
            return _table([], names, 2)
        chunk, ids, texts = _chunk(docs)
        s = Survivors(ids, texts, kept, buckets)
        rows = []
        for k, x, y in _cuts(s.bucket[s.rep[s.cold]], buckets):
            r = s.rep[s.cold[x:y]]
            raw = b"".join(texts[i][p : p + c] for i, p, c in zip(s.row[r].tolist(), s.at[r].tolist(), (s.count[r].astype(np.int64) + WINDOW - 1).tolist(), strict=True))
            rows.append((chunk, k, *(pack_array(v[r]) for v in (s.key, s.print, s.doc, s.count, s.lead)), pack_bytes(raw)))
        for k, x, y in _cuts(s.hot_bucket, buckets):
            rows.append((chunk, k, pack_array(s.hot_first[x:y]), pack_array(s.hot_second[x:y]), pack_array(s.hot_doc[x:y]), None, None, None))
        return _table(rows, names, 2)

    return run


def _repeated(data: np.ndarray, key: np.ndarray, doc: np.ndarray, at: np.ndarray, count: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """For each context a bit for each of its strings: it also starts in a context with a smaller document. Keys are sorted."""
    mask = np.zeros(len(key), np.uint32)
    heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    upto = np.concatenate(([0], np.cumsum(count, dtype=np.int64)))
    k = 0
    while k < len(heads) - 1:
        # Whole keys, at least one, of at most STRINGS strings.
        z = max(k + 1, int(np.searchsorted(upto[heads], upto[heads[k]] + STRINGS, "right")) - 1)
        a, b = heads[k], heads[z]
        n = count[a:b].astype(np.int64)
        who = np.repeat(np.arange(a, b), n)
        j = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
        place = at[who] + j
        group = (np.cumsum(np.concatenate(([0], key[a + 1 : b] != key[a : b - 1])))[who - a] << 8) | (lead[who].astype(np.int64) - j + 128)
        alive = np.argsort(group, kind="stable")
        group = group[alive]
        for depth in [None, *range(0, WINDOW - 8, 8), WINDOW - 8]:
            if depth is not None:  # the next digit: eight bytes of each string that still ties
                digit = np.zeros(len(alive), np.uint64)
                for byte in range(8):
                    digit = (digit << np.uint64(8)) | data[place[alive] + depth + byte]
                order = np.lexsort((digit, group))
                alive, group, digit = alive[order], group[order], digit[order]
                new = np.concatenate(([True], (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])))
            else:
                new = np.concatenate(([True], group[1:] != group[:-1]))
            tied = ~(new & np.append(new[1:], True))
            group = np.cumsum(new)[tied]
            alive = alive[tied]
            if not len(alive):
                break
        if len(alive):
            first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            owner = doc[who[alive]]
            least = np.repeat(np.minimum.reduceat(owner, first), np.diff(np.append(first, len(alive))))
            gone = alive[owner > least]
            np.bitwise_or.at(mask, who[gone], np.uint32(1) << j[gone].astype(np.uint32))
        k = z
    return mask


def _least(t: pa.Table) -> list[tuple[int, np.ndarray]]:
    """(chunk, smallest document of each of its hot strings)."""
    read = lambda name, kind: [unpack_array(x, kind) for x in t.column(name).to_pylist()]
    firsts = read("keys", np.uint64)
    if not firsts:
        return []
    first, second, doc = np.concatenate(firsts), np.concatenate(read("prints", np.uint64)), np.concatenate(read("docs", np.int64))
    order = np.lexsort((second, first))
    new = np.concatenate(([True], (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1])))
    head = np.flatnonzero(new)
    least = np.empty(len(order), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(doc[order], head), np.diff(np.append(head, len(order))))
    cuts = np.cumsum([0, *map(len, firsts)]).tolist()
    return [(c, least[x:y]) for c, x, y in zip(t.column("chunk").to_pylist(), cuts[:-1], cuts[1:], strict=True)]


def _settle(t: pa.Table) -> pa.Table:
    """Of a bucket's contexts, the strings that a smaller document has, and of its hot strings the smallest document, for each chunk in the order it sent."""
    names, bucket = "chunk bucket masks least", t.column("bucket")[0].as_py()
    is_hot = t.column("bytes").is_null().to_numpy(zero_copy_only=False)
    rows = [(c, bucket, None, pack_array(x)) for c, x in _least(t.filter(pa.array(is_hot)))]
    t = t.filter(pa.array(~is_hot))
    if not t.num_rows:
        return _table(rows, names, 2)
    read = lambda name, kind: [unpack_array(x, kind) for x in t.column(name).to_pylist()]
    keys = read("keys", np.uint64)
    key, shape, doc, count, lead = np.concatenate(keys), *(np.concatenate(read(n, k)) for n, k in (("prints", np.uint64), ("docs", np.int64), ("counts", np.uint8), ("leads", np.uint8)))
    data = np.concatenate([unpack_bytes(x) for x in t.column("bytes").to_pylist()])
    lengths = count.astype(np.int64) + WINDOW - 1
    at = np.cumsum(lengths) - lengths
    order = np.lexsort((doc, shape, key))
    new = np.concatenate(([True], (key[order][1:] != key[order][:-1]) | (shape[order][1:] != shape[order][:-1])))
    head = order[new]  # the smallest document of each context
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    value, size = np.unique(key[head], return_counts=True)
    several = np.flatnonzero(size[np.searchsorted(value, key[head])] > 1)
    found = np.zeros(len(head), np.uint32)
    pick = head[several]
    if len(pick):
        found[several] = _repeated(data, key[pick], doc[pick], at[pick], count[pick], lead[pick])
    every = ((np.uint64(1) << count.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
    mask = np.where(doc > doc[head[group]], every, found[group])
    cuts = np.cumsum([0, *map(len, keys)]).tolist()
    rows += [(c, bucket, pack_array(mask[x:y]), None) for c, x, y in zip(t.column("chunk").to_pylist(), cuts[:-1], cuts[1:], strict=True)]
    return _table(rows, names, 2)


def _finish(buckets: int):
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        names = ["doc_id", "n_bytes", "spans", "kept"]
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
        if not docs.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names)
        _, ids, texts = _chunk(docs)
        sizes = np.array([len(x) for x in texts], np.int64)
        base = np.cumsum(sizes) - sizes
        edges = np.zeros(int(sizes.sum()) + 1, np.int32)
        kept = told.filter(told.column("keys").is_valid()) if told.num_rows else told
        if kept.num_rows:
            s = Survivors(ids, texts, kept, buckets)
            pick = lambda name, kind: [unpack_array(x, kind) for x in told.filter(told.column(name).is_valid()).sort_by("bucket").column(name).to_pylist()]
            mask = np.zeros(len(s.rep), np.uint32)
            if len(s.cold):
                mask[s.cold] = np.concatenate(pick("masks", np.uint32))
            if len(s.hot_rep):
                gone = s.doc[s.rep[s.hot_rep]] > np.concatenate(pick("least", np.int64))[s.hot_of]
                np.bitwise_or.at(mask, s.hot_rep[gone], np.uint32(1) << s.hot_string[gone].astype(np.uint32))
            every = ((np.uint64(1) << s.count.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
            mine = np.where(s.doc > s.doc[s.rep[s.group]], every, mask[s.group])
            for j in range(WINDOW - GRAM + 1):
                on = (mine >> np.uint32(j)) & 1 == 1
                at = base[s.row[on]] + s.at[on] + j
                np.add.at(edges, at, 1)
                np.add.at(edges, at + WINDOW, -1)
        gone = np.cumsum(edges[:-1]) > 0
        spans, left = [], []
        for b, n, text in zip(base.tolist(), sizes.tolist(), texts, strict=True):
            cut = np.flatnonzero(np.diff(np.concatenate(([0], gone[b : b + n].view(np.int8), [0]))))
            pairs = list(zip(cut[::2].tolist(), cut[1::2].tolist(), strict=True))
            spans.append([{"start": x, "end": y} for x, y in pairs])
            if pairs:
                out, end = [], 0
                for x, y in pairs:
                    out.append(text[end:x])
                    end = y
                text = b"".join([*out, text[end:]])
            left.append(text)
        own = pa.array([None if i == _NOBODY else i for i in ids.tolist()], kinds[0])
        return pa.table([own, pa.array(sizes), pa.array(spans, kinds[2]), pa.array(left, kinds[3])], names)

    return run


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans, kept) for every row: the removed runs of bytes, and the remaining bytes as binary.

    Null texts are empty; texts under 50 bytes lose nothing; rows with equal ids don't remove each other's strings; a
    null id is smaller than none; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("text"))
    total = byte_size(docs, "text")
    chunks, buckets = parts_for(total, CHUNK_BYTES), parts_for(total, BUCKET_BYTES)
    rows = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks).cast("long")))
    by_chunk = spread(rows, chunks, "chunk").groupBy("chunk")
    to_chunk = lambda df: spread(df, chunks, "chunk").groupBy("chunk")
    to_bucket = lambda df: spread(df, buckets, "bucket").groupBy("bucket")
    sent = by_chunk.applyInArrow(_send_keys(buckets), _SENT)
    kept = to_bucket(sent).applyInArrow(_survivors(HOT), _SURVIVORS)
    contexts = by_chunk.cogroup(to_chunk(kept)).applyInArrow(_send_contexts(buckets), _CONTEXTS)
    masks = to_bucket(contexts).applyInArrow(_settle, _MASKS)
    told = kept.unionByName(masks, allowMissingColumns=True)
    return by_chunk.cogroup(to_chunk(told)).applyInArrow(_finish(buckets), "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")

"""Katz backoff language model over words, trained and evaluated where the documents are.

Counts of n-grams up to ``ORDER`` words are discounted by Good-Turing up to ``K`` occurrences; the freed mass of a history
goes to the words not seen after it in proportion to their probabilities after the history without its first word, with
backoff weight

    alpha(h) = (1 - sum of P(w | h) over seen w) / (1 - sum of P(w | h') over seen w),

so that every history's distribution adds up to one, exactly. Unigrams are discounted alike; their freed mass is the class
of unknown words. A history whose followers all occur more than ``K`` times would free nothing: it counts one more,
unseen, occurrence. N-grams of three words and more that occur once count as unseen, as Katz proposed (their mass is
freed too, and how many there are is known from the others). A document begins after an end token; its first tokens have
histories as long as what came before them.

Chunks of documents are stored once in the shared folder as word numbers with their vocabulary. Each chunk sends its
distinct words, then its distinct bigrams, and so on, to hash buckets with their training counts; buckets add up, store
their part of the model (tables partitioned by order, counts of 64 bits, and the backoff weights once the discounts are
known), and reply to each chunk in the order it asked. Words are told apart by 72 bits of a hash; from then on they and
the n-grams that can be histories have numbers, so longer n-grams are compared exactly. An n-gram is sent on only if its
history and its ending occur twice: others can't. The followers of a history of ``HOT`` occurrences or more are dealt to
buckets by follower, and its sums are added up by Spark. A hot word or n-gram is one entry per chunk, and a chunk
evaluates its own tokens by recursion over the replies.
"""

from __future__ import annotations

import gc
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import bucket_of, pack_array, pack_longs, pack_sorted, unpack_array, unpack_longs, unpack_sorted
from .common import byte_size, get_file, materialize, parts_for, put_file, scratch, prepare

ORDER = 3
#: The longest n-grams that an order can be asked for.
LONGEST = 16
K = 5
CHUNK_TOKENS = 1 << 20
BUCKET_BYTES = 8 << 20
#: Occurrences from which a history's followers are dealt to several buckets.
HOT = 1 << 16
#: Stands for the end; no word holds a blank.
END = b" end "
FOLDS, HELD = 7, 2
#: Columns of a history's sums: occurrences of followers beyond K, followers seen 1..K times, seen followers whose ending occurs 1..K times, the other endings' occurrences.
SUMS = 2 * K + 2


def held_out(doc_id: int | None) -> bool:
    """Whether a document is kept from training; a null id counts as an empty text."""
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % FOLDS == HELD


def unseen(order: int) -> int:
    """Up to how many occurrences an n-gram counts as unseen."""
    return 0 if order < 3 else 1


def discounts(n: list[int]) -> np.ndarray:
    """Factors for counts 0..K from the numbers of types that occur 1..K+1 times (n[0] is unused).

    Good-Turing in Katz's form; where the counts of counts allow no such factors (all in (0, 1], some below 1), absolute
    discounting by N1 / (N1 + 2 N2).
    """
    out = np.ones(K + 1)
    if all(x > 0 for x in n[1 : K + 2]):
        tail = (K + 1) * n[K + 1] / n[1]
        if tail < 1:
            r = np.arange(1, K + 1)
            d = ((r + 1) * np.array(n[2 : K + 2]) / np.array(n[1 : K + 1]) / r - tail) / (1 - tail)
            if (d > 0).all() and (d <= 1).all() and (d < 1).any():
                out[1:] = d
                return out
    delta = min(0.99, max(0.01, n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5))
    r = np.arange(1, K + 1)
    out[1:] = (r - delta) / r
    return out


def factor(d: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.where(count <= K, d[np.minimum(count, K)], 1.0)


class Unigrams:
    """Discounted unigram probabilities from the totals of the training tokens."""

    def __init__(self, tokens: int, types: int, n: list[int]):
        self.tokens, self.types = tokens, types
        self.d = discounts(n)
        freed = sum(r * n[r] * (1 - self.d[r]) for r in range(1, K + 1))
        self.unknown = freed / tokens if tokens else 1.0
        if tokens and not self.unknown:  # no type is rare: one more, unknown, token
            self.tokens_p, self.unknown = tokens + 1, 1 / (tokens + 1)
        else:
            self.tokens_p = max(tokens, 1)

    def p(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, factor(self.d, count) * count / self.tokens_p, self.unknown)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1) / (self.tokens + (self.types + 1)))


class Order:
    """Discounted probabilities of n-grams and backoff weights of their histories (rows of ``SUMS``, and their occurrences)."""

    def __init__(self, order: int, n: list[int], below: Unigrams | Order):
        self.order, self.below, self.d = order, below, discounts(n)
        self.d[1 : unseen(order) + 1] = 0.0

    def _freed(self, sums: np.ndarray, tot: np.ndarray) -> np.ndarray:
        r = np.arange(1, K + 1)
        n = sums[:, 1 : K + 1]
        return (n * (r * (1 - self.d[1:]))).sum(axis=1) + (tot - sums[:, 0] - (n * r).sum(axis=1))

    def total(self, sums: np.ndarray, tot: np.ndarray) -> np.ndarray:
        """Occurrences of each history, with the unseen one where nothing is freed."""
        return tot + (self._freed(sums, tot) <= 0)

    def log_p(self, count: np.ndarray, total: np.ndarray) -> np.ndarray:
        return np.log10(factor(self.d, count) * count / total)

    def log_alpha(self, sums: np.ndarray, tot: np.ndarray, below: np.ndarray | float) -> np.ndarray:
        """``below``: the occurrences (by ``total``) of the history without its first word; for bigrams, of all tokens."""
        freed = self._freed(sums, tot)
        left = np.where(freed > 0, freed, 1) / self.total(sums, tot)
        r = np.arange(1, K + 1)
        seen = (sums[:, K + 1 : 2 * K + 1] * (r * self.below.d[1:])).sum(axis=1) + sums[:, 2 * K + 1]
        return np.log10(left / (1 - seen / below))


def _mix(x: np.ndarray) -> np.ndarray:
    """Numbers spread over 64 bits."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins of the runs of equal neighbours, with the length at the end; and their values."""
    at = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.array([], np.int64)
    return np.append(at, len(x)), x[at]


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct numbers in the order in which they come, where each comes first, and which each element is."""
    which, value = pd.factorize(x)
    first = np.empty(len(value), np.int64)
    first[which[::-1]] = np.arange(len(x) - 1, -1, -1)
    return value, first, which


def _by_two(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The order by a, then b; equal pairs in any order."""
    if len(a) and int(b.max()).bit_length() + int(a.max()).bit_length() < 63:
        return np.argsort((a << int(b.max()).bit_length()) | b)
    return np.lexsort((b, a))


class Grams:
    """The n-grams of a chunk at one order: its histories, its items, and which of them each position has."""

    def __init__(self, chunk: Chunk, order: int, hist: np.ndarray, occurs: np.ndarray, low: np.ndarray, below: np.ndarray | None):
        self.buckets, least = chunk.buckets, unseen(order) + 1
        live = occurs >= least
        self.hists, first, at = _distinct(hist[live])
        self.tot = occurs[live][first]
        self.below = None if below is None else below[live][first]
        self.h_place = np.full(len(hist), -1)
        self.h_place[live] = at
        sent = live & (low >= least)
        pair, first, at = _distinct((self.h_place[sent] << 32) | chunk.tokens[sent])
        self.place = np.full(len(hist), -1)
        self.place[sent] = at
        self.owner, self.word, self.low = pair >> 32, chunk.word_id[pair & 0xFFFFFFFF], low[sent][first]
        self.seen = np.bincount(at[chunk.train[sent]], minlength=len(pair))
        self.order, self.hot = order, self.tot >= chunk.hot
        # Histories that occur in this chunk only: their sums needn't travel.
        self.own = (np.bincount(self.h_place[live & chunk.train], minlength=len(self.hists)) == self.tot) & ~self.hot
        # Histories by bucket and number; cold items with them, hot items by their own bucket.
        self.h_bucket = (_mix(self.hists) % np.uint64(self.buckets)).astype(np.int64)
        self.h_order = np.lexsort((self.hists, self.h_bucket))
        rank = np.empty(len(self.hists), np.int64)
        rank[self.h_order] = np.arange(len(self.hists))
        warm = self.hot[self.owner]
        self.cold = np.flatnonzero(~warm)
        self.cold = self.cold[_by_two(rank[self.owner[self.cold]], self.word[self.cold])]
        self.warm = np.flatnonzero(warm)
        self.w_bucket = (_mix(_mix(self.word[self.warm]) ^ self.hists[self.owner[self.warm]].astype(np.uint64)) % np.uint64(self.buckets)).astype(np.int64)
        turn = np.lexsort((self.word[self.warm], self.hists[self.owner[self.warm]], self.w_bucket))
        self.warm, self.w_bucket = self.warm[turn], self.w_bucket[turn]

    def _message(self, bucket: int, hot: bool, hists: np.ndarray, sizes: np.ndarray, items: np.ndarray) -> tuple:
        words, at = np.unique(self.word[items], return_inverse=True)
        below = None if self.below is None else pack_longs(self.below[hists])
        asc = self.hists[hists]
        return (bucket, hot, pack_longs(np.diff(asc, prepend=0)), pack_longs(self.tot[hists]), below, pack_longs(sizes), pack_longs(np.diff(words, prepend=0)), pack_longs(at), pack_longs(self.seen[items]), pack_longs(self.low[items]), np.packbits(self.own[hists]).tobytes())

    def messages(self) -> list[tuple]:
        """(bucket, hot, numbers, occurrences and totals below of histories, sizes, followers, which, training counts, endings' counts, own histories)."""
        out = []
        sizes = np.bincount(self.owner[self.cold], minlength=len(self.hists))[self.h_order]
        upto = np.concatenate(([0], np.cumsum(sizes)))
        cuts, bucket = _runs(self.h_bucket[self.h_order])
        for b, x, y in zip(bucket.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            out.append(self._message(b, False, self.h_order[x:y], sizes[x:y], self.cold[upto[x] : upto[y]]))
        cuts, bucket = _runs(self.w_bucket)
        for b, x, y in zip(bucket.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            inner, owner = _runs(self.owner[self.warm[x:y]])
            out.append(self._message(b, True, owner, np.diff(inner), self.warm[x:y]))
        return out

    def take(self, replies: list[tuple], told: list[tuple]) -> None:
        """Replies (hot, bucket, counts, numbers, sums) and (history, sums) of hot histories: ``total`` and ``number`` of items, ``sums`` of histories."""
        self.total, self.number = np.zeros(len(self.owner), np.int64), np.zeros(len(self.owner), np.int64)
        self.sums = np.zeros((len(self.hists), SUMS), np.int64)
        for hot, items in ((False, self.cold), (True, self.warm)):
            mine = sorted((r for r in replies if r[0] == hot), key=lambda r: r[1])
            if mine:
                counts = [unpack_longs(r[2]) for r in mine]
                self.total[items] = np.concatenate(counts)
                if mine[0][3] is not None:  # longest n-grams are no histories
                    bucket = np.repeat([r[1] for r in mine], [len(c) for c in counts])
                    self.number[items] = ((np.concatenate([unpack_longs(r[3]) for r in mine]) * self.buckets + bucket) << 1) | int(hot)
            if mine and not hot:
                self.sums[self.h_order[~self.own[self.h_order]]] = np.concatenate([_matrix(r[4]) for r in mine])
        local = self.own[self.owner]
        self.sums[self.own] = _history_sums(self.owner[local], self.total[local], self.low[local], len(self.hists), self.order)[self.own]
        if told:
            hist = np.array([h for h, _ in told], np.int64)
            turn = np.argsort(self.hists)
            at = turn[np.searchsorted(self.hists, hist, sorter=turn)]
            self.sums[at] = np.array([x for _, x in told], np.int64)


class Chunk:
    """Documents as word numbers; number 0 is the end."""

    def __init__(self, ids: list[int | None], sizes: np.ndarray, tokens: np.ndarray, order: np.ndarray, buckets: int, hot: int):
        #: Words in the order in which they are sent: by bucket and key.
        self.ids, self.sizes, self.tokens, self.order, self.buckets, self.hot = ids, sizes, tokens, order, buckets, hot
        self.held = np.array([held_out(i) for i in ids], bool)
        self.train = np.repeat(~self.held, sizes)
        self.starts = np.cumsum(sizes) - sizes
        self.inside = np.arange(len(tokens)) - np.repeat(self.starts, sizes)

    def dump(self) -> bytes:
        ids = np.array([0 if i is None else i for i in self.ids], np.int64)
        none = np.array([i is None for i in self.ids], np.uint8)
        parts = [zstandard.compress(x, 1) for x in (ids.tobytes(), none.tobytes())] + [pack_longs(self.sizes), pack_longs(self.tokens), pack_longs(self.order)]
        return b"".join(len(x).to_bytes(8, "little") + x for x in parts)

    @classmethod
    def load(cls, raw: bytes, buckets: int, hot: int) -> Chunk:
        parts, at = [], 0
        while at < len(raw):
            n = int.from_bytes(raw[at : at + 8], "little")
            parts.append(raw[at + 8 : at + 8 + n])
            at += 8 + n
        ids, none = (np.frombuffer(zstandard.decompress(x), k) for x, k in zip(parts, (np.int64, np.uint8), strict=False))
        return cls([None if z else i for i, z in zip(ids.tolist(), none.tolist(), strict=True)], *(unpack_longs(x) for x in parts[2:]), buckets, hot)

    def positions(self, order: int) -> list[int]:
        """Training tokens that have a history of each length up to ``order``."""
        return [int((self.train & (self.inside >= m - 2)).sum()) for m in range(2, order + 1)]

    def words(self, high: np.ndarray, low: np.ndarray, order: int) -> list[tuple]:
        """(bucket, keys, rest of the keys, training counts, positions) of the distinct words, whose keys these are."""
        count = np.bincount(self.tokens[self.train], minlength=len(high))[self.order]
        high, low, out = high[self.order], low[self.order], []
        cuts, bucket = _runs(bucket_of(high, self.buckets))
        for b, x, y in zip(bucket.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            out.append((b, pack_sorted(high[x:y]), pack_array(low[x:y]), pack_longs(count[x:y]), None if out else self.positions(order)))
        return out

    def set_words(self, replies: list[tuple]) -> None:
        """Each word's training count and number, from replies (bucket, counts, numbers)."""
        mine = sorted(replies)
        counts, ranks = [unpack_longs(r[1]) for r in mine], [unpack_longs(r[2]) for r in mine]
        self.count, self.word_id = np.empty(len(self.order), np.int64), np.empty(len(self.order), np.int64)
        self.count[self.order] = np.concatenate(counts)
        self.word_id[self.order] = np.concatenate(ranks) * self.buckets + np.repeat([r[0] for r in mine], [len(c) for c in counts])

    def grams(self, order: int, replies: dict[int, tuple[list, list]], models: list[Order]) -> list[Grams]:
        """The n-grams of orders 2 to ``order``; all but the last have had their replies, the last if there are some for it."""
        start = self.inside == 0
        history = np.concatenate(([0], self.tokens[:-1]))
        history[start] = 0
        hist, occurs, low, below, out = self.word_id[history], self.count[history], self.count[self.tokens], None, []
        for m in range(2, order + 1):
            g = Grams(self, m, hist, occurs, low, below)
            out.append(g)
            if m in replies:
                g.take(*replies[m])
            if m == order:
                break
            # The n-gram at a position is the history of the next one.
            has = g.place >= 0
            total, number = np.where(has, g.total[g.place] if len(g.total) else 0, 0), np.where(has, g.number[g.place] if len(g.number) else 0, 0)
            hist, occurs = np.concatenate(([0], number[:-1])), np.concatenate(([0], total[:-1]))
            occurs[start] = 0
            low = total
            whole = models[m - 2].total(g.sums, g.tot)
            below = np.where(g.h_place >= 0, whole[g.h_place] if len(whole) else 0, 0)
        return out

    def scores(self, one: Unigrams, models: list[Order], grams: list[Grams]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known tokens, base score, model score) of each document."""
        count = self.count[self.tokens]
        base = np.add.reduceat(one.base(count), self.starts)
        known = np.add.reduceat((count > 0).astype(np.int64), self.starts)
        score = np.log10(one.p(count))
        for model, g in zip(models, grams, strict=True):
            if not len(g.hists):
                continue
            # Backoff: the shorter history's probability times the weight; then the n-gram's own where it was seen.
            alpha = model.log_alpha(g.sums, g.tot, one.tokens_p if g.below is None else g.below)
            has = g.h_place >= 0
            score = np.where(has, score + alpha[g.h_place], score)
            seen = np.append(g.total, 0)[g.place]
            hit = has & (seen > unseen(model.order))
            score[hit] = model.log_p(seen[hit], model.total(g.sums, g.tot)[g.h_place[hit]])
        return known, base, np.add.reduceat(score, self.starts)


_WORDS = "chunk long, bucket long, keys binary, rest binary, counts binary, positions array<long>"
_ASKED = "chunk long, bucket long, hot boolean, hists binary, tots binary, belows binary, sizes binary, words binary, which binary, counts binary, lows binary, owns binary"
_REPLY = "part string, chunk long, bucket long, hot boolean, keys binary, counts binary, numbers binary, sums binary, tots binary, belows binary, stats array<long>"
_ARROW = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    names, kinds = zip(*(x.split(" ") for x in schema.split(", ")), strict=True)
    return pa.table([pa.array([r[k] for r in rows], _ARROW[t]) for k, t in enumerate(kinds)], list(names))


def _stats(count: np.ndarray) -> list[int]:
    """Occurrences of those that occur twice at least, all occurrences, types, and types that occur 1..K+1 times."""
    return [int(count[count > 1].sum()), int(count.sum()), int((count > 0).sum()), *np.bincount(np.minimum(count, K + 2), minlength=K + 3)[1 : K + 2].tolist()]


def _planes(sums: np.ndarray) -> bytes:
    return pack_longs(sums.T.reshape(-1))


def _matrix(raw: bytes) -> np.ndarray:
    return unpack_longs(raw).reshape(SUMS, -1).T


def _store(folder: str, buckets: int, order: int):
    def run(batches):
        task, number = TaskContext.get().partitionId(), 0
        ids: list = []
        sizes: list[int] = []
        tokens: list[int] = []
        local: dict[bytes, int] = {END: 0}

        def flush():
            raw, flat = b"".join(xxhash.xxh3_128_digest(w) for w in local), np.array(tokens, np.int64)
            keys = np.frombuffer(raw, ">u8").astype(np.uint64).reshape(-1, 2)
            # Frequent words get small numbers, which compress better; the end stays 0.
            turn = np.concatenate(([0], 1 + np.argsort(-np.bincount(flat, minlength=len(keys))[1:], kind="stable")))
            number_of = np.empty(len(turn), np.int64)
            number_of[turn] = np.arange(len(turn))
            high, low = keys[turn, 0], (keys[turn, 1] >> np.uint64(32)).astype(np.uint32)
            sent = np.lexsort((low, high & np.uint64((1 << 40) - 1), bucket_of(high, buckets)))
            chunk, name = Chunk(ids, np.array(sizes), number_of[flat], sent, buckets, HOT), (task << 24) | number
            put_file(folder, f"{name}.chunk", chunk.dump())
            return _table(_WORDS, [(name, *r) for r in chunk.words(high, low, order)]).combine_chunks().to_batches()[0]

        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = (text.as_py() or "").encode().lower().split()
                add = local.setdefault
                ids.append(i)
                tokens.extend([add(w, len(local)) for w in words])
                tokens.append(0)
                sizes.append(len(words) + 1)
                if len(tokens) >= CHUNK_TOKENS:
                    yield flush()
                    number, ids, sizes, tokens, local = number + 1, [], [], [], {END: 0}
        if ids:
            yield flush()

    return run


def _add_words(t: pa.Table) -> pa.Table:
    bucket, chunks = t.column("bucket")[0].as_py(), t.column("chunk").to_pylist()
    high, low = [unpack_sorted(x) for x in t.column("keys").to_pylist()], [unpack_array(x, np.uint32) for x in t.column("rest").to_pylist()]
    count = np.concatenate([unpack_longs(x) for x in t.column("counts").to_pylist()])
    h, l = np.concatenate(high), np.concatenate(low)
    turn = np.lexsort((l, h))
    new = np.concatenate(([True], (h[turn][1:] != h[turn][:-1]) | (l[turn][1:] != l[turn][:-1])))
    place = np.empty(len(turn), np.int64)
    place[turn] = np.cumsum(new) - 1
    total = _sum(place, count, int(new.sum()))
    rows, at = [], 0
    for chunk, k in zip(chunks, high, strict=True):
        mine = place[at : at + len(k)]
        rows.append(("reply", chunk, bucket, False, None, pack_longs(total[mine]), pack_longs(mine), None, None, None, None))
        at += len(k)
    first = turn[new]
    positions = [p for p in t.column("positions").to_pylist() if p]
    stats = [*_stats(total), *(np.sum(positions, axis=0).tolist() if positions else [])]
    model = ("model", None, bucket, False, pack_longs(h[first]), pack_longs(total), pack_array(l[first]), None, None, None, stats)
    return _table(_REPLY, [*rows, model])


def _sum(place: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """Sums of counts by place, in whole numbers."""
    out = np.zeros(n, np.int64)
    np.add.at(out, place, count)
    return out


def _told(t: pa.Table, order: int) -> tuple[list, dict[int, tuple[list, list]]]:
    """What a chunk's rows say: replies on words, and by order (replies, sums of hot histories)."""
    words, grams = [], {m: ([], []) for m in range(2, order + 1)}
    for m, bucket, hot, counts, numbers, sums, told in zip(*(t.column(c).to_pylist() for c in ("order", "bucket", "hot", "counts", "numbers", "sums", "told")), strict=True):
        if m == 1:
            words.append((bucket, counts, numbers))
        elif told is not None:
            grams[m][1].extend((x["hist"], x["sums"]) for x in told)
        else:
            grams[m][0].append((hot, bucket, counts, numbers, sums))
    return words, grams


def _ask(folder: str, buckets: int, hot: int, order: int, models: list[Order]):
    def run(t: pa.Table) -> pa.Table:
        name = t.column("chunk")[0].as_py()
        chunk = Chunk.load(get_file(folder, f"{name}.chunk"), buckets, hot)
        words, told = _told(t, order - 1)
        chunk.set_words(words)
        return _table(_ASKED, [(name, *r) for r in chunk.grams(order, told, models)[-1].messages()])

    return run


def _history_sums(who: np.ndarray, total: np.ndarray, ending: np.ndarray, n: int, order: int) -> np.ndarray:
    """The ``SUMS`` of n histories from their n-grams: history, occurrences, occurrences of the ending."""
    seen, sums = total > unseen(order), np.zeros((n, SUMS), np.int64)
    sums[:, 0] = _sum(who[total > K], total[total > K], n)
    for r in range(1, K + 1):
        sums[:, r] = np.bincount(who[total == r], minlength=n)
        sums[:, K + r] = np.bincount(who[seen & (ending == r)], minlength=n)
    big = seen & (ending > K)
    sums[:, 2 * K + 1] = _sum(who[big], ending[big], n)
    return sums


def _add_grams(order: int, last: bool, most: int):
    def run(t: pa.Table) -> pa.Table:
        bucket, hot, chunks = t.column("bucket")[0].as_py(), t.column("hot")[0].as_py(), t.column("chunk").to_pylist()
        read = lambda name: [unpack_longs(x) for x in t.column(name).to_pylist()]
        hists, sizes = [np.cumsum(x) for x in read("hists")], read("sizes")
        words = [np.cumsum(w)[i] for w, i in zip(read("words"), read("which"), strict=True)]
        value, first, hist = np.unique(np.concatenate(hists), return_index=True, return_inverse=True)
        tot, below = np.concatenate(read("tots"))[first], np.concatenate(read("belows"))[first] if order > 2 else None
        owner = np.repeat(hist, np.concatenate(sizes))
        word, count, low = np.concatenate(words), np.concatenate(read("counts")), np.concatenate(read("lows"))
        turn = _by_two(owner, word)
        new = np.concatenate(([True], (owner[turn][1:] != owner[turn][:-1]) | (word[turn][1:] != word[turn][:-1]))) if len(turn) else np.array([], bool)
        head, place = turn[new], np.empty(len(turn), np.int64)
        place[turn] = np.cumsum(new) - 1
        total = _sum(place, count, len(head))
        who, ending = owner[head], low[head]
        sums = _history_sums(who, total, ending, len(value), order)
        # Only n-grams that occur twice can be histories.
        number = np.where(total > 1, np.cumsum(total > 1) - 1, 0)
        rows, a, b = [], 0, 0
        for chunk, hs, ws, own in zip(chunks, hists, words, t.column("owns").to_pylist(), strict=True):
            mine, items = hist[a : a + len(hs)], place[b : b + len(ws)]
            rows.append(("reply", chunk, bucket, hot, None, pack_longs(total[items]), None if last else pack_longs(number[items]), None if hot else _planes(sums[mine[np.unpackbits(np.frombuffer(own, np.uint8), count=len(hs)) == 0]]), None, None, None))
            asked = hs[tot[mine] >= most]
            if not hot and len(asked):
                rows.append(("ask", chunk, bucket, hot, pack_longs(asked), None, None, None, None, None, None))
            a, b = a + len(hs), b + len(ws)
        kept = np.flatnonzero(total > unseen(order))
        follower = _lengths(np.bincount(who[kept], minlength=len(value)), word[head[kept]], total[kept])
        # A longer history without seen followers has weight one and is left out.
        whole = (tot < most if not hot else np.ones(len(value), bool)) & ((order < 3) | sums.any(axis=1))
        rows.append(("hot" if hot else "model", None, bucket, hot, pack_longs(value[whole]), pack_longs(tot[whole]), None, _planes(sums[whole]), None, None if below is None else pack_longs(below[whole]), _stats(total)))
        rows.append(("counts", None, bucket, hot, pack_longs(value), follower, None, None, None, None, None))
        return _table(_REPLY, rows)

    return run


def _lengths(*arrays: np.ndarray) -> bytes:
    parts = [pack_longs(x) for x in arrays]
    return b"".join(len(x).to_bytes(8, "little") + x for x in parts)


def _evaluate(folder: str, buckets: int, hot: int, one: Unigrams, models: list[Order]):
    order = len(models) + 1

    def run(t: pa.Table) -> pa.Table:
        chunk = Chunk.load(get_file(folder, f"{t.column('chunk')[0].as_py()}.chunk"), buckets, hot)
        words, told = _told(t, order)
        chunk.set_words(words)
        known, base, score = chunk.scores(one, models, chunk.grams(order, told, models))
        n = len(chunk.ids)
        return pa.table([pa.array(chunk.ids, pa.int64()), pa.array(chunk.held), pa.array(chunk.sizes), pa.array(known), pa.array([one.tokens] * n, pa.int64()), pa.array(base), pa.array(score)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def _keep(df: DataFrame, root: str, order: int) -> tuple[DataFrame, list[int]]:
    """Store the replies and an order's part of the model; the model's totals."""
    path = f"{root}/order={order}"
    df.write.partitionBy("part").option("compression", "none").parquet(path)
    stored = df.sparkSession.read.schema(_REPLY).parquet(path)
    size = K + 4 + (LONGEST if order == 1 else 0)
    sums = stored.filter("part IN ('model', 'hot')").agg(*[F.sum(F.get("stats", F.lit(k))) for k in range(size)]).first()
    return stored, [int(x or 0) for x in sums]


def _release(spark) -> None:
    """Let Spark delete the exchanges whose results are stored: it does when its garbage collection finds nobody holds them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_HOT_ROWS = "chunk long, hist long, tot long, below long, sums array<long>"


def _expand(batches):
    """A row for each hot history: asked for by a chunk, or part of its sums."""
    for b in batches:
        for part, chunk, keys, tots, sums, belows in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("part", "chunk", "keys", "counts", "sums", "belows")), strict=True):
            hist = unpack_longs(keys)
            n = len(hist)
            known = part == "hot"
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([chunk] * n, pa.int64()), pa.array(hist), pa.array(unpack_longs(tots) if known else [None] * n, pa.int64()), pa.array(unpack_longs(belows) if known and belows is not None else [None] * n, pa.int64()),
                    pa.array(_matrix(sums).tolist() if known else [None] * n, pa.list_(pa.int64())),
                ],
                ["chunk", "hist", "tot", "below", "sums"],
            )


def _hot(stored: DataFrame, order: int) -> tuple[DataFrame, DataFrame]:
    """(chunk, order, told): sums of the hot histories that each chunk asked for; and (hist, tot, below, sums) of all of them."""
    rows = stored.filter("part IN ('ask', 'hot')").select("part", "chunk", "keys", "counts", "sums", "belows").mapInArrow(_expand, _HOT_ROWS)
    rows = materialize(rows, "katz-hot")
    parts = rows.filter("sums IS NOT NULL").groupBy("hist").agg(F.max("tot").alias("tot"), F.max("below").alias("below"), F.array(*[F.sum(F.get("sums", F.lit(k))) for k in range(SUMS)]).alias("sums"))
    asked = rows.filter("sums IS NULL").select("chunk", "hist").join(parts, "hist")
    return asked.groupBy("chunk").agg(F.lit(order).alias("order"), F.collect_list(F.struct("hist", "sums")).alias("told")), parts


def _weigh(model: Order, one: Unigrams):
    def run(batches):
        for b in batches:
            col = lambda c: b.column(b.schema.get_field_index(c)).to_pylist()  # noqa: B023, E731
            for keys, tots, sums, belows in zip(col("keys"), col("counts"), col("sums"), col("belows"), strict=True):
                tot = unpack_longs(tots)
                below = one.tokens_p if belows is None else unpack_longs(belows)
                yield pa.RecordBatch.from_arrays([pa.array(unpack_longs(keys)), pa.array(tot), pa.array(model.log_alpha(_matrix(sums), tot, below))], ["history", "occurrences", "log_alpha"])

    return run


def _weigh_hot(model: Order, one: Unigrams):
    def run(batches):
        for b in batches:
            hist, tot, below, sums = (c.to_pylist() for c in b.columns)
            if hist:
                low = one.tokens_p if model.order == 2 else np.array(below, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(hist, pa.int64()), pa.array(tot, pa.int64()), pa.array(model.log_alpha(np.array(sums, np.int64), np.array(tot, np.int64), low))], ["history", "occurrences", "log_alpha"])

    return run


def weights(spark, root: str) -> DataFrame:
    """(order, history, occurrences, log_alpha): the stored backoff weights, a row per history (its number).

    Histories of two words and more without seen followers have weight one and no row.
    """
    return spark.read.parquet(f"{root}/weights").select("order", "history", "occurrences", "log_alpha")


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", root: str | None = None, order: int = ORDER) -> DataFrame:
    """Train on the documents of the training folds and score all: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null texts are empty and score their end; equal rows are scored and counted each; a null id is in training; ids are
    integers, and texts of digits are cast; other columns don't matter; an empty table gives an empty result. ``root`` is
    a new folder for the model (counts in ``order=1`` to ``order=n``, and backoff weights in ``weights`` by order), in a
    file system that executors share. ``docs`` must give the same rows in a partition each time it is read, as a table
    does. ``order`` is 2 at least.
    """
    spark = docs.sparkSession
    prepare(spark)
    root = root or scratch(spark, "katz")
    folder = f"{root}/chunks"
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    if docs.isEmpty():
        return spark.createDataFrame([], out)
    buckets = parts_for(byte_size(docs, "text"), BUCKET_BYTES)
    words = docs.mapInArrow(_store(folder, buckets, order), _WORDS)
    stored, n = _keep(words.groupBy("bucket").applyInArrow(_add_words, _REPLY), root, 1)
    one, positions = Unigrams(n[1], n[2], [0, *n[3 : K + 4]]), n[K + 4 :]
    models: list[Order] = []

    def said(stored: DataFrame, m: int) -> DataFrame:
        return stored.filter("part = 'reply'").select("chunk", F.lit(m).alias("order"), "bucket", "hot", "counts", "numbers", "sums", F.lit(None).cast("array<struct<hist:bigint,sums:array<bigint>>>").alias("told"))

    replies = said(stored, 1)
    del words
    for m in range(2, order + 1):
        _release(spark)
        asked = replies.groupBy("chunk").applyInArrow(_ask(folder, buckets, HOT, m, list(models)), _ASKED)
        stored, n = _keep(asked.groupBy("bucket", "hot").applyInArrow(_add_grams(m, m == order, HOT), _REPLY), root, m)
        del asked
        if m > 2:  # n-grams that occur once were not all sent; the rest of the positions are theirs
            n[3] = max(0, positions[m - 2] - n[0])
        models.append(Order(m, [0, *n[3 : K + 4]], models[-1] if models else one))
        told, hot = _hot(stored, m)
        replies = replies.unionByName(said(stored, m)).unionByName(told, allowMissingColumns=True)
        model = stored.filter("part = 'model'").select("keys", "counts", "sums", "belows")
        cold = model.mapInArrow(_weigh(models[-1], one), "history long, occurrences long, log_alpha double")
        warm = hot.select("hist", "tot", "below", "sums").mapInArrow(_weigh_hot(models[-1], one), "history long, occurrences long, log_alpha double")
        cold.unionByName(warm).write.option("compression", "zstd").parquet(f"{root}/weights/order={m}")
    _release(spark)
    return replies.groupBy("chunk").applyInArrow(_evaluate(folder, buckets, HOT, one, models), out)

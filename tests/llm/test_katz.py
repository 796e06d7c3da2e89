import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillform.llm import blobs, katz, q_katz


def words(t):
    return [*(t or "").encode().lower().split(), katz.END]


class Model:
    """Brute force over dictionaries, with recursion over any order."""

    def __init__(self, rows, order=3):
        train = [words(t) for d, t in rows if zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2]
        self.order = order
        # Padded by one end: the first token has a history of one word, the next of two.
        self.count = {m: Counter(g for t in train for g in self.grams(t, m)) for m in range(1, order + 1)}
        self.n, self.v = sum(self.count[1].values()), len(self.count[1])
        self.d = {}
        for m, c in self.count.items():
            of = Counter(c.values())
            self.d[m] = katz.discounts([0, *(of[i] for i in range(1, katz.K + 2))])
            if m > 2:
                self.d[m][1] = 0.0
        self.unknown = 1 - sum(self.factor(1, c) * c for c in self.count[1].values()) / self.n
        self.after, self.total, self.alpha = defaultdict(list), {}, {}
        for m in range(2, order + 1):
            for g, c in self.count[m].items():
                self.after[g[:-1]].append((g[-1], c))
        for m in range(2, order + 1):
            for h in {g[:-1] for g in self.count[m]}:
                ws = self.after[h]
                total = sum(c for _, c in ws)
                left = 1 - sum(self.factor(m, c) * c for _, c in ws) / total
                if left < 1e-12:
                    total += 1
                    left = 1 / total
                self.total[h] = total
                self.alpha[h] = left / (1 - sum(self.p(h[1:], w) for w, c in ws if self.factor(m, c)))

    @staticmethod
    def grams(ws, m):
        if m == 1:
            return [(w,) for w in ws]
        padded = [katz.END, *ws]
        return [tuple(padded[i : i + m]) for i in range(len(padded) - m + 1)]

    def factor(self, m, c):
        return self.d[m][c] if c <= katz.K else 1.0

    def p(self, h, w):
        if not h:
            c = self.count[1][w,]
            return self.factor(1, c) * c / self.n if c else self.unknown
        c = self.count[len(h) + 1][(*h, w)]
        if c and self.factor(len(h) + 1, c):
            return self.factor(len(h) + 1, c) * c / self.total[h]
        return self.alpha.get(h, 1.0) * self.p(h[1:], w)

    def row(self, d, t):
        ws = words(t)
        base = sum(math.log10((self.count[1][w,] + 1) / (self.n + self.v + 1)) for w in ws)
        padded = [katz.END, *ws]
        score = sum(math.log10(self.p(tuple(padded[max(0, i - self.order + 1) : i]), padded[i])) for i in range(1, len(padded)))
        return (d, zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2, len(ws), sum(self.count[1][w,] > 0 for w in ws), self.n, round(base, 4), round(score, 4))


@pytest.mark.parametrize(("tokens", "size", "hot", "order"), [(1 << 20, 8 << 20, 1 << 16, 3), (3000, 40_000, 300, 3), (5000, 20_000, 20, 4), (5000, 100_000, 100, 2)])
def test_against_brute_force(spark, tables, documents, monkeypatch, tokens, size, hot, order):
    monkeypatch.setattr(katz, "CHUNK_TOKENS", tokens)
    monkeypatch.setattr(katz, "BUCKET_BYTES", size)
    monkeypatch.setattr(katz, "HOT", hot)
    rows = [(r[0], r[1]) for r in documents]
    model = Model(rows, order)
    docs = spark.read.parquet(tables(documents=documents) + "/documents.parquet")
    out = q_katz.op5_katz_scores(spark, tables(documents=documents)) if order == katz.ORDER else katz.score(docs, order=order)
    got = [(r[0], r[1], r[2], r[3], r[4], round(r[5], 4), round(r[6], 4)) for r in out.collect()]
    want = sorted((model.row(*r) for r in rows), key=str)
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=str), want, strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-6, abs=1e-3)


def test_distributions_add_up_to_one(documents):
    m = Model([(r[0], r[1]) for r in documents])
    every = [w for (w,) in m.count[1]]
    assert sum(m.p((), w) for w in every) + m.unknown == pytest.approx(1)
    longest = sorted((h for h in m.alpha if len(h) == 2), key=lambda h: -m.total[h])[:15]
    for h in [*[h for h in m.alpha if len(h) == 1][:30], *longest]:
        assert sum(m.p(h, w) for w in every) + m.p(h, b"never seen") == pytest.approx(1)


def test_backoff_weights_agree_with_the_definition():
    one = katz.Unigrams(1000, 100, [0, 40, 20, 10, 8, 6, 4])
    two = katz.Order(2, [0, 60, 20, 10, 6, 5, 4], one)
    sums, tot = np.array([[0, 2, 1, 1, 0, 0, 1, 0, 0, 1, 0, 55], [30, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 300]]), np.array([7, 30])
    seen = (one.d[1] * 1 + one.d[4] * 4 + 55) / 1000
    left = 1 - (2 * two.d[1] + 2 * two.d[2] + 3 * two.d[3]) / 7
    assert two.log_alpha(sums, tot, 1000)[0] == pytest.approx(math.log10(left / (1 - seen)))
    assert two.total(sums, tot).tolist() == [7, 31] and two.log_alpha(sums, tot, 1000)[1] == pytest.approx(math.log10(1 / 31 / (1 - 0.3)))
    three = katz.Order(3, [0, 60, 20, 10, 6, 5, 4], two)
    alone = np.zeros((1, katz.SUMS), np.int64)
    assert three.d[1] == 0 and three.log_alpha(alone, np.array([9]), np.array([40]))[0] == 0


def test_counts_beyond_32_bits_stay_whole():
    x = np.array([2**32 + 5, 3, 2**55 + 1, 0])
    assert blobs.unpack_longs(blobs.pack_longs(x)).tolist() == x.tolist() and blobs.unpack_longs(blobs.pack_longs(x[:0])).tolist() == []
    with pytest.raises(ValueError, match="negative"):
        blobs.pack_longs(np.array([-1]))
    assert katz._sum(np.array([0, 0, 1]), np.array([2**53, 1, 7]), 2).tolist() == [2**53 + 1, 7]


def test_degenerate_tables(spark, tables):
    assert q_katz.op5_katz_scores(spark, tables()).collect() == []


def test_nothing_in_training(spark):
    held = next(i for i in range(100) if katz.held_out(i))
    rows = katz.score(spark.createDataFrame([(held, "a b", "x")], "doc_id long, text string, score string")).collect()
    assert [(r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.score) for r in rows] == [(True, 3, 0, 0, 0.0)]


@pytest.mark.parametrize("hot", [1 << 16, 50])
def test_stored_weights_are_those_of_brute_force(spark, documents, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(katz, "HOT", hot)
    monkeypatch.setattr(katz, "BUCKET_BYTES", 100_000)
    rows = [(r[0], r[1]) for r in documents]
    root = f"file://{tmp_path}/model"
    katz.score(spark.createDataFrame(rows, "doc_id long, text string"), root=root).count()
    model, got = Model(rows), defaultdict(list)
    for r in katz.weights(spark, root).collect():
        got[r.order].append((r.occurrences, round(r.log_alpha, 6)))
    # Total of a history without its unseen occurrence; histories of two words occur twice at least.
    said = lambda h: (sum(c for _, c in model.after[h]), round(math.log10(model.alpha[h]), 6))
    for m in (2, 3):
        want = sorted(said(h) for h in model.alpha if len(h) == m - 1 and (m == 2 or said(h)[0] > 1))
        have = sorted(x for x in got[m] if m == 2 or x[0] > 1)
        # A longer history without any seen follower has no row: its weight is one.
        missing = Counter(want) - Counter(have)
        assert not Counter(have) - Counter(want) and all(a == 0 for _, a in missing)

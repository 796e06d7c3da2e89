import zlib
from collections import defaultdict

import numpy as np
import pytest

from quillform.llm import packing, q_packing, tokens


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


def test_encoder_gives_the_ids_of_tokenizers(reference, documents):
    e = tokens.encoder(tokens.default_path())
    for t in [r[1] for r in documents] + ["<|endoftext|> a  b\n\n c", "don't 12345 　 ﷽ \U0001f468‍\U0001f469"]:
        assert e.encode(t).tolist() == (reference.encode(t or "", add_special_tokens=False).ids if t else [])


def test_pieces_cover_every_token_once(spark, tables, documents, reference):
    rows = q_packing.op4_mixture_packing(spark, tables(documents=documents)).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    texts = defaultdict(list)
    for r in documents:
        texts[r[0]].append(r[1])
    for d, ts in texts.items():
        if len(ts) > 1:  # equal ids: their pieces can't be told apart by id
            assert sum(p[1] for p in pieces[d]) == sum(len(reference.encode(t or "", add_special_tokens=False).ids) + 1 for t in ts)
            continue
        ids = np.array([*reference.encode(ts[0] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for start, length, crc, n in sorted(pieces[d]):
            assert (start, n, crc) == (at, len(ids), zlib.crc32(ids[at : at + length].tobytes()))
            at += length
        assert at == len(ids)
    for p in sequences.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at == 2048 or at & (at - 1) == 0
    assert sorted(sequences) == list(range(len(sequences)))


def test_empty_table(spark, tables):
    assert q_packing.op4_mixture_packing(spark, tables()).collect() == []


def round_robin(totals, quanta, cost):
    """Queues in the order of service, token by token."""
    deficit, left, out = [0] * len(totals), list(totals), []
    while any(left):
        for q, w in enumerate(quanta):
            if left[q]:
                deficit[q] += w
                while left[q] and 2 * deficit[q] > cost:
                    out.append(q)
                    left[q] -= 1
                    deficit[q] -= cost
    return out


CASES = [
    ([50], None), ([97, 3, 77, 45], None), ([1, 1, 1], None), ([64, 64], [1, 3]), ([300, 40, 5], [0.2, 0.5, 0.3]), ([40, 400, 3], [5, 1, 0]), ([7] * 30, None),
    ([1 + k % 5 for k in range(300)], None), ([1 + k % 7 for k in range(300)], [1 + k % 3 for k in range(300)]),
]


@pytest.mark.parametrize("totals, targets", CASES)
def test_schedule_is_a_token_by_token_round_robin(totals, targets, monkeypatch):
    r = packing.Rounds(totals, 16, targets)
    scale = max(1, int(r.quanta.max()) >> 8)  # coarser quanta: the slow version goes round by round
    r.quanta, r.bits = np.maximum(r.quanta // scale, 1), 8
    r.cost, r.dry = 2 << 8, -(-(((2 * r.totals - 1) << 8) + 1) // np.maximum(r.quanta, 1))
    r.rounds = int(r.dry.max())
    order = round_robin(totals, r.quanta.tolist(), r.cost)
    place = defaultdict(list)
    for at, q in enumerate(order):
        place[q].append(at)
    assert all([r.rank(q, j) for j in range(t)] == place[q] for q, t in enumerate(totals))
    w = np.arange(r.full + len(r.tail))
    want = [[sum(p < b for p in place[q]) for q in range(len(totals))] for b in r.border(w).tolist()]
    assert r.served(w).tolist() == want and want[-1] == totals
    assert (np.abs(r.deficits(w)) <= 1).all()


@pytest.mark.parametrize("totals", [[5000], [100_000, 3, 777, 12_345], [2048, 2048], [10**14, 3 * 10**13, 12345], [2**44, 2**40, 1]])
def test_windows_hold_the_targets_at_any_size(totals):
    r = packing.Rounds(totals)
    last = r.full + len(r.tail) - 1
    w = np.unique(np.concatenate([np.arange(min(300, last + 1)), np.arange(max(0, last - 50), last + 1)]))
    served = r.served(w)
    assert served.sum(axis=1).tolist() == r.border(w).tolist() and served[-1].tolist() == totals
    assert (np.diff(served, axis=0) >= 0).all()
    share = r.quanta / r.quanta.sum()
    early = (served < r.totals[None, :]).all(axis=1)
    assert (np.abs(served[early] - r.border(w)[early, None] * share[None, :]) < 1 + len(totals) / 2).all()


def test_targets_and_a_dry_source(spark):
    """Windows hold the targets until a source is dry, then the others' share of them."""
    df = spark.createDataFrame([(i, "a b c d e f g " * 30, "abc"[i % 3], 1) for i in range(60)], "doc_id long, text string, source string, offset int")
    pieces = packing.pack(df, length=256, targets={"a": 0.6, "b": 0.3, "c": 0.1}).cache()
    got = defaultdict(dict)
    for r in packing.shares(pieces).collect():
        got[r.sequence_id][r.p_source] = r.tokens
    dry = max(k for k, x in got.items() if "a" in x)
    assert all(abs(x.get(s, 0) - 256 * t) <= 2 for k, x in got.items() if k < dry for s, t in (("a", 0.6), ("b", 0.3), ("c", 0.1)))
    late = [x for k, x in got.items() if dry < k < max(k for k, x in got.items() if "b" in x) and sum(x.values()) == 256]
    assert late and all(abs(x["b"] - 192) <= 2 and abs(x["c"] - 64) <= 2 for x in late)
    assert pieces.agg({"length": "sum"}).first()[0] == pieces.select("doc_id", "doc_tokens").distinct().agg({"doc_tokens": "sum"}).first()[0]


def test_three_hundred_sources_are_queues_of_their_own(spark):
    df = spark.createDataFrame([(i, "a b c " * 40, f"s{i % 300}", 1) for i in range(600)], "doc_id long, text string, source string, n int")
    pieces = packing.pack(df).cache()
    assert pieces.agg({"length": "sum"}).first()[0] == pieces.select("doc_id", "doc_tokens").distinct().agg({"doc_tokens": "sum"}).first()[0]
    got = defaultdict(dict)
    for r in packing.shares(pieces).collect():
        got[r.sequence_id][r.p_source] = r.tokens
    n = sum(got[0].values())
    assert all(len(x) == 300 and max(x.values()) - min(x.values()) <= 1 for x in got.values() if sum(x.values()) == n == 2048)

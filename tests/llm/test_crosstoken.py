import hashlib
import json
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quillform.llm import crosstoken, q_crosstoken, tokens

from .conftest import hostile_documents

HARD = ["<|endoftext|> and <s></s><unk> <0x41>", "a▁b", "é\U0001f600 日本\n\n  tabs\t\t", " ", "\x00\x01", "x" * 3000, "don't  stop", "﻿​ "]


def want(docs, relation="end"):
    """Brute force over (doc_id, text): rows as of the query, sorted."""
    plain = list(range(0x21, 0x7F)) + list(range(0xA1, 0xAD)) + list(range(0xAE, 0x100))
    codes = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in plain)}
    path = public_tokenizers.path("byte_bpe_50k.json")
    entry = {i: x for x, i in json.load(open(path, encoding="utf-8"))["model"]["vocab"].items()}
    first = Tokenizer.from_file(path)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows, counts = [], Counter()
    for doc, text in docs:
        a = b = a_raw = b_raw = []
        if text:
            a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
            a_raw = [bytes(codes[c] for c in entry[i]) for i in a]
            b_raw = [bytes([int(x[3:5], 16)]) if len(x) == 6 and x.startswith("<0x") else x.replace("▁", " ").encode() for x in map(second.id_to_piece, b)]
            if b"".join(a_raw) != (" " + text).encode() or b"".join(b_raw) != (" " + text).encode():
                a = b = a_raw = b_raw = []
        ae, be = np.cumsum([len(x) for x in a_raw]).tolist(), np.cumsum([len(x) for x in b_raw]).tolist()
        if relation == "end":
            links = [(x, y) for i, x in zip(ae, a, strict=True) for j, y in zip(be, b, strict=True) if i == j] if len(ae) < 2000 else [(x, dict(zip(be, b, strict=True))[i]) for i, x in zip(ae, a, strict=True) if i in set(be)]
        else:
            links = [(x, y) for i, w, x in zip(ae, a_raw, a, strict=True) for j, v, y in zip(be, b_raw, b, strict=True) if i - len(w) < j and j - len(v) < i]
        counts.update(links)
        cuts = sorted(set(ae) & set(be))
        groups, lo = [], 0
        for cut in cuts:
            pick = lambda ends, ids: ",".join(str(i) for e, i in zip(ends, ids, strict=True) if lo < e <= cut)  # noqa: B023, E731
            groups.append(f"{pick(ae, a)}|{pick(be, b)}")
            lo = cut
        rows.append((doc, len(a), len(b), len(cuts), links, ";".join(groups)))
    top = {}
    for (_, b), n in counts.items():
        top[b] = max(top.get(b, 0), n)
    return sorted(
        ((doc, n_a, n_b, n_g, len(ls), sum(counts[x] == top[x[1]] for x in ls), sum(counts[x] for x in ls), hashlib.sha256(g.encode()).hexdigest() if g else "") for doc, n_a, n_b, n_g, ls, g in rows),
        key=lambda r: (r[0] is not None, r),
    )


def texts():
    docs = [(r[0], r[1] if r[1] is None or len(r[1]) < 3000 else r[1][:1500]) for r in hostile_documents(n=12)]
    return docs + [(1000 + k, t) for k, t in enumerate(HARD)]


@pytest.mark.parametrize("size", [4 << 20, 500])
def test_query_against_brute_force(spark, tables, monkeypatch, size):
    monkeypatch.setattr(crosstoken, "CHUNK_BYTES", size)
    docs = texts()
    got = [tuple(r) for r in q_crosstoken.op13_tokenizer_alignment(spark, tables(documents=[(d, t, None, None, None) for d, t in docs])).collect()]
    assert sorted(got, key=lambda r: (r[0] is not None, r)) == want(docs)


def test_overlaps_against_brute_force(spark):
    docs = [(d, t) for d, t in texts() if d is not None]
    got = crosstoken.align(spark.createDataFrame(docs, "doc_id long, text string"), relation="overlap", digest=True).selectExpr("row.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups").collect()
    assert sorted(tuple(r) for r in got) == sorted(want(docs, "overlap"))


def test_groups_as_text_clashing_columns_and_repeats(spark):
    df = spark.createDataFrame([(1, 2, "Hello there"), (1, 2, "Hello there"), (None, 0, None)], "groups int, n_a long, text string")
    got = crosstoken.align(df).collect()
    a, b = tokens.encoder(tokens.default_path()), tokens.piece_encoder(tokens.piece_path())
    assert len(got) == 3
    for r in got:
        if r.row.groups == 1:
            ids = [[int(x) for side in g.split("|")[k : k + 1] for x in side.split(",")] for g in r.groups.split(";") for k in (0, 1)]
            assert sum(ids[::2], []) == a.encode_plain(" Hello there").tolist() and sum(ids[1::2], []) == b.encode_plain("Hello there").tolist()
            assert r.n_best == r.n_links == r.n_groups and r.count_sum == 2 * r.n_links
        else:
            assert r.groups == "" and r.n_a == r.n_links == r.count_sum == 0


def test_empty_table_and_long_text(spark, tables):
    assert q_crosstoken.op13_tokenizer_alignment(spark, tables()).count() == 0
    long = "the quick brown fox " * 60_000
    (r,) = q_crosstoken.op13_tokenizer_alignment(spark, tables(documents=[(5, long, None, None, None)])).collect()
    assert r.n_groups == r.n_links == r.n_best and r.n_a > 200_000


def test_plain_encoding_is_that_of_tokenizers():
    slow = Tokenizer.from_file(tokens.default_path())
    slow.encode_special_tokens = True
    fast = tokens.encoder(tokens.default_path())
    for t in HARD:
        assert fast.encode_plain(" " + t).tolist() == slow.encode(" " + t, add_special_tokens=False).ids

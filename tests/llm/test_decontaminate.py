import hashlib
import random
import re

import numpy as np
import pytest

from quillform.llm import decontaminate, q_decontaminate

WORD = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def split(t):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def want(docs, items):
    windows = {}
    for i, t in items:
        w = split(t)
        size = min(10, len(w))
        for p in range(len(w) - size + 1 if size else 0):
            windows.setdefault(tuple(w[p : p + size]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, got = split(t), set(), set()
        for size in {len(x) for x in windows}:
            for p in range(len(w) - size + 1):
                owner = windows.get(tuple(w[p : p + size]))
                if owner:
                    hit |= set(range(p, p + size))
                    got |= owner
        ids = ",".join(sorted(str(i) for i in got))
        out.append((d, len(w), len(hit), len(got), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def case(documents):
    rng = random.Random(2)
    items = [(i, " ".join(split(rng.choice(documents)[1])[4:34])) for i in range(25)]
    items += [(100, "Onlytwo, WORDS!"), (101, None), (102, ""), (103, "one"), (104, items[0][1]), (105, "A b C d E f G h I j k L m"), (105, "A b C d E f G h I j k L m")]
    extra = [(800, "x onlytwo words y onlytwo-words", "en", "s", None), (801, "a b c d e f g h i j k l " * 40, "en", "s", None), (802, "É a\tb.c;d e f g h i j ü", None, None, None)]
    return [*documents, *extra], items


@pytest.mark.parametrize(("shard", "block"), [(1 << 18, 16 << 20), (200, 300)])
def test_against_brute_force(spark, tables, documents, monkeypatch, shard, block):
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", shard)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    docs, items = case(documents)
    got = q_decontaminate.op10_benchmark_decontamination(spark, tables(documents=docs, benchmark=items)).collect()
    assert sorted((tuple(r) for r in got), key=str) == want([(d[0], d[1]) for d in docs], items)


def test_suffix_array_and_index():
    rng = np.random.default_rng(1)
    for n, top in ((1, 2), (2, 3), (50, 3), (400, 3), (400, 40)):
        s = np.append(rng.integers(1, top, n), 0)
        order = decontaminate.suffix_array(s)
        assert order.tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
        f = decontaminate.FMIndex(s, top)
        table = rng.integers(1, top, (60, 4))
        lengths = rng.integers(1, 5, 60)
        found = {int(w): sorted(f.locate(np.arange(a, b)).tolist()) for w, a, b in zip(*f.search(table, lengths), strict=True)}
        for k, (row, m) in enumerate(zip(table.tolist(), lengths.tolist(), strict=True)):
            assert found.get(k, []) == [i for i in range(n - m + 1) if s[i : i + m].tolist() == row[:m]]


def test_spans_can_be_cut(spark):
    docs = spark.createDataFrame([(1, "Keep this. One two, THREE four five! six seven eight nine ten and go", "x"), (2, None, None), (3, "clean", "y")], "doc_id long, text string, d_items string")
    bench = spark.createDataFrame([(7, "one two three four five six seven eight nine ten")], "item_id long, text string")
    out = decontaminate.remove_spans(docs.withColumnRenamed("d_items", "note"), bench)
    assert [(r.doc_id, r.text, r.note) for r in out.orderBy("doc_id").collect()] == [(1, "Keep this.  and go", "x"), (2, None, None), (3, "clean", "y")]
    assert [r.doc_id for r in decontaminate.clean(docs, bench).orderBy("doc_id").collect()] == [2, 3]


def test_columns_keep_their_names_and_values(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten", "2001-01-01", "x", 5)], "doc_id long, text string, d_date string, quill_row string, d_items int")
    bench = spark.createDataFrame([(7, "one two three four five six seven eight nine ten")], "item_id long, text string")
    row = decontaminate.find(docs, bench).first()
    assert (row.d_date, row.quill_row, row.d_items) == ("2001-01-01", "x", [7]) and decontaminate.clean(docs, bench).columns == docs.columns


def test_phrases_are_arrays():
    items = [(i, " ".join(f"w{(i * 7 + k * k) % 50}" for k in range(60))) for i in range(300)] + [(900, "w1 w2"), (901, None)]
    p = decontaminate.Phrases(items)
    windows = {}
    for k, (_, t) in enumerate(items):
        w = decontaminate.split_words(t)
        size = min(10, len(w))
        for at in range(len(w) - size + 1 if size else 0):
            windows.setdefault(tuple(w[at : at + size]), set()).add(k)
    name = {v: k for k, v in p.words.items()}
    got = {tuple(name[x] for x in row[:n].tolist()): set(p.owners(i)) for i, (row, n) in enumerate(zip(p.table, p.lengths.tolist(), strict=True))}
    assert got == windows and p.table.dtype == np.int32


def test_empty_tables(spark, tables, documents):
    assert q_decontaminate.op10_benchmark_decontamination(spark, tables()).collect() == []
    rows = q_decontaminate.op10_benchmark_decontamination(spark, tables(documents=documents)).collect()
    assert len(rows) == len(documents) and not any(r.contaminated for r in rows)

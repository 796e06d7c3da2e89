import hashlib
from collections import defaultdict

import pyarrow as pa
import pyarrow.compute as pc
import pytest

from quillform.llm import q_substrings, substrings


def want(rows):
    least, out = {}, []
    size = substrings.WINDOW
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - size + 1):
            key = b[i : i + size]
            if d is not None and least.get(key, d + 1) > d:
                least[key] = d
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            low = least.get(b[i : i + size])
            if low is not None and (d is None or low < d):
                gone[i : i + size] = b"\1" * size
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("chunk", "bucket", "hot"), [(4 << 20, 8 << 20, 1000), (20_000, 30_000, 1), (40_000, 30_000, 4)])
def test_against_brute_force(spark, tables, documents, monkeypatch, chunk, bucket, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(substrings, "BUCKET_BYTES", bucket)
    got = q_substrings.op2_substring_dedup(spark, tables(documents=documents)).collect()
    assert sorted((tuple(r) for r in got), key=str) == want([(r[0], r[1]) for r in documents])


def test_kept_bytes_and_spans_fit(spark, documents):
    df = spark.createDataFrame([(r[0], r[1], 5, "x") for r in documents[:30]], "doc_id long, text string, chunk int, bucket string")
    texts = defaultdict(list)
    for r in documents[:30]:
        texts[r[0]].append((r[1] or "").encode())
    for r in substrings.dedup(df).collect():
        assert any(len(r.kept) == len(b) - sum(s.end - s.start for s in r.spans) for b in texts[r.doc_id])


def test_empty_table(spark, tables):
    assert q_substrings.op2_substring_dedup(spark, tables()).collect() == []


def by(tables, key):
    whole = pa.concat_tables([x for x in tables if x.num_rows] or tables[:1])
    return {k: whole.filter(pc.equal(whole[key], k)) for k in sorted(set(whole[key].to_pylist()))}


@pytest.mark.parametrize(("segment", "hot", "chunks"), [(4096, 1000, 3), (4096, 2, 5), (300, 0, 2)])
def test_small_segments(documents, monkeypatch, segment, hot, chunks):
    """The stages one after another in this process, where segments and slices can be made small."""
    monkeypatch.setattr(substrings, "SEGMENT", segment)
    monkeypatch.setattr(substrings, "STRINGS", segment)
    substrings._powers.cache_clear()
    rows, buckets = [(r[0], r[1]) for r in documents], 4
    docs = [pa.table({"doc_id": pa.array([r[0] for r in part], pa.int64()), "text": pa.array([(r[1] or "").encode() for r in part], pa.binary()), "chunk": [c] * len(part)}) for c, part in enumerate([rows[k::chunks] for k in range(chunks)])]
    sent = by([substrings._send_keys(buckets)(d) for d in docs], "bucket")
    kept = by([substrings._survivors(hot)(t) for t in sent.values()], "chunk")
    contexts = by([substrings._send_contexts(buckets)(d, kept[c]) for c, d in enumerate(docs) if c in kept], "bucket")
    told = by([substrings._settle(t) for t in contexts.values()], "chunk")
    got = []
    for c, d in enumerate(docs):
        both = [x[c] for x in (kept, told) if c in x]
        done = substrings._finish(buckets)(d, pa.concat_tables(both, promote_options="default") if both else pa.table({"keys": pa.array([], pa.binary()), "masks": pa.array([], pa.binary()), "least": pa.array([], pa.binary())}))
        got += [(r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in done.to_pylist()]
    substrings._powers.cache_clear()
    assert sorted(got, key=str) == want(rows)

import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from quillform.llm import q_warc, warc

LONG, SHORT = "<p>É" * 40, "tiny"
PAGES = [(i, f"http://x/{i}", LONG if i % 3 == 0 else SHORT if i % 3 == 1 else f"{i}" * 90) for i in range(40)]
PAGES += [(50, None, None), (51, "http://a b\r\nX: y", ""), (52, "http://é/", "x" * 300_000), (3, "http://again", LONG), (3, "http://x/3", LONG), (None, "n", LONG), (None, None, "alone" * 30), (None, "m", "alone" * 30)]


def want(rows):
    out, seen, least = [], set(), {}
    for p, _, h in rows:
        if p is not None:
            least[h or ""] = min(least.get(h or "", p), p)
    for p, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (h or "").encode()
        first = least.get(h or "")
        again = len(b) >= 100 and ((h or "") in seen)
        seen.add(h or "")
        out.append((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def test_against_brute_force(spark, tables):
    got = q_warc.op3_warc_archive(spark, tables(pages=PAGES)).collect()
    assert sorted((tuple(r) for r in got), key=str) == want(PAGES)


def test_empty_table(spark, tables):
    assert q_warc.op3_warc_archive(spark, tables()).collect() == []


def frame(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string")


def test_files_roll_and_are_deterministic(spark, tmp_path):
    runs = []
    for name in "ab":
        out = f"file://{tmp_path}/{name}"
        m = warc.write(frame(spark).repartition(3 if name == "a" else 1), out, roll=3000, shard_bytes=100_000).orderBy("file").collect()
        runs.append([(r.file, r.sha256) for r in m])
        assert sum(r.records for r in m) == len(PAGES) and len(m) > 2
        for r in m:
            assert hashlib.sha256((tmp_path / name / "data" / r.file).read_bytes()).hexdigest() == r.sha256
        assert not (tmp_path / name / "_temporary").exists()
    assert runs[0] == runs[1]


def test_borders_follow_from_the_table(spark, tmp_path):
    """Three writes of 2,500 rows in different partitions, a third of them without an id, give the same shards and digests."""
    rows = [(None if i % 3 == 0 else i, f"http://x/{i}", f"{i % 400} " * (20 + i % 90)) for i in range(2500)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    runs = []
    for k, parts in enumerate((3, 7, 1)):
        m = warc.write(df.repartition(parts).withColumn("shard", F.lit("x")), f"file://{tmp_path}/{k}", roll=50_000, shard_bytes=100_000).orderBy("file").collect()
        runs.append([tuple(r) for r in m])
    assert runs[0] == runs[1] == runs[2]
    by = {}
    for r in runs[0]:
        by[r[1]] = by.get(r[1], 0) + r[2]
    size = sum(len(h) + warc.HEAD_BYTES for _, _, h in rows)
    assert len(by) == -(-size // 100_000) and max(by.values()) < 2 * min(list(by.values())[:-1])
    back = warc.read(spark, f"file://{tmp_path}/0")
    assert sorted(((r.page_id, r.payload_bytes) for r in back.collect()), key=str) == sorted(((p, len(h)) for p, _, h in rows), key=str)


def test_an_archive_is_written_once(spark, tmp_path):
    out = f"file://{tmp_path}/once"
    warc.write(frame(spark), out)
    with pytest.raises(FileExistsError):
        warc.write(frame(spark), out)


def test_reader_gives_urls_and_payloads_back(spark, tmp_path):
    out = f"file://{tmp_path}/w"
    warc.write(frame(spark), out)
    got = {(r.page_id, r.url, bytes(r.payload).decode()) for r in warc.read(spark, out).collect() if r.record_type == "response"}
    assert got <= {(p, u, h or "") for p, u, h in PAGES} and (52, "http://é/", "x" * 300_000) in got


def test_damage_is_found(spark, tmp_path):
    out = f"file://{tmp_path}/w"
    warc.write(frame(spark), out)
    path = next((tmp_path / "w" / "data").glob("*.gz"))
    raw = gzip.decompress(path.read_bytes()).replace(b"<p>", b"<q>", 1)
    path.write_bytes(gzip.compress(raw))
    with pytest.raises(Exception, match="digest"):
        warc.read(spark, out).collect()

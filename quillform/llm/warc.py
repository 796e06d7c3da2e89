"""Deterministic sharded WARC archives: write, commit, read back.

Records are range-sorted by page and payload digest into shards. Shard borders are exact: keys and sizes (no payloads)
are sorted once, and a shard begins wherever the running total of bytes passes a multiple of the shard size, so that
borders follow from the table alone, and a page id that holds many rows is split by digest. Each shard's task streams its
records into gzip members, rolls to a new file once the compressed size reaches ``ROLL_BYTES``, regenerates every header
and digest, and writes under temporary names. A finished file is renamed to its final name, and a table of files (the
manifest) is renamed into place only when all shards are done: readers see the files that the manifest lists, or nothing.
Records depend on their rows only (ids by UUID5, a fixed date), so a task that runs again, after an executor was lost,
writes the same bytes.

Of records with equal payloads of ``REVISIT_BYTES`` bytes or more that with the smallest page id is the response and
others revisit it. Which they are is found by an aggregation over digests; the decisions travel through the same
exchange as the pages, just before their page, so payloads are shuffled once.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import io
import uuid

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import hadoop, materialize, prepare

REVISIT_BYTES = 100
ROLL_BYTES = 32 << 20
SHARD_BYTES = 32 << 20
#: Bytes that a record counts for besides its payload when borders are drawn.
HEAD_BYTES = 500
#: Shards at most: larger tables get larger shards.
MOST_SHARDS = 1 << 16
DATE = "2000-01-01T00:00:00Z"
LEVEL = 6
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = "file string, shard int, records long, bytes long, sha256 string, first_page long, last_page long"
_RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, file string, position long"


def record_id(page_id: int | None, digest: str, copy: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}:{copy}')}>"


def _uri(url: str | None, page_id: int | None) -> str:
    """A header-safe target: control characters and blanks are percent-encoded."""
    if not url:
        return f"urn:page:{page_id}"
    return "".join(c if "!" <= c <= "~" or c > "\xa0" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def _record(kind: str, rid: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", DATE), *fields, ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Length", str(len(block)))]
    raw = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return gzip.compress(raw.encode() + block + b"\r\n\r\n", LEVEL, mtime=0)


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: tuple[int | None] | None, copy: int = 0) -> bytes:
    """A gzip member: a response, or a revisit of the page in ``refers_to``; ``copy`` numbers rows with equal page and payload."""
    digest = hashlib.sha256(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Target-URI", _uri(url, page_id)), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(len(payload)))]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if url is not None:
        fields.append(("X-URL", url.encode("unicode_escape").decode()))
    if refers_to is None:
        return _record("response", record_id(page_id, digest, copy), fields, http + payload)
    fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(refers_to[0], digest))]
    if refers_to[0] is not None:
        fields.append(("X-Refers-To-Page", str(refers_to[0])))
    return _record("revisit", record_id(page_id, digest, copy), fields, http)


class _Roller:
    """The files of one shard."""

    def __init__(self, root: str, shard: int, roll: int):
        self.fs, self.root = pafs.FileSystem.from_uri(root)
        self.shard, self.roll, self.number, self.out, self.done = shard, roll, 0, None, []
        self.attempt = uuid.uuid4().hex  # only in temporary names

    def add(self, page_id: int | None, member: bytes) -> None:
        if self.out is None:
            self.name = f"part-{self.shard:06d}-{self.number:05d}.warc.gz"
            self.temp = f"{self.root}/_temporary/{self.name}.{self.attempt}"
            self.fs.create_dir(f"{self.root}/_temporary", recursive=True)
            self.out, self.sum, self.size, self.records, self.first = self.fs.open_output_stream(self.temp, compression=None), hashlib.sha256(), 0, 0, page_id
            info = f"software: quillform\r\nformat: WARC File Format 1.1\r\nfilename: {self.name}\r\n".encode()
            self._write(_record("warcinfo", record_id(None, self.name), [("Content-Type", "application/warc-fields")], info))
        self._write(member)
        self.records, self.last = self.records + 1, page_id
        if self.size >= self.roll:
            self._finish()

    def _write(self, raw: bytes) -> None:
        self.out.write(raw)
        self.sum.update(raw)
        self.size += len(raw)

    def close(self) -> list[tuple]:
        """The rows of the manifest for the shard."""
        if self.out is not None:
            self._finish()
        return self.done

    def _finish(self) -> None:
        self.out.close()
        self.fs.create_dir(f"{self.root}/data", recursive=True)
        self.fs.move(self.temp, f"{self.root}/data/{self.name}")
        self.done.append((self.name, self.shard, self.records, self.size, self.sum.hexdigest(), self.first, self.last))
        self.number, self.out = self.number + 1, None


def borders(keyed: DataFrame, size: int) -> list[tuple[bool, int, str]]:
    """The first key of each shard but the first, from (page_id, digest, n): (whether there is an id, the id, the digest).

    Rows of equal key stay together.
    """
    key = [F.col("page_id").isNotNull().alias("some"), F.coalesce("page_id", F.lit(0)).alias("id"), "digest"]
    one = keyed.groupBy(*key).agg(F.sum(F.col("n") + HEAD_BYTES).alias("n")).orderBy("some", "id", "digest")
    one = materialize(one.withColumn("part", F.spark_partition_id()), "warc-keys")
    parts = one.groupBy("part").agg(F.sum("n").alias("n"))
    base = parts.select(F.col("part"), (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("base"))  # a row for each task
    upto = F.sum("n").over(W.partitionBy("part").orderBy("some", "id", "digest").rowsBetween(W.unboundedPreceding, 0))
    at = one.select("part", "some", "id", "digest", "n", upto.alias("upto")).join(F.broadcast(base), "part")
    shard = F.floor((F.col("base") + F.col("upto") - F.col("n")) / size)
    first = at.groupBy(shard.alias("shard")).agg(F.min(F.struct("some", "id", "digest")).alias("k")).orderBy("shard")
    return [tuple(r.k) for r in first.collect()][1:]  # MOST_SHARDS at most


def write(pages: DataFrame, out: str, roll: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write (page_id, url, html) under ``out``, a folder in a file system that executors share; returns the manifest.

    Other columns are left out, whatever their names. Page ids are integers; texts of digits are cast. Null html is
    empty. Null page ids come first and count as larger than all others when the response of a group is chosen. Of rows
    with equal page and payload the first is what the page is, others revisit it. An empty table gives an empty
    manifest. An archive is written once: a folder that has a manifest is refused.
    """
    spark = pages.sparkSession
    prepare(spark)
    final, fs = hadoop(spark, f"{out}/manifest")
    if fs.exists(final):
        raise FileExistsError(f"{out} has a manifest")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    keyed = materialize(pages.select("page_id", F.sha2("html", 256).alias("digest"), F.octet_length("html").cast("long").alias("n")), "warc-digests")
    total = keyed.agg(F.sum(F.col("n") + HEAD_BYTES)).first()[0] or 0
    starts = borders(keyed, max(shard_bytes, -(-total // MOST_SHARDS)))
    shards = len(starts) + 1

    @F.pandas_udf("int")
    def shard(page_id: pd.Series, digest: pd.Series) -> pd.Series:
        keys = zip(page_id.notna().tolist(), page_id.fillna(0).astype("int64").tolist(), digest.tolist(), strict=True)
        return pd.Series([bisect.bisect_right(starts, k) for k in keys], dtype="int32")

    large = keyed.filter(F.col("n") >= REVISIT_BYTES).select("page_id", "digest")
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id")
    first = large.groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    told = large.join(first, "digest").filter(~F.col("first.page_id").eqNullSafe(F.col("page_id"))).select("page_id", "digest", F.col("first.page_id").alias("first")).distinct()
    rows = pages.select("page_id", F.lit(1).alias("kind"), F.sha2("html", 256).alias("digest"), F.lit(None).cast("long").alias("first"), "url", "html").unionByName(
        told.select("page_id", F.lit(0).alias("kind"), "digest", "first", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"))
    )
    rows = rows.withColumn("shard", shard(F.col("page_id").cast("string"), "digest") if shards > 1 else F.lit(0))
    sorted_ = rows.repartitionById(shards, "shard").sortWithinPartitions("shard", "page_id", "digest", "kind", "url")

    def run(batches):
        roller, key, refers, copy = None, object(), None, 0
        done = []
        for b in batches:
            for page_id, kind, digest, of, url, html, number in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if roller is None or roller.shard != number:
                    if roller is not None:
                        done += roller.close()
                    roller = _Roller(out, number, roll)
                if (page_id, digest) != key:
                    key, refers, copy = (page_id, digest), None, -1
                if not kind:
                    refers = (of,)
                    continue
                copy, payload = copy + 1, html.encode()
                if copy and refers is None and len(payload) >= REVISIT_BYTES:
                    refers = (page_id,)
                roller.add(page_id, page_record(page_id, url, payload, refers, copy))
        if roller is not None:
            done += roller.close()
        if done:
            cols = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["file", "shard", "records", "bytes", "sha256", "first_page", "last_page"])

    sorted_.mapInArrow(run, _MANIFEST).write.mode("overwrite").parquet(f"{out}/_manifest")
    if not fs.rename(hadoop(spark, f"{out}/_manifest")[0], final):
        raise OSError(f"the manifest could not be moved to {out}/manifest")
    fs.delete(hadoop(spark, f"{out}/_temporary")[0], True)
    return manifest(spark, out)


def manifest(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(_MANIFEST).parquet(f"{out}/manifest")


def _parse(stream) -> dict[str, str] | None:
    line = stream.readline()
    if not line:
        return None
    if line.strip() != b"WARC/1.1":
        raise ValueError(f"not a WARC record: {line[:40]!r}")
    head = {}
    while (line := stream.readline().rstrip(b"\r\n")):
        k, _, v = line.decode().partition(": ")
        head[k] = v
    return head


def read(spark: SparkSession, out: str, payload: bool = True) -> DataFrame:
    """Every page record of the files in the manifest; block and payload digests and record counts are verified.

    ``payload`` is null for revisits, and for all if not asked for; empty payloads are empty. Null page ids and URLs come
    back null. A manifest without files gives no rows; a folder without manifest, or damaged files, an error.
    """
    prepare(spark)
    files = manifest(spark, out)
    n = max(1, files.count())

    def run(batches):
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.int64())
        names = [x.split()[0] for x in _RECORD.split(", ")]
        for b in batches:
            for name, want in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                fs, root = pafs.FileSystem.from_uri(out)
                rows, held, got = [], 0, 0
                with fs.open_input_stream(f"{root}/data/{name}", compression=None) as raw:
                    stream = io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20)
                    while (head := _parse(stream)) is not None:
                        block = stream.read(int(head["Content-Length"]))
                        stream.read(4)
                        if head["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
                            raise ValueError(f"{name}: block digest of {head['WARC-Record-ID']}")
                        if head["WARC-Type"] == "warcinfo":
                            continue
                        body, digest = block.partition(b"\r\n\r\n")[2], head["WARC-Payload-Digest"].removeprefix("sha256:")
                        response = head["WARC-Type"] == "response"
                        if response and (hashlib.sha256(body).hexdigest() != digest or len(body) != int(head["X-Payload-Length"])):
                            raise ValueError(f"{name}: payload digest of {head['WARC-Record-ID']}")
                        number = lambda k: int(head[k]) if k in head else None  # noqa: B023, E731
                        url = head["X-URL"].encode().decode("unicode_escape") if "X-URL" in head else None
                        rows.append((number("X-Page-ID"), url, number("X-Payload-Length"), digest, head["WARC-Type"], number("X-Refers-To-Page"), body if payload and response else None, name, got))
                        got, held = got + 1, held + len(body)
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows, held = [], 0
                if got != want:
                    raise ValueError(f"{name}: {got} records, {want} in the manifest")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return files.repartition(n).mapInArrow(run, _RECORD)

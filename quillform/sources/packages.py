"""ZIP packages as tables of entries, with limits and fingerprints."""

from __future__ import annotations

import hashlib
import io
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries, bytes in all and bytes of one entry that a package may hold.
MAX_ENTRIES, MAX_TOTAL, MAX_ENTRY = 25_000, 2 << 30, 512 << 20
_ENTRY = "path string, entry string, bytes long, packed long, crc long, is_safe boolean, error string"


def _entries(content: bytes) -> list[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return [(i.filename, i.file_size, i.compress_size, i.CRC, not (i.filename.startswith(("/", "\\")) or ".." in i.filename.replace("\\", "/").split("/") or ":" in i.filename)) for i in z.infolist()]


def read_entries(spark: SparkSession, path: str, pattern: str = "*.zip") -> DataFrame:
    """A row per entry of each package under a path; a broken package is one row with ``error``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches):
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
        names = [x.split()[0] for x in _ENTRY.split(", ")]
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    rows = [(name, *e, None) for e in _entries(content)]
                except zipfile.BadZipFile as e:
                    rows = [(name, None, None, None, None, None, str(e)[:200])]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return files.mapInArrow(run, _ENTRY)


def limits(entries: DataFrame) -> DataFrame:
    """(path, entries, bytes, problem): the first limit that a package breaks, or null."""
    g = entries.groupBy("path").agg(F.count("entry").alias("entries"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.max("bytes").alias("largest"), F.bool_and("is_safe").alias("safe"), F.first("error", ignorenulls=True).alias("error"))
    problem = F.when(F.col("error").isNotNull(), "broken").when(F.col("entries") > MAX_ENTRIES, "too many entries").when(F.col("bytes") > MAX_TOTAL, "too large").when(F.col("largest") > MAX_ENTRY, "entry too large").when(~F.col("safe"), "unsafe path")
    return g.select("path", "entries", "bytes", problem.alias("problem"))


def fingerprint(content: bytes) -> str | None:
    """SHA-256 over the length-prefixed names and contents of a DOCX's ``word/`` parts in order; null where it is no package."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            h = hashlib.sha256()
            for name in sorted(n for n in z.namelist() if n.startswith("word/") and not n.endswith("/")):
                for part in (name.encode(), z.read(name)):
                    h.update(len(part).to_bytes(8, "big") + part)
            return h.hexdigest()
    except zipfile.BadZipFile:
        return None


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, fingerprint) of each DOCX under a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(x.as_py()) for x in b.column(1)], pa.string())], ["path", "fingerprint"])

    return files.select("path", "content").mapInArrow(run, "path string, fingerprint string")

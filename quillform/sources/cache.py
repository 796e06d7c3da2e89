"""Analyses of files that are made once: results are kept by what a file is and by the version of the rules.

A file is known by its path, length and time of change, as its listing tells them without reading it. Files whose key has results
are not read again; the others are read where the task runs, and their results come to the store as a version of their own, so a
run that dies leaves the store as it was.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import published

#: Bytes of files that are handed on at a time.
BATCH_BYTES = 32 << 20


def listing(spark: SparkSession, path: str, pattern: str, rules: str) -> DataFrame:
    """(path, key) of the files under a path; the key changes with the file and with the rules."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    return files.select("path", F.sha2(F.concat_ws("\n", "path", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string"), F.lit(rules)), 256).alias("key"))


def contents(files: DataFrame) -> DataFrame:
    """(path, key, content) of listed files, read by the tasks."""

    def run(batches):
        names = ["path", "key", "content"]
        for b in batches:
            ready, size = [], 0
            for path, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                # "file:/x" is how Hadoop writes a local path.
                fs, at = pafs.FileSystem.from_uri(path if "://" in path else path.replace("file:/", "file:///", 1))
                with fs.open_input_stream(at, compression=None) as f:
                    ready.append((path, key, f.read()))
                size += len(ready[-1][2])
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*ready, strict=True), (pa.string(), pa.string(), pa.binary()), strict=True)], names)
                    ready, size = [], 0
            if ready:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*ready, strict=True), (pa.string(), pa.string(), pa.binary()), strict=True)], names)

    return files.select("path", "key").mapInArrow(run, "path string, key string, content binary")


def analysed(spark: SparkSession, path: str, pattern: str, analyse: Callable[[DataFrame], DataFrame], root: str, rules: str) -> DataFrame:
    """What ``analyse`` makes of the files (path, content) under a path, from the store at ``root`` where it has been made before.

    ``analyse`` returns rows with ``path``; a file may have none or many. The rows of files that are gone or have changed stay in the
    store and are left out. The store keeps its last version beside the present one.
    """
    files = listing(spark, path, pattern, rules)
    known = published.current(spark, root)
    fresh = files.join(published.read(spark, root).select("key").distinct(), "key", "left_anti") if known else files
    if fresh.limit(1).count():
        # Tasks of a known number share the new files out; a file is read once.
        made = analyse(contents(fresh.repartition("path")))
        # A row per file says that it has been seen, also if the analysis has no rows for it.
        rows = fresh.select("path", "key").join(made.withColumn("has_rows", F.lit(True)), "path", "left")
        published.publish(rows, root, expected=known[0] if known else 0, extend=True)
    elif not known:
        return analyse(contents(files)).limit(0)
    found = published.read(spark, root).join(files.select("key"), "key", "left_semi")
    return found.filter("has_rows").drop("key", "has_rows")

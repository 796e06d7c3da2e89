"""Streams of changes into keyed tables (an addition: the form engine itself has none)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.history import latest

#: Buckets of keys that a table is dealt into.
BUCKETS = 64


def windowed_counts(events: DataFrame, ts: str, kind: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events per tumbling window and kind; rows later than ``late`` are dropped by the watermark."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, width).alias("w"), kind).agg(F.count("*").alias("n")).select("w.start", kind, "n")


def upsert_stream(changes: DataFrame, keys: list[str], order: str, path: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Keep the last change per key as Parquet under ``path``: each micro-batch rewrites the buckets of keys that it touches.

    A bucket's rows are a folder of the version that last touched it, ``version=<batch>/bucket=<k>``. A batch that runs
    again reads the versions before it and writes the same rows, so a restart neither loses nor doubles changes. Of each
    bucket the newest version and the one before stay; older ones go. ``read_latest`` reads the newest whole versions.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        touched = [r[0] for r in rows.select("bucket").distinct().collect()]  # BUCKETS at most
        if not touched:
            return
        before = _paths(spark, path, epoch)
        old = [p for k in touched for p in before.get(k, [])[:1]]
        if old:
            rows = rows.unionByName(spark.read.option("basePath", path).parquet(*old).select(*batch.columns, "bucket"))
        last = latest(rows, [*keys, "bucket"], [F.col(order)]).select(*batch.columns, "bucket")
        # Dynamic: a batch that runs again replaces its own version.
        last.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/version={epoch:012d}")
        fs = _fs(spark, path)
        for k in touched:
            for p in before.get(k, [])[1:]:
                fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p), True)

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _fs(spark, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _paths(spark, path: str, before: int | None = None) -> dict[int, list[str]]:
    """Bucket -> its folders in whole versions, the newest first."""
    jvm_path, fs, out = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, _fs(spark, path), {}
    if not fs.exists(jvm_path(path)):
        return out
    for name in sorted((s.getPath().getName() for s in fs.listStatus(jvm_path(path))), reverse=True):
        if not name.startswith("version=") or (before is not None and int(name.removeprefix("version=")) >= before) or not fs.exists(jvm_path(f"{path}/{name}/_SUCCESS")):
            continue
        for s in fs.listStatus(jvm_path(f"{path}/{name}")):
            inner = s.getPath().getName()
            if inner.startswith("bucket="):
                out.setdefault(int(inner.removeprefix("bucket=")), []).append(f"{path}/{name}/{inner}")
    return out


def read_latest(spark, path: str, before: int | None = None) -> DataFrame | None:
    """The rows of the newest whole version of every bucket, or None."""
    newest = [ps[0] for ps in _paths(spark, path, before).values()]
    return spark.read.parquet(*newest) if newest else None

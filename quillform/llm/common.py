"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import uuid

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..deploy import ship

#: The white space of every word contract, besides the blank: tab to carriage return.
BREAKS = "\t\n\x0b\f\r"
BATCH_ROWS = 1000
#: The column that holds an input row as it was.
ROW = "quill_row"
#: Partitions up to which each bounded group gets one of its own.
MOST_PARTS = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a scale-factor folder, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Before Python runs on executors: send them this package, and hand it ``BATCH_ROWS`` rows at a time where the session has
    Spark's own default of 10,000.

    Batches of whole texts otherwise take some hundred megabytes per task, in the JVM and in the worker.
    """
    ship(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a local master gets a folder of this machine; a cluster must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file:///tmp/checkpoints"
    return qualified(spark, named)


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its file system: executors open files there without Hadoop's defaults."""
    at, fs = hadoop(spark, path)
    whole = fs.makeQualified(at).toString().rstrip("/")
    return f"file://{whole[5:]}" if whole.startswith("file:/") and not whole.startswith("file://") else whole


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's interpreter ends."""
    path = f"{shared_folder(spark)}/quillform-{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path by Hadoop's file system; a session that has ended leaves it."""
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    at, fs = hadoop(spark, path)
    fs.delete(at, True)


def hadoop(spark: SparkSession, path: str):
    """Hadoop's path and file system objects of a path."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read back, and where: the lineage ends in files that survive lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``stored`` without the path: the table stays until the driver's interpreter ends."""
    return stored(df, name)[0]


def byte_size(df: DataFrame, column: str) -> int:
    """Total UTF-8 bytes of a text column over all rows."""
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


def parts_for(total: int, each: int, least: int = 1) -> int:
    """How many parts of ``each`` bytes hold ``total`` bytes."""
    return max(least, -(-total // each))


def spread(df: DataFrame, groups: int, key: str) -> DataFrame:
    """``df`` by ``key`` in about as many partitions as it has groups of bounded size, so that a task holds few of them.

    From ``MOST_PARTS`` groups on, or the session's number of shuffle partitions if that is larger, partitions take several.
    """
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(usual, min(groups, MOST_PARTS)), key)


def packed(df: DataFrame) -> DataFrame:
    """``df`` with all its columns in the struct ``ROW``: operators add columns beside it without meeting names of the input."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(ROW))


def unpacked(df: DataFrame, **changed: Column) -> DataFrame:
    """The columns that ``packed`` took in, some changed."""
    row = F.col(ROW)
    for name, value in changed.items():
        row = row.withField(f"`{name}`", value)
    return df.select(row.alias(ROW)).select(f"{ROW}.*")


def arrow_column(batch, name: str):
    """A column of an Arrow batch, or a field of a struct column by ``column.field``."""
    head, _, field = name.partition(".")
    column = batch.column(batch.schema.get_field_index(head))
    if not field:
        return column
    # Nulls of the struct itself don't occur: every row has one.
    return column.field(column.type.get_field_index(field))


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; none for null."""
    flat = F.translate(F.coalesce(text, F.lit("")), BREAKS, " " * len(BREAKS))
    return F.array_remove(F.split(flat, " ", -1), "")


_BLOCK = 64


def _sum(array: str, begin: Column, n: Column) -> Column:
    return F.aggregate(F.slice(array, begin, n), F.lit(0).cast("long"), lambda a, x: a + x)


def with_blocks(df: DataFrame, lens: str) -> DataFrame:
    """Add ``quill_upto``: for each block of the array ``lens`` the sum of the blocks before it."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lens) - 1) / _BLOCK).cast("int")), lambda k: _sum(lens, k * _BLOCK + 1, F.lit(_BLOCK)))
    df = df.withColumn("quill_blocks", F.when(F.size(lens) > 0, blocks))
    return df.withColumn("quill_upto", F.transform("quill_blocks", lambda _, k: _sum("quill_blocks", F.lit(1), k))).drop("quill_blocks")


def sum_before(lens: str, i: Column) -> Column:
    """The sum of the elements of ``lens`` before the i-th (from 0), after ``with_blocks``."""
    block = F.floor(i / _BLOCK).cast("int")
    return F.get("quill_upto", block) + _sum(lens, block * _BLOCK + 1, i % _BLOCK)


def running(df: DataFrame, lens: str, name: str) -> DataFrame:
    """Add ``name``: for each element of the array ``lens`` the sum of the elements before it."""
    at = F.transform(lens, lambda _, i: sum_before(lens, i))
    return with_blocks(df, lens).withColumn(name, F.when(F.size(lens) > 0, at).otherwise(F.array().cast("array<bigint>"))).drop("quill_upto")


def put_file(root: str, name: str, raw: bytes) -> None:
    """Write a file of a shared folder from an executor: under a temporary name, then renamed, so that it is whole or absent."""
    fs, at = pafs.FileSystem.from_uri(root)
    fs.create_dir(at, recursive=True)
    temp = f"{at}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(temp, compression=None) as out:
        out.write(raw)
    fs.move(temp, f"{at}/{name}")


def get_file(root: str, name: str) -> bytes:
    fs, at = pafs.FileSystem.from_uri(root)
    with fs.open_input_stream(f"{at}/{name}", compression=None) as f:
        return f.read()

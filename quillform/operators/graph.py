"""Connected components of a table of links."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scratch(spark, name: str) -> str:
    """A new path in the shared folder that ``spark.checkpoint.dir`` names; it goes when the driver's interpreter ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file:///tmp/checkpoints"
    path = f"{root.rstrip('/')}/quillform-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """``df`` in a table of the shared folder, so that lineage ends there."""
    path = scratch(df.sparkSession, "graph")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove(spark, path: str) -> None:
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, grp): each node with the smallest node that links (u, v) lead to.

    Rounds of two aggregations: every node takes the smallest label among its own and its neighbours', then the label of
    its label (pointer jumping), so chains shrink by half a round.
    """
    both = stored(edges.select("u", "v").union(edges.select("v", "u")).distinct())
    labels = stored(nodes.select("node", F.col("node").alias("grp")))
    while True:
        near = both.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("grp").alias("low"))
        low = labels.join(near, F.col("node") == F.col("u"), "left").select("node", F.least("grp", F.coalesce("low", "grp")).alias("grp"))
        jump = low.alias("a").join(low.alias("b"), F.col("a.grp") == F.col("b.node")).select("a.node", F.least("a.grp", "b.grp").alias("grp"))
        fresh = stored(jump)
        changed = fresh.alias("x").join(labels.alias("y"), "node").filter("x.grp <> y.grp")
        if changed.isEmpty():
            return fresh
        labels = fresh

"""Queries through sinks: versions of a table, template packages out and in again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.graph import scratch
from ..sources import backup, ooxml, published
from .forms import table

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return keep


@query("""SELECT 1 AS version, o_orderstatus, count(*) AS n, sum(o_custkey) AS keys FROM orders WHERE o_orderstatus = 'F' GROUP BY 2
UNION ALL SELECT 2, o_orderstatus, count(*), sum(o_custkey) FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 2 UNION ALL SELECT 3, o_orderstatus, count(*), sum(o_custkey) FROM orders GROUP BY 2""")
def published_versions(spark, sf_dir):
    """Orders published in three versions, the last of which adds to the one before; one that fails its audit isn't seen."""
    o, root = table(spark, sf_dir, "orders"), scratch(spark, "published")
    published.publish(o.filter("o_orderstatus = 'F'"), root, lambda rows: rows.filter("o_orderstatus <> 'F'"), expected=0, keep=3)
    published.publish(o.filter("o_orderstatus = 'O'"), root, expected=1, keep=3, extend=True)
    try:
        published.publish(o, root, lambda rows: rows.filter("o_orderstatus = 'P'").select("o_orderkey"))
    except published.Rejected:
        pass
    published.publish(o.filter("o_orderstatus NOT IN ('F', 'O')"), root, expected=2, keep=3, extend=True)
    parts = [published.read(spark, root, n).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("keys")).select(F.lit(n).alias("version"), "o_orderstatus", "n", "keys") for n in (1, 2, 3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""WITH p AS (SELECT c_custkey, 'p' || c_custkey AS path, c_nationkey, c_custkey % 11 = 0 AS broken FROM customer),
f AS (SELECT c_nationkey, min(path) AS first FROM p WHERE NOT broken GROUP BY 1)
SELECT path, CASE WHEN broken THEN 'no package' WHEN p.c_nationkey = 3 OR path <> first THEN 'duplicate' END AS problem, CASE WHEN NOT broken THEN '{"template":{"name":"' || c_name || '"}}' END AS config
FROM p JOIN customer USING (c_custkey) LEFT JOIN f ON f.c_nationkey = p.c_nationkey""")
def imported_packages(spark, sf_dir):
    """A template package of each customer, exported and imported: equal sources come once, known ones not at all."""
    c = table(spark, sf_dir, "customer").withColumn("path", F.concat(F.lit("p"), F.col("c_custkey").cast("string")))
    sources = ooxml.to_docx(table(spark, sf_dir, "nation").withColumn("text", F.concat(F.lit("País "), "n_name", F.lit("\n{{nome}}"))), "n_nationkey", "text").withColumnRenamed("content", "source")
    config = F.concat(F.lit('{"template":{"name":"'), "c_name", F.lit('"}}'))
    t = c.join(sources, c.c_nationkey == sources.n_nationkey).select(F.col("path").alias("id"), config.alias("config"), "source", "c_custkey")
    made = backup.export_packages(t).withColumnRenamed("id", "path")
    broken = F.substring("path", 2, 20).cast("long") % 11 == 0
    packages = made.select("path", F.when(broken, F.lit(b"PK")).otherwise(F.col("content")).alias("content"))
    known = backup.import_packages(backup.export_packages(sources.filter("n_nationkey = 3").select(F.lit("k").alias("id"), F.lit("{}").alias("config"), "source")).withColumnRenamed("id", "path"), spark.createDataFrame([], "fingerprint string"))
    return backup.import_packages(packages, known.select("fingerprint")).select("path", "problem", "config")

"""Queries on page geometry, each with DuckDB SQL of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geometry
from .forms import table

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return keep


@query("""WITH w AS (SELECT l_suppkey AS doc, l_orderkey % 20 AS y, l_partkey % 400 AS x0, l_partkey % 400 + 10 AS x1, CAST(l_partkey AS VARCHAR) AS text FROM lineitem GROUP BY ALL),
b AS (SELECT s_suppkey AS doc, n AS widget, n * 3 AS y, n * 20 AS x1 FROM supplier, (SELECT unnest(range(0, 6)) AS n)),
p AS (SELECT b.doc, widget, b.x1 AS wx, w.x0, w.x1, text FROM b JOIN w ON b.doc = w.doc AND abs(w.y - b.y) <= 3 AND w.x0 >= b.x1 AND w.x0 - b.x1 <= 220),
e AS (SELECT *, coalesce(max(x1) OVER (PARTITION BY doc, widget ORDER BY x0, x1, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), wx) AS ended FROM p),
r AS (SELECT *, sum(CASE WHEN x0 - ended > 18 THEN 1 ELSE 0 END) OVER (PARTITION BY doc, widget ORDER BY x0, x1, text ROWS UNBOUNDED PRECEDING) AS breaks FROM e)
SELECT doc, widget, string_agg(text, ' ' ORDER BY x0, x1, text) AS label FROM r WHERE breaks = 0 GROUP BY ALL""")
def widget_labels(spark, sf_dir):
    w = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc"), (F.col("l_orderkey") % 20).alias("y"), (F.col("l_partkey") % 400).alias("x0"), (F.col("l_partkey") % 400 + 10).alias("x1"), F.col("l_partkey").cast("string").alias("text")).distinct()
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("widget"))
    return geometry.right_labels(b.select("doc", "widget", (F.col("widget") * 3).alias("y"), (F.col("widget") * 20).alias("x1")), w)


@query("""WITH r AS (SELECT o_custkey AS doc, o_orderkey % 1000 AS y, o_orderkey % 30 AS x, 2 + o_orderkey % 2 AS options FROM orders),
n AS (SELECT *, CASE WHEN options = lag(options) OVER q AND abs(x - lag(x) OVER q) <= 12 AND y - lag(y) OVER q <= 65 THEN 0 ELSE 1 END AS new FROM r WINDOW q AS (PARTITION BY doc ORDER BY y, x)),
i AS (SELECT *, sum(new) OVER (PARTITION BY doc ORDER BY y, x ROWS UNBOUNDED PRECEDING) AS id FROM n)
SELECT doc, min(y) AS first_y, count(*) AS n_rows, any_value(options) AS options FROM i GROUP BY doc, id HAVING count(*) >= 2""")
def choice_matrices(spark, sf_dir):
    k = F.col("o_orderkey")
    return geometry.matrices(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), (k % 1000).alias("y"), (k % 30).alias("x"), (2 + k % 2).alias("options")))


@query("""WITH b AS (SELECT o_custkey AS doc, o_orderkey AS block, o_orderkey % 500 AS x0, o_orderkey % 700 AS y0, o_orderkey % 500 + 40 AS x1, o_orderkey % 700 + 12 AS y1 FROM orders), t AS (SELECT c_custkey AS doc, 100 AS x0, 100 AS y0, 300 AS x1, 400 AS y1 FROM customer WHERE c_custkey % 2 = 0)
SELECT doc, block, row_number() OVER (PARTITION BY doc ORDER BY y0, x0, block) AS n FROM b WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.doc = b.doc AND (b.x0 + b.x1) / 2 BETWEEN t.x0 AND t.x1 AND (b.y0 + b.y1) / 2 BETWEEN t.y0 AND t.y1)""")
def reading_order(spark, sf_dir):
    k = F.col("o_orderkey")
    b = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), k.alias("block"), (k % 500).alias("x0"), (k % 700).alias("y0"), (k % 500 + 40).alias("x1"), (k % 700 + 12).alias("y1"))
    t = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("doc"), F.lit(100).alias("x0"), F.lit(100).alias("y0"), F.lit(300).alias("x1"), F.lit(400).alias("y1"))
    return geometry.reading_order(b, t).select("doc", "block", "n")

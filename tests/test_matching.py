"""Unambiguous matches of described fields, against all pairs."""

import random

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillform.operators import matching

SCHEMA = "k int, field_id string, label_norm string, type string, section_norm string, semantic string, context string"


def brute(s, t, least):
    on = F.col("s.k") == F.col("t.k")
    pairs = s.alias("s").join(t.alias("t"), on).select(F.col("t.k").alias("k"), F.col("t.field_id").alias("target_id"), F.col("s.field_id").alias("source_id"), matching.match_score("s", "t").alias("score"))
    pairs = pairs.filter(F.col("score") >= least).distinct()
    for side in ("target_id", "source_id"):
        w = W.partitionBy("k", side)
        pairs = pairs.withColumn("best", F.max("score").over(w)).filter("score = best").withColumn("ties", F.count("*").over(w)).filter("ties = 1").select("k", "target_id", "source_id", "score")
    return sorted(tuple(r) for r in pairs.collect())


def test_matches_are_those_of_all_pairs(spark):
    rnd = random.Random(7)
    pick = lambda *xs: rnd.choice(xs)

    def fields(n):
        made = [(rnd.randrange(40), f"f{rnd.randrange(n)}", pick("", "a", "b", "c", None), pick("text", "cpf", "date", "list", None), pick("", "x", "y", None), pick("", "", "email", "cep", None), pick("", "", "", "p", "q", None)) for _ in range(n)]
        return spark.createDataFrame(made, SCHEMA).cache()

    s, t = fields(220), fields(220)
    for least in (90, 80):
        got = sorted(tuple(r) for r in matching.identity_matches(s, t, "k", least).collect())
        assert got == brute(s, t, least) and len(got) > 20


def _shuffled(spark) -> int:
    """Rows that all stages of the session have written to shuffles."""
    jvm, store = spark.sparkContext._jvm, spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_fields_of_one_label_are_not_paired(spark):
    many = lambda p, n: [(1, f"{p}{i}", "nome", "text", f"s{i % 3}", "", "") for i in range(n)]
    s = spark.createDataFrame([*many("s", 400), (1, "s", "nome", "text", "only", "", "")], SCHEMA)
    t = spark.createDataFrame([*many("t", 400), (1, "t", "nome", "text", "only", "", "")], SCHEMA)
    before = _shuffled(spark)
    assert [tuple(r) for r in matching.identity_matches(s, t, "k").collect()] == [(1, "t", "s", 100)]
    assert _shuffled(spark) - before < 10_000

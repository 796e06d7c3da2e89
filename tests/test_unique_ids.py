from pyspark.sql.group import GroupedData

from quillform.operators import records


def test_one_base_beside_taken_names_is_settled_without_python(spark):
    rows = spark.createDataFrame([(i, "a") for i in range(6)] + [(9, "b"), (10, "b")], "pos int, base string")
    taken = spark.createDataFrame([(x,) for x in ("a", "a_3", "a_4", "a_1", "a_02", "a_x", "a_99999999999999999999", "a_2_2", "b_2")], "base string")
    out = records.unique_ids(rows, "base", ["pos"], taken=taken)
    assert [r.unique_id for r in sorted(out.collect(), key=lambda r: r.pos)] == ["a_2", "a_5", "a_6", "a_7", "a_8", "a_9", "b", "b_3"]


def test_no_row_of_one_base_goes_to_python(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "a") for i in range(3)], "pos int, base string")
    taken = spark.createDataFrame([("a",)], "base string")

    seen, real = [], GroupedData.applyInArrow
    monkeypatch.setattr(GroupedData, "applyInArrow", lambda self, f, schema: seen.append(self._df.count()) or real(self, f, schema))
    assert sorted(r.unique_id for r in records.unique_ids(rows, "base", ["pos"], taken=taken).collect()) == ["a_2", "a_3", "a_4"]
    assert seen == [0]


def test_what_gives_the_rows_runs_once_though_callers_drop_columns(spark):
    from pyspark.sql import functions as F

    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def base(i):
        seen.add(1)
        return f"b_{i % 3}" if i % 2 else "b"

    rows = spark.range(0, 40, 1, 2).select(F.col("id").alias("pos"), base("id").alias("base"), (F.col("id") * 3).alias("unread"))
    got = records.unique_ids(rows, "base", ["pos"]).select("pos", "unique_id").collect()
    assert len({r.unique_id for r in got}) == 40 and seen.value == 40

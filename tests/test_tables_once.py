from quillform.operators import geometry, inference
from tests.test_inference import CELLS, PARAGRAPHS


def test_classify_works_out_the_rows_of_tables_twice_at_most(spark):
    cells = spark.createDataFrame([(1, 0, 1, 0, 0, 0, 1, "a", False, None)], CELLS)
    plan = inference.classify(spark.createDataFrame([], PARAGRAPHS), cells)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("cell_index#") and sum("LogicalRDD" in x and "cell_index" in x for x in plan.splitlines()) <= 2


def test_matrices_of_tied_rows_do_not_depend_on_their_order(spark):
    rows = [(1, 0, 0, 2), (1, 0, 0, 3), (1, 0, 0, 2), (1, 9, 0, 3)]
    for order in (rows, rows[::-1], sorted(rows)):
        got = geometry.matrices(spark.createDataFrame(order, "doc int, y int, x int, options int").coalesce(1)).collect()
        assert sorted((r.first_y, r.n_rows, r.options) for r in got) == [(0, 2, 2), (0, 2, 3)]


def test_matrices_of_rows_without_a_place_are_in_no_run(spark):
    rows = [(1, None, None, 2), (1, None, None, 2), (1, 5, 0, 2), (1, 9, None, 2), (1, 10, 0, 2), (1, 20, 0, 2)]
    got = geometry.matrices(spark.createDataFrame(rows, "doc int, y int, x int, options int")).collect()
    assert [(r.first_y, r.n_rows, r.options) for r in got] == [(10, 2, 2)]

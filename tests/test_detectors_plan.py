import pytest

from quillform.operators import detectors as operators
from quillform.plans import detectors


@pytest.mark.parametrize("name", ["detector_cascade", "candidate_fields", "applied_tags"])
def test_no_detector_broadcasts_what_grows_with_the_records(spark, name):
    # The records of a form are exploded from a small table, whose size the planner goes by.
    df = detectors.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_detectors_work_out_each_value_once(spark):
    # A text with single blanks and a clean label were written out wherever a filter read them: 401 patterns in this plan.
    df = detectors.QUERIES["detector_cascade"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") < 250


def test_masks_are_found_wherever_their_sign_is(spark):
    texts = ["A: XXXX", "B: __", "C: (00) 0000-0000", "D: 000.000.000-00", "E: R$ 00", "F: contato@empresa.com", "GG: {nome}", "H: R$xx", "I: nada"]
    records = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc int, ordinal int, text string")
    assert sorted(r.ordinal for r in operators.inline_masks(records).collect()) == list(range(8))

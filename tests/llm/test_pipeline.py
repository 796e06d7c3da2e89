import random

import corpus_pipeline as cp
from quillform.llm import packing, quality, secrets, simhash
from tests.llm.conftest import prose
from tests.llm.test_decontaminate import want as contaminated
from tests.llm.test_simhash import grouped, slow

KEY = "04dbebab91ab85687d33eeaaf9ac699e1188f962"


def test_stages_take_effect_on_all_that_came_before(spark, tables, documents):
    docs = [r for r in documents if r[0] is not None and len(r[1] or "") < 60_000]
    docs = list({r[0]: r for r in docs}.values())
    plain = [r for r in docs if r[1] and 80 < len(r[1].split()) < 300]
    docs += [(700, prose(random.Random(77), 90) + f'\ntoken = "{KEY}" ' + prose(random.Random(78), 60), "en", "hot", None)]
    items = [(1, " ".join(plain[4][1].split()[5:40]))]
    sf_dir = tables(documents=docs, benchmark=items)
    frame = cp.table(spark, sf_dir, "documents")
    rows, kept = {r[0]: r for r in docs}, {}
    for name, stage in cp.STAGES:
        out = cp.materialize(stage(spark, frame, sf_dir), f"test-{name}")
        if name != "mixture_packing":
            assert out.columns == frame.columns
            kept[name] = {r.doc_id: r.text for r in out.collect()}
        frame = out
    judged = {r.doc_id for r in quality.judge(spark.createDataFrame(docs, cp.table(spark, sf_dir, "documents").schema)).filter("kept").collect()}
    assert set(kept["quality_rules"]) == judged
    comp = grouped({d: slow(rows[d][1]) for d in judged})
    assert set(kept["simhash_near_dedup"]) == set(comp.values())
    dirty = {r[0] for r in contaminated([(d, rows[d][1]) for d in kept["simhash_near_dedup"]], items) if r[-1]}
    assert dirty and set(kept["benchmark_decontamination"]) == set(kept["simhash_near_dedup"]) - dirty
    assert set(kept["secret_scan"]) == set(kept["benchmark_decontamination"])
    assert KEY not in kept["secret_scan"][700] and secrets.REPLACEMENT in kept["secret_scan"][700]
    assert all(kept["secret_scan"][d] == rows[d][1] for d in kept["secret_scan"] if d != 700)
    pieces = {(r.doc_id, r.start): r.length for r in frame.collect()}
    assert {d for d, _ in pieces} == set(kept["secret_scan"])
    whole = {(r.doc_id, r.start): r.length for r in cp.run(spark, sf_dir).collect()}
    total = lambda p: {d: sum(n for (e, _), n in p.items() if e == d) for d, _ in p}
    assert total(whole) == total(pieces)


def test_hostile_rows_and_empty_tables_pass_every_stage(spark, tables, documents):
    assert cp.run(spark, tables(documents=documents, benchmark=[(None, None), (1, "")])).count() > 0
    assert cp.run(spark, tables()).count() == 0


def test_names():
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "simhash_near_dedup", "benchmark_decontamination", "secret_scan", "mixture_packing"]
    assert packing.LENGTH == 2048 and simhash.MAX_BITS == 4

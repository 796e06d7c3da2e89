import random

from quillform.llm import simhash


def test_keep_one_takes_the_links_of_fingerprints(spark):
    rng = random.Random(2)
    # The repeated words settle the fingerprint; the sets of shingles have little in common.
    texts = [" ".join(["um dois tres quatro cinco"] * 100 + [f"w{rng.randrange(10**6)}" for _ in range(20)]) for _ in range(3)] + ["outro texto que fica como esta"]
    prints = [simhash.fingerprint(x) for x in texts]
    assert all((prints[0] ^ p).bit_count() <= simhash.MAX_BITS for p in prints[:3])
    assert not any(simhash.SIMILAR <= len(set(a) & set(b)) / len(set(a) | set(b)) for i, a in enumerate(map(simhash.shingle_set, texts)) for b in map(simhash.shingle_set, texts[:i]))
    kept = simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == {0, 3}

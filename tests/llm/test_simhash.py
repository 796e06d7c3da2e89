import random
import re

import numpy as np
import pytest
import xxhash

from quillform.llm import q_simhash, simhash


def slow(t):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(prints):
    """fingerprints by node -> component names, by brute force."""
    keys = sorted(prints)
    up = {k: k for k in keys}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


@pytest.mark.parametrize("wide", [4096, 2])
def test_against_brute_force(spark, tables, documents, monkeypatch, wide):
    monkeypatch.setattr(simhash, "WIDE", wide)
    rows = [r for r in documents if r[0] is not None and len(r[1] or "") < 60_000]
    seen, clean = set(), []
    for r in rows:
        if r[0] not in seen:
            seen.add(r[0])
            clean.append(r)
    prints = {r[0]: slow(r[1]) for r in clean}
    comp = grouped(prints)
    got = {r[0]: (r[1], r[2]) for r in q_simhash.op7_simhash_near_dedup(spark, tables(documents=clean)).collect()}
    assert got == {d: (format(p, "016x"), comp[d]) for d, p in prints.items()}
    assert len(set(comp.values())) < len(comp) - 8


@pytest.mark.parametrize("wide", [10_000, 5])
def test_no_link_is_lost_among_random_fingerprints(spark, monkeypatch, wide):
    monkeypatch.setattr(simhash, "WIDE", wide)
    rng, prints = random.Random(3), {}
    for _ in range(60):
        seed = rng.getrandbits(64)
        for _ in range(6):
            seed ^= sum(1 << b for b in rng.sample(range(64), rng.choice((3, 4, 5))))
            prints[len(prints)] = seed
    df = spark.createDataFrame([(simhash._signed(p), i) for i, p in prints.items()], "fp long, id long")
    got = {r.fp: r.best for r in simhash.groups(df, "id").collect()}
    comp = grouped(prints)
    assert {i: got[simhash._signed(p)] for i, p in prints.items()} == comp


def test_chain_budgets_are_those_of_the_principle():
    for ring in range(5):
        chains = simhash._chains(ring)
        assert [c[1] for c in chains] == [1, 2, 3, 4] and int(chains[-1][0]) == (1 << 64) - 1
    rng = random.Random(5)
    for _ in range(2000):  # every pair within 4 bits passes from some segment of the ring
        d = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
        x = np.uint64(d)
        ok = False
        for ring, (shift, bits) in enumerate(simhash.RING):
            first = (d >> shift & ((1 << bits) - 1)) == 0
            ok |= first and all(np.bitwise_count(x & m) <= b for m, b in simhash._chains(ring))
        assert ok


def test_nulls_and_repeated_rows(spark, tables, documents):
    rows = q_simhash.op7_simhash_near_dedup(spark, tables(documents=documents)).collect()
    assert len(rows) == len(documents)
    assert {r.component_id for r in rows if r.fingerprint == "0" * 16} == {min(r[0] for r in documents if r[0] is not None and not (r[1] or "").split())}


def test_keep_one_keeps_the_smallest_id_with_all_columns(spark, documents):
    odd = next(r for r in documents if sum(x[0] == r[0] for x in documents) > 1 and r[0] is not None and sum(x == r for x in documents) == 1 and r[2] == "en")
    df = spark.createDataFrame([(*r, "fp", i) for i, r in enumerate(documents) if r is not odd], "doc_id long, text string, lang string, source string, n_chars long, fp string, sim_row long")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    rows = kept.collect()
    comp = {}
    for r in simhash.near_duplicates(df).collect():
        comp.setdefault(r.component_id, 0)
    assert len(rows) == len(comp) and {r.doc_id for r in rows} == set(comp)


def test_keep_one_drops_edited_copies_and_no_less_similar_texts(spark):
    rng, texts, near, far = random.Random(9), [], 0, 0
    sets = lambda t: {tuple(t.lower().split()[k : k + 5]) for k in range(len(t.split()) - 4)}
    for _ in range(60):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(120, 400))]
        copy = list(base)
        for k in rng.sample(range(len(copy)), len(copy) * rng.choice((1, 2, 6)) // 100):
            copy[k] = "edited"
        x, y = sets(" ".join(base)), sets(" ".join(copy))
        similar = len(x & y) / len(x | y) >= 0.8
        near, far = near + similar, far + (not similar)
        texts.append((" ".join(base), " ".join(copy), similar))
    assert near >= 20 and far >= 10
    rows = [(2 * i + k, pair[k]) for i, pair in enumerate(texts) for k in range(2)]
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {2 * i + k for i, pair in enumerate(texts) for k in range(2) if not (k and pair[2])}


def jaccard(x, y):
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("tile", [simhash.TILE_HASHES, 700, 1])
def test_buckets_give_the_components_of_all_similar_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE_HASHES", tile)
    rng = random.Random(4)
    sets, members = {}, []
    for band in range(6):
        base = [rng.getrandbits(60) for _ in range(60)]
        for _ in range(25):
            node = len(sets) + 1
            sets[node] = frozenset([*rng.sample(base, rng.choice((50, 55, 58))), *[rng.getrandbits(60) for _ in range(rng.choice((0, 3, 9)))]])
            members.append((band, node, len(sets[node]), node if rng.random() < 0.7 else 1 + 25 * band))
    df = spark.createDataFrame(members, "band long, node long, size long, root long")
    links = simhash._bucket_links(df, spark.createDataFrame([(n, sorted(x)) for n, x in sets.items()], "node long, hashes array<long>"), 0.8).collect()
    assert all(jaccard(sets[r.a], sets[r.b]) >= 0.8 for r in links) and len(links) < len(sets) * (1 if tile > 10**6 else 40)

    def comps(pairs):
        up = {n: n for n in sets}
        find = lambda x: x if up[x] == x else find(up[x])
        for a, b in [*pairs, *[(n, r) for _, n, _, r in members]]:
            up[max(find(a), find(b))] = min(find(a), find(b))
        return {n: find(n) for n in sets}

    every = [(a, b) for i, (k, a, *_) in enumerate(members) for q, b, *_ in members[:i] if k == q and jaccard(sets[a], sets[b]) >= 0.8]
    assert len(every) > 100 and comps([(r.a, r.b) for r in links]) == comps(every)


def test_empty_table(spark, tables):
    assert q_simhash.op7_simhash_near_dedup(spark, tables()).collect() == []

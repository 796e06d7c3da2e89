import hashlib
import itertools
import random
import re
import zlib

import pytest

from quillform.llm import q_repair, repair

ROLES = ["user", "assistant", "system", "tool", None, ""]
TEXTS = ["Fine.", "cut", "", " \t\n", "Really?", "more, ", None, "ok!  "]


def brute(rows):
    """All edits with up to two insertions before each row and at the end: (cost, audit, repaired) of (role, text) rows in order."""
    runs = [x for n in range(3) for x in itertools.product("ua", repeat=n)]
    names = {"u": "user", "a": "assistant"}
    options, seen = [], set()
    for role, text in rows:
        rest = text.rstrip(" \t\n\x0b\f\r")
        gone = not rest or (role, text) in seen
        seen.add((role, text))
        late = 0 if gone or rest[-1] in ".!?" else 3
        options.append([("D", 4, None)] + ([] if gone else [("K", late, (role, text)), ("R", 3 + late, ("user", text)), ("R", 3 + late, ("assistant", text))]))
    best = None
    for way in itertools.product(*[itertools.product(runs, o) for o in options], runs):
        cost, audit, out = 0, "", []
        for run, (edit, c, turn) in way[:-1]:
            cost += 3 * len(run) + c
            audit += "I" * len(run) + edit
            out += [(names[x], "") for x in run] + ([turn] if turn else [])
        cost, audit = cost + 3 * len(way[-1]), audit + "I" * len(way[-1])
        out += [(names[x], "") for x in way[-1]]
        initials = "".join(r[:1] or "?" for r, _ in out)
        if re.fullmatch(r"(s?(ua)+)?", initials):
            best = min(best, (cost, audit, out)) if best else (cost, audit, out)
    return best


def order(row):
    turn, role, text = row
    return (turn is not None, turn or 0, role, hashlib.sha256(text.encode()).digest())


def want(rows):
    """conv -> the whole result of undamaged rows, by brute force."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted(((t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv), key=order)
        cost, audit, turns = brute([(r, x) for _, r, x in mine])
        blank = dup = cut = 0
        for i, (_, r, x) in enumerate(mine):
            rest = x.rstrip(" \t\n\x0b\f\r")
            if not rest:
                blank += 1
            elif any((r, x) == m[1:] for m in mine[:i]):
                dup += 1
            else:
                cut += rest[-1] not in ".!?"
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        at = [t for t, _, _ in mine if t is not None]
        gaps = max(at) - min(at) + 1 - len(set(at)) if at else 0
        out[conv] = (gaps, blank, dup, cut, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in turns).encode()).hexdigest())
    return out


def hostile(seed, n=25):
    rng = random.Random(seed)
    return [(c, rng.choice([0, 1, 2, 3, 7, None]), rng.choice(ROLES[:2] + ROLES), rng.choice(TEXTS[:2] + TEXTS)) for c in [*range(n), None] for _ in range(rng.choice((1, 2, 3)))]


def run(spark, rows):
    pieces = repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = pieces.repartition(2, "conv_id").sortWithinPartitions("conv_id", "part", "chunk").mapInArrow(q_repair._digest, q_repair._OUT).collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got}


@pytest.mark.parametrize("rows_a_chunk", [4096, 1, 2])
def test_cheapest_repairs_against_all_edits(spark, monkeypatch, rows_a_chunk):
    monkeypatch.setattr(repair, "CHUNK_ROWS", rows_a_chunk)
    rows = hostile(rows_a_chunk)
    assert run(spark, rows) == want(rows)


def test_chunks_of_any_size_give_one_result(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(7, t, rng.choice(ROLES), rng.choice(TEXTS) if t % 3 else f"text {t}.") for t in range(300)]
    whole = run(spark, rows)
    for limit, chars in ((1, 1), (7, 1 << 20), (4096, 40)):
        monkeypatch.setattr(repair, "CHUNK_ROWS", limit)
        monkeypatch.setattr(repair, "CHUNK_CHARS", chars)
        assert run(spark, rows) == whole


def test_repeated_rows_are_one_row_with_copies(spark, monkeypatch):
    monkeypatch.setattr(repair, "CHUNK_ROWS", 10)
    rows = [(1, 0, "user", "Hi.")] * 45 + [(1, 1, "assistant", "Yes.")]
    (got,) = run(spark, rows).values()
    assert got[6] == "K" + "D" * 44 + "K" and got[2] == 44 and got[4] == 44 and got[5] == 176


def test_duplicates_are_found_across_turns_and_long_texts_are_whole(spark):
    long = "word " * 300_000 + "end."
    rows = [(1, 0, "user", long), (1, 1, "assistant", "A."), (1, 5, "user", long), (1, 6, "assistant", "B.")]
    (got,) = run(spark, rows).values()
    assert got[:7] == (3, 0, 1, 0, 0, 7, "KKDIK")
    assert got[7] == hashlib.sha256(f"user:{long}\nassistant:A.\nuser:\nassistant:B.".encode()).hexdigest()


def test_layers_are_few():
    repair.step.cache_clear()
    rng = random.Random(3)
    for _ in range(50):
        repair.walk(rng.randrange(4), [(rng.randrange(9), 1) for _ in range(500)])
    assert repair.step.cache_info().currsize < 3000


def test_damage_follows_the_checksum(spark):
    rows = [(c, t, "assistant", "A. b? c!") for c in range(40) for t in (0, 1, None)]
    got = sorted((r.conv_id, r.turn if r.turn is not None else -1, r.role, r.text) for r in q_repair.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect())
    out = []
    for c, t, role, text in rows:
        harm = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        row = (c, -1 if t is None else t, "user" if harm == 4 else role, "" if harm == 1 else "A b c" if harm == 2 else text)
        out += [row] * (0 if harm == 0 else 2 if harm == 3 else 1)
    assert got == sorted(out)


def test_query_keeps_every_conversation(spark, tables):
    rows = [(c, 0, "user", "Hi.") for c in range(60)] + [(None, None, None, None), (None, 1, "user", "x")]
    got = {r.conv_id: r for r in q_repair.op12_conversation_repair(spark, tables(conversations=rows)).collect()}
    assert set(got) == {*range(60), None}
    gone = next(c for c in range(60) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert tuple(got[gone])[1:8] == (0, 0, 0, 0, 0, 0, "") and got[gone].repaired_sha256 == hashlib.sha256(b"").hexdigest()
    assert q_repair.op12_conversation_repair(spark, tables()).count() == 0


def test_extra_columns_are_left_out(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi.", 3, "x")], "conv_id long, turn long, role string, text string, part int, rows string")
    (r,) = repair.repair(df).collect()
    assert r.audit == "KI" and [tuple(x) for x in r.repaired] == [("user", "Hi."), ("assistant", "")]

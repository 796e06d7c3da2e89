"""The replayed log against a step-by-step one."""

import random

from quillform.operators import lifecycle

LOG = "template_id string, seq int, command string, version int"


def brute(rows):
    out = {}
    for key in {r[0] for r in rows}:
        state, saved, now = "absent", [], None
        for _, seq, command, version in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
            before, snapshot = state, None
            ok = command in lifecycle.COMMANDS and lifecycle.STATES[lifecycle.COMMANDS[command][0]] == state and (command != "restore_version" or 1 <= (version or 0) <= len(saved))
            if ok:
                if command in ("update", "restore_version"):
                    saved.append(now)
                    snapshot = len(saved)
                if command in ("create", "update"):
                    now = seq
                if command == "restore_version":
                    now = saved[version - 1]
                if command == "delete":
                    saved, now = [], None
                state = lifecycle.STATES[lifecycle.COMMANDS[command][1]]
            out[key, seq] = (before, ok, state, snapshot, now)
    return out


def replay(spark, rows):
    h = lifecycle.replay(spark.createDataFrame(rows, LOG))
    return h, {(r.template_id, r.seq): (r.before, r.accepted, r.state, r.snapshot, r.source) for r in h.collect()}


def test_against_step_by_step_replay(spark):
    rng = random.Random(7)
    commands = ["create", "update", "update", "update", "restore_version", "restore_version", "archive", "restore", "restore", "delete", "rename", None]
    rows = [(rng.choice([*"abcdef", None]), seq, rng.choice(commands), rng.choice((1, 1, 2, 3, 5, None, 0))) for seq in range(600)]
    # One template has more than all others.
    rows += [("hot", seq, rng.choice(commands[:9]), rng.choice((1, 2, 4, 9, 30))) for seq in range(1500)]
    h, got = replay(spark, rows)
    assert got == brute(rows)
    at = 900
    want = {}
    for (key, seq), x in sorted(brute(rows).items(), key=lambda kv: kv[0][1]):
        if seq <= at:
            want[key] = (x[2], x[4])
    assert {r.template_id: (r.state, r.source) for r in lifecycle.as_of(h, at).collect()} == {k: v for k, v in want.items() if v[0] != "absent"}


def test_versions_and_lives(spark):
    rows = [("a", 0, "create", None), ("a", 1, "update", None), ("a", 2, "restore_version", 1), ("a", 3, "restore_version", 2), ("a", 4, "restore_version", 9), ("b", 0, "create", None), ("b", 1, "update", None), ("b", 2, "delete", None), ("b", 3, "create", None), ("b", 4, "restore_version", 1)]
    h, got = replay(spark, rows)
    assert [got["a", i][4] for i in range(5)] == [0, 1, 0, 1, 1] and not got["a", 4][1] and not got["b", 4][1] and got["b", 3][4] == 3
    assert sorted(tuple(r) for r in lifecycle.versions(h).collect()) == [("a", 1, 1, 0), ("a", 2, 2, 1), ("a", 3, 3, 0)]


def test_empty_log(spark):
    assert replay(spark, [])[1] == {}

"""Query op12_conversation_repair and its SQL."""

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import repair
from .common import table

_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_OUT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damage(rows: DataFrame) -> DataFrame:
    """Conversations with rows dropped, emptied, stripped of full stops, repeated or given the role user, by a checksum of their place."""
    space = F.lit(" ")
    rows = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    place = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = rows.withColumn("harm", F.crc32(F.encode(place, "utf-8")) % 20).where("harm <> 0")
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    twice = F.explode(F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return rows.select("conv_id", "turn", F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), twice).drop("copy")


def _line(turn: dict) -> str:
    return f"{turn['role']}:{turn['text']}"


def _digest(batches):
    """Pieces of conversations in order -> one row each, with the digest of all their repaired lines."""
    state: dict = {}

    def row():
        first, last = state["first_turn"], state["last_turn"]
        gaps = 0 if first is None else last - first + 1 - state["seen"]
        return (state["conv"], gaps, state["blank"], state["duplicate"], state["truncated"], state["illegal"], state["cost"], "".join(state["audit"]), state["sha"].hexdigest())

    def out(rows):
        kinds = [pa.int64()] * 7 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in _OUT.split(", ")])

    for b in batches:
        rows = []
        for r in b.to_pylist():
            if not state or r["conv_id"] != state["conv"]:
                if state:
                    rows.append(row())
                state = {"conv": r["conv_id"], "first_turn": None, "last_turn": None, "seen": 0, "audit": [], "sha": hashlib.sha256(), "lines": 0, "initial": None} | dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)
            for c in ("blank", "duplicate", "truncated", "illegal", "cost"):
                state[c] += r[c]
            # Pieces meet between two rows, and within a turn where its rows lie in both.
            state["illegal"] += state["initial"] is not None and state["initial"] + r["first_initial"] not in ("su", "ua", "au")
            state["initial"] = r["last_initial"]
            if r["first_turn"] is not None:
                state["seen"] += r["turns_seen"] - (r["first_turn"] == state["last_turn"])
                state["first_turn"] = r["first_turn"] if state["first_turn"] is None else state["first_turn"]
                state["last_turn"] = r["last_turn"]
            state["audit"].append(r["audit"])
            for turn in r["repaired"]:
                state["sha"].update((("\n" if state["lines"] else "") + _line(turn)).encode())
                state["lines"] += 1
        if rows:
            yield out(rows)
    if state:
        yield out([row()])


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    pieces = repair.repair(damage(given))
    # What is whole is digested where it lies; pieces of others meet in order.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = pieces.where("alone").mapInArrow(_digest, _OUT)
    joined = pieces.where("NOT alone").repartition(parts, "conv_id").sortWithinPartitions("conv_id", "part", "chunk").mapInArrow(_digest, _OUT)
    done = whole.unionByName(joined).withColumnRenamed("conv_id", "id")
    names = given.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    all_of = names.join(done, names.conv_id.eqNullSafe(done.id), "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return all_of.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _COUNTS], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


#: Every way through a conversation's rows, with whole audit strings: of each state the cheapest and least is carried on.
SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS tab FROM range(256) t(i)
),
given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS place FROM conversations),
summed AS (
  SELECT g.*, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(place, ''), lambda x: CAST(ord(x) AS BIGINT))), lambda c, b: xor(c // 256, tab[xor(c, b) % 256 + 1])), 4294967295) % 20 AS harm
  FROM given g, crc
),
harmed AS (
  SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role, CASE WHEN harm = 1 THEN '' WHEN harm = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM summed, range(2) t(copy) WHERE harm <> 0 AND (copy = 0 OR harm = 3)
),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS k FROM harmed),
judged AS (
  SELECT *, left(role, 1) AS initial, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS again, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS before FROM placed
),
r AS (
  SELECT *, body = '' AS blank, body <> '' AND again AS duplicate, body <> '' AND NOT again AND right(body, 1) NOT IN ('.', '!', '?') AS truncated FROM judged
),
moves AS (
  SELECT * FROM (VALUES ('0', '0', ''), ('0', 'u', 'I'), ('0', 'a', 'II'), ('s', 's', ''), ('s', 'u', 'I'), ('s', 'a', 'II'), ('u', 'u', ''), ('u', 'a', 'I'), ('a', 'a', ''), ('a', 'u', 'I')) t(p, q, run)
),
edits AS (
  SELECT * FROM (VALUES ('0', 's', 'K'), ('0', 'u', 'K'), ('s', 'u', 'K'), ('a', 'u', 'K'), ('u', 'a', 'K'), ('0', 'u', 'R'), ('s', 'u', 'R'), ('a', 'u', 'R'), ('u', 'a', 'R'), ('0', '0', 'D'), ('s', 's', 'D'), ('u', 'u', 'D'), ('a', 'a', 'D')) t(p, q, edit)
),
macros AS (SELECT m.p, e.q, m.run || e.edit AS code, e.edit, length(m.run) * 3 + CASE e.edit WHEN 'R' THEN 3 WHEN 'D' THEN 4 ELSE 0 END AS cost FROM moves m JOIN edits e ON m.q = e.p),
ways AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS k, '0' AS state, {'cost': CAST(0 AS BIGINT), 'audit': '', 'said': ''} AS best FROM (SELECT DISTINCT conv_id FROM r)
  UNION ALL
  SELECT w.conv_id, w.k + 1, m.q, min({'cost': w.best.cost + m.cost + CASE WHEN r.truncated AND m.edit <> 'D' THEN 3 ELSE 0 END, 'audit': w.best.audit || m.code,
    'said': w.best.said || CASE WHEN length(m.code) > 1 THEN CASE WHEN m.p = 'u' THEN chr(10) || 'assistant:' WHEN length(m.code) = 3 THEN chr(10) || 'user:' || chr(10) || 'assistant:' ELSE chr(10) || 'user:' END ELSE '' END
      || CASE m.edit WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || r.role || ':' || r.text ELSE chr(10) || CASE m.q WHEN 'u' THEN 'user:' ELSE 'assistant:' END || r.text END})
  FROM ways w JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.k = w.k + 1 JOIN macros m ON m.p = w.state
  WHERE m.edit = 'D' OR (NOT r.blank AND NOT r.duplicate AND (m.edit = 'R' OR r.initial = m.q))
  GROUP BY w.conv_id, w.k, m.q
),
facts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate,
    count(*) FILTER (WHERE truncated) AS truncated, count(*) FILTER (WHERE before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id
),
ends AS (
  SELECT f.conv_id, min({'cost': w.best.cost + e.more, 'audit': w.best.audit || e.run, 'said': w.best.said || e.said}) AS best
  FROM facts f JOIN ways w ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND w.k = f.n
    JOIN (VALUES ('0', '', 0, ''), ('a', '', 0, ''), ('u', 'I', 3, chr(10) || 'assistant:'), ('s', 'II', 6, chr(10) || 'user:' || chr(10) || 'assistant:')) e(p, run, more, said) ON e.p = w.state
  GROUP BY f.conv_id
)
SELECT c.conv_id, CAST(coalesce(f.gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(f.blank, 0) AS BIGINT) AS blank, CAST(coalesce(f.duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(f.truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(f.illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(e.best.cost, 0) AS BIGINT) AS cost,
  coalesce(e.best.audit, '') AS audit, sha256(coalesce(substr(e.best.said, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""

QUERIES = {"op12_conversation_repair": op12_conversation_repair}
ORACLES = {"op12_conversation_repair": SQL}

"""Queries on the lifecycle of templates: the events of a user are the commands on a template."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lifecycle
from .forms import table

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return keep


#: Commands by the kind and value of an event, in the SQL that both engines read; most are updates and restored versions.
_COMMAND = (
    "CASE WHEN event_type = 'error' AND value < 2 THEN 'delete' WHEN event_type = 'error' THEN 'archive' WHEN event_type = 'view' AND value < 8 THEN 'create' WHEN event_type = 'view' THEN 'restore_version' "
    "WHEN event_type = 'click' THEN 'update' WHEN value < 10 THEN 'restore' ELSE 'create' END"
)
_VERSION = "CAST(floor(value) AS INT) % 6 + 1"


def _log(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("template_id"), F.col("event_id").alias("seq"), F.expr(_COMMAND).alias("command"), F.expr(_VERSION).alias("version"))


#: One command after the other, with the list of all snapshots at hand.
_REPLAY = f"""
l AS (SELECT user_id AS id, event_id AS seq, {_COMMAND} AS command, {_VERSION} AS version, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
h AS (
  SELECT id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, '' AS command, 0 AS version, 'absent' AS before, FALSE AS ok, 'absent' AS state, CAST(NULL AS BIGINT) AS snapshot, CAST(NULL AS BIGINT) AS source, CAST([] AS BIGINT[]) AS saved FROM (SELECT DISTINCT id FROM l)
  UNION ALL
  SELECT id, n, seq, command, version, before, ok, CASE WHEN NOT ok THEN before WHEN command = 'archive' THEN 'archived' WHEN command = 'delete' THEN 'absent' ELSE 'live' END,
    CASE WHEN ok AND command IN ('update', 'restore_version') THEN len(saved) + 1 END,
    CASE WHEN NOT ok THEN source WHEN command IN ('create', 'update') THEN seq WHEN command = 'restore_version' THEN saved[version] WHEN command = 'delete' THEN NULL ELSE source END,
    CASE WHEN ok AND command IN ('update', 'restore_version') THEN list_append(saved, source) WHEN ok AND command = 'delete' THEN CAST([] AS BIGINT[]) ELSE saved END
  FROM (
    SELECT h.id, l.n, l.seq, l.command, l.version, h.state AS before, h.source, h.saved,
      CASE l.command WHEN 'create' THEN h.state = 'absent' WHEN 'restore' THEN h.state = 'archived' WHEN 'restore_version' THEN h.state = 'live' AND l.version <= len(h.saved) ELSE h.state = 'live' END AS ok
    FROM h JOIN l ON l.id = h.id AND l.n = h.n + 1
  )
)
"""


@query(f"WITH RECURSIVE {_REPLAY} SELECT id AS template_id, seq, command, before, ok AS accepted, state, snapshot, source FROM h WHERE n > 0")
def template_log(spark, sf_dir):
    """Every command with the state before and after it, its snapshot and the content that then holds."""
    return lifecycle.replay(_log(spark, sf_dir)).select("template_id", "seq", "command", "before", "accepted", "state", "snapshot", "source")


@query(f"""WITH RECURSIVE {_REPLAY}, m AS (SELECT CAST(floor(max(event_id) / 2) AS BIGINT) AS half FROM events)
SELECT id AS template_id, arg_max(state, n) AS state, arg_max(coalesce(source, -1), n) AS source FROM h, m WHERE n > 0 AND seq <= half GROUP BY id HAVING arg_max(state, n) <> 'absent'""")
def templates_as_of(spark, sf_dir):
    """The templates that there were when half of all commands had been given."""
    half = table(spark, sf_dir, "events").agg(F.floor(F.max("event_id") / 2)).first()[0]
    return lifecycle.as_of(lifecycle.replay(_log(spark, sf_dir)), half if half is not None else -1).withColumn("source", F.coalesce("source", F.lit(-1)))


@query(f"""WITH RECURSIVE {_REPLAY},
last AS (SELECT id, arg_max(state, n) AS now, arg_max(saved, n) AS saved, max(seq) FILTER (WHERE ok AND command = 'delete') AS ends FROM h GROUP BY id)
SELECT h.id AS template_id, h.snapshot, h.seq AS saved_seq, saved_of.saved[h.snapshot] AS source FROM h JOIN last AS saved_of ON saved_of.id = h.id WHERE h.snapshot IS NOT NULL AND now = 'live' AND (ends IS NULL OR h.seq > ends)""")
def template_versions(spark, sf_dir):
    """The snapshots that live templates can go back to."""
    return lifecycle.versions(lifecycle.replay(_log(spark, sf_dir)))

"""Templates over time: a log of commands replayed to states, versions and contents.

A template is absent, live or archived. Commands that its state doesn't allow are refused and change nothing:
create needs an absent one, update, restore_version, archive and delete a live one, restore an archived one. An update or a
restored version keeps what held before as a snapshot; snapshots count from 1 and end with a deletion. Restoring version k makes
the content of snapshot k the present one again.

States follow from the commands before, so they are scanned in order; the scan is split. Each partition of the sorted log follows
its commands from all three states at once, one small array per row; what the partitions before have left decides which entry
holds. A template with a third of the log is dealt to many tasks.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .graph import stored

ABSENT, LIVE, ARCHIVED = range(3)
#: Command -> the state it needs and the state it leads to.
COMMANDS = {"create": (ABSENT, LIVE), "update": (LIVE, LIVE), "restore_version": (LIVE, LIVE), "archive": (LIVE, ARCHIVED), "restore": (ARCHIVED, LIVE), "delete": (LIVE, ABSENT)}
STATES = ("absent", "live", "archived")


def states_before(log: DataFrame, key: str, order: list[str], symbol: str, steps: dict[str, dict[int, int]], states: int) -> DataFrame:
    """``log`` with ``before``: the state of an automaton, started in 0, before each row of its key.

    ``steps`` maps a symbol to what it makes of states; symbols and states that it lacks change nothing. Rows that are equal in
    ``order`` come in any order, so it should be total.
    """
    spark = log.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = {s: [m.get(q, q) for q in range(states)] for s, m in steps.items()}
    row = T.StructType([T.StructField("row", log.schema), T.StructField("part", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("at", T.ArrayType(T.ByteType())), T.StructField("then", T.ArrayType(T.ByteType()))])

    def run(batches):
        part, n, last, now = TaskContext.get().partitionId(), 0, None, None
        same = list(range(states))
        for b in batches:
            keys, symbols = b.column(1).to_pylist(), b.column(2).to_pylist()
            at, then = [], []
            for k, s in zip(keys, symbols, strict=True):
                if n + len(at) == 0 or k != last:
                    now, last = same, k
                at.append(now)
                step = table.get(s)
                now = [step[q] for q in now] if step else now
                then.append(now)
            lists = lambda x: pa.array(x, pa.list_(pa.int8()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([part] * len(at), pa.int32()), pa.array(range(n, n + len(at)), pa.int64()), lists(at), lists(then)], ["row", "part", "n", "at", "then"])
            n += len(at)

    cols = [F.struct(*[F.col(f"`{c}`") for c in log.columns]).alias("row"), F.col(f"`{key}`").alias("k"), F.col(f"`{symbol}`").cast("string").alias("s")]
    ordered = log.repartitionByRange(parts, key, *order).sortWithinPartitions(key, *order).select(*cols)
    # Stored: the borders of ranges are sampled, and both uses must see the same ones.
    rows = stored(ordered.mapInArrow(run, row))
    own = F.col(f"row.`{key}`")
    pieces = rows.groupBy(own.alias("k"), "part").agg(F.max_by("then", "n").alias("then"))
    # A key has a piece in each partition at most.
    lists = pieces.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("part", "then"))).alias("ps"))
    entry = F.aggregate(F.slice("ps", F.lit(1), F.col("i")), F.lit(0).cast("tinyint"), lambda q, p: F.get(p["then"], q.cast("int")))
    starts = lists.select("k", "ps", F.posexplode("ps").alias("i", "p")).select("k", F.col("p.part").alias("part"), entry.alias("entry"))
    joined = rows.join(starts.withColumnsRenamed({"part": "x_part", "k": "x_k"}), own.eqNullSafe(F.col("x_k")) & (rows.part == F.col("x_part")))
    return joined.select("row.*", F.get("at", F.col("entry").cast("int")).cast("int").alias("before"))


def replay(log: DataFrame) -> DataFrame:
    """The log (template_id, seq, command, version) with ``before``, ``accepted``, ``state`` (after), ``snapshot`` (the number that a command
    saved what held before under) and ``source`` (seq of the create or update whose content holds after it; null if none does).

    ``seq`` is unique within a template. A restored version that doesn't exist, and unknown or null commands, are refused. Null
    template ids are one template.
    """
    columns = ["template_id", "seq", "command", "version"]
    steps = {c: {a: b} for c, (a, b) in COMMANDS.items()}
    rows = states_before(log.select(*columns), "template_id", ["seq"], "command", steps, len(STATES))
    needs = F.create_map(*[F.lit(x) for c, (a, _) in COMMANDS.items() for x in (c, a)])
    leads = F.create_map(*[F.lit(x) for c, (_, b) in COMMANDS.items() for x in (c, b)])
    rows = rows.withColumn("fits", F.coalesce(needs[F.col("command")] == F.col("before"), F.lit(False)))
    by, life = W.partitionBy("template_id").orderBy("seq"), W.partitionBy("template_id", "life").orderBy("seq")
    rows = rows.withColumn("life", F.sum((F.col("fits") & (F.col("command") == "create")).cast("int")).over(by))
    # A version can be restored if that many snapshots exist; refused restorations make none, so those that fit are counted in rounds
    # of one: a restoration of version k fits if at least k updates and restorations before it did.
    rows = _accepted(rows, life)
    rows = rows.withColumn("snapshot", F.when(F.col("accepted") & F.col("command").isin("update", "restore_version"), F.sum((F.col("accepted") & F.col("command").isin("update", "restore_version")).cast("int")).over(life)))
    sets = F.col("accepted") & F.col("command").isin("create", "update", "restore_version")
    rows = stored(rows.withColumn("prior", F.last(F.when(sets, F.col("seq")), ignorenulls=True).over(life.rowsBetween(W.unboundedPreceding, -1))))
    own = _sources(rows)
    # An archived template keeps its content, a deleted or absent one has none.
    out = rows.join(own.select(F.col("template_id").alias("o_id"), F.col("seq").alias("o_seq"), "source"), rows.template_id.eqNullSafe(F.col("o_id")) & (rows.seq == F.col("o_seq")), "left")
    state = F.when(F.col("accepted"), leads[F.col("command")]).otherwise(F.col("before"))
    held = F.last(F.when(sets, F.col("source")), ignorenulls=True).over(life)
    named = lambda x: F.get(F.array(*[F.lit(s) for s in STATES]), x)
    out = out.withColumn("after", state).withColumn("held", held)
    return out.select(*columns, named(F.col("before")).alias("before"), "accepted", named(F.col("after")).alias("state"), F.col("snapshot").cast("long").alias("snapshot"), F.when(F.col("after") != ABSENT, F.col("held")).alias("source"))


def _accepted(rows: DataFrame, life) -> DataFrame:
    """Add ``accepted``. The snapshots before a row are at least the updates before it and at most the updates and restorations that
    fit by state; restorations between the two are settled in rounds, each of which settles the first open one of every life.

    A restoration whose version is at most the updates so far is accepted, one above updates and restorations is refused, so
    rounds are needed only where versions name snapshots that restorations made.
    """
    change = F.col("fits") & (F.col("command") == "update")
    asked = F.col("fits") & (F.col("command") == "restore_version")
    back = life.rowsBetween(W.unboundedPreceding, -1)
    count = lambda c: F.coalesce(F.sum(c.cast("int")).over(back), F.lit(0))
    known = F.when(asked & (F.coalesce("version", F.lit(0)) < 1), F.lit(False)).when(~asked, F.col("fits"))
    rows = rows.withColumn("accepted", known)
    while True:
        sure = F.coalesce(F.col("accepted"), F.lit(False)) & (change | asked)
        open_ = asked & F.col("accepted").isNull()
        least, most = count(sure), count(sure | open_)
        rows = stored(rows.withColumn("accepted", F.when(open_ & (F.col("version") <= least), F.lit(True)).when(open_ & (F.col("version") > most), F.lit(False)).otherwise(F.col("accepted"))))
        if rows.filter("accepted IS NULL").limit(1).count() == 0:
            return rows


def _sources(rows: DataFrame) -> DataFrame:
    """(template_id, seq, source) of accepted creates, updates and restorations: where their content was first written.

    A restoration of snapshot k points to the change before the one that saved it; pointers are followed by doubling.
    """
    sets = rows.filter("accepted AND command IN ('create', 'update', 'restore_version')").select("template_id", "life", "seq", "command", "version", "snapshot", "prior")
    saved = sets.filter("snapshot IS NOT NULL").select(F.col("template_id").alias("s_id"), F.col("life").alias("s_life"), F.col("snapshot").alias("s_n"), F.col("prior").alias("target"))
    again = (F.col("command") == "restore_version") & sets.template_id.eqNullSafe(F.col("s_id")) & (F.col("life") == F.col("s_life")) & (F.col("version") == F.col("s_n"))
    at = stored(sets.join(saved, again, "left").select("template_id", "seq", F.coalesce("target", "seq").alias("source")))
    while True:
        nxt = at.select(F.col("template_id").alias("n_id"), F.col("seq").alias("n_seq"), F.col("source").alias("n_source"))
        moved = stored(at.join(nxt, at.template_id.eqNullSafe(F.col("n_id")) & (at.source == F.col("n_seq"))).select("template_id", "seq", F.col("n_source").alias("source"), (F.col("n_source") != F.col("source")).alias("moved")))
        at = moved.drop("moved")
        if moved.filter("moved").limit(1).count() == 0:
            return at


def as_of(history: DataFrame, seq: int) -> DataFrame:
    """(template_id, state, source) of ``replay`` as they were after all commands up to ``seq``; templates that were absent are left out."""
    last = history.filter(F.col("seq") <= seq).groupBy("template_id").agg(F.max_by(F.struct("state", "source"), "seq").alias("x"))
    return last.select("template_id", "x.state", "x.source").filter("state <> 'absent'")


def versions(history: DataFrame) -> DataFrame:
    """(template_id, snapshot, saved_seq, source): the snapshots that live templates have now, with the change that saved each and the
    content that it keeps."""
    by = W.partitionBy("template_id").orderBy("seq")
    h = history.withColumn("was", F.lag("source").over(by)).withColumn("ends", F.max(F.when(F.col("accepted") & (F.col("command") == "delete"), F.col("seq"))).over(W.partitionBy("template_id")))
    h = h.withColumn("now", F.last("state").over(by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    kept = (F.col("snapshot").isNotNull()) & (F.col("ends").isNull() | (F.col("seq") > F.col("ends"))) & (F.col("now") == "live")
    return h.filter(kept).select("template_id", "snapshot", F.col("seq").alias("saved_seq"), F.col("was").alias("source"))

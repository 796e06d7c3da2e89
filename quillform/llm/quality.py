"""Quality rules with adaptive thresholds (native: DataFrame functions only).

Each metric of a document, a count over an exposure, goes into a log-binned quantile sketch of its language and source. A
sketch is a table of (bin, count) rows: sketches of two inputs merge by adding counts, any quantile has a relative error
of at most ``ACCURACY``, and the number of bins depends on the range of values, not on the number of rows.

The thresholds are the sketch's own: with its quantiles q10, q50 and q90, a metric may reach from q10 - reach * (q50 -
q10) to q90 + reach * (q90 - q50), in units of the group, whatever they are. A document is rejected when its count lies
beyond what a document at the fence would show by chance: more than ``NOISE`` times the square root of the count, the
sampling error of a count. There is no cutoff on any metric and no switch by size of group: the quantiles of a group of n
documents are shrunk towards those of its language by weights n and ``PRIOR``, and those of a language towards the
corpus likewise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import ROW, materialize, packed, unpacked, words

#: Relative error of a quantile.
ACCURACY = 0.01
#: Documents that the quantiles of the language (or of the corpus) count for beside a group's own.
PRIOR = 100
#: How many times the distance from the median to an outer quantile the fence lies beyond that quantile; chosen, with
#: ``NOISE``, on the labelled documents of even id (README has the result on those of odd id).
REACH = 4.0
#: Sampling errors that a count must lie beyond the fence.
NOISE = 4.0
#: Lower outer quantile, median, upper outer quantile, in tenths.
TENTHS = (1, 5, 9)
#: Metric -> (count, exposure, has a lower fence).
METRICS = {
    "word_length": ("word_chars", "n_words", True),
    "symbol_share": ("n_symbols", "word_chars", False),
    "dup_line_share": ("n_dup_lines", "n_lines", False),
    "repeat_share": ("n_repeat_words", "n_words", False),
}
#: Groups up to which the table of fences is broadcast: a few hundred bytes each.
BROADCAST_GROUPS = 20_000

GAMMA = (1 + ACCURACY) / (1 - ACCURACY)
SYMBOLS = "#*$%&|<>"


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the struct ``q_features`` of base counts and ``q_words``' derived metrics to each row; null text has no words."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.translate(x, " \t\x0b\f\r", "") != "")
    out = docs.withColumn("q_words", words(F.col(text))).withColumn("q_lines", lines)
    window = F.transform(
        F.when(F.size("q_words") >= 3, F.slice("q_words", F.lit(1), F.size("q_words") - 2)).otherwise(F.array().cast("array<string>")),
        lambda w, i: F.xxhash64(w, F.get("q_words", i + 1), F.get("q_words", i + 2)),
    )
    out = out.withColumn("q_hash", window)
    # Only texts with a repeated window are sorted.
    repeats = F.size(F.array_distinct("q_hash")) < F.size("q_hash")
    pairs = F.when(repeats, F.sort_array(F.transform("q_hash", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    out = out.withColumn("q_sorted", pairs)
    at = F.transform("q_sorted", lambda e, j: F.when((F.get("q_sorted", j - 1)["h"] == e["h"]) | (F.get("q_sorted", j + 1)["h"] == e["h"]), e["i"]))
    out = out.withColumn("q_at", F.sort_array(F.filter(at, lambda x: x.isNotNull())))
    covered = F.aggregate(
        F.transform("q_at", lambda x, j: F.least(F.lit(3), F.coalesce(F.get("q_at", j + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x
    )
    return out.withColumn(
        "q_features",
        F.struct(
            F.size("q_words").cast("long").alias("n_words"),
            F.char_length(F.translate(t, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
            (F.char_length(t) - F.char_length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long").alias("n_dup_lines"),
            F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
            F.size("q_lines").cast("long").alias("n_lines"),
        ),
    ).drop("q_words", "q_lines", "q_hash", "q_sorted", "q_at")


def metrics(f: Column) -> dict[str, Column]:
    """The metrics that thresholds hold for; 0 where there is nothing to divide by."""
    return {name: F.when(f[of] > 0, f[count] / f[of]).otherwise(F.lit(0.0)) for name, (count, of, _) in METRICS.items()}


def base_failed(f: Column) -> Column:
    return (f["n_words"] < 50) | (100 * f["n_repeat_words"] > 50 * f["n_words"])


def sketch(rows: DataFrame) -> DataFrame:
    """(q_lang, q_source, metric, bin, n): the sketch of each group, from rows with ``q_features``."""
    entries = F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in metrics(F.col("q_features")).items()])
    return (
        rows.select("q_lang", "q_source", F.explode(entries).alias("e"))
        .select("q_lang", "q_source", "e.metric", F.when(F.col("e.value") > 0, F.ceil(F.log("e.value") / F.lit(math.log(GAMMA)))).cast("int").alias("bin"))
        .groupBy("q_lang", "q_source", "metric", "bin")
        .agg(F.count("*").alias("n"))
    )


def merge(bins: DataFrame, *keys: str) -> DataFrame:
    """Merge sketches up to ``keys`` by adding counts."""
    return bins.groupBy(*keys, "metric", "bin").agg(F.sum("n").alias("n"))


def marks(bins: DataFrame, *keys: str) -> DataFrame:
    """(keys, n_docs, <metric>_<tenth>...): quantiles from the sketches of ``keys``; null bins are zeros."""
    by = W.partitionBy(*keys, "metric")
    run = by.orderBy(F.col("bin").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    value = F.when(F.col("bin").isNull(), 0.0).otherwise(2 * F.pow(F.lit(GAMMA), F.col("bin")) / (GAMMA + 1))
    ranked = bins.select(*keys, "metric", value.alias("value"), F.sum("n").over(run).alias("upto"), F.sum("n").over(by).alias("n_docs"))
    out = [F.min(F.when((F.col("metric") == name) & (10 * F.col("upto") >= t * F.col("n_docs")), F.col("value"))).alias(f"{name}_{t}") for name in METRICS for t in TENTHS]
    return ranked.groupBy(*keys).agg(F.max("n_docs").alias("n_docs"), *out)


def _shrunk(n: Column, own: Column, above: Column) -> Column:
    return (n * own + PRIOR * above) / (n + PRIOR)


def fences(groups: DataFrame) -> DataFrame:
    """(f_lang, f_source, low_<metric>, high_<metric>) of each group, from the sketches of all groups."""
    own, lang, whole = marks(groups, "q_lang", "q_source"), marks(merge(groups, "q_lang"), "q_lang"), marks(merge(groups)).first()
    up = own.alias("o").join(lang.alias("l"), F.col("o.q_lang").eqNullSafe(F.col("l.q_lang")))
    out = []
    for name, (_, _, below) in METRICS.items():
        at = {}
        for t in TENTHS:
            corpus = F.lit(whole[f"{name}_{t}"] if whole else None).cast("double")  # one row of numbers
            at[t] = _shrunk(F.col("o.n_docs"), F.col(f"o.{name}_{t}"), _shrunk(F.col("l.n_docs"), F.col(f"l.{name}_{t}"), corpus))
        low, mid, high = (at[t] for t in TENTHS)
        if below:
            out.append((low - REACH * (mid - low)).alias(f"low_{name}"))
        out.append((high + REACH * (high - mid)).alias(f"high_{name}"))
    return up.select(F.col("o.q_lang").alias("f_lang"), F.col("o.q_source").alias("f_source"), *out)


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """All rows and columns of ``docs`` with ``q_features`` (struct), ``base_failed`` and ``kept``.

    Null text counts as empty and fails the base rule; null languages and sources are groups of their own; repeated
    rows are judged each; an empty table gives an empty result. Columns of ``docs`` keep their names and values, but for
    any that have one of the three names that are added: those are replaced.
    """
    rows = decide(with_features(packed(docs), f"{ROW}.{text}"), f"{ROW}.{lang}", f"{ROW}.{source}")
    old = [F.col(f"{ROW}.`{c}`") for c in docs.columns if c not in ("q_features", "base_failed", "kept")]
    return rows.select(*old, "q_features", "base_failed", "kept")


def decide(rows: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Sketch, fence and judge rows with ``q_features``; see ``judge``.

    Rows are stored once between the sketch and the verdict, with all their columns: to write them takes a tenth of the
    time that the counts take. Hand in counts alone where texts aren't needed.
    """
    mine = rows.drop("base_failed", "kept")
    rows = materialize(mine.withColumn("q_lang", F.col(lang)).withColumn("q_source", F.col(source)), "quality-features")
    limits = materialize(fences(materialize(sketch(rows), "quality-sketch")), "quality-fences")
    if limits.count() <= BROADCAST_GROUPS:
        limits = F.broadcast(limits)
    # A larger table of fences meets a hot group in a join that the adaptive planner splits.
    joined = rows.join(limits, rows["q_lang"].eqNullSafe(limits["f_lang"]) & rows["q_source"].eqNullSafe(limits["f_source"]), "left")
    f, inside = F.col("q_features"), F.lit(True)
    for name, (count, of, below) in METRICS.items():
        error = NOISE * F.sqrt(f[count].cast("double"))
        inside = inside & (f[count] - error <= F.col(f"high_{name}") * f[of])
        if below:
            inside = inside & (f[count] + error >= F.col(f"low_{name}") * f[of])
    failed = base_failed(f)
    return joined.select(*[F.col(f"`{c}`") for c in mine.columns], failed.alias("base_failed"), (~failed & F.coalesce(inside, F.lit(False))).alias("kept"))


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``.

    Null and empty texts fail the base rule and go; repeated rows are judged alike; an empty table gives an empty result.
    """
    rows = with_features(packed(docs), f"{ROW}.text")
    return unpacked(decide(rows, f"{ROW}.lang", f"{ROW}.source").filter("kept"))

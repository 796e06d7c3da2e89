"""Reusing saved answers, and finding equal or similar templates."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import identity_text, name_key
from .graph import components

#: Common identities and the words in a label or id that name them.
IDENTITIES = (
    ("cnpj", (" cnpj ",)), ("cpf", (" cpf ",)), ("email", (" email ", " e mail ")), ("phone", (" telefone ", " celular ", " whatsapp ", " phone ")), ("cep", (" cep ", " codigo postal ")),
    ("registration", (" matricula ", " registro funcional ")), ("full_name", (" nome completo ", " nome do servidor ", " nome do solicitante ")), ("legal_name", (" razao social ", " legal name ")), ("trade_name", (" nome fantasia ", " trade name ")),
)
#: Types whose answers are texts that can stand for each other.
TEXT_LIKE = ("text", "email", "phone", "cpf", "cnpj", "cep", "currency", "integer", "percentage")
#: Words that name no template, and endings that mark a copy or a version.
STOP_WORDS = ("a", "an", "and", "da", "das", "de", "do", "document", "documento", "dos", "e", "for", "form", "formulario", "modelo", "of", "o", "os", "para", "template", "the")
COPY_WORDS = ("copy", "copia", "copias", "duplicate", "duplicado", "duplicada", "new", "novo", "nova")
VERSION_WORDS = ("version", "versao", "revision", "revisao", "rev")
SIMILAR = 0.84


def semantic_identity(label: Column, field_id: Column) -> Column:
    context = F.concat(F.lit(" "), identity_text(label), F.lit(" "), identity_text(field_id), F.lit(" "))

    def named(c: Column) -> Column:
        out = F.lit("")
        for name, needles in reversed(IDENTITIES):
            out = F.when(F.greatest(*[F.contains(c, F.lit(n)) for n in needles]) if len(needles) > 1 else F.contains(c, F.lit(needles[0])), name).otherwise(out)
        return out

    # Bound as a lambda variable: every branch would work out the context anew.
    return F.get(F.transform(F.array(context), named), F.lit(0))


def compatible(a: Column, b: Column) -> Column:
    return (a == b) | (a.isin(*TEXT_LIKE) & b.isin(*TEXT_LIKE))


def match_score(s: str, t: str) -> Column:
    """How surely two described fields (columns label_norm, type, section_norm, semantic, context of aliases s and t) are the same: 0..100.

    ``context`` is an identity that was worked out from where a field stands, or an empty text.
    """
    c = lambda side, name: F.col(f"{side}.{name}")
    fits = compatible(c(s, "type"), c(t, "type"))
    same_section = (c(s, "section_norm") != "") & (c(s, "section_norm") == c(t, "section_norm"))
    by_label = F.when(fits, 96).otherwise(82) + F.when(c(s, "type") == c(t, "type"), 2).otherwise(0) + F.when(same_section, 2).otherwise(0)
    by_meaning = F.lit(90) + F.when(same_section, 3).otherwise(0)
    by_context = (c(s, "context") != "") & (c(s, "context") == c(t, "context")) & fits
    return F.when(by_context, 99).when((c(s, "label_norm") != "") & (c(s, "label_norm") == c(t, "label_norm")), F.least(by_label, F.lit(100))).when((c(s, "semantic") != "") & (c(s, "semantic") == c(t, "semantic")) & fits, by_meaning).otherwise(0)


def _marks(least: int) -> Column:
    """ARRAY<STRUCT<score, a, b, c>>: all that a described field can share with another, each with the ``match_score`` that it gives.

    Of several shared marks the highest score holds, but for an equal context, which ``match_score`` puts first.
    """
    kind = F.when(F.col("type").isin(*TEXT_LIKE), F.array(F.lit("text-like"))).otherwise(F.array(F.lit("type"), F.col("type")))
    fits, same = F.array_join(kind, ":"), F.concat(F.lit(":"), F.col("type"))
    label, place, meaning, section = (F.nullif(F.col(c), F.lit("")) for c in ("label_norm", "context", "semantic", "section_norm"))
    levels = (
        (100, label, same, section), (99, place, F.when(F.col("type").isNotNull(), fits)), (98, label, same), (98, label, F.when(F.col("type").isNotNull(), fits), section), (96, label, F.when(F.col("type").isNotNull(), fits)),
        (93, meaning, F.when(F.col("type").isNotNull(), fits), section), (90, meaning, F.when(F.col("type").isNotNull(), fits)), (84, label, F.lit("any"), section), (82, label, F.lit("any")),
    )
    made = [F.when(F.forall(F.array(*by), lambda x: x.isNotNull()), F.struct(F.lit(score).alias("score"), *[x.alias(n) for x, n in zip((*by, F.lit("")), "abc")])) for score, *by in levels if score >= least]
    return F.filter(F.array(*made), lambda m: m.isNotNull())


def identity_matches(source: DataFrame, target: DataFrame, key: str, least: int = 90) -> DataFrame:
    """(key, target_id, source_id, score): unambiguous pairs of described fields, by ``match_score``.

    A target whose two best sources tie gets none; a source that several targets want goes to the single strongest.
    Pairs are no rows: targets of equal descriptions are one, and meet the first and last source of each mark that they
    share; where these differ, sources tie. Without a column ``context`` no field has one.
    """
    s, t = (df if "context" in df.columns else df.withColumn("context", F.lit("")) for df in (source, target))
    said = ("label_norm", "type", "section_norm", "semantic", "context")
    ends = lambda x: (F.min(x).alias("low"), F.max(x).alias("high"))
    whole = F.coalesce("context", F.lit(""))
    # Equal contexts score 99 where all else is equal too: such sources don't count among those of 100.
    s = s.select(key, F.struct(F.col("field_id").alias("id")).alias("s"), whole.alias("place"), F.explode(_marks(least)).alias("mark"))
    s = s.groupBy(key, "mark", F.when(F.col("mark.score") == 100, F.col("place")).otherwise("").alias("s_place")).agg(*ends("s"))
    t = t.groupBy(key, "field_id").agg(F.array_sort(F.collect_set(F.struct(*said))).alias("said")).withColumn("id", F.struct(F.col("field_id").alias("id")))
    t = t.groupBy(key, "said").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    each = t.select(key, "said", "first", "last", F.explode("said").alias("one")).select(key, F.struct("said", "first", "last").alias("t"), "one.*")
    each = each.select(key, "t", whole.alias("t_place"), F.explode(_marks(least)).alias("mark"))
    met = each.join(s, [key, "mark"]).filter("s_place = '' OR s_place <> t_place").select(key, "t", F.col("mark.score").alias("score"), "low", "high")

    def single(df: DataFrame, side: str) -> DataFrame:
        best = df.groupBy(key, side, "score").agg(F.min("low").alias("low"), F.max("high").alias("high")).groupBy(key, side).agg(F.max_by(F.struct("score", "low", "high"), "score").alias("b"))
        return best.filter("b.low = b.high").select(key, side, "b.score", F.col("b.low").alias("other"))

    wanted = single(met, "t").select(key, F.col("other").alias("s"), "score", F.col("t.first").alias("low"), F.col("t.last").alias("high"))
    return single(wanted, "s").select(key, F.col("other.id").alias("target_id"), F.col("s.id").alias("source_id"), "score")


def resolve(target: DataFrame, stages: list[DataFrame], key: str) -> DataFrame:
    """Each (key, target_id) takes the first stage that has it; a stage is (key, target_id, value)."""
    ranked = None
    for i, s in enumerate(stages):
        one = s.select(key, "target_id", "value", F.lit(i + 1).alias("stage"))
        ranked = one if ranked is None else ranked.unionByName(one)
    best = ranked.groupBy(key, "target_id").agg(F.min(F.struct("stage", "value")).alias("b"))
    return target.join(best, [key, "target_id"], "left").select(*target.columns, F.col("b.value").alias("value"), F.col("b.stage").alias("stage"))


def duplicates(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(fingerprint, n, first): contents that occur more than once; only digests are shuffled."""
    return df.select(F.col(key), F.sha2(text, 256).alias("fingerprint")).groupBy("fingerprint").agg(F.count("*").alias("n"), F.min(key).alias("first")).filter("n > 1")


def template_key(x: Column) -> Column:
    """A name's words without stop words, and without copy and version marks at the end."""
    kept = F.array_join(F.filter(F.split(name_key(x), " "), lambda t: (t != "") & ~t.isin(*STOP_WORDS)), " ")
    ending = rf"(?:(?:^| )(?:{'|'.join(COPY_WORDS)}|v?[0-9]+|(?:{'|'.join(VERSION_WORDS)}) [0-9]+))+$"
    return F.regexp_replace(kept, ending, "")


def _segments(m: int) -> list[tuple[int, int]]:
    """(begin, end) of the segments of a key of m letters: one more than the insertions and deletions that a ratio of .92 with a key no shorter leaves."""
    k = min(m, 8 * m // 46 + 1)
    return [(i * m // k, (i + 1) * m // k) for i in range(k)]


def _own(key: str) -> list[str]:
    return [f"{len(key)}:{i}:{key[a:z]}" for i, (a, z) in enumerate(_segments(len(key)))]


def _probes(key: str) -> list[str]:
    """Where a key meets the segments of keys no longer than it: at all shifts that the insertions and deletions of a ratio of .92 allow."""
    n, out = len(key), set()
    for m in range(-(-46 * n // 54), n + 1):
        edits = 8 * (m + n) // 100
        for i, (a, z) in enumerate(_segments(m)):
            for shift in range(-((edits - n + m) // 2), (edits + n - m) // 2 + 1):
                if a + shift >= 0 and z + shift <= n:
                    out.add(f"{m}:{i}:{key[a + shift : z + shift]}")
    return sorted(out)


def _without_common_word(n: DataFrame) -> DataFrame:
    """Pairs (aliases a, b) of rows of ``n`` that hold all whose keys have a ratio of .92 or more.

    Such keys are at most 8 % of their letters in insertions and deletions apart, each of which touches one segment of the
    shorter key: one segment at least is whole in the longer.
    """

    @F.pandas_udf("array<string>")
    def own(keys: pd.Series) -> pd.Series:
        return keys.map(_own)

    @F.pandas_udf("array<string>")
    def probes(keys: pd.Series) -> pd.Series:
        return keys.map(_probes)

    keyed = n.filter(F.length("compact") >= 5)
    x, y = keyed.select(F.col("name").alias("x"), F.explode(own("key")).alias("mark")), keyed.select(F.col("name").alias("y"), F.explode(probes("key")).alias("mark"))
    met = x.join(y, "mark").filter("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    return met.join(n.alias("a"), F.col("x") == F.col("a.name")).join(n.alias("b"), F.col("y") == F.col("b.name"))


def similar_names(names: DataFrame, name: str = "name", least: float = SIMILAR) -> DataFrame:
    """(a, b, score): pairs of different distinct names whose similarity reaches ``least``, a < b.

    1 for equal normalised names, .99 for equal keys, .98 for keys equal without blanks; else the best of the character
    ratio of the keys, .98 of that without blanks, the share of common words, and .91 where one key's words (two at least)
    are all in the other. Keys under five letters match nothing else, keys with one common word of several need a ratio of
    .86, keys without a common word one of .92. Pairs are found through common words, equal compact keys and segments that
    any two keys of ratio .92 share, not among all names; none is missed.
    """
    n = names.select(F.col(name).alias("name")).distinct().withColumn("norm", name_key(F.col("name"))).withColumn("key", template_key(F.col("name")))
    n = n.filter("norm <> ''").withColumn("compact", F.replace("key", F.lit(" "), F.lit(""))).withColumn("words", F.array_distinct(F.filter(F.split("key", " "), lambda t: t != "")))
    marks = F.concat(F.transform("words", lambda w: F.concat(F.lit("w:"), w)), F.array(F.concat(F.lit("n:"), "norm"), F.concat(F.lit("c:"), "compact")))
    met = n.withColumn("mark", F.explode(marks))
    a, b = met.alias("a"), met.alias("b")
    pairs = a.join(b, (F.col("a.mark") == F.col("b.mark")) & (F.col("a.name") < F.col("b.name")))
    cols = [F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in ("name", "norm", "key", "compact", "words")]
    p = pairs.select(*cols).union(_without_common_word(n).select(*cols)).dropDuplicates(["name_a", "name_b"])
    common, fewest = F.size(F.array_intersect("words_a", "words_b")), F.least(F.size("words_a"), F.size("words_b"))
    p = p.withColumn("common", common).withColumn("fewest", fewest).withColumn("jaccard", F.try_divide(common, F.size(F.array_union("words_a", "words_b"))))
    # Ratios of strings of lengths m and n are at most 2 min / (m + n): only pairs that can reach the threshold are compared in Python.
    room = 2.0 * F.least(F.length("compact_a"), F.length("compact_b")) >= least * (F.length("compact_a") + F.length("compact_b")) - 2
    p = p.filter((F.col("norm_a") == F.col("norm_b")) | room | ((common == fewest) & (fewest >= 2)) | (F.col("jaccard") >= least))

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, q, r).ratio() for q, r in zip(x, y, strict=True)], dtype="float64")

    p = p.withColumn("whole", ratio("key_a", "key_b")).withColumn("tight", ratio("compact_a", "compact_b"))
    best = F.greatest("whole", F.col("tight") * 0.98, "jaccard", F.when((common == fewest) & (fewest >= 2), 0.91).otherwise(0.0))
    weak = ((common == 0) & (F.col("whole") < 0.92)) | ((common == 1) & (F.size("words_a") > 1) & (F.size("words_b") > 1) & (F.col("whole") < 0.86) & (F.col("jaccard") < 0.75))
    short = F.least(F.length("compact_a"), F.length("compact_b")) < 5
    no_key = (F.col("key_a") == "") | (F.col("key_b") == "")
    score = F.when(F.col("norm_a") == F.col("norm_b"), 1.0).when(no_key, 0.0).when(F.col("key_a") == F.col("key_b"), 0.99).when(F.col("compact_a") == F.col("compact_b"), 0.98).when(short | weak, 0.0).otherwise(F.round(best, 4))
    return p.withColumn("score", score).filter(F.col("score") >= least).select(F.col("name_a").alias("a"), F.col("name_b").alias("b"), "score")


def similar_groups(templates: DataFrame, key: str, name: str = "name", least: float = SIMILAR) -> DataFrame:
    """(key, name, grp): templates in a connected group of two or more by similar names; ``grp`` is the group's smallest key.

    Templates of the same name are linked too; names without letters or digits are like nothing, not even themselves.
    """
    t = templates.select(F.col(key).alias("key"), F.col(name).alias("name")).filter(name_key(F.col("name")) != "")
    links = similar_names(t, "name", least).select(F.col("a").alias("u"), F.col("b").alias("v"))
    placed = t.join(components(t.select(F.col("name").alias("node")).distinct(), links), F.col("name") == F.col("node"))
    groups = placed.groupBy(F.col("grp").alias("g")).agg(F.min("key").alias("grp"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return placed.select("key", "name", F.col("grp").alias("g")).join(groups, "g").select(F.col("key").alias(key), "name", "grp")


def suffixes(key: Column) -> Column:
    """The last one to four words of a key, normalised."""
    w = F.filter(F.split(identity_text(key), " "), lambda t: t != "")
    n = F.size(w)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.least(n, F.lit(4))), lambda k: F.array_join(F.slice(w, n - k + 1, k), " "))).otherwise(F.expr("cast(array() as array<string>)"))


#: Labels too general to match by, and single words that are not.
GENERIC = ("campo", "data", "descricao", "item", "nome", "observacao", "opcao", "quantidade", "responsavel", "tipo", "unidade", "valor")
STRONG = ("cep", "cnpj", "cpf", "email", "e mail", "matricula", "telefone", "celular", "whatsapp")


def safe_label(label: Column) -> Column:
    """Whether a normalised label is specific enough to match a saved answer by."""
    return ~label.isin(*GENERIC, "") & (label.isin(*STRONG) | ((F.size(F.split(label, " ")) >= 2) & (F.length(label) >= 7)))


def suffix_matches(answers: DataFrame, fields: DataFrame, key: str) -> DataFrame:
    """(key, field_id, answer_key): fields whose label is the ending of exactly one saved key that no field before them took.

    ``answers`` has ``answer_key``, ``fields`` has field_id, label and pos. Labels must be safe and stand once. A key that
    a field has taken is free for none after it, in the order of ``pos``. Labels that can compete for a key end in the
    same word, so each last word of a form is settled by itself.
    """
    f = fields.withColumn("norm", identity_text(F.col("label"))).withColumn("same", F.count("*").over(W.partitionBy(key, "norm"))).filter(safe_label(F.col("norm")) & (F.col("same") == 1))
    s = answers.filter(~F.startswith("answer_key", F.lit("@"))).select(key, "answer_key", F.explode(suffixes(F.col("answer_key"))).alias("norm")).distinct()
    pairs = f.join(s, [key, "norm"]).select(key, "field_id", "pos", "answer_key", F.element_at(F.split("norm", " "), -1).alias("last"))
    schema = pairs.select(key, "field_id", "answer_key").schema

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for (_, field_id), keys in rows.sort_values(["pos", "answer_key"]).groupby(["pos", "field_id"], sort=True)["answer_key"]:
            free = [k for k in keys if k not in used]
            if len(free) == 1:
                used.add(free[0])
                out.append((rows[key].iloc[0], field_id, free[0]))
        return pd.DataFrame(out, columns=[key, "field_id", "answer_key"])

    # Keys that one field wants, of fields that want one key, need no settling.
    alone = pairs.withColumn("wants", F.count("*").over(W.partitionBy(key, "field_id"))).withColumn("wanted", F.count("*").over(W.partitionBy(key, "answer_key")))
    clear = (F.col("wants") == 1) & (F.col("wanted") == 1)
    settled = alone.filter(~clear).drop("wants", "wanted").groupBy(key, "last").applyInPandas(settle, schema)
    return alone.filter(clear).select(key, "field_id", "answer_key").union(settled)


def prune(favorites: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Favorites that still exist."""
    return favorites.join(existing.select(key).distinct(), key, "left_semi")

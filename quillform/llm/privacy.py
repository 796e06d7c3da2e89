"""PII spans and information-theoretic sanitisation (native: DataFrame functions only).

Emails, IP addresses, card and phone numbers are found by pattern and check. They are the protected entities. How much
a term (a word with a letter) reveals of an entity is estimated from co-occurrence in whole documents. With document
frequencies df over D documents, a reader who sees t guesses e rightly with probability

    P(e | t) = (df(e, t) + PRIOR * P(e)) / (df(t) + PRIOR),        P(e) = df(e) / D,

which is shrunk towards P(e) as if ``PRIOR`` documents of the corpus at large had been seen with t as well. Of the
entity's information IC(e) = -log2 P(e), the term gives PMI(e; t) = log2(P(e | t) / P(e)) bits; its disclosure is their
ratio. Terms are sanitised wherever they occur if they disclose ``THRESHOLD`` of an entity or more and leave ``LEFT``
bits of doubt at most (with the second bound the rule means the same at every size of corpus): removed if they leave
``SURE`` bits or less, generalised to the entity's kind otherwise.

Every entity is assessed. The shrunk estimate alone decides how much evidence it takes: a term that was seen with its
entity in one document leaves log2(1 + PRIOR) = 1.58 bits, so entities and pairs with one document are set aside before
terms are counted, without changing the result.

Counts are added up by term and by pair in each task before anything is exchanged, and joined one row a term.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, materialize, packed, running, sum_before, unpacked, with_blocks

#: Share of an entity's information that a term may give away, exclusively.
THRESHOLD = 0.8
#: Bits of doubt about the entity that a disclosing term leaves at most, and up to which it is removed.
LEFT, SURE = 1.0, 0.5
#: Documents of the corpus at large that count as seen with each term.
PRIOR = 2
#: Rows with entities, pairs and terms up to which their table is broadcast (a few dozen bytes each).
BROADCAST_ROWS = 200_000

#: Kind -> pattern. Possessive, and anchored where a run begins or the last match ended, so that matching is linear.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_IP = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$"
_SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string,value:string>>"
_ALNUM = r"\p{L}\p{M}\p{N}"
#: A run of letters, marks and digits, joined by hyphens, apostrophes or underscores inside.
TERM = rf"[{_ALNUM}]++(?:[_'-]++[{_ALNUM}]++)*+"
#: What stands between terms: no letters or digits, and not joiners alone.
_GAP = rf"(?<![_'-])[_'-]*+[^{_ALNUM}_'-][^{_ALNUM}]*+"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    d = F.split(F.reverse(_digits(x)), "")

    def add(total, at):
        v = F.get(d, at).cast("int") * (1 + at % 2)
        return total + v - F.when(v > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), F.char_length(_digits(x)) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    n = F.char_length(_digits(x))
    if kind == "ip":
        return x.rlike(_IP)
    if kind == "card":
        return F.when(n.between(14, 19), _luhn(x)).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def with_entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``e_spans``: the base matches by start, then kind."""
    out, arrays, rest = docs, [], [F.col(f"`{c}`") for c in docs.columns]
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        t = F.coalesce(F.col(text), F.lit(""))
        if _NEEDS[kind]:
            t = F.when(F.contains(t, F.lit(_NEEDS[kind])), t).otherwise(F.lit(""))
        out = out.withColumn("e_found", F.regexp_extract_all(t, F.lit(pattern), F.lit(0)))
        out = out.withColumn("e_between", F.when(F.size("e_found") > 0, F.split(F.col(text), pattern, -1)))
        out = out.withColumn("e_lens", F.zip_with("e_between", "e_found", lambda a, b: F.char_length(a) + F.coalesce(F.char_length(b), F.lit(0))))
        out = running(out, "e_lens", "e_at")
        start = lambda i: F.get("e_at", i) + F.char_length(F.get("e_between", i))
        value = lambda x: F.lower(x) if kind == "email" else x if kind == "ip" else _digits(x)  # noqa: B023, E731
        spans = F.transform(
            "e_found",
            lambda x, i: F.when(
                _valid(kind, x),  # noqa: B023
                F.struct(
                    start(i).alias("start"), F.lit(rank).alias("rank"), (start(i) + F.char_length(x)).alias("end"), F.lit(kind).alias("kind"), value(x).alias("value"),  # noqa: B023
                ),
            ),
        )
        name = f"e_{kind}"
        out = out.withColumn(name, F.coalesce(F.filter(F.when(F.size("e_found") > 0, spans), lambda x: x.isNotNull()), F.expr(f"cast(array() as {_SPAN})")))
        arrays.append(name)
        out = out.select(*rest, *arrays)
    return out.select(*rest, F.array_sort(F.concat(*arrays)).alias("e_spans"))


def _is_term(t: Column) -> Column:
    return (F.char_length(t) >= 3) & t.rlike(r"\p{L}")


def _tokens(text: Column) -> Column:
    """Distinct lower-cased terms of a text, with short ones, numbers and an empty one among them."""
    return F.array_distinct(F.split(F.lower(F.concat(F.lit(" "), text, F.lit(" "))), _GAP, -1))


def terms(text: Column) -> Column:
    """Distinct terms of a text, lower-cased: three characters or more, a letter among them."""
    return F.filter(_tokens(text), _is_term)


def _exploded(docs: DataFrame, text: str, *keep: Column) -> DataFrame:
    """A row for each document and term."""
    # Outer explode: for a plain one the optimizer infers a filter that splits every text twice.
    return docs.select(*keep, F.explode_outer(_tokens(F.col(text))).alias("term")).filter(_is_term(F.col("term")))


def _fit(df: DataFrame) -> DataFrame:
    """Broadcast a stored table of a checked size; larger ones are joined by shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def disclosing(rows: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, kind, disclosure, left): terms beyond the thresholds and the bits that they leave.

    ``rows`` has e_spans and d_terms (terms of rows with entities) for each row of ``docs``, whose texts aren't null. Where a term discloses
    several entities, that which it discloses most counts, and of equal ones the kind that is last by name.
    """
    total = float(rows.count())
    held = rows.filter(F.size("e_spans") > 0).withColumn("d_e", F.array_distinct(F.transform("e_spans", lambda s: F.struct(s["kind"].alias("kind"), s["value"].alias("value")))))
    owners = held.select(F.explode("d_e").alias("e")).groupBy("e").agg(F.count("*").alias("df_e")).filter("df_e > 1")
    owners = materialize(owners, "privacy-owners")
    shared = held.select(F.explode("d_e").alias("e"), "d_terms").join(_fit(owners), "e")
    pairs = shared.select("e", "df_e", F.explode("d_terms").alias("term")).groupBy("e", "df_e", "term").agg(F.count("*").alias("df_et")).filter("df_et > 1")
    pairs = materialize(pairs, "privacy-pairs")
    # Counted under 96 bits of two hashes: fixed-width keys take half the time of texts.
    hashes = [F.xxhash64("term").alias("t_long"), F.hash("term").alias("t_short")]
    seen = _exploded(docs, text).select(*hashes).groupBy("t_long", "t_short").agg(F.count("*").alias("df_t")).filter("df_t > 1")
    own = F.col("df_e") / F.lit(total)
    likely = (F.col("df_et") + PRIOR * own) / (F.col("df_t") + F.lit(PRIOR))
    share = F.when(F.col("df_e") < total, F.log2(likely / own) / -F.log2(own))
    found = pairs.select("*", *hashes).join(seen, ["t_long", "t_short"]).select("term", F.col("e.kind").alias("kind"), share.alias("disclosure"), (-F.log2(likely)).alias("left"))
    found = found.filter((F.col("disclosure") >= THRESHOLD) & (F.col("left") <= LEFT))
    best = found.groupBy("term").agg(F.max(F.struct("disclosure", "kind", "left")).alias("b"))
    return materialize(best.select("term", "b.kind", F.round("b.disclosure", 9).alias("disclosure"), F.round("b.left", 9).alias("left")), "privacy-terms")


def entities(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(d_doc, d_hash, e_spans, d_terms) for every row; the last is null without entities."""
    mine = docs.select(F.col(doc_id).alias("d_doc"), F.coalesce(F.col(text), F.lit("")).alias("d_text"))
    return with_entities(mine, "d_text").select("d_doc", F.xxhash64("d_text").alias("d_hash"), "e_spans", F.when(F.size("e_spans") > 0, terms(F.col("d_text"))).alias("d_terms"))


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(d_doc, d_hash, e_spans, t_spans) for every row of ``docs``: base spans, and spans of disclosing terms.

    ``d_hash`` is XXH64 of the text; equal rows have equal results and count once each as documents. Term spans have kind
    ``term``, the entity's kind as value, the disclosure and the bits left. Null and empty texts have no spans; null ids
    are ids like any other; an empty table gives an empty result.
    """
    mine = docs.select(F.col(doc_id).alias("d_doc"), F.coalesce(F.col(text), F.lit("")).alias("d_text"))
    key = F.xxhash64("d_text")
    rows = materialize(entities(docs, doc_id, text), "privacy-entities")
    told = disclosing(rows, mine, "d_text")
    rows = rows.drop("d_terms")
    kind = "array<struct<start:bigint,end:bigint,kind:string,value:string,disclosure:double,left:double>>"
    none = F.expr(f"cast(array() as {kind})")
    if told.isEmpty():
        return rows.select("d_doc", "d_hash", "e_spans", none.alias("t_spans"))
    held = _exploded(mine, "d_text", F.col("d_doc"), key.alias("d_hash")).join(_fit(told), "term")
    held = materialize(held.groupBy("d_doc", "d_hash").agg(F.map_from_entries(F.collect_set(F.struct("term", F.struct("kind", "disclosure", "left")))).alias("told")), "privacy-held")
    texts = mine.withColumn("d_hash", key).alias("a").join(_fit(held).alias("b"), F.col("a.d_doc").eqNullSafe(F.col("b.d_doc")) & (F.col("a.d_hash") == F.col("b.d_hash")))
    texts = texts.select("a.d_doc", "a.d_hash", "a.d_text", "b.told")
    out = texts.withColumn("w_found", F.regexp_extract_all("d_text", F.lit(TERM), F.lit(0))).withColumn("w_between", F.split("d_text", TERM, -1))
    out = with_blocks(out.withColumn("w_lens", F.zip_with("w_between", "w_found", lambda a, b: F.char_length(a) + F.coalesce(F.char_length(b), F.lit(0)))), "w_lens")
    # Positions and kinds only of the terms that are told.
    out = out.withColumn("w_terms", F.map_keys("told")).withColumn("w_low", F.transform("w_found", F.lower))
    out = out.withColumn("w_hits", F.filter(F.transform("w_low", lambda x, i: F.when(F.array_contains("w_terms", x), i)), lambda i: i.isNotNull()))
    begin = lambda i: sum_before("w_lens", i) + F.char_length(F.get("w_between", i))
    said = lambda i: F.element_at("told", F.get("w_low", i))
    spans = F.transform(
        "w_hits",
        lambda i: F.struct(
            begin(i).alias("start"), (begin(i) + F.char_length(F.get("w_found", i))).alias("end"), F.lit("term").alias("kind"),
            said(i)["kind"].alias("value"), said(i)["disclosure"].alias("disclosure"), said(i)["left"].alias("left"),
        ),
    )
    # Where the texts are; then equal rows count once.
    spans = materialize(out.select("d_doc", "d_hash", spans.alias("t_spans")), "privacy-spans").dropDuplicates(["d_doc", "d_hash"])
    both = rows.alias("a").join(_fit(spans).alias("b"), F.col("a.d_doc").eqNullSafe(F.col("b.d_doc")) & (F.col("a.d_hash") == F.col("b.d_hash")), "left")
    # A term inside an entity is gone with it.
    clear = F.filter(F.coalesce("b.t_spans", none), lambda t: ~F.exists("a.e_spans", lambda e: (t["start"] < e["end"]) & (e["start"] < t["end"])))
    return both.select("a.d_doc", "a.d_hash", "a.e_spans", clear.alias("t_spans"))


def sanitise(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns of ``docs``: entities replaced by their kind, disclosing terms removed or generalised.

    Null texts stay null and texts without spans stay as they are; repeated rows are changed alike, each; null ids are
    ids like any other; columns keep their names whatever they are; an empty table gives an empty result.
    """
    found = find(docs, doc_id, text).dropDuplicates(["d_doc", "d_hash"])
    rows = packed(docs)
    said = F.col(f"{ROW}.{text}")
    rows = rows.withColumn("s_hash", F.xxhash64(F.coalesce(said, F.lit(""))))
    both = rows.join(found, F.col(f"{ROW}.{doc_id}").eqNullSafe(F.col("d_doc")) & (F.col("s_hash") == F.col("d_hash")), "left")
    entity = F.transform("e_spans", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), F.concat(F.lit("["), F.upper(e["kind"]), F.lit("]")).alias("by")))
    term = F.transform("t_spans", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.when(t["left"] <= SURE, F.lit("")).otherwise(F.concat(F.lit("[related to "), t["value"], F.lit("]"))).alias("by")))
    both = both.withColumn("s_all", F.array_sort(F.concat(entity, term)))
    # Overlapping entities: what an earlier span has replaced stays replaced.
    step = F.aggregate(
        "s_all",
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("end")),
        lambda a, s: F.when(s["start"] < a["end"], F.struct(a["out"].alias("out"), F.greatest(a["end"], s["end"]).alias("end"))).otherwise(
            F.struct(F.concat(a["out"], F.substring(said, a["end"].cast("int") + 1, (s["start"] - a["end"]).cast("int")), s["by"]).alias("out"), s["end"].alias("end"))
        ),
    )
    both = both.withColumn("s_made", step)
    clean = F.when(F.size("s_all") > 0, F.concat(F.col("s_made.out"), F.substring(said, F.col("s_made.end").cast("int") + 1, F.char_length(said)))).otherwise(said)
    return unpacked(both, **{text: clean})

"""Secret scan with a random forest that removes false positives (native: DataFrame functions and Spark ML only).

Candidates are of three kinds: what stands in a credential's place (after a key such as ``password`` in a text, JSON, YAML,
XML, a header or a command line; before the ``@`` of a URL, whose scheme, user and host are no part of it), blocks of private
keys, tokens of named forms with dots, and any run of 16 or more characters ``[A-Za-z0-9+/_-]``; each of any length. A random forest judges each from its length, character transitions, dictionary coverage,
path and neighbouring words. It is trained with Spark ML from labelled findings, and its trees are then written as one
SQL expression, so that scanning is a single projection over the documents: nothing is exploded, joined or shuffled, and
whole texts are scanned.

Labelled findings come from texts in which secrets and look-alikes were planted (``planted.py``): candidates are found in
them as in any text, and a candidate is a secret if it overlaps a planted one, so labels don't follow from features.
"""

from __future__ import annotations

import hashlib
import inspect
import json
import uuid

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import planted
from .common import ROW, hadoop, packed, remove, running, shared_folder, unpacked

_KEYS = (
    r"passw(?:or)?d|passwd|pwd|passphrase|passwort|senha|contrase(?:n|ñ)a|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|signing[_-]?key|encryption[_-]?key|account[_-]?key"
    r"|credentials?|authorization|auth[_-]?key"
)
_LOGIN = r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s/:@\"'<>]*+:"
#: A login's password, whole; an at sign follows it.
_PASS = r"[^\s/@\"'<>]{3,}"
_WORD = rf"{_PASS}(?=@)"
#: A credential's place, up to the value; a URL with a login in it, or a block, has its own place.
_PLACE = rf"(?i:(?:{_KEYS})[A-Za-z0-9_.-]{{0,24}}[\"'\]]{{0,2}}\s{{0,3}}(?::=|=>|[:=>]|(?<=--[a-z-]{{3,30}})\x20)\s{{0,3}}[\"'`]?(?:(?:bearer|basic)\x20)?)"
_APART = rf"(?!{_LOGIN}{_WORD}|-----BEGIN )"
#: A value of any length, without punctuation behind it.
_VALUE = r"[^\s\"'`<>]{5,}[^\s\"'`<>,;)}\].]"
_HOOK = r"(?:hooks\.slack\.com/services|discord(?:app)?\.com/api/webhooks)/"
_DOTTED = r"(?<![A-Za-z0-9+/_-])(?:eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+(?:\.[A-Za-z0-9_-]++)?|SG\.[A-Za-z0-9_-]{16,}+\.[A-Za-z0-9_-]{16,}+)"
_RUN = r"[A-Za-z0-9+/_-]{16,}+={0,2}"
#: A private key in a block of its own, with its headers; its body has no dash, so matching stays linear.
_BLOCK = r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY(?: BLOCK)?-----(?:\s*+[A-Z][A-Za-z]*+-?[A-Za-z]*+:[^\n]*+\n){0,6}+[A-Za-z0-9+/=\s\\]*+-----END [A-Z ]{0,24}PRIVATE KEY(?: BLOCK)?-----"
#: What of a match stands before the candidate.
LEAD = rf"(?:{_PLACE}{_APART}(?={_VALUE})|{_LOGIN}(?={_PASS}$)|{_HOOK}(?={_RUN}))"
CANDIDATE = rf"(?:{_BLOCK}|{_PLACE}{_APART}{_VALUE}|{_LOGIN}{_WORD}|{_HOOK}{_RUN}|{_DOTTED}|(?<![A-Za-z0-9+/_-]){_RUN})"
#: Characters of context on either side.
NEAR = 48
#: Findings at this probability or above are secrets.
CUTOFF = 0.5
TREES, DEPTH, SEED = 32, 9, 7
#: Planted texts that labelled findings are taken from, and findings that the forest is fitted on at most.
TEXTS, LABELLED = 6000, 20_000
REPLACEMENT = "[SECRET]"

#: Words that names, placeholders and identifiers are made of.
DICTIONARY = (
    "about access account action admin alpha amount apple article attribute avatar backup banner base before beta block blog button bucket calendar category change changeme client cloud code color "
    "column comment commit common company config connect content context control cookie count country create customer data database date default delete demo detail develop device digest document "
    "domain download dummy email engine error event example false fake field file filter first folder font footer format frame front function gallery global google group handler hash header height hello "
    "hidden home host html http https icon image import index info input insert instance internal item java json label lang layout left library link list local login main manager master member menu "
    "message method model module name network news node null number object offset option order output package page panel parent password path photo picture placeholder point post prefix price private "
    "process product profile project public query random range reader record release remote report request reset resource response result right root sample schema score script search secret section "
    "select server service session setting shadow share signature site size small source stack start state static status storage store stream string style submit subject support system table target task "
    "template test text theme thumb time title toggle token total track true type update upload user util value version video view wall web widget width window with word world write your"
).split()
_WORDS = "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w)))
#: Transitions that are common inside words of European languages.
_COMMON = "th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|ed|is|it|al|ar|st|to|nt|ng|se|ha|as|ou|io|le|ve|co|me|de|hi|ri|ro|ic|ne|ea|ra|ce|li|ch|ll|be|ma|si|om|ur|la|el|un|us|ta|ei|ie|qu|ss|ge|ei|do|da|os"

FEATURES = (
    "length", "distinct", "transitions", "common", "digits", "uppers", "letters", "hex", "separators", "symbols", "dictionary", "test_path", "place", "password", "login", "harmless", "assigned", "quoted", "prefix", "reference",
    "placeholder", "locator", "closed", "longest_run", "neighbours",
)


def features(c: Column, before: Column, after: Column, path: Column) -> Column:
    """The struct of ``FEATURES`` (doubles) of a candidate between its neighbours in a path."""
    n = F.char_length(c).cast("double")
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0")
    runs = F.regexp_replace(classes, r"(.)\1*+", "$1")
    left, low, low_c = F.lower(before), F.lower(F.coalesce(path, F.lit(""))), F.lower(c)
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    share = lambda x: F.char_length(x) / n
    return F.struct(
        n.alias("length"),
        (F.size(F.array_distinct(F.split(c, ""))) / n).alias("distinct"),
        ((F.char_length(runs) - 1) / n).alias("transitions"),
        (F.regexp_count(low_c, F.lit(f"(?={_COMMON})")) / n).alias("common"),
        share(F.regexp_replace(c, "[^0-9]", "")).alias("digits"),
        share(F.regexp_replace(c, "[^A-Z]", "")).alias("uppers"),
        share(F.regexp_replace(c, "[^A-Za-z]", "")).alias("letters"),
        flag(c.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")).alias("hex"),
        share(F.regexp_replace(c, "[^/_+-]", "")).alias("separators"),
        share(F.regexp_replace(c, "[A-Za-z0-9/_+-]", "")).alias("symbols"),
        (1 - share(F.regexp_replace(low_c, f"(?:{_WORDS})", ""))).alias("dictionary"),
        flag(low.rlike("test|spec|fixture|example|sample|mock|demo|docs?/")).alias("test_path"),
        flag(left.rlike(rf"{_PLACE}$")).alias("place"),
        flag(left.rlike(r"(?:passw|pwd|senha|contrase)[a-z0-9_.-]{0,24}[\"'\]]{0,2}\s{0,3}(?::=|=>|[:=>\x20])\s{0,3}[\"'`]?$")).alias("password"),
        flag(left.rlike(r"://[^\s/:@]*+:$") & after.startswith("@")).alias("login"),
        flag(F.concat(left, F.lit(" "), F.lower(F.substring(after, 1, 12))).rlike("\\b(?:commit|sha1|sha256|sha512|md5|hash|integrity|digest|checksum|uuid|guid|etag|revision|rev|image|src|href|id|example|sample|dummy|placeholder|isbn|order|tracking|version|build|font|base64|ssh-rsa|public)\\b")).alias("harmless"),
        flag(left.rlike("[=:]>?\\s{0,2}[\"']?$")).alias("assigned"),
        flag(left.rlike("[\"'`]$") & after.rlike("^[\"'`]")).alias("quoted"),
        flag(c.rlike("^(?:A[KS]IA[A-Z0-9]{12}|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|[sr]k_live_|AIza|eyJ|SG\\.|npm_|pypi-|-----BEGIN )") | left.rlike(f"{_HOOK}$")).alias("prefix"),
        flag(c.rlike(r"^[$%{<@*\[(]|\$\{|\{\{|\(|\)$|(?i:environ|getenv|process\.env|\bself\.|\bthis\.|config\.|settings\.|vault:|secretref|params\.|req\.)")).alias("reference"),
        flag(low_c.rlike(r"example|change.?me|your[_-]|[_-]here|placeholder|dummy|x{4}|\*{3}|\.{3}|0{6}|12345|abcde|sample|redacted|insert|replace|^(?:string|required|optional|undefined|boolean|integer|password|username|disabled|enabled|default)")).alias("placeholder"),
        flag(low_c.rlike(r"^(?:https?:|\.{0,2}/|[a-z]:\\)|://|\.(?:com|org|net|html?|php|js|css|png|jpe?g|gif|svg|json|ya?ml|py|java|go|ts|md|txt|pem)\b")).alias("locator"),
        flag(after.rlike(r"^[\"'`]?\s{0,2}(?:[,;})\]<\n]|$)")).alias("closed"),
        # The longest run of one class of characters.
        (F.array_max(F.transform(F.regexp_extract_all(classes, F.lit(r"((.)\2*+)"), F.lit(1)), lambda x: F.char_length(x))) / n).alias("longest_run"),
        # Prose on both sides: words of small letters.
        (flag(left.rlike(r"[a-z]{2,}[,.]?\x20$")) + flag(after.rlike(r"^[,.]?\x20[a-z]{2,}"))).alias("neighbours"),
    )


def _found(docs: DataFrame, text: str, path: str) -> DataFrame:
    """``docs`` with s_between (texts between matches) and s_seen: start, end, candidate, lead, its neighbours and features."""
    out = docs.withColumn("s_found", F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(CANDIDATE), F.lit(0)))
    out = out.withColumn("s_between", F.when(F.size("s_found") > 0, F.split(F.col(text), CANDIDATE, -1)))
    out = out.withColumn("s_lens", F.zip_with("s_between", "s_found", lambda a, b: F.char_length(a) + F.coalesce(F.char_length(b), F.lit(0))))
    out = running(out, "s_lens", "s_at")
    parts = F.transform(
        "s_found",
        lambda m, i: F.struct(
            F.regexp_replace(m, f"^{LEAD}", "").alias("c"), m.alias("m"), (F.get("s_at", i) + F.char_length(F.get("s_between", i)) + F.char_length(m)).alias("end"),
            F.right(F.concat(F.when((i > 0) & (F.char_length(F.get("s_between", i)) < NEAR), F.right(F.get("s_found", i - 1), F.lit(NEAR))).otherwise(F.lit("")), F.right(F.get("s_between", i), F.lit(NEAR))), F.lit(NEAR)).alias("b"),
            F.substring(F.concat(F.get("s_between", i + 1), F.coalesce(F.get("s_found", i + 1), F.lit(""))), 1, NEAR).alias("a"),
        ),
    )
    out = out.withColumn("s_parts", F.when(F.size("s_found") > 0, parts))
    lead = lambda p: F.left(p["m"], F.char_length(p["m"]) - F.char_length(p["c"]))
    seen = F.transform(
        "s_parts",
        lambda p: F.struct(
            (p["end"] - F.char_length(p["c"])).alias("start"), p["end"].alias("end"), p["c"].alias("candidate"), lead(p).alias("lead"),
            F.concat(p["b"], lead(p)).alias("before"), p["a"].alias("after"), features(p["c"], F.concat(p["b"], lead(p)), p["a"], F.col(path)).alias("features"),
        ),
    )
    return out.withColumn("s_seen", seen)


def labelled(texts: DataFrame) -> DataFrame:
    """(candidate, before, after, path, template, label) of (text, path, template, secrets array<struct<start, end>>).

    A candidate is a secret (1) if it overlaps one of ``secrets``.
    """
    found = _found(texts, "text", "path").select("path", "template", "secrets", F.explode_outer("s_seen").alias("s")).filter(F.col("s").isNotNull())
    label = F.exists("secrets", lambda x: (x["start"] < F.col("s.end")) & (F.col("s.start") < x["end"])).cast("int")
    return found.select("s.candidate", "s.before", "s.after", "path", "template", label.alias("label"))


def planted_findings(spark: SparkSession, texts: int = TEXTS, held_out: bool | None = None, kinds: str = "all") -> DataFrame:
    """Labelled findings of planted texts; ``held_out``: only of templates that are kept from training, or only of others; ``kinds`` of
    values: all, those that training sees (seen), or those that are kept from it (unseen)."""
    rows = planted.texts(texts, kinds=kinds)
    rows = [r for r in rows if held_out is None or planted.held_out(r[2]) == held_out]
    return labelled(spark.createDataFrame(rows, "text string, path string, template string, secrets array<struct<start:int,end:int>>"))


def train(findings: DataFrame, limit: int = LABELLED) -> RandomForestClassificationModel:
    """Fit the forest on (candidate, before, after, path, label), at most ``limit`` rows (the smallest by hash)."""
    rows = findings.select("candidate", "before", "after", "path", "label")
    rows = rows.orderBy(F.xxhash64(*rows.columns)).limit(limit)
    flat = rows.select(features(F.col("candidate"), F.col("before"), F.col("after"), F.col("path")).alias("f"), F.col("label").cast("double").alias("label")).select("f.*", "label").coalesce(1)
    made = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(flat)
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt").fit(made)


def forest_sql(model: RandomForestClassificationModel, struct: str) -> str:
    """SQL for the forest's probability of label 1, over the fields of ``struct``."""

    def node(n) -> str:
        if n.getClass().getSimpleName() == "LeafNode":
            stats = list(n.impurityStats().stats())
            return repr(float(stats[1] / sum(stats))) + "D"
        split = n.split()
        return f"CASE WHEN {struct}.{FEATURES[split.featureIndex()]} <= {float(split.threshold())!r}D THEN {node(n.leftChild())} ELSE {node(n.rightChild())} END"

    return "(" + " + ".join(node(t._java_obj.rootNode()) for t in model.trees) + f") / {len(model.trees)}"


_FITTED: dict[str, RandomForestClassificationModel] = {}


def _inputs() -> str:
    """A digest of all that the production forest depends on."""
    told = json.dumps([planted.texts(TEXTS), FEATURES, CANDIDATE, LEAD, DICTIONARY, inspect.getsource(features), LABELLED, TREES, DEPTH, SEED], default=str)
    return hashlib.sha256(told.encode()).hexdigest()[:32]


def production_model(spark: SparkSession) -> RandomForestClassificationModel:
    """The forest on all planted findings, fitted once and kept in the shared folder under a digest of its inputs.

    It is written under a temporary name and renamed; a folder that cannot be read is passed over and fitted anew.
    """
    app = spark.sparkContext.applicationId
    if app not in _FITTED:
        _FITTED.clear()
        path = f"{shared_folder(spark)}/quillform-forest-{_inputs()}"
        at, fs = hadoop(spark, path)
        try:
            _FITTED[app] = RandomForestClassificationModel.load(path) if fs.exists(at) else None
        except Exception:  # noqa: BLE001 - whatever is wrong with a stored model, a new one replaces it here
            _FITTED[app] = None
        if _FITTED[app] is None:
            _FITTED[app] = train(planted_findings(spark))
            temp = f"{path}-{uuid.uuid4().hex}"
            _FITTED[app].save(temp)
            if fs.exists(at) or not fs.rename(hadoop(spark, temp)[0], at):
                remove(spark, temp)
    return _FITTED[app]


def _scan(rows: DataFrame, model: RandomForestClassificationModel | None, text: str, path: str) -> DataFrame:
    out = _found(rows, text, path)
    tree = forest_sql(model or production_model(rows.sparkSession), "x.features")
    out = out.withColumn("s_probability", F.expr(f"transform(s_seen, x -> {tree})"))
    judged = F.zip_with("s_seen", "s_probability", lambda x, p: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["candidate"].alias("candidate"), p.alias("probability"), (p >= CUTOFF).alias("secret"), x["features"].alias("features"), x["lead"].alias("lead")))
    return out.withColumn("s_findings", judged)


def scan(docs: DataFrame, model: RandomForestClassificationModel | None = None, text: str = "text", path: str = "source") -> DataFrame:
    """All rows and columns of ``docs`` with ``s_findings``: start, end (code points), candidate, probability, secret, features, lead.

    Null and empty texts have no findings (null); null paths count as empty; repeated rows are scanned each; an empty
    table gives an empty result. A column of ``docs`` that is called ``s_findings`` is replaced; all others stay.
    """
    out = _scan(packed(docs), model, f"{ROW}.{text}", f"{ROW}.{path}")
    return out.select(*[F.col(f"{ROW}.`{c}`") for c in docs.columns if c != "s_findings"], "s_findings")


def redact(docs: DataFrame, model: RandomForestClassificationModel | None = None, text: str = "text", path: str = "source") -> DataFrame:
    """All rows of ``docs`` with each secret of the text replaced by ``REPLACEMENT``; other texts stay as they are.

    Null texts stay null, empty ones empty; repeated rows are changed alike; all columns keep their names and other
    values; an empty table gives an empty result.
    """
    found = _scan(packed(docs), model, f"{ROW}.{text}", f"{ROW}.{path}")
    parts = F.zip_with("s_between", "s_findings", lambda a, f: F.concat(a, F.coalesce(f["lead"], F.lit("")), F.when(f["secret"], F.lit(REPLACEMENT)).otherwise(F.coalesce(f["candidate"], F.lit("")))))
    clean = F.when(F.exists("s_findings", lambda f: f["secret"]), F.array_join(parts, "")).otherwise(F.col(f"{ROW}.{text}"))
    return unpacked(found, **{text: clean})

"""Query op9_pii_sanitise."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import privacy
from .common import table


def op9_pii_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every document."""
    out = privacy.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("e_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    said = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.array_join(F.transform("e_spans", said), ",")
    ranked = F.array_sort(F.concat(
        F.transform("e_spans", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))),
        F.transform("t_spans", lambda s: F.struct(s["start"].alias("start"), F.lit(9).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))),
    ))
    return out.select(F.col("d_doc").alias("doc_id"), *[count(k) for k in privacy.PATTERNS], F.sha2(base, 256).alias("base_sha256"), F.array_join(F.transform(ranked, said), ",").alias("spans"))


#: The contract's patterns, for an engine without lookbehind.
_PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
_DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN (length({_DIGITS}) - i) % 2 = 1 THEN CAST({_DIGITS}[i] AS INT) * 2 - CASE WHEN CAST({_DIGITS}[i] AS INT) > 4 THEN 9 ELSE 0 END ELSE CAST({_DIGITS}[i] AS INT) END)) % 10 = 0"
_VALID = {"email": "TRUE", "ip": f"regexp_full_match(x, '{privacy._IP[1:-1]}')", "card": f"CASE WHEN length({_DIGITS}) BETWEEN 14 AND 19 THEN {_LUHN} ELSE FALSE END", "phone": f"length({_DIGITS}) BETWEEN 10 AND 15"}
_VALUE = {"email": "lower(x)", "ip": "x", "card": _DIGITS, "phone": _DIGITS}
_FOUND = " UNION ALL ".join(f"SELECT doc_id, {r} AS rank, '{k}' AS kind, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS b FROM d" for r, (k, p) in enumerate(_PLAIN.items()))
_AT = "list_sum(list_transform(b[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0)"
_TERM = r"[\p{L}\p{M}\p{N}]+([_''-]+[\p{L}\p{M}\p{N}]+)*"
_TERMS = rf"list_distinct(list_transform(list_filter(regexp_extract_all(@, '{_TERM}'), lambda w: length(w) >= 3 AND regexp_matches(w, '\p{{L}}')), lambda w: lower(w)))"

SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({_FOUND}),
u AS (SELECT doc_id, rank, kind, m[i] AS x, CAST({_AT} AS BIGINT) AS start FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM f)),
e AS (SELECT doc_id, rank, kind, start, start + length(x) AS stop, CASE kind {' '.join(f"WHEN '{k}' THEN {v}" for k, v in _VALUE.items())} END AS value FROM u WHERE CASE kind {' '.join(f"WHEN '{k}' THEN {v}" for k, v in _VALID.items())} END),
o AS (SELECT kind, value, count(DISTINCT doc_id) AS df_e FROM e GROUP BY ALL),
p AS (SELECT kind, value, term, count(*) AS df_et FROM (SELECT kind, value, unnest({_TERMS.replace('@', 't')}) AS term FROM (SELECT DISTINCT kind, value, doc_id FROM e) JOIN d USING (doc_id)) GROUP BY ALL),
w AS (SELECT term, count(*) AS df_t FROM (SELECT unnest({_TERMS.replace('@', 't')}) AS term FROM d) GROUP BY term),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM d),
l AS (SELECT term, df_e / n AS own, (df_et + {privacy.PRIOR} * (df_e / n)) / (df_t + {privacy.PRIOR}) AS likely FROM p JOIN o USING (kind, value) JOIN w USING (term) CROSS JOIN n WHERE df_e < n),
told AS (SELECT DISTINCT term FROM l WHERE log2(likely / own) / -log2(own) >= {privacy.THRESHOLD} AND -log2(likely) <= {privacy.LEFT}),
tw AS (SELECT doc_id, regexp_extract_all(t, '{_TERM}') AS m, string_split_regex(t, '{_TERM}') AS b FROM d WHERE list_has_any({_TERMS.replace('@', 't')}, (SELECT coalesce(list(term), []) FROM told))),
tu AS (SELECT doc_id, m[i] AS x, CAST({_AT} AS BIGINT) AS place FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM tw)),
ts AS (SELECT doc_id, 9 AS rank, 'term' AS kind, place AS start, length(x) AS size FROM tu WHERE lower(x) IN (SELECT term FROM told)),
a AS (SELECT doc_id, rank, kind, start, stop FROM e UNION ALL SELECT doc_id, rank, kind, start, start + size FROM ts WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.doc_id = ts.doc_id AND ts.start < e.stop AND e.start < ts.start + ts.size)),
g AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'email') AS n_email, count(*) FILTER (WHERE kind = 'ip') AS n_ip, count(*) FILTER (WHERE kind = 'card') AS n_card, count(*) FILTER (WHERE kind = 'phone') AS n_phone,
  string_agg(kind || ':' || CAST(start AS VARCHAR) || ':' || CAST(stop AS VARCHAR), ',' ORDER BY start, rank) FILTER (WHERE kind <> 'term') AS base,
  string_agg(kind || ':' || CAST(start AS VARCHAR) || ':' || CAST(stop AS VARCHAR), ',' ORDER BY start, rank) AS spans FROM a GROUP BY doc_id)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)
"""

QUERIES = {"op9_pii_sanitise": op9_pii_sanitise}
ORACLES = {"op9_pii_sanitise": SQL}

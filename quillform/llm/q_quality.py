"""Query op8_quality_rules and its SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality
from .common import table


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    # The text isn't needed beyond the counts.
    out = quality.decide(quality.with_features(docs).drop("text"))
    return out.select("doc_id", F.col("q_features.n_words"), F.col("q_features.word_chars"), F.col("q_features.n_symbols"), F.col("q_features.n_dup_lines"), F.col("q_features.n_repeat_words"), "base_failed", "kept")


def _marks_sql(keys: str, source: str) -> str:
    by = f"PARTITION BY {keys + ', ' if keys else ''}metric"
    cols = [f"min(CASE WHEN metric = '{m}' AND 10 * upto >= {t} * n_docs THEN value END) AS {m}_{t}" for m in quality.METRICS for t in quality.TENTHS]
    return f"""SELECT {keys + ', ' if keys else ''}CAST(max(n_docs) AS BIGINT) AS n_docs, {', '.join(cols)} FROM (
        SELECT {keys + ', ' if keys else ''}metric, CASE WHEN bin IS NULL THEN 0.0 ELSE 2 * pow({quality.GAMMA!r}, bin) / ({quality.GAMMA!r} + 1) END AS value,
          sum(n) OVER ({by} ORDER BY bin NULLS FIRST ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER ({by}) AS n_docs
        FROM (SELECT {keys + ', ' if keys else ''}metric, bin, sum(n) AS n FROM {source} GROUP BY ALL)) {'GROUP BY ' + keys if keys else ''}"""


def _at(name: str) -> str:
    p = quality.PRIOR
    return f"((o.n_docs * o.{name} + {p} * ((l.n_docs * l.{name} + {p} * a.{name}) / (l.n_docs + {p}))) / (o.n_docs + {p}))"


def _inside() -> str:
    out = []
    for name, (count, of, below) in quality.METRICS.items():
        low, mid, high = (_at(f"{name}_{t}") for t in quality.TENTHS)
        out.append(f"{count} - {quality.NOISE} * sqrt({count}) <= ({high} + {quality.REACH} * ({high} - {mid})) * {of}")
        if below:
            out.append(f"{count} + {quality.NOISE} * sqrt({count}) >= ({low} - {quality.REACH} * ({mid} - {low})) * {of}")
    return " AND ".join(out)


SQL = f"""
WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), grams AS (
  SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM w
), marked AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS c FROM grams
), covered AS (
  SELECT doc_id, sum(least(3, coalesce(nxt - i, 3))) AS n_repeat_words FROM (
    SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM marked WHERE c >= 2) GROUP BY doc_id
), lines AS (
  SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM w
), f AS (
  SELECT w.doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines
  FROM w JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)
), m AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0.0 END AS word_length,
    CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0.0 END AS symbol_share,
    CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0.0 END AS dup_line_share,
    CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0.0 END AS repeat_share
  FROM f
), bins AS (
  SELECT lang, source, metric, CASE WHEN value > 0 THEN CAST(ceil(ln(value) / {quality.math.log(quality.GAMMA)!r}) AS INT) END AS bin, count(*) AS n
  FROM (UNPIVOT (SELECT lang, source, word_length, symbol_share, dup_line_share, repeat_share FROM m) ON word_length, symbol_share, dup_line_share, repeat_share INTO NAME metric VALUE value)
  GROUP BY ALL
), o AS ({_marks_sql('lang, source', 'bins')}), l AS ({_marks_sql('lang', 'bins')}), a AS ({_marks_sql('', 'bins')})
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND ({_inside()}) AS kept
FROM m JOIN o ON m.lang IS NOT DISTINCT FROM o.lang AND m.source IS NOT DISTINCT FROM o.source JOIN l ON m.lang IS NOT DISTINCT FROM l.lang CROSS JOIN a
"""

QUERIES = {"op8_quality_rules": op8_quality_rules}
ORACLES = {"op8_quality_rules": SQL}

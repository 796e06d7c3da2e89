import hashlib
import math
import re

import duckdb
from pyspark.sql import functions as F

from quillform.llm import privacy, q_privacy

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 10 <= len(d) <= 15


def base(t):
    return sorted((m.start(), i, m.end(), k) for i, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, t or "") if valid(k, m[0]))


TEXTS = [
    "mail a.b+c@x-y.co.uk, a@b.c_d@e.f a@b @x.y a@b..c ..@-.-", "1.2.3.4.5.6.7.8 256.1.1.1 0001.255.0.0 1.2.3 001.2.3.04.", "4111 1111 1111 1111 and 4111-1111-1111-1112 5500005555555559 1 2", "+1 (555) 123-4567 +12 +99 99.99.99-99) +1+1 5551234567",
    "É日\U0001f600 x@y.z \U0001f600 +44 20 7946 0958", None, "", "@" * 2000, "a." * 20_000 + "@", "1 " * 20_000, "9" * 30_000, "+" + "1 " * 20_000, "4111 1111 1111 1111@x.y 10.0.0.1@b.c", "a@b.c" * 500,
]


def test_base_against_regular_expressions(spark, tables):
    docs = [(i, t, "en", "s", None) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "en", "s", None), (None, TEXTS[1], None, None, None), (3, TEXTS[0], None, None, None)]
    got = sorted((tuple(r)[:6] for r in q_privacy.op9_pii_sanitise(spark, tables(documents=docs)).collect()), key=str)
    want = []
    for d, t, *_ in docs:
        b = base(t)
        want.append((d, *(sum(x[3] == k for x in b) for k in PATTERNS), hashlib.sha256(",".join(f"{k}:{a}:{z}" for a, _, z, k in b).encode()).hexdigest()))
    assert got == sorted(want, key=str)


FILL = "ordinary words that occur in every text of this small corpus "
HIDDEN = [(i, f"{FILL}case {i} about Zorblatt writes to z@q.org in time {FILL}", "en", "s", None) for i in range(5)]
REST = [(100 + i, f"{FILL} number {i} from a@b{i}.org nothing else {FILL}", "en", "s", None) for i in range(200)]
ALONE = [(400, f"{FILL} Once more, \"Zorblatt\" came; zorblatts did not.", "en", "s", None)]


def test_disclosing_terms_are_found_and_others_left(spark, tables):
    rows = {r.doc_id: r.spans for r in q_privacy.op9_pii_sanitise(spark, tables(documents=HIDDEN + REST + ALONE)).collect()}
    text = ALONE[0][1]
    assert rows[400] == f"term:{text.index('Zorblatt')}:{text.index('Zorblatt') + 8}"
    assert all("term" in rows[i] for i in range(5)) and not any("term" in rows[100 + i] for i in range(200))


def test_sql_finds_the_same_spans(spark, tables):
    sf_dir = tables(documents=HIDDEN + REST + ALONE + [(500 + i, t, "en", "s", None) for i, t in enumerate(TEXTS[:6])])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = sorted(con.execute(q_privacy.SQL).fetchall())
    got = sorted(tuple(r) for r in q_privacy.op9_pii_sanitise(spark, sf_dir).collect())
    assert got == want and sum("term" in r[-1] for r in got) == 6


def test_copies_are_documents(spark, tables):
    """Wherever the word stands its reader learns the address, also if all those texts are copies."""
    copies = [(i, HIDDEN[0][1], "en", "s", None) for i in range(9)]
    rows = q_privacy.op9_pii_sanitise(spark, tables(documents=copies + REST)).collect()
    assert all(("term" in r.spans) == (r.doc_id < 9) for r in rows)


def test_one_document_is_no_evidence_and_distance_does_not_matter(spark, tables):
    """A term far from its entity counts like one beside it; a word seen once with its entity leaves 1.58 bits."""
    far = [(i, f"Vexilla9 {FILL * 40} reach q{i % 1}@far.example {FILL}", "en", "s", None) for i in range(3)]
    once = [(50, f"Solitudo {FILL} s@once.example", "en", "s", None)]
    rows = {r.doc_id: r.spans for r in q_privacy.op9_pii_sanitise(spark, tables(documents=far + once + REST)).collect()}
    assert all("term:0:8" in rows[i] for i in range(3)) and "term" not in rows[50]


def disclosed(docs):
    """Terms and their best entity by the formulas, pair by pair."""
    word = re.compile(r"[^\W_]+(?:[_'-]+[^\W_]+)*")
    of = [(set(x for x in (m[0].lower() for m in word.finditer(t or "")) if len(x) >= 3 and re.search(r"[^\W\d_]", x)), {(k, (t[a:z].lower() if k == "email" else t[a:z] if k == "ip" else re.sub("[^0-9]", "", t[a:z]))) for a, _, z, k in base(t)}) for _, t, *_ in docs]
    out = {}
    for e in set().union(*(x for _, x in of)):
        df_e = sum(e in x for _, x in of)
        for t in set().union(*(w for w, x in of if e in x)):
            both, df_t = sum(t in w and e in x for w, x in of), sum(t in w for w, _ in of)
            p = df_e / len(of)
            likely = (both + privacy.PRIOR * p) / (df_t + privacy.PRIOR)
            if df_e < len(of) and math.log2(likely / p) / -math.log2(p) >= privacy.THRESHOLD and -math.log2(likely) <= privacy.LEFT:
                out[t] = max(out.get(t, (0, "")), (round(math.log2(likely / p) / -math.log2(p), 9), e[0]))
    return out


def test_against_formulas_with_a_term_of_two_kinds(spark):
    twice = [(600 + i, f"{FILL} Quorra o'neil_7 has z@q.org2 and 10.0.0.9 and +1 (555) 123-45{i % 2}7 {FILL}", "en", "s", None) for i in range(4)]
    docs = HIDDEN + REST + ALONE + twice + [(700, None, None, None, None), (701, "", None, None, None)]
    rows = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").fillna("", ["text"])
    got = {r.term: (r.disclosure, r.kind) for r in privacy.disclosing(privacy.entities(rows), rows).collect()}
    assert got == disclosed(docs) and got["quorra"][1] == "ip" and "o'neil_7" in got and "ordinary" not in got


def test_sanitise_replaces_and_keeps_columns(spark):
    df = spark.createDataFrame([(*r, "k") for r in HIDDEN + REST + ALONE] + [(None, None, None, None, None, "k")], "doc_id long, text string, lang string, source string, n_chars long, d_hash string")
    out = privacy.sanitise(df)
    assert out.columns == df.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert "z@q.org" not in got[0] and "[EMAIL]" in got[0] and not any(re.search(r"\bZorblatt\b", t or "") for t in got.values()) and got[None] is None
    assert got[100].count("[EMAIL]") == 1 and got[100].replace("[EMAIL]", "a@b0.org") == REST[0][1]


def test_empty_table(spark, tables):
    assert q_privacy.op9_pii_sanitise(spark, tables()).collect() == []


def test_terms_are_words_of_letters(spark):
    row = spark.range(1).select(privacy.terms(F.lit("The (rock'n'roll) x2 über-cool, the a@b.c «O» end.")).alias("t")).first()
    assert row.t == ["the", "rock'n'roll", "über-cool", "end"]

import difflib
import random

from pyspark.sql import functions as F

from quillform.functions import text
from quillform.operators import detect, graph, history, layout, matching, records, rules, stores, tags


def parsed(spark, token):
    return spark.createDataFrame([(token,)], "t string").select(tags.parse(F.col("t")).alias("p")).first().p


def test_tag_grammar(spark):
    p = parsed(spark, " Dropdown: a.b | X | | Y => y ")
    assert (p.kind, p.tag_type, p.field_id, p.type, p.options, p.error) == ("field", "dropdown", "a.b", "dropdown", ["X", "Y => y"], None)
    p = parsed(spark, "default_or_text:obs| a | b")
    assert (p.field_id, p.default_value, p.type) == ("obs", "a|b", "multiline")
    assert parsed(spark, "single_choice:x|one").error == "too few options" and parsed(spark, "dropdown:x").error == "no options" and parsed(spark, "checkbox: ").error == "missing id"
    assert parsed(spark, "repeat: items").kind == "repeat" and parsed(spark, "linha.número").kind == "row_number" and parsed(spark, "foo:bar").field_id == "foo:bar"


def test_scan_merges_repeated_ids(spark):
    df = spark.createDataFrame([(1, "{{nome}} {{x}} {{checkbox:x}} {{x}} {{date:x}}")], "k int, text string")
    got = {r.field_id: (r.first_pos, r.occurrences, r.type) for r in tags.scan_fields(df, "k").collect()}
    assert got == {"nome": (0, 1, "text"), "x": (1, 4, "checkbox")}


def test_render_leaves_unanswered_tags(spark):
    df = spark.createDataFrame([(1, "a {{x}} b {{checkbox:y}} {{default_or_text:z|dflt}}{{w}}", {"x": "{{w}}", "y": "Sim"}), (2, "no tags", {}), (3, None, {"x": "1"})], "k int, text string, a map<string,string>")
    got = {r.k: (r.rendered, r.unresolved) for r in tags.render(df, "a").collect()}
    assert got[1] == ("a {{w}} b ☑ dflt{{w}}", ["w"]) and got[2] == ("no tags", [])


def test_fill_pattern_sees_tags_of_values(spark):
    pairs = F.array(F.struct(F.lit("a").alias("key"), F.lit("{{b}}").alias("value")), F.struct(F.lit("b").alias("key"), F.lit("x").alias("value")))
    assert spark.range(1).select(tags.fill_pattern(F.lit("{{a}}-{{date:b}}"), pairs).alias("x")).first().x == "x-x"


def test_conditions(spark):
    rows = [("equals", "integral", "Integral", True), ("equals", "x", None, False), ("equals", "none", None, True), ("not_equals", "Parcial", "Integral", True), ("truthy", None, "", False), ("truthy", None, "sim", True), ("truthy", None, "false", True), ("truthy", None, "None", True), ("truthy", None, "0", True), ("truthy", None, None, False), ("whatever", None, None, True)]
    df = spark.createDataFrame(rows, "op string, expected string, actual string, want boolean")
    assert all(r.got is r.want for r in df.select("want", rules.condition_matches(F.col("op"), F.col("expected"), F.col("actual")).alias("got")).collect())
    flag = spark.createDataFrame([("equals", "sim", "true", True), ("equals", "no", "true", False), ("truthy", None, "true", True), ("truthy", None, "false", False)], "op string, expected string, actual string, want boolean")
    assert all(r.got is r.want for r in flag.select("want", rules.condition_matches(F.col("op"), F.col("expected"), F.col("actual"), F.lit(True)).alias("got")).collect())
    assert spark.range(1).select(rules.parse_condition(F.lit("tipo = Integral ")).alias("c")).first().c == ("tipo", "equals", "Integral")
    assert spark.range(1).select(rules.parse_condition(F.lit("regra-sem-igual")).alias("c")).first().c is None


def test_validation_takes_the_first_problem(spark):
    rows = [("cpf", "529.982.247-25", None), ("cpf", "1", "cpf"), ("text", " ", "required"), ("checkbox", None, None), ("email", "a@b", "email"), ("email", "a@b.c", None), ("percentage", "101", "range"), ("percentage", "x", "number"), ("integer", "-5", None), ("decimal", "1.234,5", None), ("dropdown", "C", "not an option"), ("text", "abcdef", "too long"), ("phone", "83 9999-8888", None)]
    df = spark.createDataFrame(rows, "kind string, v string, want string").withColumn("o", F.array(F.lit("A"), F.lit("B")))
    got = df.select("want", rules.validate(F.col("kind"), F.col("v"), F.lit(True), options=F.col("o"), most=F.when(F.col("kind") == "text", 5).otherwise(0)).alias("got")).collect()
    assert [(r.got) for r in got] == [r[2] for r in rows]


def test_quality_issues_and_cycles(spark):
    f = spark.createDataFrame(
        [("t", 0, "cliente.nome", "A", "text", None, None), ("t", 1, "cliente.nome", "B", "text", None, None), ("t", 2, "d", "D", "dropdown", ["x"], None), ("t", 3, "e", " ", "text", None, "gone"), ("t", 4, "9a", "N", "text", None, "d")],
        "template_id string, pos int, id string, label string, type string, options array<string>, depends_on string",
    )
    got = {(r.pos, r.code) for r in rules.quality_issues(f).collect()}
    assert got == {(0, "field.id_duplicate"), (1, "field.id_duplicate"), (2, "dropdown.options_missing"), (3, "field.label_missing"), (3, "condition.field_unknown"), (4, "field.id_invalid")}
    assert rules.issue_counts(rules.quality_issues(f)).first().errors == 6
    e = spark.createDataFrame([("t", "a", "b"), ("t", "b", "a"), ("t", "c", "a"), ("t", "s", "s"), ("u", "a", "b")] + [("u", f"n{i}", f"n{i + 1}") for i in range(20)] + [("u", "n20", "n13")], "k string, n string, t string")
    assert {tuple(r) for r in rules.cycles(e, "k", "n", "t").collect()} == {("t", "a"), ("t", "b"), ("t", "s")} | {("u", f"n{i}") for i in range(13, 21)}


def test_low_confidence_is_flagged_until_reviewed(spark):
    f = spark.createDataFrame([("t", i, f"f{i}", "L", "text", None, None, "automatic", seen, c) for i, (seen, c) in enumerate([(False, 0.5), (False, 0.7), (True, 0.5), (False, 0.9)])], "template_id string, pos int, id string, label string, type string, options array<string>, depends_on string, detection_source string, detection_reviewed boolean, detection_confidence double")
    assert {(r.pos, r.code) for r in rules.quality_issues(f).collect()} == {(0, "detection.low_confidence"), (1, "detection.medium_confidence")}


def test_similar_names(spark):
    names = ["Termo de Referência", "Termo de Referencia", "Termo Referência 2024", "Contrato de Obra", "Contrato de Obras", "Ata", "Parecer"]
    got = {(r.a, r.b): r.score for r in matching.similar_names(spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert got[("Termo de Referencia", "Termo de Referência")] == 1.0 and ("Contrato de Obra", "Contrato de Obras") in got and not any("Ata" in p or "Parecer" in p for p in got)


def _brute_pairs(spark, names):
    """Pairs of names without a common word whose keys have a ratio of .92 or more, by comparing all."""
    df = spark.createDataFrame([(n,) for n in names], "name string").select("name", matching.template_key(F.col("name")).alias("key"))
    keys = sorted((r.name, r.key) for r in df.collect())
    return {(a, b) for i, (a, x) in enumerate(keys) for b, y in keys[i + 1 :] if not set(x.split()) & set(y.split()) and difflib.SequenceMatcher(None, x, y).ratio() >= 0.92}


def _edited_names():
    rng, names = random.Random(5), {"zolicitacao administrativaz", "solicitacao administrativas"}
    for _ in range(60):
        base = " ".join("".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randrange(6, 15))) for _ in range(rng.randrange(1, 4)))
        words = [rng.choice(("z" + w[1:], w + "x", w[1:], w[:3] + "k" + w[3:], w[:4] + w[5:])) for w in base.split(" ")]
        names |= {base, " ".join(words), base[1:] + "z", "y" + base}
    return sorted(names)


def test_similar_names_without_a_common_word_equal_all_pairs(spark):
    names = _edited_names()
    want = _brute_pairs(spark, names)
    got = {(r.a, r.b) for r in matching.similar_names(spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert ("solicitacao administrativas", "zolicitacao administrativaz") in want and len(want) > 30 and want <= got


def _slow_score(x, y, k, m):
    """The reference's similarity of two names by their normalised names and keys."""
    if not x or not y or x == y:
        return float(bool(x) and x == y)
    if not k or not m or k == m:
        return 0.99 if k and k == m else 0.0
    p, q, a, b = k.replace(" ", ""), m.replace(" ", ""), set(k.split()), set(m.split())
    if p == q:
        return 0.98
    ratio = lambda u, v: difflib.SequenceMatcher(None, u, v).ratio()
    whole, share, least = ratio(k, m), len(a & b) / len(a | b), min(len(a), len(b))
    if min(len(p), len(q)) < 5 or (not a & b and whole < 0.92) or (len(a & b) == 1 and len(a) > 1 and len(b) > 1 and whole < 0.86 and share < 0.75):
        return 0.0
    return round(max(whole, 0.98 * ratio(p, q), share, 0.91 if len(a & b) == least >= 2 else 0), 4)


def test_similar_groups_equal_all_pairs(spark):
    names = [*_edited_names()[:80], "Contrato de Obra", "contrato de obra", "Contrato de Obras", "Ata", "Ata", "Parecer", "--", "--", "zolicitacao administrativaz", "solicitacao administrativas"]
    df = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    rows = [tuple(r) for r in df.select("id", text.name_key(F.col("name")), matching.template_key(F.col("name"))).orderBy("name", "id").collect()]
    up = {r[0]: r[0] for r in rows}
    for i, (a, x, k) in enumerate(rows):
        for b, y, m in rows[i + 1 :]:
            if _slow_score(x, y, k, m) >= 0.84 and up[a] != up[b]:
                low, high = sorted((up[a], up[b]))
                up = {n: low if g == high else g for n, g in up.items()}
    want = {(n, g) for n, g in up.items() if list(up.values()).count(g) > 1}
    assert {(r.id, r.grp) for r in matching.similar_groups(df, "id").collect()} == want and len(want) > 20


def test_identity_matches_refuse_ties(spark):
    def field(i, label, kind="text", section=""):
        return (1, i, label, kind, section, "")

    cols = "k int, field_id string, label_norm string, type string, section_norm string, semantic string"
    s = spark.createDataFrame([field("s1", "nome completo"), field("s2", "e mail"), field("s3", "e mail"), field("s4", "cidade", section="a")], cols)
    t = spark.createDataFrame([field("t1", "nome completo"), field("t2", "e mail"), field("t4", "cidade", section="a"), field("t5", "cidade", section="b")], cols)
    assert {(r.target_id, r.source_id, r.score) for r in matching.identity_matches(s, t, "k").collect()} == {("t1", "s1", 98), ("t4", "s4", 100)}


def test_records(spark):
    cells = spark.createDataFrame([(1, 0, 2, "a"), (1, 2, 2, "b"), (2, 0, 4, "title")], "doc int, start int, span int, text string")
    rows = spark.createDataFrame([(1, 1, 2), (1, 3, 1), (2, 0, 1)], "doc int, start int, span int")
    got = {(r.doc, r.start): r.header for r in records.overlap_headers(rows, cells, ["doc"], 4).collect()}
    assert got == {(1, 1): "a / b", (1, 3): "b"}
    c = spark.createDataFrame([(1, 1, "table", [10, 11]), (1, 2, "field", [10]), (1, 3, "field", [9, 10]), (2, 4, "field", [10]), (1, 5, "table", [12, 13]), (1, 6, "field", [11, 12]), (1, 7, "field", [12])], "doc int, cand int, kind string, places array<int>")
    # One table must hold a candidate whole: two together don't.
    assert {(r.cand, r.suppressed) for r in records.suppress_owned(c, "doc").collect()} == {(1, 1), (3, 0), (4, 0), (5, 1), (6, 0)}
    o = spark.createDataFrame([(["A => a", " B ", "", "C => a"],)], "raw array<string>").select(records.options(F.col("raw")).alias("o")).first().o
    assert [tuple(x) for x in o] == [("A", "a"), ("B", "B")]
    u = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x_2"), (4, "x")], "pos int, base string")
    ids = [r.unique_id for r in records.unique_ids(u, "base", ["pos"]).collect()]
    assert len(set(ids)) == 4 and "x" in ids and "x_2" in ids
    u = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a_2"), (4, "a_6"), (5, "b"), (6, "b"), (7, "a")], "pos int, base string")
    assert {r.pos: r.unique_id for r in records.unique_ids(u, "base", ["pos"]).collect()} == {1: "a", 2: "a_2", 3: "a_2_2", 4: "a_6", 5: "b", 6: "b_2", 7: "a_3"}
    taken = spark.createDataFrame([("a",), ("a_3",), ("b_2",)], "name string")
    free = {r.pos: r.free for r in stores.free_names(u.filter("pos <> 4").withColumnRenamed("base", "file"), taken, "file", ["pos"]).collect()}
    assert free == {1: "a_2", 2: "a_4", 3: "a_2_2", 5: "b", 6: "b_3", 7: "a_5"}
    assert spark.range(1).select(records.field_id(F.lit("1 Nome do Cliente")).alias("x")).first().x == "auto.campo_1_nome_do_cliente"


def test_components_of_long_chains(spark):
    nodes = spark.range(60).withColumnRenamed("id", "node")
    edges = spark.range(59).filter("id <> 30").selectExpr("id as u", "id + 1 as v")
    got = {r.node: r.grp for r in graph.components(nodes, edges).collect()}
    assert got == {i: 0 if i <= 30 else 31 for i in range(60)}


def test_history(spark):
    e = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, "w")], "k string, at int, v string")
    assert {tuple(r) for r in history.latest(e, ["k"], [F.col("at")]).collect()} == {("a", 3, "z"), ("b", 1, "w")}
    assert [r.v for r in history.beyond(e, ["k"], [F.desc("at")], 2).collect()] == ["x"]
    base = spark.createDataFrame([("a", "old"), ("c", "old")], "k string, v string")
    ch = spark.createDataFrame([("a", "new", False, 1), ("a", "gone", True, 2), ("d", "add", False, 1)], "k string, v string, deleted boolean, at int")
    assert {tuple(r) for r in history.upsert(base, ch, ["k"], [F.col("at")]).collect()} == {("c", "old"), ("d", "add")}


def test_template_keys(spark):
    names = ["Modelo de Contrato (cópia) v2", "Contrato", "Termo versão 3", "O Termo", "2024"]
    assert [r.k for r in spark.createDataFrame([(n,) for n in names], "n string").select(matching.template_key(F.col("n")).alias("k")).collect()] == ["contrato", "contrato", "termo", "termo", ""]


def test_masks_do_not_overlap(spark):
    text = "UF: __ Nome: XXXX R$ 000.000,00 {campo.id} {{tag}} (00) 00000-0000 contato@empresa.com.br a__b"
    got = spark.createDataFrame([(text,)], "t string").select(detect.masks(F.col("t")).alias("m")).first().m
    assert [(x.kind, text[x.start : x.end]) for x in got] == [("underscores", "__"), ("letters", "XXXX"), ("currency", "R$ 000.000,00"), ("braces", "{campo.id}"), ("phone", "(00) 00000-0000"), ("email", "contato@empresa.com.br")]
    assert [x.confidence for x in got][:3] == [0.91, 0.91, 0.74]


def test_labels_of_records(spark):
    rows = [(1, 0, None, None, None, "1. Dados gerais"), (1, 1, None, None, None, "Nome completo"), (1, 2, None, None, None, "______"), (1, 3, 0, 0, 0, "Cargo"), (1, 4, 0, 0, 1, ""), (1, 5, 0, 1, 0, "___"), (1, 6, None, None, None, "Data: __/__/____")]
    df = spark.createDataFrame(rows, "doc int, ordinal int, table_index int, row_index int, cell_index int, text string")
    got = {r.ordinal: (r.role, r.section, r.label, r.label_source) for r in detect.annotate(df).collect()}
    assert got[2] == ("fill_area", "1. Dados gerais", "Nome completo", "nearby") and got[4][2:] == ("Cargo", "left") and got[5][2:] == ("Cargo", "column") and got[6][2:] == ("Data", "same_text")


def test_sheets_and_repairs(spark):
    rows = spark.createDataFrame([(1, 0, 0, 3, "a | b | c"), (1, 0, 1, 1, "____"), (1, 0, 2, 3, "x"), (1, 0, 3, 1, "short")], "doc int, table_index int, row_index int, n_cells int, text string")
    assert [r.row_index for r in detect.editable_sheets(rows).collect()] == [0]
    cells = spark.createDataFrame([(1, 0, 0, 1, "__", True, 0.9), (1, 0, 1, 1, "__", True, 0.9), (1, 0, 2, 1, " ", False, 0.8), (1, 0, 3, 1, "", False, 0.5), (1, 0, 2, 2, "", False, 0.9)], "doc int, table_index int, row_index int, cell_index int, text string, editable boolean, label_confidence double")
    assert [(r.row_index, r.cell_index) for r in detect.consistency_repairs(cells).collect()] == [(2, 1)]


def test_rescoring(spark):
    def score(base, *codes):
        r = spark.range(1).select(detect.rescore(F.lit(base), F.array(*[F.lit(c) for c in codes]) if codes else F.expr("cast(array() as array<string>)")).alias("s")).first().s
        return (r.confidence, r.band, r.priority, r.selected)

    assert score(0.9) == (0.9, "high", "ready", True) and score(0.9, "poor_label", "label_agreement") == (0.54, "low", "required", False) and score(0.95, "label_agreement") == (1.0, "high", "ready", True) and score(0.9, "pdf_reconstruction") == (0.88, "high", "recommended", True)


def test_layout_operators(spark):
    e = spark.createDataFrame([("t", "b", "X", 0)], "template_id string, field_id string, section string, pos int")
    f = spark.createDataFrame([("t", "a", "Y", 0), ("t", "b", "Y", 1), ("t", "c", None, 2)], "template_id string, field_id string, section string, pos int")
    assert {(r.field_id, r.section) for r in layout.normalize_sections(e, f).collect()} == {("a", "Y"), ("b", "X"), ("c", "Outros")}
    c = spark.createDataFrame([(1, 1, "b", 5), (1, 0, "a", 6)], "row int, column int, text string, order int")
    assert [tuple(r) for r in layout.static_rows(c, "row").collect()] == [(1, 5, "a | b")]
    b = spark.createDataFrame([(1, "Sim"), (1, "Não"), (2, "Sim"), (2, "Talvez"), (3, "Nada consta"), (3, "Consta débito")], "cell int, label string")
    assert {r.cell for r in layout.choice_groups(b, "cell").collect()} == {1, 3}
    p = spark.createDataFrame([(["Data de início", "Data de fim", "Data de hoje"],), (["x"],), (["a b", "b a"],)], "l array<string>").select(layout.common_prefix(F.col("l")).alias("p")).collect()
    assert [r.p for r in p] == ["Data de", "x", ""]


def test_suffix_matches_are_unique_and_safe(spark):
    a = spark.createDataFrame([(1, "auto.nome_completo"), (1, "x.data"), (1, "a.cpf"), (1, "b.cpf"), (1, "chefe.razao_social"), (1, "x.opcao"), (2, "cliente.nome completo"), (2, "nome completo"), (2, "@other/nome completo"), (3, "um.celular"), (3, "dois.celular")], "k int, answer_key string")
    f = spark.createDataFrame(
        [(1, "f1", "Nome Completo", 1), (1, "f2", "Data", 2), (1, "f3", "CPF", 3), (1, "f4", "Razão Social", 4), (1, "f5", "Outro rótulo", 5), (1, "f6", "Outro rótulo", 6), (1, "f7", "Opção", 7), (2, "g1", "Cliente nome completo", 1), (2, "g2", "Nome completo", 2), (3, "h", "Celular", 1)],
        "k int, field_id string, label string, pos int",
    )
    got = {(r.field_id, r.answer_key) for r in matching.suffix_matches(a, f, "k").collect()}
    # The first field takes its key, which leaves one key for the second.
    assert got == {("f1", "auto.nome_completo"), ("f4", "chefe.razao_social"), ("g1", "cliente.nome completo"), ("g2", "nome completo")}


def test_score_of_equal_contexts(spark):
    cols = "k int, field_id string, label_norm string, type string, section_norm string, semantic string, context string"
    s = spark.createDataFrame([(1, "s", "a", "currency", "", "", "x.y:text"), (1, "s2", "b", "multiline", "", "", "")], cols)
    t = spark.createDataFrame([(1, "t", "c", "percentage", "", "", "x.y:text"), (1, "t2", "b", "text", "", "", "")], cols)
    assert [(r.target_id, r.source_id, r.score) for r in matching.identity_matches(s, t, "k").collect()] == [("t", "s", 99)]


def test_distinct_labels_keep_no_set_of_labels_in_a_row(spark):
    rows = [(None, "A", "a1"), (None, "A", "a2"), (1, "A", "a1"), (1, "A", "a1"), (2, "A", "a1"), (2, None, "n"), (3, "B", None)]
    df = layout.distinct_labels(spark.createDataFrame(rows, "t int, label string, id_label string"), "t")
    assert sorted(df.select("t", "shown").collect(), key=repr) == sorted([(1, "A"), (1, "A"), (2, "A"), (2, None), (3, "B"), (None, "a1"), (None, "a2")], key=repr)
    assert "collect_set" not in df._jdf.queryExecution().optimizedPlan().toString()

"""Merging what documents say into what people set."""

from quillform.operators import merging

TYPES = {"layout_column_index": "int", "layout_column_span": "int", "layout_grid_columns": "int", "layout_order": "int", "choice_required": "boolean"}
FIELD = "doc int, pos int, field_id string, type string, label string, label_source string, section string, section_source string, detection_source string, " + ", ".join(f"{c} {TYPES.get(c, 'string')}" for c in merging.LAYOUT)
SAID = "doc int, field_id string, section string, detected_label string, " + ", ".join(f"{c} {TYPES.get(c, 'string')}" for c in merging.LAYOUT)


def rows(spark, schema, *given):
    names = [x.split()[0] for x in schema.split(", ")]
    return spark.createDataFrame([tuple(g.get(n) for n in names) for g in given], schema)


def apply(spark, field, said):
    base = {"doc": 1, "pos": 0, "field_id": "x"}
    (r,) = merging.apply_layout(rows(spark, FIELD, base | field), rows(spark, SAID, *([{"doc": 1, "field_id": "x"} | said] if said is not None else []))).collect()
    return r


def test_what_people_set_stays(spark):
    r = apply(spark, {"label": "À mão", "label_source": "manual", "section": "Minha", "layout": "full_width"}, {"detected_label": "Doc", "section": "13. Prazo", "layout": "choice", "layout_group": "prazo", "choice_required": True})
    assert (r.label, r.section, r.layout, r.layout_group, r.choice_required) == ("À mão", "Minha", "full_width", "prazo", True)
    assert r.origins == {"label": "kept", "section": "kept", "layout": "kept", "layout_group": "document", "choice_required": "document"}


def test_derived_values_follow_the_document(spark):
    r = apply(spark, {"label": "X", "label_source": "identifier", "section": "Dados do documento", "layout": "auto"}, {"detected_label": "Doc", "section": "1. Um", "layout": "form_grid", "layout_column_index": 0})
    assert (r.label, r.label_source, r.section, r.layout, r.layout_column_index) == ("Doc", "document_context", "1. Um", "form_grid", 0)
    assert apply(spark, {"label": "X", "layout_order": 3}, None).layout_order == 3


def test_tables_become_grids_and_boxes_go_home(spark):
    r = apply(spark, {"layout": "table", "layout_group": "doc_table_1", "layout_row": "row_3", "layout_row_label": "Órgão", "layout_column": "Órgão"}, {"layout": "form_grid", "layout_group": "doc_table_1_segment_1", "layout_row": "row_3", "layout_column_span": 2})
    assert (r.layout, r.layout_group, r.layout_column_span, r.layout_row_label, r.layout_column) == ("form_grid", "doc_table_1_segment_1", 2, None, None)
    assert apply(spark, {"layout": "table", "layout_group": "minha"}, {"layout": "form_grid"}).layout == "table"
    r = apply(spark, {"type": "checkbox", "detection_source": "automatic", "layout": "choice", "layout_group": "g1", "layout_group_label": "Situação"}, {"layout": "table", "layout_group": "doc_table_1", "layout_row": "row_2", "layout_column": "Sim", "choice_group": "zz"})
    assert (r.layout, r.layout_group, r.choice_group, r.choice_group_label, r.choice_required, r.compact_choice, r.layout_column) == ("table", "doc_table_1", "g1", "Situação", True, True, "Sim")


def test_manual_values_survive_two_scans(spark):
    frame = lambda *r: spark.createDataFrame(list(r), "id string, label string, type string")
    base = frame(("a", "A", "text"), ("b", "B", "text"), ("c", "C", "text"), ("d", "D", "text"))
    user = frame(("a", "À mão", "text"), ("b", "B", "text"), ("d", "D!", "text"), ("e", "Novo", None))
    first = frame(("a", "A2", "date"), ("b", "B2", "text"), ("c", "C2", "text"), ("f", "F", "text"))
    get = lambda df: {r.id: (r.label, r.type, r.origins["label"], r.conflicts) for r in df.collect()}
    once = merging.three_way(base, user, first, ["id"], ["label", "type"])
    assert get(once) == {"a": ("À mão", "date", "user", ["label"]), "b": ("B2", "text", "scan", []), "d": ("D!", "text", "user", []), "e": ("Novo", None, "user", []), "f": ("F", "text", "scan", [])}
    second = frame(("a", "A3", "cpf"), ("b", "B2", "text"), ("c", "C2", "text"), ("d", "D", "text"), ("f", "F2", "text"))
    twice = merging.three_way(first, once.select("id", "label", "type"), second, ["id"], ["label", "type"])
    got = get(twice)
    assert got["a"][:3] == ("À mão", "cpf", "user") and got["f"][:2] == ("F2", "text") and got["e"][0] == "Novo" and "c" not in got and got["d"][0] == "D!"


GRID = "doc int, section string, layout_group string, layout_row string, pos int, label string, start int, span int, grid int, locked boolean, statics array<struct<start:int,span:int,label:string>>"


def grid(spark, *given):
    base = {"doc": 1, "section": "s", "layout_group": "g", "layout_row": "r", "grid": 3, "span": 1, "start": 0}
    names = [x.split()[0] for x in GRID.split(", ")]
    df = spark.createDataFrame([tuple((base | {"pos": k} | g).get(n) for n in names) for k, g in enumerate(given)], GRID)
    return [(r.start, r.span, r.grid, r.full_width, [s.label for s in r.statics]) for r in sorted(merging.normalized(df).collect(), key=lambda r: r.pos)]


def test_grids_are_normalized(spark):
    assert grid(spark, {"start": 1, "label": "Nome", "statics": [(0, 1, "Nome:")]}) == [(0, 3, 3, True, [])]
    assert grid(spark, {"start": 1, "label": "Nome", "statics": [(0, 1, "Nome:")]}, {"start": 2, "label": "B"}) == [(0, 2, 3, False, []), (2, 1, 3, False, [])]
    assert grid(spark, {"start": 1, "label": "Nome", "locked": True, "statics": [(0, 1, "Nome")]}) == [(1, 1, 3, False, ["Nome"])]
    assert grid(spark, {"start": 1, "label": "Nome", "statics": [(0, 1, "Orientação")]}) == [(1, 1, 3, False, ["Orientação"])]
    assert grid(spark, {"start": 0, "span": 2, "label": "Tipo", "statics": [(0, 2, "Tipo: Escolher um item.")]}, {"start": 2}) == [(0, 2, 3, False, []), (2, 1, 3, False, [])]
    assert grid(spark, {"start": 9, "span": 9, "grid": 40}, {"start": -2, "span": 0, "grid": None}) == [(9, 3, 12, False, []), (0, 1, 12, False, [])]
    assert grid(spark, {"start": 1, "locked": True}) == [(1, 1, 3, False, [])]


def test_explicit_fields_win_over_assisted_duplicates(spark):
    schema = "doc int, layout_group string, layout_row string, pos int, start int, span int, label string, detection_source string, field_id string"
    f = [(1, "g", "r", 0, 0, 2, "1. Descrição", None, "auto.descricao"), (1, "g", "r", 1, 1, 1, "Descricao:", None, "desc"), (1, "g", "r", 2, 2, 1, "Descrição", "automatic", "d"), (1, "g", "q", 3, 0, 1, "Descrição", "automatic", "e"), (1, "g", "r", 4, 1, 1, "descrição", "word_control", "f"), (1, None, "r", 5, 0, 2, "Descrição", "automatic", "h")]
    assert sorted(r.pos for r in merging.without_duplicates(spark.createDataFrame(f, schema)).collect()) == [2, 3, 4, 5]


def test_a_fixed_text_and_a_label_are_read_once(spark):
    df = spark.createDataFrame([("Tipo : ", "tipo"), ("TIPO: Selecione  uma opção.", "Tipo"), ("Tipo: outro", "Tipo"), ("", "Tipo"), (None, None)], "a string, b string")
    out = df.select(merging.describes(df.a, df.b).alias("x"))
    assert [r.x for r in out.collect()] == [True, True, False, False, False]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 2

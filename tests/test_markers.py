"""Lone check boxes in packages as word processors write them."""

import pytest

from quillform.operators import inference, markers
from quillform.sources import ooxml

NS = (
    'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:w14="http://schemas.microsoft.com/office/word/2010/wordml" '
    'xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006" xmlns:v="urn:schemas-microsoft-com:vml"'
)
BOX = '<w:sdt><w:sdtPr>{}<w14:checkbox/></w:sdtPr><w:sdtContent><w:r><w:t>☐</w:t></w:r></w:sdtContent></w:sdt>'
OLD = '<w:r><w:fldChar w:fldCharType="begin"><w:ffData><w:name w:val="{}"/><w:checkBox/></w:ffData></w:fldChar></w:r>'
SYM = '<w:r><w:sym w:font="Wingdings" w:char="F0A8"/></w:r>'
DRAWN = '<w:r><mc:AlternateContent><mc:Choice Requires="wps"><w:drawing/></mc:Choice><mc:Fallback><w:pict/></mc:Fallback></mc:AlternateContent></w:r>'


def run(text, bold=False):
    return f"<w:r>{'<w:rPr><w:b/></w:rPr>' if bold else ''}<w:t>{text}</w:t></w:r>"


def p(*inner, numbered=False):
    return f"<w:p>{'<w:pPr><w:numPr/></w:pPr>' if numbered else ''}{''.join(inner)}</w:p>"


def cell(*paragraphs, width=None):
    w = f'<w:tcPr><w:tcW w:w="{width}" w:type="dxa"/></w:tcPr>' if width else ""
    return f"<w:tc>{w}{''.join(paragraphs) or '<w:p/>'}</w:tc>"


def records(spark, *blocks):
    body = "".join(b if isinstance(b, str) else "<w:tbl>" + "".join(f"<w:tr>{''.join(r)}</w:tr>" for r in b) + "</w:tbl>" for b in blocks)
    raw = ooxml.packed([("word/document.xml", f"<w:document {NS}><w:body>{body}</w:body></w:document>".encode())])
    made = ooxml.parse_docx(spark.createDataFrame([("d", bytearray(raw))], "path string, content binary"))
    return made.selectExpr("path AS doc", "block", "IF(depth = 1, table_index, NULL) AS table_index", "row_index", "grid_start AS start", "ordinal AS k", "text", "width", "runs", "bold_runs", "is_numbered", "named_boxes", "bare_boxes", "named_legacy", "bare_legacy", "glyph", "has_field", "has_object")


def groups(spark, *blocks):
    return sorted(markers.marker_groups(records(spark, *blocks)).collect(), key=lambda r: (r.table_index, r.first_row))


@pytest.mark.parametrize("mark", [run("☐"), run(" ( ) "), run("✓"), BOX.format(""), OLD.format(""), SYM, DRAWN, "<w:r><w:pict/></w:r>"])
def test_every_kind_of_lone_marker(spark, mark):
    (g,) = groups(spark, p(run("Verificada a seguinte ocorrência:")), [[cell(p(mark)), cell(p(run("Atraso")))], [cell(p(mark)), cell(p(run("Falta")), p(run("de material")))]])
    assert (g.label, g.options, g.confidence, g.inferred) == ("Ocorrência verificada", ["Atraso", "Falta — de material"], 0.93, 0)


@pytest.mark.parametrize("mark", [BOX.format('<w:tag w:val="x"/>'), OLD.format("nome"), run("☐ texto"), run("☐ ☐"), run("{{checkbox:x}}"), "", "<w:r><w:drawing/><w:drawing/></w:r>"])
def test_named_boxes_texts_and_tags_are_no_markers(spark, mark):
    assert groups(spark, [[cell(p(mark)), cell(p(run("Atraso")))], [cell(p(mark)), cell(p(run("Falta")))]]) == []


def test_blank_cells_in_a_narrow_marker_column(spark):
    mark = lambda w: [cell(p(run("☐")), width=w), cell(p(run("1) Um")), width=6000)]
    rows = lambda w, text: [mark(500), [cell(p(), width=w), cell(text, width=6000)]]
    (g,) = groups(spark, rows(500, p(run("2) Dois"))))
    assert g.modes == ["text_span", "inferred_blank"] and g.confidence == 0.89 and g.inferred == 1 and g.label == "Ocorrência verificada"
    assert groups(spark, rows(500, p(run("Em negrito", bold=True))))[0].options == ["1) Um", "Em negrito"]
    assert groups(spark, rows(500, p(run("Item de lista"), numbered=True)))[0].inferred == 1
    assert groups(spark, rows(1801, p(run("2) Dois")))) == [] and groups(spark, rows(500, p(run("Texto comum")))) == []
    assert groups(spark, [mark(500), [cell(p(), width=500), cell(p(run("2) Dois")), width=1400)]]) == []
    # Widths that aren't declared don't stand in the way.
    assert groups(spark, [[cell(p(run("☐"))), cell(p(run("1) Um")))], [cell(p()), cell(p(run("2) Dois")))]])[0].inferred == 1


def test_runs_are_cut_at_gaps_and_at_eight(spark):
    mark = lambda i: [cell(p(run("☐"))), cell(p(run(f"Caso {i}")))]
    plain = [cell(p(run("Texto"))), cell(p(run("x")))]
    got = groups(spark, p(run("3. Situação do processo")), [mark(0), mark(1), plain, mark(3), plain, *[mark(i) for i in range(5, 15)]])
    assert [(g.first_row, len(g.options)) for g in got] == [(0, 2), (5, 8)] and {g.label for g in got} == {"Situação do processo"}


def test_options_end_at_follow_ups_and_are_cut(spark):
    mark = cell(p(run("☐")))
    rows = [[mark, cell(p(run("Um")), p(run("____")), p(run("Observação: ____")), p(run("não")))], [mark, cell(p(run("a" * 400)))]]
    (g,) = groups(spark, p(run("Prosa longa. " * 12)), rows)
    assert g.options == ["Um", "a" * 357 + "…"] and g.label == "Ocorrência verificada"


def test_packages_feed_layout_inference(spark):
    table = '<w:tblGrid><w:gridCol/><w:gridCol/><w:gridCol/></w:tblGrid><w:tr><w:tc><w:tcPr><w:gridSpan w:val="3"/></w:tcPr><w:p><w:r><w:t>1. Dados:</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:trPr><w:gridBefore w:val="1"/></w:trPr>' + cell(p(run("Nome: {{n}}"))) + cell(p(run("x"))) + "</w:tr>"
    raw = ooxml.packed([("word/document.xml", f"<w:document {NS}><w:body>{p(run('Título:', bold=True))}<w:tbl>{table}</w:tbl></w:body></w:document>".encode())])
    got = ooxml.parse_docx(spark.createDataFrame([("d", bytearray(raw))], "path string, content binary"))
    paragraphs, cells = ooxml.layout_inputs(got)
    assert [tuple(r) for r in paragraphs.select("text", "runs", "bold_runs").collect()] == [("Título:", 1, 1)]
    (r,) = inference.infer(paragraphs, cells).collect()
    assert (r.section, r.layout_column_index, r.layout_grid_columns, r.detected_label, r.layout_group) == ("1. Dados", 1, 3, "Nome", "doc_table_1_segment_1")


def test_lines_are_read_and_dealt_once(spark):
    from quillform.plans import markers as plan

    p = plan.marked_rows(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert p.count("FileScan") == 1 and p.count("Exchange hashpartitioning") == 1


def test_prompts_by_blocks_before(spark):
    pair = [[cell(p(run("☐"))), cell(p(run("Um")))], [cell(p(run("☐"))), cell(p(run("Dois")), p(run("  ____ ")), p(run("Observação: x")), p(run("Três")))]]
    got = groups(spark, p(run("1.  Prazo de  entrega")), pair, p(run("Nada a dizer")), pair, p(run("prosa " * 30)), pair, p(run("As SEGUINTES ocorrências:")), p(), pair)
    assert [g.label for g in got] == ["Prazo de entrega", "Prazo de entrega", "Prazo de entrega", "Ocorrências verificadas"] and {tuple(g.options) for g in got} == {("Um", "Dois")}

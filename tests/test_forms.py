"""Packages with controls, grids and text boxes; filling them; gates; tags written into texts."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quillform.operators import detectors, diagnosis, profiles
from quillform.sources import generate, ooxml

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:w14="http://schemas.microsoft.com/office/word/2010/wordml" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"'
P = "<w:p><w:r><w:t>{}</w:t></w:r></w:p>"
BODY = (
    '<w:p><w:r><w:rPr><w:color w:val="FF0000"/></w:rPr><w:t>In</w:t></w:r><w:r><w:t>formar {{a</w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:t>.b}} x</w:t></w:r></w:p>'
    '<w:p><w:r><mc:AlternateContent><mc:Choice><w:txbxContent>' + P.format("caixa {{c}}") + "</w:txbxContent></mc:Choice><mc:Fallback><w:txbxContent>" + P.format("caixa {{c}}") + "</w:txbxContent></mc:Fallback></mc:AlternateContent></w:r></w:p>"
    '<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr>' + P.format("T") + '</w:tc><w:tc><w:tcPr><w:vMerge w:val="restart"/></w:tcPr>' + P.format("U") + "</w:tc></w:tr></w:tbl>"
    '<w:sdt><w:sdtPr><w:alias w:val="uf"/><w:dropDownList><w:listItem w:displayText="PB" w:value="1"/><w:listItem w:value="PE"/></w:dropDownList></w:sdtPr><w:sdtContent>' + P.format("Escolher um item.") + "</w:sdtContent></w:sdt>"
    '<w:p><w:sdt><w:sdtPr><w:tag w:val="ok"/><w14:checkbox><w14:checked w14:val="0"/></w14:checkbox></w:sdtPr><w:sdtContent><w:r><w:t>☐</w:t></w:r></w:sdtContent></w:sdt></w:p>'
    '<w:p><w:r><w:fldChar><w:ffData><w:name w:val="velha"/><w:checkBox/></w:ffData></w:fldChar></w:r></w:p>'
)


def package(body, header=None):
    members = [("[Content_Types].xml", b"<Types/>"), ("word/document.xml", f"<w:document {NS}><w:body>{body}</w:body></w:document>".encode())]
    if header:
        members.append(("word/header1.xml", f"<w:hdr {NS}>{header}</w:hdr>".encode()))
    return ooxml.packed(members)


def test_records_of_controls_grids_and_boxes():
    rows = ooxml.records(package(BODY, P.format("topo")))
    names = [x.split(" ")[0] for x in ooxml._RECORD.split(", ")][1:-1]
    got = [dict(zip(names, r, strict=True)) for r in rows]
    assert [r["text"] for r in got] == ["Informar {{a.b}} x", "", "caixa {{c}}", "T", "U", "Escolher um item.", "☐", "", "topo"]
    assert got[0]["is_red"] and not got[2]["is_red"] and got[0]["has_marker"]
    assert [(r["grid_start"], r["grid_span"], r["v_merge"]) for r in got[3:5]] == [(0, 2, None), (2, 1, "restart")]
    assert (got[5]["control_id"], got[5]["control_kind"], got[5]["control_options"]) == ("uf", "dropdown", ["PB", "PE"])
    assert (got[6]["control_id"], got[6]["control_kind"]) == ("ok", "checkbox") and got[7]["legacy_box"] == "velha" and got[8]["story"] == "header1"


def test_filling_keeps_runs_and_sets_controls():
    made = generate.generate(package(BODY, P.format("topo {{d}}")), {"a.b": "XY", "c": "1", "d": "2", "uf": "PE", "ok": True, "velha": "sim"})
    texts = [r[8] for r in ooxml.records(made)]
    assert texts[0] == "Informar XY x" and texts[2] == "caixa 1" and texts[5] == "PE" and texts[-1] == "topo 2"
    with zipfile.ZipFile(io.BytesIO(made)) as z:
        raw = z.read("word/document.xml").decode()
    assert 'checked' in raw and "☒" in raw and raw.count("XY") == 1
    with pytest.raises(generate.Unfilled, match="left: c"):
        generate.generate(package(BODY), {"a.b": "x"})
    with pytest.raises(generate.Unfilled, match="not an option"):
        generate.generate(package(BODY), {"a.b": "x", "c": "1", "uf": "SP"})
    row = '<w:tbl><w:tr><w:tc>' + P.format("{{repeat:t}}{{row.number}} {{t.x}}") + "</w:tc></w:tr></w:tbl>"
    done = generate.generate(package(row), {"t": [{"x": "a"}, {"x": "b", "__row_number__": "9"}]})
    assert [r[8] for r in ooxml.records(done)] == ["01 a", "9 b"]
    with pytest.raises(generate.Unfilled, match="t 1: t.x"):
        generate.generate(package(row), {"t": [{}]})
    assert [r[8] for r in ooxml.records(ooxml.build_docx(["a\x01b퟿", [["c", "d"]]]))] == ["ab퟿", "c", "d"]


def test_gates(spark):
    issues = spark.createDataFrame([("t", "tag.malformed", "error", "", "9z"), ("u", "field.unused_config", "warning", "x", "")], "template_id string, code string, severity string, field_id string, detail string")
    with pytest.raises(ValueError, match="tag.malformed 9z"):
        diagnosis.require(issues)
    diagnosis.require(issues.filter("template_id = 'u'"))
    names = spark.createDataFrame([("t",), ("u",), ("v",)], "template_id string")
    assert {r.template_id for r in diagnosis.allowed(names, issues).collect()} == {"u", "v"}


def test_tags_are_written_from_the_right(spark):
    records = spark.createDataFrame([(1, 0, "UF: __ Nome: ____"), (1, 1, "  "), (1, 2, "Cargo:"), (1, 3, "fixo")], "doc int, ordinal int, text string")
    tags = spark.createDataFrame([(1, 0, 4, 6, "{{uf}}"), (1, 0, 13, 17, "{{nome}}"), (1, 1, None, None, "{{x}}"), (1, 2, None, None, "{{c}}")], "doc int, ordinal int, start int, end int, tag string")
    got = [r.text for r in detectors.apply_spans(records, tags).orderBy("ordinal").collect()]
    assert got == ["UF: {{uf}} Nome: {{nome}}", "{{x}}", "Cargo: {{c}}", "fixo"]


def test_an_empty_id_gives_way_to_an_alias(spark):
    f = spark.createDataFrame([(1, "a", "", 0), (1, "b", "a", 1), (1, "c", "k", 2), (1, "d", "k", 3)], "k int, field_id string, profile_key string, pos int")
    a = spark.createDataFrame([(1, "a", " "), (1, "b", "B"), (1, "c", ""), (1, "d", "D")], "k int, field_id string, value string")
    assert {r.name: r.value for r in profiles.payload(f, a, "k").collect()} == {"a": "B", "b": "B", "c": "", "d": "D", "k": "D"}
    assert profiles.identities(f.withColumn("label", F.lit("1. CPF")), "k").first().semantic == "cpf"

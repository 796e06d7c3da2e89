"""Edits of split runs, and packages that keep all else."""

import io
import random
import re
import zipfile

from quillform.operators import edits
from quillform.sources import ooxml, pieces

EDIT = "doc string, ordinal int, op string, start int, end int, text string"
#: As word processors write it: prefixes that only values of attributes name, properties, breaks, a text box, a fallback.
REAL = (
    '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:w14="http://schemas.microsoft.com/office/word/2010/wordml" '
    'xmlns:wp14="http://schemas.microsoft.com/office/word/2010/wordprocessingDrawing" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006" mc:Ignorable="w14 wp14"><w:body>'
    '<w:p w14:paraId="1"><w:pPr><w:tabs><w:tab w:val="left"/></w:tabs></w:pPr><w:r><w:rPr><w:b/></w:rPr><w:t>Olá {{no</w:t></w:r><w:r><w:t>me}}</w:t><w:br/><w:t xml:space="preserve"> &amp; {{x}} </w:t></w:r></w:p>'
    '<w:p/><w:p><w:r><mc:AlternateContent><mc:Choice Requires="wps"><w:txbxContent><w:p><w:r><w:t>caixa {{x}}</w:t></w:r></w:p></w:txbxContent></mc:Choice><mc:Fallback><w:p><w:r><w:t>{{x}}</w:t></w:r></w:p></mc:Fallback></mc:AlternateContent></w:r><w:r><w:tab/><w:t/></w:r></w:p>'
    '<w:p><w:r><w:t>fim</w:t></w:r></w:p></w:body></w:document>'
)


def package(xml=REAL):
    return ooxml.packed([("[Content_Types].xml", b"<Types/>"), ("word/document.xml", xml.encode()), ("word/media/a.bin", b"\x00\x01")])


def xml_of(content):
    return zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml").decode()


def files(spark, *contents):
    return spark.createDataFrame([(f"d{i}", bytearray(c)) for i, c in enumerate(contents)], "doc string, content binary")


def changed(spark, content, rows):
    f = files(spark, content)
    nodes = pieces.parse(f)
    e = spark.createDataFrame(rows, EDIT)
    assert edits.problems(edits.offsets(nodes), e).count() == 0
    return pieces.write(f, edits.apply(edits.offsets(nodes), e), edits.removed(e)).first().content


def test_nodes_count_breaks_and_skip_fallbacks():
    got = pieces.read(package())
    assert got == [(0, 0, "t", "Olá {{no"), (0, 1, "t", "me}}"), (0, 2, "gap", "\n"), (0, 3, "t", " & {{x}} "), (2, 0, "gap", "\t"), (2, 1, "t", ""), (3, 0, "t", "caixa {{x}}"), (4, 0, "t", "fim")]


def test_tags_in_split_runs_are_filled_and_all_else_stays(spark):
    f = files(spark, package())
    nodes = pieces.parse(f)
    answers = spark.createDataFrame([("d0", "nome", "Ana <1>"), ("d0", "x", "Z")], "doc string, field_id string, value string")
    e = edits.fill(nodes, answers)
    assert edits.unfilled(nodes, e).count() == 0 and edits.problems(edits.offsets(nodes), e).count() == 0
    made = pieces.write(f, edits.apply(edits.offsets(nodes), e), edits.removed(e)).first().content
    want = REAL.replace("<w:t>Olá {{no</w:t>", '<w:t xml:space="preserve">Olá Ana &lt;1&gt;</w:t>').replace("<w:t>me}}</w:t>", '<w:t xml:space="preserve"></w:t>').replace('<w:t xml:space="preserve"> &amp; {{x}} </w:t>', '<w:t xml:space="preserve"> &amp; Z </w:t>')
    assert xml_of(made) == want.replace("<w:t>caixa {{x}}</w:t>", '<w:t xml:space="preserve">caixa Z</w:t>')
    assert zipfile.ZipFile(io.BytesIO(made)).read("word/media/a.bin") == b"\x00\x01"


def test_operations(spark):
    got = changed(spark, package(), [("d0", 0, "replace", None, None, "novo"), ("d0", 1, "append", None, None, "{{a}}"), ("d0", 3, "append", None, None, "{{b}}"), ("d0", 4, "remove", None, None, None)])
    xml = xml_of(got)
    assert '<w:t xml:space="preserve">novo</w:t>' in xml and "Olá" not in xml and "fim" not in xml
    assert '<w:p><w:r><w:t xml:space="preserve">{{a}}</w:t></w:r></w:p>' in xml and "caixa {{x}}</w:t></w:r><w:r><w:t xml:space=\"preserve\"> {{b}}</w:t>" in xml
    assert "<mc:Fallback><w:p><w:r><w:t>{{x}}" in xml and re.findall('xmlns:[a-z0-9]+="[^"]*"', xml) == re.findall('xmlns:[a-z0-9]+="[^"]*"', REAL)


def test_spans_against_brute_force(spark):
    rng = random.Random(3)
    nodes, rows, want = [], [], {}
    for d in range(40):
        texts = ["".join(rng.choice("abc") for _ in range(rng.choice((0, 1, 3, 6)))) for _ in range(5)]
        nodes += [(f"d{d}", 0, k, "t", t) for k, t in enumerate(texts)]
        owner = [k for k, t in enumerate(texts) for _ in t]
        whole, at, out = "".join(texts), 0, [""] * 5
        while at < len(whole):
            if rng.random() < 0.3:
                end = min(len(whole), at + rng.choice((1, 2, 5)))
                rows.append((f"d{d}", 0, "span", at, end, f"<{at}>"))
                out[owner[at]] += f"<{at}>"
                at = end
            else:
                out[owner[at]] += whole[at]
                at += 1
        want |= {(f"d{d}", k): t for k, t in enumerate(out) if t != texts[k]}
    n = edits.offsets(spark.createDataFrame(nodes, "doc string, ordinal int, node int, kind string, text string"))
    e = spark.createDataFrame(rows, EDIT)
    assert edits.problems(n, e).count() == 0
    assert {(r.doc, r.node): r.text for r in edits.apply(n, e).collect()} == want


def test_problems(spark):
    n = edits.offsets(spark.createDataFrame([("d", 0, 0, "t", "abc"), ("d", 0, 1, "gap", "\n"), ("d", 0, 2, "t", "de")], "doc string, ordinal int, node int, kind string, text string"))
    rows = [("d", 0, "span", 0, 2, "x"), ("d", 0, "span", 1, 3, "y"), ("d", 0, "span", 3, 4, "z"), ("d", 0, "span", 5, 9, "z"), ("d", 0, "span", 2, 2, "z"), ("d", 0, "cut", None, None, "z"), ("d", 1, "span", 0, 1, "z"), ("d", 0, "append", None, None, None), ("d", 9, "remove", None, None, None)]
    got = sorted((r.ordinal, r.op, r.start or 0, r.problem) for r in edits.problems(n, spark.createDataFrame(rows, EDIT)).collect())
    assert got == [(0, "append", 0, "no text"), (0, "cut", 0, "unknown operation"), (0, "span", 1, "overlap"), (0, "span", 2, "no span"), (0, "span", 3, "no text there"), (0, "span", 5, "no text there"), (1, "span", 0, "no text there")]


def test_candidates_become_edits(spark):
    place = "array<struct<ordinal:int,start:int,end:int,field_id:string>>"
    c = spark.createDataFrame(
        [
            ("d", "paragraph_block", "o", "{{single_choice:o|A|B}}", [(0, None, None, None), (1, None, None, None), (2, None, None, None)]), ("d", "checkbox_group", None, None, [(3, None, None, "s"), (4, None, None, "n")]),
            ("d", "checkbox_spans", None, None, [(5, 0, 1, "p"), (5, 6, 7, "q"), (6, None, None, "r")]), ("d", "text_span", "t", "{{t}}", [(7, 6, 10, None)]), ("d", "append_tag", "u", "{{u}}", [(8, None, None, None)]), ("d", "empty_cell", "v", "{{v}}", [(9, None, None, None)]),
        ],
        f"doc string, kind string, field_id string, tag string, places {place}",
    )
    texts = ["A", "OU", "B", "☐ Sim", "( ) Não", "☐ Um  ☐ Dois", "", "Nome: ____", "Data", ""]
    r = spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], "doc string, ordinal int, text string")
    got = sorted((x.ordinal, x.op, x.start, x.end, x.text) for x in edits.from_candidates(c, r).collect())
    assert got == [
        (0, "replace", None, None, "{{single_choice:o|A|B}}"), (1, "remove", None, None, None), (2, "remove", None, None, None), (3, "replace", None, None, "{{checkbox:s}} Sim"), (4, "replace", None, None, "{{checkbox:n}} Não"), (5, "span", 0, 1, "{{checkbox:p}}"),
        (5, "span", 6, 7, "{{checkbox:q}}"), (6, "replace", None, None, "{{checkbox:r}}"), (7, "span", 6, 10, "{{t}}"), (8, "append", None, None, "{{u}}"), (9, "replace", None, None, "{{v}}"),
    ]


def test_accepted_sets_are_held_to_their_rules(spark):
    rows = [
        ("d", "a", "mask", "text", None, None, None), ("d", "a", "mask", "text", None, None, None), ("d", " ", "mask", "text", None, None, None), ("d", "t", "repeatable_table", "repeatable_table", None, ["x", "x"], None), ("d", "u", "repeatable_table", "repeatable_table", None, ["x", ""], None),
        ("d", "l", "mask", "dropdown", ["A", " A ", ""], None, None), ("d", None, "checkbox_choice", "checkbox", None, None, ["s", "", "e"]), ("e", "s", "checkbox_choice", "checkbox", None, None, ["s", "s"]), ("e", "a", "mask", "dropdown", ["A", "B"], None, None),
    ]
    got = sorted((r.doc, r.field_id, r.problem) for r in edits.accepted_problems(spark.createDataFrame(rows, "doc string, field_id string, source string, type string, options array<string>, columns array<string>, fields array<string>")).collect())
    assert got == [("d", "", "no id"), ("d", "", "option without id"), ("d", "a", "repeated id"), ("d", "l", "too few options"), ("d", "t", "repeated columns"), ("d", "u", "no valid columns"), ("e", "s", "repeated id")]


def test_damaged_packages_have_no_nodes(spark):
    assert pieces.parse(files(spark, b"PK no", package("<x"))).count() == 0


def test_completed_documents_keep_declarations():
    from quillform.sources.generate import generate

    got = xml_of(generate(package(), {"nome": "Ana", "x": "Z"}))
    declared = lambda xml: sorted(re.findall(r'xmlns:[a-z0-9]+="[^"]*"', xml))
    assert declared(got) == declared(REAL) and 'mc:Ignorable="w14 wp14"' in got and "ns0:" not in got and "Olá Ana" in got
    # Twice filled is filled the same way.
    assert xml_of(generate(generate(package(), {"nome": "Ana", "x": "Z"}), {})) == got


def test_filled_nodes_are_not_joined_with_themselves(spark):
    nodes = spark.createDataFrame([(1, 0, 0, "t", "a {{"), (1, 0, 1, "t", "x}} {{y}}"), (1, 0, 2, "br", "\n"), (1, 0, 3, "t", "{{x}}"), (2, 0, 0, "t", "b")], "doc int, ordinal int, node int, kind string, text string")
    answers = spark.createDataFrame([(1, "x", "11")], "doc int, field_id string, value string")
    df = edits.filled(nodes, answers)
    assert sorted(map(tuple, df.collect())) == [(1, 0, 0, "a 11"), (1, 0, 1, " {{y}}"), (1, 0, 2, "\n"), (1, 0, 3, "11"), (2, 0, 0, "b")]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2


def test_open_tags_are_found_without_shuffling_nodes(spark):
    texts = ["a {{nome}} {{checkbox:x}}{{default_or_text:d|sim}}{{repeat:r}} {{ y }}{{y}}", "sem", "{{default_or_text:e| }}"]
    rows = [(1, i, [(0, "t", t[:4]), (1, "t", t[4:])]) for i, t in enumerate(texts)] + [(2, 0, [(0, "t", "{{x}}")])]
    whole = spark.createDataFrame(rows, "doc long, ordinal int, nodes array<struct<node:int,kind:string,text:string>>")
    nodes = whole.selectExpr("doc", "ordinal", "inline(nodes)")
    answers = spark.createDataFrame([(1, "x", None), (1, "x", "sim"), (1, "y", None), (2, "x", None)], "doc long, field_id string, value string")
    want = sorted(map(tuple, edits.unfilled(nodes, edits.fill(nodes, answers)).collect()))
    assert want == [(1, "default_or_text:e|"), (1, "nome"), (1, "y"), (2, "x")]
    for n in (nodes, whole):
        assert sorted(map(tuple, edits.open_tags(n, answers).collect())) == want
    assert "Exchange" not in edits.paragraphs(whole)._jdf.queryExecution().executedPlan().toString()

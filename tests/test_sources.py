import json
import zipfile

from pyspark.sql import functions as F

from quillform.sources import ooxml, packages, stores
from quillform.streaming import upserts

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
BODY = f"""<w:document {W}><w:body>
<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:rPr><w:b/></w:rPr><w:t>1. Dados</w:t></w:r></w:p>
<w:p><w:r><w:t>Nome: {{{{</w:t></w:r><w:r><w:t>cliente.nome}}}}</w:t></w:r></w:p>
<w:tbl><w:tr><w:tc><w:p><w:r><w:t>A</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>B</w:t><w:br/><w:t>C</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p/></w:tc></w:tr></w:tbl>
<w:sdt><w:sdtPr><w:tag w:val="data.inicio"/></w:sdtPr><w:sdtContent><w:p><w:r><w:t>controle</w:t></w:r></w:p></w:sdtContent></w:sdt>
</w:body></w:document>"""


def test_docx_records(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", BODY)
        z.writestr("word/header1.xml", f"<w:hdr {W}><w:p><w:r><w:t>topo</w:t></w:r></w:p></w:hdr>")
    (tmp_path / "b.docx").write_bytes(b"no archive")
    rows = ooxml.read_docx(spark, str(tmp_path)).orderBy("path", "ordinal").collect()
    got = [(r.ordinal, r.story, r.table_index, r.row_index, r.cell_index, r.text, r.control_id) for r in rows if r.error is None]
    assert got == [
        (0, "document", None, None, None, "1. Dados", None), (1, "document", None, None, None, "Nome: {{cliente.nome}}", None), (2, "document", 0, 0, 0, "A", None), (3, "document", 0, 0, 1, "B\nC", None),
        (4, "document", 0, 1, 0, "", None), (5, "document", None, None, None, "controle", "data.inicio"), (6, "header1", None, None, None, "topo", None),
    ]
    assert rows[0].is_bold and rows[0].style == "Heading1"
    assert [r.error.split(":")[0] for r in rows if r.error] == ["BadZipFile"]


def test_docx_is_deterministic_and_checked(spark):
    assert ooxml.build_docx(["a & <b>"]) == ooxml.build_docx(["a & <b>"])
    row = ooxml.check_docx(ooxml.to_docx(spark.createDataFrame([(1, "x\ny")], "k int, t string"), "k", "t")).select(F.col("problem").isNull().alias("ok"), "content").first()
    assert row.ok and [r[8] for r in ooxml.records(bytes(row.content))] == ["x", "y"]


def test_stores(spark, tmp_path):
    for name, value in {"ok": {"schema_version": 1, "kind": "profiles", "data": [1]}, "new": {"schema_version": 2, "kind": "profiles", "data": []}, "other": {"schema_version": 1, "kind": "x", "data": []}, "raw": [{"id": 1}]}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
    (tmp_path / "bad.json").write_text("{")
    got = {r.path.rsplit("/", 1)[1]: (r.status, r.schema_version, r.data) for r in stores.read_store(spark, str(tmp_path), "profiles").collect()}
    assert got["ok.json"] == ("ok", 1, "[1]") and got["raw.json"][:2] == ("migrated", 0) and got["new.json"][0] == "too new" and got["other.json"][0] == "wrong kind" and got["bad.json"][0] == "broken"
    out = stores.envelope(spark.createDataFrame([("[1]",)], "data string"), "profiles").first().value
    assert json.loads(out) == {"schema_version": 1, "kind": "profiles", "data": [1]}


def test_template_folders(spark, tmp_path):
    for folder, value in {"b": {"id": "b", "name": "beta"}, "a": {"template": {"id": "a", "name": "Alpha", "version": "2"}}, "_hidden": {"id": "h"}}.items():
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "template.json").write_text(json.dumps(value))
    assert [(r.id, r.name, r.version) for r in stores.list_templates(spark, str(tmp_path)).collect()] == [("a", "Alpha", "2"), ("b", "beta", None)]


def test_pasted_tables(spark):
    df = spark.createDataFrame([(1, "a\tb\tc\r\n\r\n d ")], "k int, t string")
    assert [tuple(r) for r in stores.paste_tsv(df, "k", "t", ["x", "y"]).collect()] == [(1, 0, "a", "b"), (1, 1, "d", "")]


def test_streamed_upserts_survive_a_restart(spark, tmp_path):
    source, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    schema = "k string, at int, v string"
    for n, rows in enumerate([[("a", 1, "x"), ("b", 1, "w")], [("a", 3, "z"), ("a", 2, "y")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(source / f"p{n}"))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(source))
        upserts.upsert_stream(stream, ["k"], "at", out, ck).awaitTermination()
    assert {tuple(r) for r in upserts.read_latest(spark, out).select("k", "at", "v").collect()} == {("a", 3, "z"), ("b", 1, "w")}
    # The second batch rewrote the bucket of its key only; the first version's stays behind it.
    by = upserts._paths(spark, out)
    assert sorted(len(v) for v in by.values()) == [1, 2]
    assert {tuple(r) for r in upserts.read_latest(spark, out, before=1).select("k", "at", "v").collect()} == {("a", 1, "x"), ("b", 1, "w")}


def test_windowed_counts(spark, tmp_path):
    spark.createDataFrame([(1, "2024-01-01 00:10:00", "a"), (2, "2024-01-01 00:20:00", "a"), (3, "2024-01-01 01:10:00", "b"), (4, "2024-01-03 00:00:00", "b")], "id int, ts string, kind string").selectExpr("id", "cast(ts as timestamp_ntz) ts", "kind").write.parquet(str(tmp_path / "e"))
    events = spark.readStream.schema("id int, ts timestamp_ntz, kind string").parquet(str(tmp_path / "e"))
    q = upserts.windowed_counts(events, "ts", "kind").writeStream.format("memory").queryName("counts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.kind, r.n) for r in spark.table("counts").collect()} == {("a", 2), ("b", 1)}


def test_packages(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "ok.zip", "w") as z:
        z.writestr("a/b.txt", "x" * 50)
        z.writestr("c.txt", "y")
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../evil.txt", "x")
    (tmp_path / "no.zip").write_bytes(b"nothing")
    got = {r.path.rsplit("/", 1)[1]: (r.entries, r.bytes, r.problem) for r in packages.limits(packages.read_entries(spark, str(tmp_path))).collect()}
    assert got == {"ok.zip": (2, 51, None), "bad.zip": (1, 1, "unsafe path"), "no.zip": (0, 0, "broken")}


def test_fingerprints_ignore_what_is_outside_word(spark, tmp_path):
    for name, extra, body in (("a", "1", "same"), ("b", "2", "same"), ("c", "1", "other")):
        with zipfile.ZipFile(tmp_path / f"{name}.docx", "w") as z:
            z.writestr("docProps/x.xml", extra)
            z.writestr("word/document.xml", body)
    got = {r.path.rsplit("/", 1)[1]: r.fingerprint for r in packages.fingerprints(spark, str(tmp_path)).collect()}
    assert got["a.docx"] == got["b.docx"] != got["c.docx"]


def test_packages_are_dealt_to_all_tasks_and_opened_once(spark):
    from pyspark.sql import functions as F

    from quillform.sources import backup, generate, ooxml

    rows = spark.range(0, 40, 1, 1).select(F.col("id").cast("string").alias("id"), F.lit("a {{x}}").alias("text"), F.lit(ooxml.build_docx(["a {{x}}"])).alias("source"), F.lit('{"x": "1"}').alias("config"))
    packages = backup.export_packages(rows)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for made in (ooxml.to_docx(rows, "id", "text"), generate.documents(rows, "id", "source", "config"), packages):
        assert made.rdd.getNumPartitions() == parts and made.count() == 40
    got = backup.import_packages(packages.withColumnRenamed("id", "path"), spark.createDataFrame([], "fingerprint string"))
    assert "MapInArrow" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.filter("problem IS NULL").count() == 1 and got.filter("problem = 'duplicate'").count() == 39

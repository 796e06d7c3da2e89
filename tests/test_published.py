"""Versions that are seen whole, and backups that are kept whole."""

import glob
import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from quillform.sources import backup, cache, ooxml, published


def test_versions_follow_each_other_and_old_ones_stay_readable(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    with pytest.raises(FileNotFoundError):
        published.read(spark, root)
    assert [published.publish(spark.range(n), root, keep=3) for n in (1, 2, 3, 4)] == [1, 2, 3, 4]
    assert published.read(spark, root).count() == 4 and published.read(spark, root, 3).count() == 3
    assert [n for n, _ in published.history(spark, root)] == [2, 3, 4]
    assert published.restore(spark, root, 2) == 5 and published.read(spark, root).count() == 2
    with pytest.raises(FileNotFoundError):
        published.restore(spark, root, 1)


def test_a_lost_task_leaves_the_old_version(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    published.publish(spark.range(10), root)
    # One of eight tasks dies after others have written.
    bad = spark.range(0, 80, 1, 8).select(F.when(F.col("id") == 75, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        published.publish(bad, root)
    assert published.read(spark, root).count() == 10 and [n for n, _ in published.history(spark, root)] == [1]
    assert len(glob.glob(f"{tmp_path}/t/data-*")) == 1


def test_half_written_version_files_are_passed_over(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    published.publish(spark.range(10), root)
    (tmp_path / "t" / "_versions" / f"{2:012d}").write_text('{"folders": ["data-')
    assert published.read(spark, root).count() == 10


def test_versions_that_extend_share_folders(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    for n in (1, 2, 3, 4):
        published.publish(spark.range(n), root, extend=True)
    assert published.read(spark, root).count() == 10 and published.read(spark, root, 3).count() == 6 and len(glob.glob(f"{tmp_path}/t/data-*")) == 4
    published.publish(spark.range(5), root)
    published.publish(spark.range(6), root)
    assert published.read(spark, root, 5).count() == 5 and len(glob.glob(f"{tmp_path}/t/data-*")) == 2


def test_analyses_are_made_once_per_file_and_rules(spark, tmp_path):
    folder, root = tmp_path / "in", f"file://{tmp_path}/cache"
    folder.mkdir()
    for i in range(6):
        (folder / f"{i}.docx").write_bytes(ooxml.build_docx([f"texto {i}", "{{x}}"]))
    (folder / "broken.docx").write_bytes(b"no")
    seen = spark.sparkContext.accumulator(0)

    def analyse(files):
        def count(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        return ooxml.parse_docx(files.select("path", "content").mapInArrow(count, "path string, content binary")).select("path", "ordinal", "text")

    run = lambda rules: sorted((r.path.rpartition("/")[2], r.ordinal or 0, r.text) for r in cache.analysed(spark, f"file://{folder}", "*.docx", analyse, root, rules).collect())
    first = run("1")
    assert len(first) == 13 and seen.value == 7 and run("1") == first and seen.value == 7
    (folder / "0.docx").write_bytes(ooxml.build_docx(["outro texto", "{{yy}}"]))
    (folder / "1.docx").unlink()
    (folder / "7.docx").write_bytes(ooxml.build_docx(["novo"]))
    second = run("1")
    assert seen.value == 9 and {r[0] for r in second} == {"0.docx", "2.docx", "3.docx", "4.docx", "5.docx", "7.docx", "broken.docx"} and ("0.docx", 0, "outro texto") in second
    assert run("2") == second and seen.value == 16


def test_audits_and_conflicts(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    audit = lambda rows: rows.filter("id > 5")
    assert published.publish(spark.range(3), root, audit, expected=0) == 1
    with pytest.raises(published.Rejected, match="6"):
        published.publish(spark.range(9), root, audit)
    with pytest.raises(published.Conflict):
        published.publish(spark.range(2), root, expected=0)

    def meanwhile(rows):
        published._commit(spark, root, 2, {"folders": ["data-x"], "at": 0})
        return rows.limit(0)

    with pytest.raises(published.Conflict):
        published.publish(spark.range(2), root, meanwhile, expected=1)
    assert len(glob.glob(f"{tmp_path}/t/data-*")) == 1


FILES = [("templates", f"t{i}/template.json", bytearray(f"{{{i}}}".encode() * 50)) for i in range(20)] + [("data", "x.bin", bytearray(b"\x00\xff")), ("data", "empty", bytearray()), ("data", "null", None)]


def test_backups_round_trip(spark, tmp_path):
    path = str(tmp_path / "b")
    files = spark.createDataFrame(FILES, backup.SCHEMA)
    backup.save(files.repartition(3), path)
    got = {(r.folder, r.name): bytes(r.content) for r in backup.load(spark, path).collect()}
    assert got == {(f, n): bytes(c or b"") for f, n, c in FILES} and not glob.glob(f"{path}/.volume*")
    root = f"file://{tmp_path}/t"
    assert backup.restore(spark, path, root, ["templates", "data"]) == 1 and published.read(spark, root).count() == len(FILES)
    backup.save(files.limit(0), str(tmp_path / "none"))
    assert backup.load(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("limits", [{"entries": 22}, {"bytes": 1000}, {"entry_bytes": 100}])
def test_backups_over_a_limit_leave_nothing(spark, tmp_path, limits):
    path = str(tmp_path / "b")
    with pytest.raises(Exception, match="over"):
        backup.save(spark.createDataFrame(FILES, backup.SCHEMA).repartition(4), path, **limits)
    assert not os.path.exists(f"{path}/{backup.MANIFEST}") and not glob.glob(f"{path}/volume*")


def test_unsafe_names_damaged_volumes_and_failed_restores(spark, tmp_path):
    with pytest.raises(Exception, match="unsafe"):
        backup.save(spark.createDataFrame([("a", "../b", bytearray(b"x"))], backup.SCHEMA), str(tmp_path / "u"))
    path, root = str(tmp_path / "b"), f"file://{tmp_path}/t"
    backup.save(spark.createDataFrame(FILES, backup.SCHEMA).coalesce(1), path)
    backup.restore(spark, path, root, ["templates", "data"])
    with pytest.raises(published.Rejected, match="unknown folder"):
        backup.restore(spark, path, root, ["templates"])
    with pytest.raises(published.Rejected, match="missing folder"):
        backup.restore(spark, path, root, ["templates", "data", "more"])
    (volume,) = glob.glob(f"{path}/volume*")
    with open(volume, "r+b") as f:
        f.seek(40)
        f.write(b"!!")
    with pytest.raises(Exception, match="damaged"):
        backup.restore(spark, path, root, ["templates", "data"])
    assert published.read(spark, root).count() == len(FILES) and [n for n, _ in published.history(spark, root)] == [1]


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, c in members.items():
            z.writestr(n.replace("__", "/").replace("_dot_", "."), c)
    return bytearray(out.getvalue())


def test_packages_are_imported_once(spark):
    a, b, c = (ooxml.build_docx([t]) for t in "abc")
    t = spark.createDataFrame([("x", '{"template":{"name":"X"}}', bytearray(a))], "id string, config string, source binary")
    made = backup.export_packages(t).first().content
    rows = [
        ("1", bytearray(made)), ("2", bytearray(made)), ("3", zipped(f__template_dot_json="{}", f__template_dot_docx=b)), ("4", zipped(template_dot_json='{"source_file":"q.docx"}', q_dot_docx=c, z_dot_docx=b)), ("5", zipped(template_dot_json="{}", q_dot_docx=a, z_dot_docx=b)),
        ("6", zipped(a__template_dot_json="{}", b__template_dot_json="{}")), ("7", bytearray(b"no")), ("8", zipped(template_dot_json="no", template_dot_docx=b)), ("9", None),
    ]
    existing = spark.createDataFrame([(backup._fingerprint(c),)], "fingerprint string")
    got = {r.path: r for r in backup.import_packages(spark.createDataFrame(rows, "path string, content binary"), existing).collect()}
    assert {k: r.problem for k, r in got.items()} == {"1": None, "2": "duplicate", "3": None, "4": "duplicate", "5": "not one DOCX", "6": "no template.json", "7": "no package", "8": "broken template.json", "9": "no package"}
    assert bytes(got["1"].source) == a and got["1"].config == '{"template":{"name":"X"}}'

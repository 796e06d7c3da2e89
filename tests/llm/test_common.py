import pyarrow.fs as pafs
import pytest

from quillform.llm import common


@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_paths_get_their_file_system(spark, tmp_path, scheme):
    assert common.qualified(spark, f"{scheme}{tmp_path}/x/") == f"file://{tmp_path}/x"
    assert pafs.FileSystem.from_uri(common.qualified(spark, f"{scheme}{tmp_path}/x"))[1] == f"{tmp_path}/x"


def test_materialize_and_files(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(common, "shared_folder", lambda s: f"file://{tmp_path}")
    df = common.materialize(spark.range(5), "t")
    assert df.count() == 5 and "quillform-t-" in df.inputFiles()[0] and str(tmp_path) in df.inputFiles()[0]
    root = common.scratch(spark, "f")
    common.put_file(root, "a", b"1")
    common.put_file(root, "a", b"2")
    assert common.get_file(root, "a") == b"2"
    common.remove(spark, root)
    assert not (tmp_path / root.rsplit("/", 1)[1]).exists()


def test_running_sums(spark):
    df = spark.createDataFrame([(list(range(200)),), ([],), ([7],)], "n array<int>")
    got = [r.s for r in common.running(df, "n", "s").collect()]
    assert got == [[sum(range(i)) for i in range(200)], [], [0]]


def test_words(spark):
    df = spark.createDataFrame([(" a\tb\x0bc d \n",), ("",), (None,)], "t string")
    assert [r.w for r in df.select(common.words(df["t"]).alias("w")).collect()] == [["a", "b", "c d"], [], []]


def test_packed_rows_come_back(spark):
    df = spark.createDataFrame([(1, "x", "y")], "`odd name` int, quill_row string, text string")
    out = common.unpacked(common.packed(df), text=common.F.lit("z"))
    assert out.columns == df.columns and tuple(out.first()) == (1, "x", "z")

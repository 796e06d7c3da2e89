"""Backups as a data source: files (folder, name, content) in volumes of ZIP, committed whole or not at all.

``df.write.format("quill_backup").save(path)``; ``spark.read.format("quill_backup").load(path)``. Each task writes a volume under a
temporary name and reports its entries and bytes. Only when all have, and the limits hold, are volumes renamed and named by a manifest;
otherwise they are deleted. The reader has a partition per volume of the manifest, and sees nothing of a backup without one.
Limits hold while streaming: a task stops at the entry that would break one.
"""

from __future__ import annotations

import hashlib
import io
import json
import uuid
import zipfile
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..operators.graph import stored
from .packages import MAX_ENTRIES, MAX_ENTRY, MAX_TOTAL

SCHEMA = "folder string, name string, content binary"
MANIFEST = "backup.json"
VERSION = 1


class Limit(ValueError):
    """A backup that is larger than it may be, or that holds an unsafe name."""


@dataclass
class Volume(WriterCommitMessage):
    temp: str
    entries: int
    size: int
    digest: str


@dataclass
class VolumePartition(InputPartition):
    name: str
    digest: str


def _unsafe(name: str) -> bool:
    parts = name.replace("\\", "/").split("/")
    return name.startswith(("/", "\\")) or ".." in parts or ":" in name or "" in parts


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


class _Writer(DataSourceWriter):
    def __init__(self, path: str, limits: tuple[int, int, int]):
        self.path, self.limits = path, limits

    def write(self, iterator):
        entries, total, largest = self.limits
        out, seen, size = io.BytesIO(), 0, 0
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for row in iterator:
                name, content = f"{row.folder}/{row.name}", bytes(row.content or b"")
                seen, size = seen + 1, size + len(content)
                if _unsafe(name):
                    raise Limit(f"unsafe name {name!r}")
                if seen > entries or size > total or len(content) > largest:
                    raise Limit(f"{name}: over {entries} entries, {total} bytes or {largest} bytes an entry")
                z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), content, zipfile.ZIP_DEFLATED)
        raw, temp = out.getvalue(), f".volume-{uuid.uuid4().hex}.tmp"
        if seen:
            fs, at = _open(self.path)
            fs.create_dir(at, recursive=True)
            with fs.open_output_stream(f"{at}/{temp}", compression=None) as f:
                f.write(raw)
        return Volume(temp, seen, size, hashlib.sha256(raw).hexdigest())

    def commit(self, messages):
        made = [m for m in messages if m is not None and m.entries]
        if sum(m.entries for m in made) > self.limits[0] or sum(m.size for m in made) > self.limits[1]:
            self.abort(messages)
            raise Limit(f"over {self.limits[0]} entries or {self.limits[1]} bytes in all")
        fs, at = _open(self.path)
        fs.create_dir(at, recursive=True)
        mark, listed = uuid.uuid4().hex[:8], []
        for k, m in enumerate(made):
            name = f"volume-{mark}-{k:05d}.zip"
            fs.move(f"{at}/{m.temp}", f"{at}/{name}")
            listed.append({"name": name, "entries": m.entries, "bytes": m.size, "sha256": m.digest})
        with fs.open_output_stream(f"{at}/.{MANIFEST}.tmp", compression=None) as f:
            f.write(json.dumps({"version": VERSION, "volumes": listed}).encode())
        fs.move(f"{at}/.{MANIFEST}.tmp", f"{at}/{MANIFEST}")

    def abort(self, messages):
        fs, at = _open(self.path)
        for m in messages:
            if m is not None and m.entries and fs.get_file_info(f"{at}/{m.temp}").type != pafs.FileType.NotFound:
                fs.delete_file(f"{at}/{m.temp}")


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        fs, at = _open(self.path)
        with fs.open_input_stream(f"{at}/{MANIFEST}", compression=None) as f:
            told = json.loads(f.read())
        if told["version"] > VERSION:
            raise Limit(f"backup of version {told['version']}, {VERSION} is known")
        return [VolumePartition(v["name"], v["sha256"]) for v in told["volumes"]]

    def read(self, partition):
        if partition is None:  # a backup without volumes
            return
        fs, at = _open(self.path)
        with fs.open_input_stream(f"{at}/{partition.name}", compression=None) as f:
            raw = f.read()
        if hashlib.sha256(raw).hexdigest() != partition.digest:
            raise Limit(f"{partition.name} is damaged")
        schema = pa.schema([("folder", pa.string()), ("name", pa.string()), ("content", pa.binary())])
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            for i in z.infolist():
                if _unsafe(i.filename) or i.file_size > MAX_ENTRY:
                    raise Limit(f"{i.filename!r} can't be restored")
                folder, _, name = i.filename.partition("/")
                yield pa.RecordBatch.from_arrays([pa.array([folder]), pa.array([name]), pa.array([z.read(i)], pa.binary())], schema=schema)


class BackupSource(DataSource):
    """``quill_backup``; options ``entries``, ``bytes`` and ``entry_bytes`` set limits under the fixed ones."""

    @classmethod
    def name(cls):
        return "quill_backup"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite):
        limit = lambda name, most: min(int(self.options.get(name, most)), most)
        return _Writer(self.options["path"], (limit("entries", MAX_ENTRIES), limit("bytes", MAX_TOTAL), limit("entry_bytes", MAX_ENTRY)))


def register(spark: SparkSession) -> None:
    from ..deploy import ship

    ship(spark)
    spark.dataSource.register(BackupSource)


def save(files: DataFrame, path: str, **limits: int) -> None:
    """Back up files (folder, name, content); nothing is left of a backup that fails."""
    register(files.sparkSession)
    files.select("folder", "name", "content").write.format("quill_backup").mode("append").options(**{k: str(v) for k, v in limits.items()}).save(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("quill_backup").load(path)


def restore(spark: SparkSession, path: str, root: str, folders: list[str]) -> int:
    """Publish a backup's files as the next version of the table at ``root``, all folders at once; the version before stays.

    Repeated names and folders that are missing or unknown are problems, and a damaged volume fails: then nothing changes.
    """
    from . import published

    def audit(rows: DataFrame) -> DataFrame:
        twice = rows.groupBy("folder", "name").count().filter("count > 1").select("folder", "name", F.lit("repeated").alias("problem"))
        strange = rows.filter(~F.col("folder").isin(folders)).select("folder", "name", F.lit("unknown folder").alias("problem"))
        known = rows.select("folder").distinct()
        missing = spark.createDataFrame([(f,) for f in folders], "folder string").join(known, "folder", "left_anti").select("folder", F.lit(None).cast("string").alias("name"), F.lit("missing folder").alias("problem"))
        return twice.unionByName(strange).unionByName(missing)

    return published.publish(load(spark, path), root, audit)


#: Rows and bytes of sources that a batch of imported packages holds.
IMPORT_ROWS, IMPORT_BYTES = 64, 32 << 20


def import_packages(packages: DataFrame, existing: DataFrame) -> DataFrame:
    """(path, config, source, fingerprint, problem) of template packages (path, content): ``template.json`` (at the top or in the one folder
    that has one) and the one DOCX beside it.

    ``existing`` has the fingerprints that the store holds: a package with a known one, and all but the first (by path) of equal
    ones, are duplicates. The fingerprint is that of the DOCX's ``word/`` parts.
    """
    schema = "path string, config string, source binary, fingerprint string, problem string"

    def one(raw: bytes | None):
        try:
            with zipfile.ZipFile(io.BytesIO(raw or b"")) as z:
                infos = [i for i in z.infolist() if not i.is_dir()]
                if len(infos) > MAX_ENTRIES or sum(i.file_size for i in infos) > MAX_TOTAL or any(i.file_size > MAX_ENTRY for i in infos):
                    return None, None, None, "too large"
                if any(_unsafe(i.filename) for i in infos):
                    return None, None, None, "unsafe path"
                found = [i.filename for i in infos if i.filename.rpartition("/")[2] == "template.json"]
                top = [n for n in found if n == "template.json"] or found
                if len(top) != 1:
                    return None, None, None, "no template.json"
                folder, config = top[0].removesuffix("template.json"), z.read(top[0]).decode("utf-8", "replace")
                beside = [i.filename for i in infos if i.filename.startswith(folder) and "/" not in i.filename[len(folder) :] and i.filename.lower().endswith(".docx")]
                try:
                    told = json.loads(config)
                    named = (told.get("template") or {}).get("source_file") or told.get("source_file") or "template.docx"
                except (ValueError, AttributeError):
                    return None, None, None, "broken template.json"
                source = [n for n in beside if n == f"{folder}{named}"] or beside
                if len(source) != 1:
                    return None, None, None, "not one DOCX"
                return config, (docx := z.read(source[0])), _fingerprint(docx), None
        except zipfile.BadZipFile:
            return None, None, None, "no package"

    def run(batches):
        kinds = (pa.string(), pa.string(), pa.binary(), pa.string(), pa.string())

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "config", "source", "fingerprint", "problem"])

        for b in batches:
            held, size = [], 0
            for path, raw in zip(b.column(0), b.column(1), strict=True):
                held.append((path.as_py(), *one(raw.as_py())))
                size += len(held[-1][2] or b"")
                if len(held) >= IMPORT_ROWS or size >= IMPORT_BYTES:
                    yield batch(held)
                    held, size = [], 0
            if held:
                yield batch(held)

    # Stored, so that a package is opened once and not again for the first of its equals.
    rows = stored(packages.select("path", "content").mapInArrow(run, schema))
    first = rows.filter("fingerprint IS NOT NULL").groupBy("fingerprint").agg(F.min("path").alias("first"))
    known = existing.select("fingerprint").distinct().withColumn("known", F.lit(True))
    j = rows.join(first, "fingerprint", "left").join(known, "fingerprint", "left")
    twice = F.col("fingerprint").isNotNull() & (F.coalesce("known", F.lit(False)) | (F.col("path") != F.col("first")))
    return j.select("path", "config", "source", "fingerprint", F.coalesce("problem", F.when(twice, "duplicate")).alias("problem"))


def _fingerprint(docx: bytes) -> str | None:
    from .packages import fingerprint

    return fingerprint(docx)


def export_packages(templates: DataFrame) -> DataFrame:
    """(id, content): a package for each template (id, config, source): ``template.json`` and ``template.docx``; equal templates give equal bytes."""
    from .ooxml import dealt, packed

    schema = templates.select("id", F.lit(None).cast("binary").alias("content")).schema

    def run(batches):
        for b in batches:
            made = [packed([("template.json", (c or "{}").encode()), ("template.docx", s or b"")]) for c, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], schema.names)

    return dealt(templates.select("id", "config", "source")).mapInArrow(run, schema)

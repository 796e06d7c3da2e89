"""Tables that are published whole: written aside, audited, and made the present version by one small file.

``root/data-<id>`` holds the rows of a version, ``root/_versions/<number>`` names its folder, or all folders of one that was extended. A reader takes the highest number whose
file is complete, so it sees the old version or the new one, never a half: what a lost task or driver leaves behind isn't named
by any file. Two writers that start from the same version cannot both publish: the second finds its number taken.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another version was published since the expected one."""


class Rejected(ValueError):
    """What was written didn't pass its audit."""


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, root: str) -> list[int]:
    at, fs = _fs(spark, f"{root}/_versions")
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(at) if s.getPath().getName().isdigit()) if fs.exists(at) else []


def _told(spark: SparkSession, root: str, number: int) -> dict | None:
    """What a version's file says, or None while it isn't complete."""
    at, fs = _fs(spark, f"{root}/_versions/{number:012d}")
    stream = fs.open(at)
    try:
        raw = bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()
    try:
        return json.loads(raw)
    except ValueError:
        return None


def current(spark: SparkSession, root: str, upto: int | None = None) -> tuple[int, list[str]] | None:
    """(number, folders) of the newest whole version, or of the newest up to one."""
    for number in reversed(_numbers(spark, root)):
        if upto is None or number <= upto:
            told = _told(spark, root, number)
            if told:
                return number, told["folders"]
    return None


def publish(df: DataFrame, root: str, audit: Callable[[DataFrame], DataFrame] | None = None, expected: int | None = None, keep: int = 2, extend: bool = False) -> int:
    """Publish ``df`` as the next version and return its number; with ``extend`` its rows come to those of the present version.

    ``audit`` maps the rows as written to a table of problems; if that has any, nothing is published (``Rejected`` names up to 20).
    ``expected`` is the version that ``df`` was made from (0: none); if it isn't the present one, ``Conflict``. Of the versions before,
    the newest ``keep - 1`` stay.
    """
    spark = df.sparkSession
    folder = f"data-{uuid.uuid4().hex}"
    now = current(spark, root)
    number = (now[0] if now else 0) if expected is None else expected
    if number != (now[0] if now else 0):
        raise Conflict(f"version {now[0] if now else 0} is present, {expected} was expected")
    try:
        df.write.parquet(f"{root}/{folder}")
        if audit is not None:
            found = [r.asDict() for r in audit(spark.read.schema(df.schema).parquet(f"{root}/{folder}")).limit(20).collect()]
            if found:
                raise Rejected(f"not published: {found}")
        _commit(spark, root, number + 1, {"folders": [*(now[1] if extend and now else []), folder], "at": time.time()})
    except BaseException:
        at, fs = _fs(spark, f"{root}/{folder}")
        fs.delete(at, True)
        raise
    vacuum(spark, root, keep)
    return number + 1


def _commit(spark: SparkSession, root: str, number: int, told: dict) -> None:
    at, fs = _fs(spark, f"{root}/_versions/{number:012d}")
    try:
        # Creating a file that exists fails, on every file system that Hadoop knows.
        out = fs.create(at, False)
    except Exception as e:
        if fs.exists(at):
            raise Conflict(f"version {number} was published meanwhile") from e
        raise
    try:
        out.write(bytearray(json.dumps(told).encode()))
    finally:
        out.close()


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The present version, or the newest up to a number; ``FileNotFoundError`` if there is none."""
    found = current(spark, root, version)
    if not found:
        raise FileNotFoundError(f"nothing is published in {root}")
    return spark.read.parquet(*[f"{root}/{f}" for f in found[1]])


def history(spark: SparkSession, root: str) -> list[tuple[int, float]]:
    """(number, time) of the versions that can be read."""
    return [(n, told["at"]) for n in _numbers(spark, root) if (told := _told(spark, root, n))]


def restore(spark: SparkSession, root: str, version: int, audit: Callable[[DataFrame], DataFrame] | None = None) -> int:
    """Publish what an older version holds as the next one."""
    if version not in {n for n, _ in history(spark, root)}:
        raise FileNotFoundError(f"no version {version} in {root}")
    return publish(read(spark, root, version), root, audit)


def vacuum(spark: SparkSession, root: str, keep: int = 2, grace: float = 86_400) -> None:
    """Delete all but the newest ``keep`` versions, and folders that no version names and nobody has touched for ``grace`` seconds."""
    known = {n: _told(spark, root, n) for n in _numbers(spark, root)}
    whole = [n for n, told in known.items() if told]
    old, stay = whole[: -keep if keep else None], {f for n in whole[-keep if keep else len(whole) :] for f in known[n]["folders"]}
    held = {f for told in known.values() if told for f in told["folders"]}
    for n in old:
        # The name goes first, so that nobody begins to read what is about to go; folders that a kept version names stay.
        for path in (f"{root}/_versions/{n:012d}", *[f"{root}/{f}" for f in known[n]["folders"] if f not in stay]):
            at, fs = _fs(spark, path)
            fs.delete(at, True)
    at, fs = _fs(spark, root)
    for s in fs.listStatus(at):
        name = s.getPath().getName()
        if name.startswith("data-") and name not in held and time.time() - s.getModificationTime() / 1000 > grace:
            fs.delete(s.getPath(), True)

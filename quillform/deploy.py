"""Sending the package to Python workers that can't import it themselves."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_SENT = "quillform.zip"


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once per context.

    Workers of a local master that inherit the package's folder on PYTHONPATH have it already.
    """
    sc = spark.sparkContext
    paths = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _SENT in sc._python_includes or (sc.master.startswith("local") and _ROOT in paths):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="quillform-"), _SENT)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(os.path.join(_ROOT, "quillform")):
            for name in sorted(n for n in names if n.endswith(".py")):
                whole = os.path.join(folder, name)
                z.write(whole, os.path.relpath(whole, _ROOT))
    sc.addPyFile(path)

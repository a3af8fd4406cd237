"""Makes this package importable in Python workers that do not have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def send_package(spark: SparkSession) -> None:
    """Adds a zip of the package to the session's Python files, once per application.

    Spark serves it to every executor, also to ones that start later.
    """
    app = spark.conf.get("spark.app.id", "") or ""
    if app in _SENT:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    base = os.path.dirname(root)
    target = os.path.join(tempfile.mkdtemp(prefix="runledger-py-"), "runledger_workers.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, base))
    spark.addArtifacts(target, pyfile=True) if not hasattr(spark, "_jsc") else spark.sparkContext.addPyFile(target)
    _SENT.add(app)

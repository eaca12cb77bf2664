"""Sending the library to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def send_package(spark: SparkSession) -> None:
    """Give the tasks this package as a zip, once per application.

    Python workers import functions by name, so a job that is started from another folder, or on a cluster whose
    machines do not hold the library, needs the package itself.
    """
    app = spark.sparkContext.applicationId
    if app in _SENT:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="filingpanel-"), "filingpanel.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join(os.path.basename(root), os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
    _SENT.add(app)

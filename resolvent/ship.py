"""Sends the package to the workers of a session, where it isn't installed on every machine."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> str:
    """Zips the package's modules and gives them to all executors, those that join later too. -> the zip."""
    root = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="resolvent-ship-"), "resolvent.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    path = os.path.join(folder, n)
                    z.write(path, os.path.join("resolvent", os.path.relpath(path, root)))
    spark.sparkContext.addPyFile(out)
    return out

"""Sending the package to the executors, so that they need no path of their own."""

from __future__ import annotations

import io
import os
import zipfile

from pyspark.sql import SparkSession

from lodestrata.lineage import shared_dir

_DONE: set[str] = set()


def package_zip() -> bytes:
    """The package's sources as a zip, the same bytes for the same sources."""
    root = os.path.dirname(os.path.abspath(__file__))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                with open(path, "rb") as f:
                    z.writestr(zipfile.ZipInfo(os.path.relpath(path, os.path.dirname(root))), f.read())
    return out.getvalue()


def ship(spark: SparkSession) -> None:
    """Adds the package to the application once, by way of the shared folder."""
    sc = spark.sparkContext
    if sc.applicationId in _DONE:
        return
    jvm = sc._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/lodestrata-{sc.applicationId}.zip")
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    stream = fs.create(path, True)
    stream.write(bytearray(package_zip()))
    stream.close()
    sc.addPyFile(fs.makeQualified(path).toString())
    _DONE.add(sc.applicationId)

"""Makes this package importable in the Python workers of any cluster."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once per application. Spark serves the file
    from the driver, so executors need no path of ours."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in sorted(os.walk(here)):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    folder = tempfile.mkdtemp(prefix="weir-src-")
    path = os.path.join(folder, "weir_src.zip")
    with open(path, "wb") as f:
        f.write(packed.getvalue())
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)

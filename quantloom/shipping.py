"""Sends this package to the executors, where no shared PYTHONPATH has it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_DONE = "_quantloom_shipped"


BATCH_BYTES = 8 << 20
_LARGE = ("67108864", "67108864b", "64m")  # fixed values: Spark's own default, as it may be written


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once a SparkContext.

    Also lowers the bytes of an Arrow batch to BATCH_BYTES where the session has Spark's default: a task holds several
    copies of a batch, and texts are long.
    """
    context = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", _LARGE[0]).lower() in _LARGE:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if getattr(context, _DONE, False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(home):
        target = os.path.join(tempfile.mkdtemp(prefix="quantloom-"), "quantloom.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
            for folder, _, names in os.walk(home):
                for name in names:
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        archive.write(path, os.path.join("quantloom", os.path.relpath(path, home)))
        context.addPyFile(target)
    setattr(context, _DONE, True)

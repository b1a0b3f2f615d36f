"""The package on the executors: their Python workers import it from here, wherever it lies on the driver."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()
BATCH_KEY, BATCH_DEFAULT, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m"


def ship(spark: SparkSession | None = None) -> None:
    """Send this package to the Python workers, once an application; without a session, the active one's.

    Rows of texts reach Python in batches of a bounded number of bytes, however long the texts are: where the session leaves that
    bound at Spark's default, it is set to BATCH for the session's life.
    """
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return
    if spark.conf.get(BATCH_KEY) == BATCH_DEFAULT:
        spark.conf.set(BATCH_KEY, BATCH)
    if spark.sparkContext.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    stage = tempfile.mkdtemp(prefix="lexweave-ship-")
    shutil.copytree(os.path.join(top, "lexweave"), os.path.join(stage, "in", "lexweave"), ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(stage, "lexweave-package"), "zip", os.path.join(stage, "in")))
    _shipped.add(spark.sparkContext.applicationId)

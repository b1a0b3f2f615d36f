"""Results that must not be computed twice, as tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A path below spark.checkpoint.dir. Where the session has no such folder, as in tests on one machine, a temporary one is taken."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = f"file://{tempfile.mkdtemp(prefix='lexweave-')}"
    return f"{root.rstrip('/')}/lexweave/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once below spark.checkpoint.dir and read back: a lost executor costs a re-read, and what comes of it sees one answer."""
    path = shared_folder(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exchanged(df: DataFrame) -> DataFrame:
    """df as a side of a join that meets the other by exchange. The size of its files doesn't tell how large it is once unpacked or exploded, and a broadcast goes whole through the driver."""
    return df.hint("merge")


def dealt(df: DataFrame) -> DataFrame:
    """df, dealt out anew where it is read from so few files that half the cores would wait: a file of one row group is read by one task, however large it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if 2 * len(df.inputFiles()) > cores else df.repartition(2 * cores)

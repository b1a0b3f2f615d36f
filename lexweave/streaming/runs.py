"""Streams that run until nothing is left, over tables in the shared folder; a run with the checkpoint of an earlier one goes on after it."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.tables import shared_folder

#: Keyed state on local disk, as a changelog in the stream's checkpoint folder.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state on disk; the session's own settings come back afterwards."""
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def append_run(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Everything that the stream's sources have and earlier runs with this checkpoint haven't seen goes through it, into Parquet files at `path`.

    The file sink commits a micro-batch by its number, so one that is run again after a failure adds its rows once.
    """
    with state_on_disk(stream.sparkSession):
        run = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        run.awaitTermination()


def time_portion(rows: DataFrame, by: str, portions: int) -> Column:
    """0 .. portions - 1, in the order of `by` and about equally many rows each; nulls are in the first. Only the bounds reach the driver."""
    at = F.unix_micros(F.col(by).cast("timestamp"))
    cuts = rows.select(F.percentile_approx(at, [i / portions for i in range(1, portions)])).first()[0] if portions > 1 else None
    return F.coalesce(sum(((at > c).cast("int") for c in cuts or []), F.lit(0)), F.lit(0))


def fed_in_turns(rows: DataFrame, portion: Column, turns: int, run: Callable[[DataFrame, str], None], name: str) -> str:
    """rows arrive in a folder by portions (0 .. turns - 1); after each, run(stream over the folder, root) goes on from its checkpoint below root. Returns root."""
    spark = rows.sparkSession
    root = shared_folder(spark, f"{name}-{uuid.uuid4().hex}")
    for turn in range(turns):
        rows.filter(portion == turn).write.mode("append").parquet(f"{root}/in")
        run(spark.readStream.schema(rows.schema).parquet(f"{root}/in"), root)
    return root

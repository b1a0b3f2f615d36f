"""In-order emission of results that arrive out of order, and the limiter of model calls."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lexweave.shipping import ship

from .runs import state_on_disk

OUT = "doc long, idx int, content string, written_count long, buffer_size long"
PART = Row("doc", "idx", "content", "written_count", "buffer_size")


class Emitter(StatefulProcessor):
    """Rows (idx, content) of a document -> those that are next, and a row without idx that tells its counters."""

    def __init__(self, start: int):
        self.start = start

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "idx int, waiting long")
        self.held = handle.getMapState("held", "idx int", "content string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # Each call to the state is a message, so there are no more than needed: where nothing waits, nothing is asked for.
        following, waiting = self.next.get() or (self.start, 0)
        begun = waiting
        come: dict[int, str | None] = {}
        for r in rows:
            if r.idx >= following:
                come.setdefault(r.idx, r.content)
        for i in sorted(come):
            if i == following:
                yield PART(key[0], i, come[i], i + 1 - self.start, 0)
                following += 1
                # What the state holds goes out as soon as the gap before it closes.
                while waiting and following not in come and (entry := self.held.getValue((following,))) is not None:
                    yield PART(key[0], following, entry[0], following + 1 - self.start, 0)
                    self.held.removeKey((following,))
                    following, waiting = following + 1, waiting - 1
            elif i > following and not (begun and self.held.containsKey((i,))):
                self.held.updateValue((i,), (come[i],))
                waiting += 1
        self.next.update((following, waiting))
        yield PART(key[0], None, None, following - self.start, waiting)


def emit_in_order(results: DataFrame, start: int = 0) -> DataFrame:
    """A stream of (doc, idx, content) -> each document's results as soon as all before them have come, and a row with a null idx and
    content for each document of a micro-batch: how many were written and how many wait for a gap.

    What waits is kept entry by entry, so a batch costs what it brings and not what is held. Of a repeated index the first that came
    counts; one already emitted, or below `start`, is ignored. Rows with a null doc or idx are left out.
    """
    ship(results.sparkSession)
    rows = results.filter("doc is not null and idx is not null").select(F.col("doc").cast("long").alias("doc"), F.col("idx").cast("int").alias("idx"), F.col("content").cast("string").alias("content"))
    return rows.groupBy("doc").transformWithState(Emitter(start), OUT, "Append", "None")


def write_in_order(results: DataFrame, path: str, checkpoint: str, start: int = 0) -> None:
    """The stream's results so far appended in order: parts of documents below `path`, each written once.

    A micro-batch is written below its own number; one that is run again after a failure replaces what it had written.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("part", F.col("idx").isNotNull()).write.partitionBy("part").mode("overwrite").parquet(f"{path}/batch={number}")

    with state_on_disk(results.sparkSession):
        emit_in_order(results, start).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def written_parts(spark: SparkSession, path: str) -> DataFrame:
    """doc, idx, content, batch of what write_in_order has written; the contents in order of idx are the document."""
    return _batches(spark, path).filter("part").select("doc", "idx", "content", "batch")


def counters(spark: SparkSession, path: str) -> DataFrame:
    """doc, written_count, buffer_size after the last micro-batch that brought something for the document."""
    told = _batches(spark, path).filter("not part").groupBy("doc").agg(F.max_by(F.struct("written_count", "buffer_size"), "batch").alias("c"))
    return told.select("doc", "c.written_count", "c.buffer_size")


def _batches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{OUT}, batch long, part boolean").parquet(path)


def emitted_prefix(results: DataFrame, start: int = 0) -> DataFrame:
    """What emit_in_order has emitted once all of `results` has come: the rows before each document's first gap."""
    w = Window.partitionBy("doc").orderBy("idx")
    first = results.filter(F.col("idx") >= start).dropDuplicates(["doc", "idx"])
    return first.withColumn("n", F.row_number().over(w)).filter(F.col("n") == F.col("idx") - start + 1).drop("n")


def limiter_waits(calls: DataFrame, rate: float, per: float) -> DataFrame:
    """calls(key, call_id, at seconds) -> with wait: how long a token bucket of `rate` calls per `per` seconds holds each back.

    A key is a stream of sorted batches of which only the bucket's level is held, so a hot key gathers nothing.
    """
    ship(calls.sparkSession)

    def simulate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, level, last, begun = None, rate, 0.0, False
        for frame in frames:
            waits = []
            for key, at in zip(frame["key"], frame["at"], strict=True):
                if not begun or key != of:
                    of, level, last, begun = key, rate, at, True
                now = max(at, last)
                level = min(rate, level + (now - last) * rate / per)
                wait = 0.0 if level >= 1 else (1 - level) * per / rate
                level = 0.0 if wait else level - 1
                last = now + wait
                waits.append(last - at)
            yield frame.assign(wait=waits)

    ordered = calls.filter("key is not null").select("key", "call_id", "at").repartition("key").sortWithinPartitions("key", "at", "call_id")
    return ordered.mapInPandas(simulate, "key long, call_id long, at double, wait double")

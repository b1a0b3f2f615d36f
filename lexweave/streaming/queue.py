"""The worker of a task queue as a stream: a micro-batch is a claim.

Submissions are files in a folder. The stream's checkpoint says which batch has which of them, so a task is in one batch only, and a
batch that a lost worker left unfinished is run again with the same tasks; how many are claimed at once is the source's
maxFilesPerTrigger or maxBytesPerTrigger. Outcomes are written below the batch's number, which makes a repeated batch replace its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexweave.operators import tasks

from .runs import state_on_disk

OUTCOME = "task_id string, status string, result_url string, error string, batch long"


def work_off(submissions: DataFrame, handle: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, cancelled: Callable[[], DataFrame] | None = None, poll: str | None = None) -> StreamingQuery:
    """Hand each micro-batch of submissions(task_id, ...) to handle(claimed) -> outcomes(task_id, status, [result_url], [error]), once a task.

    Without `poll` all that has been submitted is worked off and the query ends; with it ("2 seconds") it looks for more that often, for
    ever. cancelled() -> task_ids is read anew for every batch, before its tasks are handled and again when their outcomes are there:
    those cancelled before are not handled, those cancelled meanwhile keep no other outcome. A task submitted again, in one batch or
    later, is handled once, as the row that comes first by its other columns. A claimed task for which `handle` gives no outcome has failed.
    Rows of a null task_id are left out.
    """
    spark = submissions.sparkSession

    def claim(batch: DataFrame, number: int) -> None:
        if number:
            done = spark.read.schema(OUTCOME).parquet(path).filter(F.col("batch") < number)
            batch = batch.join(done.select(F.col("task_id").alias("__done")), F.col("task_id").cast("string") == F.col("__done"), "left_anti")
        rest = [c for c in batch.columns if c != "task_id"]
        one = batch.filter("task_id is not null").groupBy("task_id").agg(F.min(F.struct(*rest)).alias("s")) if rest else batch.filter("task_id is not null").distinct()
        claimed = one.select("task_id", *[F.col("s")[c].alias(c) for c in rest])
        gone = lambda: cancelled().select(F.col("task_id").cast("string").alias("__gone")).distinct() if cancelled else spark.createDataFrame([], "__gone string")
        before = gone()
        told = handle(claimed.join(before, F.col("task_id").cast("string") == F.col("__gone"), "left_anti"))
        told = told.select(F.col("task_id").cast("string").alias("task_id"), "status", *[(F.col(c) if c in told.columns else F.lit(None)).cast("string").alias(c) for c in ("result_url", "error")])
        told.write.mode("overwrite").parquet(f"{path}-handled/{number}")
        told = spark.read.schema("task_id string, status string, result_url string, error string").parquet(f"{path}-handled/{number}")
        mine = claimed.select(F.col("task_id").cast("string").alias("task_id")).join(told, "task_id", "left").join(gone(), F.col("task_id") == F.col("__gone"), "left")
        hit = F.col("__gone").isNotNull()
        lost = F.col("status").isNull()
        out = mine.select(
            "task_id",
            F.when(hit, "cancelled").when(lost, "failed").otherwise(F.col("status")).alias("status"),
            F.when(~hit, F.col("result_url")).alias("result_url"),
            F.when(hit, tasks.CANCELLED).otherwise(F.col("error")).alias("error"),
        )
        out.write.mode("overwrite").parquet(f"{path}/batch={number}")

    with state_on_disk(spark):
        run = submissions.writeStream.foreachBatch(claim).option("checkpointLocation", checkpoint)
        run = (run.trigger(processingTime=poll) if poll else run.trigger(availableNow=True)).start()
    if not poll:
        run.awaitTermination()
    return run


def outcomes(spark: SparkSession, path: str) -> DataFrame:
    """task_id, status, result_url, error, batch of all tasks worked off so far."""
    return spark.read.schema(OUTCOME).parquet(path)

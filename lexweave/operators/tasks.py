"""The task queue as pure transitions: tasks in, tasks out. Claiming and working them off is streaming/queue.py's part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A task's columns and their defaults (fixed values); the table is kept by status and creation.
SCHEMA = "task_id string, filename string, status string, glossary_id string, bilingual boolean, progress_current int, progress_total int, progress_percentage double, progress_speed double, progress_elapsed double, result_url string, error string, created_at timestamp, updated_at timestamp"
DEFAULTS = {"bilingual": False, "progress_current": 0, "progress_total": 0, "progress_percentage": 0.0, "progress_speed": 0.0, "progress_elapsed": 0.0}
#: What is told of tasks that go back into the queue or are cancelled (fixed values).
REQUEUED, CANCELLED = "任务因 worker 中断被重新排队", "任务已被取消"


def migrated(tasks: DataFrame) -> DataFrame:
    """Tasks of an older table with all columns of SCHEMA, in its order; where one is missing or null, its default."""
    fields = T.StructType.fromDDL(SCHEMA).fields
    known = lambda n: F.coalesce(F.col(n), F.lit(DEFAULTS.get(n))) if n in tasks.columns else F.lit(DEFAULTS.get(n))
    return tasks.select(*[known(f.name).cast(f.dataType).alias(f.name) for f in fields])


def insert(tasks: DataFrame, new: DataFrame) -> DataFrame:
    """tasks with the rows of new whose id it doesn't have; of new rows of one id the first created, then the least file name, is taken."""
    w = Window.partitionBy("task_id").orderBy(*[c for c in ("created_at", "filename") if c in new.columns], *[c for c in sorted(new.columns) if c not in ("task_id", "created_at", "filename")])
    fresh = new.join(tasks.select("task_id"), "task_id", "left_anti").withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
    return tasks.unionByName(fresh, allowMissingColumns=True)


def by_id(tasks: DataFrame, ids: DataFrame) -> DataFrame:
    return tasks.join(ids.select("task_id").distinct(), "task_id", "left_semi")


def records(tasks: DataFrame) -> DataFrame:
    """task_id, task: an object as services show it: times in ISO form, progress never null."""
    iso = lambda c: F.regexp_replace(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), "\\.000000$", "")
    progress = F.struct(*[F.coalesce(f"progress_{n}", F.lit(0).cast(t)).alias(n) for n, t in (("current", "int"), ("total", "int"), ("percentage", "double"), ("speed", "double"), ("elapsed", "double"))])
    task = F.struct("task_id", "filename", "status", "glossary_id", F.coalesce("bilingual", F.lit(False)).alias("bilingual"), progress.alias("progress"), "result_url", "error", iso("created_at").alias("created_at"), iso("updated_at").alias("updated_at"))
    return tasks.select("task_id", task.alias("task"))


def _told(tasks: DataFrame, when: Column, message: Column) -> dict[str, Column]:
    return {"error": F.when(when, message).otherwise(F.col("error"))} if "error" in tasks.columns else {}


def claim(tasks: DataFrame, now: Column, n: int = 1) -> DataFrame:
    """The n oldest pending tasks (by creation, then id) become processing, and lose their error."""
    oldest = tasks.filter("status = 'pending'").orderBy("created_at", "task_id").limit(n).select("task_id", F.lit(True).alias("__claimed"))
    taken = F.coalesce("__claimed", F.lit(False))
    return tasks.join(oldest, "task_id", "left").withColumns(_told(tasks, taken, F.lit(None)) | {"status": F.when(taken, "processing").otherwise(F.col("status")), "updated_at": F.when(taken, now).otherwise(F.col("updated_at"))}).drop("__claimed")


def requeue_stale(tasks: DataFrame, now: Column, seconds: int = 900) -> DataFrame:
    stale = (F.col("status") == "processing") & F.coalesce(F.col("updated_at") < now - F.make_dt_interval(secs=F.lit(seconds)), F.lit(False))
    return tasks.withColumns(_told(tasks, stale, F.lit(REQUEUED)) | {"status": F.when(stale, "pending").otherwise(F.col("status")), "updated_at": F.when(stale, now).otherwise(F.col("updated_at"))})


def cancel(tasks: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Pending and processing tasks among ids are cancelled; `changed` tells which."""
    hit = tasks.join(ids.select("task_id", F.lit(True).alias("__hit")).distinct(), "task_id", "left")
    change = F.coalesce("__hit", F.lit(False)) & F.col("status").isin("pending", "processing")
    return hit.withColumns(_told(tasks, change, F.lit(CANCELLED)) | {"changed": change, "updated_at": F.when(change, now).otherwise(F.col("updated_at")), "status": F.when(change, "cancelled").otherwise(F.col("status"))}).drop("__hit")


def page(tasks: DataFrame, skip: int = 0, limit: int = 20) -> DataFrame:
    return tasks.orderBy(F.desc("created_at"), "task_id").offset(skip).limit(limit)


def merge_latest(old: DataFrame, new: DataFrame, key: str, stamp: str) -> DataFrame:
    """Upsert: of the rows of a key the latest, new ones before old ones, then the one with the largest other columns, by name."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc(stamp), F.desc("__new"), *[F.desc(c) for c in sorted(old.columns) if c not in (key, stamp)])
    return both.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n", "__new")


def final_status(outcomes: DataFrame) -> DataFrame:
    """outcomes(task_id, chunk_index, success) -> status, counts and an error text with the first ten failed indexes."""
    failed = F.array_sort(F.collect_list(F.when(~F.col("success"), F.col("chunk_index"))))
    g = outcomes.groupBy("task_id").agg(F.count_if("success").alias("ok"), F.count_if(~F.col("success")).alias("bad"), failed.alias("f"))
    shown = F.concat(F.array_join(F.slice("f", 1, 10).cast("array<string>"), ", "), F.when(F.size("f") > 10, " ...").otherwise(""))
    status = F.when(F.col("bad") == 0, "completed").when(F.col("ok") == 0, "failed").otherwise("partial_success")
    return g.select("task_id", status.alias("status"), "ok", "bad", F.when(F.col("bad") > 0, shown).otherwise(F.lit("")).alias("failed_chunks"))


def progress(events: DataFrame) -> DataFrame:
    """events(task_id, event_id, ts, total) -> current, percentage, elapsed seconds, chunks a minute and minutes left, event by event."""
    w = Window.partitionBy("task_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return rates(events.withColumn("current", F.count(F.lit(1)).over(w)), F.min("ts").over(w))


def rates(told: DataFrame, first: Column) -> DataFrame:
    """told(ts, current, total) with elapsed seconds since `first`, percentage, chunks a minute and minutes left."""
    elapsed = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(first.cast("timestamp"))) / 1e6
    out = told.withColumn("elapsed", elapsed)
    speed = F.when(F.col("elapsed") > 0, F.col("current") * 60 / F.col("elapsed")).otherwise(0.0)
    left = F.when(speed > 0, F.ceil((F.col("total") - F.col("current")) / speed))
    return out.withColumns({"percentage": F.round(F.col("current") * 100.0 / F.col("total"), 2), "speed": F.round(speed, 4), "eta_minutes": left})


def without_cancelled(events: DataFrame, tasks: DataFrame) -> DataFrame:
    """Events of tasks that weren't cancelled; those of unknown tasks stay."""
    return events.join(tasks.filter("status = 'cancelled'").select("task_id").distinct(), "task_id", "left_anti")


def with_glossary(tasks: DataFrame, glossaries: DataFrame) -> DataFrame:
    """tasks(glossary_id) with their glossary's entries; an empty map where it is missing or none is named."""
    return tasks.join(glossaries.select("glossary_id", "entries"), "glossary_id", "left").withColumn("entries", F.coalesce("entries", F.create_map().cast("map<string,string>")))


def remove(tasks: DataFrame, ids: DataFrame) -> DataFrame:
    """Tasks without those of ids; a task that is processing stays."""
    gone = ids.select("task_id").distinct().withColumn("__gone", F.lit(True))
    return tasks.join(gone, "task_id", "left").filter(~F.coalesce("__gone", F.lit(False)) | (F.col("status") == "processing")).drop("__gone")


def counts(tasks: DataFrame) -> DataFrame:
    """Totals of a task list: all, finished (wholly or in part), processing."""
    return tasks.agg(F.count("*").alias("total"), F.count_if(F.col("status").isin("completed", "partial_success")).alias("finished"), F.count_if(F.col("status") == "processing").alias("processing"))

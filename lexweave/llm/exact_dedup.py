"""Exact deduplication by a stateful stream, in DataFrame operations only.

A stream over the rows' digests keeps, for every digest and without expiry, the row that stays (largest stable
identifier, with its content locator) and the number of rows. The state lives in RocksDB on disk, with
its changelog in the stream's checkpoint folder, which may be kept between calls. A locator is a Parquet file and the row's place
in it, by which the content can be read again. Where a digest came more than once (a hit), the full bytes are
compared: rows of the same digest with other bytes are told apart and grouped by their text instead.

No key gathers in a task: the stream's state and every count are combined before they are exchanged, and
the join that hands results back to rows is one that Spark splits at hot keys.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Workspace, conf, free_names

#: State on disk, as a changelog in the checkpoint folder; no space set aside for the many small stores of a wide exchange.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
LOCATOR = "struct<file: string, row: bigint>"
ROWS = f"id bigint, digest string, locator {LOCATOR}"
#: Rows that hits are looked up by are broadcast up to this size; beyond it they are found by a grouping of all texts.
BROADCAST_BYTES, BYTES_A_HIT = 8 << 20, 120


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def keep_state(digests: DataFrame) -> DataFrame:
    """A stream of (id, digest, locator) -> digest, keep struct<id, locator>, n: the newest row of each digest wins.

    Works on any streaming frame; there is no watermark, so the state of a digest never expires.
    """
    return digests.groupBy("digest").agg(F.max(F.struct("id", "locator")).alias("keep"), F.count(F.lit(1)).alias("n"))


def run_stream(ws: Workspace, rows: str, state: str, max_bytes_per_trigger: int = 64 << 30) -> DataFrame:
    """Feed the tables of (id, digest, locator) below `rows` that were not yet read to the stream of `state`: the state of every digest they touch."""
    spark = ws.spark
    source = spark.readStream.schema(ROWS).option("maxBytesPerTrigger", str(max_bytes_per_trigger)).option("recursiveFileLookup", "true").parquet(rows)
    updates = ws.path("updates")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{updates}/at={number}")

    with conf(spark, STATE_CONF):
        stream = keep_state(source).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
        stream.awaitTermination()
    schema = f"digest string, keep struct<id: bigint, locator: {LOCATOR}>, n bigint, batch int, at int"
    batches = _batches(spark, updates)
    found = spark.read.schema(schema).option("basePath", updates).parquet(f"{updates}/at=*") if batches else spark.createDataFrame([], schema)
    if batches > 1:
        found = found.groupBy("digest").agg(F.max_by(F.struct("keep", "n"), "batch").alias("s")).select("digest", "s.keep", "s.n")
    return found.select("digest", F.col("keep.id").alias("keep_id"), F.col("keep.locator").alias("keep_locator"), "n")


def _batches(spark: SparkSession, path: str) -> int:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return len(fs.listStatus(at)) if fs.exists(at) else 0


def locator_of(df: DataFrame) -> Column:
    """Where a row's content lies: its Parquet file and its place in it; for other frames a number of this call."""
    try:
        df.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        return F.struct(F.lit(uuid.uuid4().hex).alias("file"), F.monotonically_increasing_id().alias("row"))
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def located(spark: SparkSession, locators: DataFrame, text_col: str = "text") -> DataFrame:
    """locators(digest, file, row) -> digest, text: contents read again from the Parquet files that the locators name."""
    files = [r.file for r in locators.select("file").distinct().collect()]  # names of files, not of rows
    if not files:
        return spark.createDataFrame([], "digest string, text string")
    stored = spark.read.parquet(*files).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return stored.join(locators, ["file", "row"]).select("digest", "text")


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, state: str | None = None) -> DataFrame:
    """One row per row of df: `id_col`, keep_id, group_size, kept, digest.

    Texts are equal when their bytes are; null counts as empty; texts may be of any length. Of equal texts the row with the largest
    id stays (null ids come last; of repeated rows with that id one stays). Other columns are ignored. An empty table gives no rows.

    state: a folder that keeps the stream between calls. Each call then counts its rows as new ones beside all of the calls before:
    groups go on, and a text whose kept row lay in an earlier call has no kept row in this one unless a larger id came.
    """
    spark = df.sparkSession
    ws = Workspace(spark, "exact-dedup")
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = state.rstrip("/") if state else ws.root
    here = f"{base}/rows/{uuid.uuid4().hex}"
    df.select(F.col(id_col).cast("long").alias("id"), digest(text).alias("digest"), locator_of(df).alias("locator")).write.parquet(here)
    rows = spark.read.schema(ROWS).parquet(here)
    kept = ws.save(run_stream(ws, f"{base}/rows", f"{base}/stream"), "state")
    hits = kept.filter("n > 1").select("digest")
    # Full bytes, on hits only while their digests are few enough to send to every task; else over all rows. In either
    # case copies are combined before the exchange, so a text leaves each task once.
    bytes_of = df.select(digest(text).alias("digest"), text.alias("text"))
    n_hits = hits.count()
    if n_hits * BYTES_A_HIT <= BROADCAST_BYTES:
        bytes_of = bytes_of.join(F.broadcast(hits), "digest", "left_semi")
    texts = bytes_of.groupBy("digest", "text").agg(F.count(F.lit(1)).alias("n"))
    if state:
        before = kept.filter("n > 1").select("digest", "keep_locator.*").join(rows.select(F.col("locator.file").alias("f")).distinct(), F.col("file") == F.col("f"), "left_anti")
        older = located(spark, before, text_col).withColumn("n", F.lit(1).cast("long"))
        texts = texts.unionByName(older).groupBy("digest", "text").agg(F.sum("n").alias("n"))
    clash = ws.save(texts.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("digest"), "clashes")
    out = rows.join(kept, "digest").select(F.col("id").alias(id_col), "keep_id", F.col("n").alias("group_size"), (F.col("locator") == F.col("keep_locator")).alias("kept"), "digest")
    if not clash.isEmpty():
        out = out.join(clash, "digest", "left_anti").unionByName(_by_text(ws, df, clash, id_col, text, digest))
    return out


def _by_text(ws: Workspace, df: DataFrame, clash: DataFrame, id_col: str, text: Column, digest: Callable[[Column], Column]) -> DataFrame:
    """The rows whose digest stands for several texts, grouped by the texts themselves (of this call)."""
    full = df.select(F.col(id_col).cast("long").alias("id"), digest(text).alias("digest"), text.alias("full_text"))
    full = ws.save(full.join(clash, "digest", "left_semi").withColumn("locator", F.monotonically_increasing_id()), "clashing")
    best = ws.save(full.groupBy("digest", "full_text").agg(F.max(F.struct("id", "locator")).alias("keep"), F.count(F.lit(1)).alias("n")), "clash-groups")
    return full.join(best, ["digest", "full_text"]).select(F.col("id").alias(id_col), F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("locator") == F.col("keep.locator")).alias("kept"), "digest")


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df without all but one row of each group of equal texts; columns as they were.

    Null counts as empty; of equal texts the row with the largest id stays, null ids last; of rows equal in id and text any one.
    An empty table gives no rows. Only ids and digests are written: what goes is told by them, and whole rows move but for that join.
    """
    spark = df.sparkSession
    ws = Workspace(spark, "drop-copies")
    gone_id, gone_digest, again = free_names(df.columns, "gone_id", "gone_digest", "again")
    gone = exact_groups(df.select(id_col, text_col), id_col, text_col).filter("not kept")
    gone = ws.save(gone.select(F.col(id_col).alias(gone_id), F.col("digest").alias(gone_digest), F.col(id_col).eqNullSafe(F.col("keep_id")).alias(again)).distinct(), "gone")
    same = F.col(id_col).cast("long").eqNullSafe(F.col(gone_id)) & (sha256(F.coalesce(F.col(text_col), F.lit(""))) == F.col(gone_digest))
    # The same plan at every size: rows are exchanged once.
    out = df.join(gone.hint("merge"), same, "left_anti")
    twice = gone.filter(F.col(again))
    if twice.isEmpty():
        return out
    # Rows equal in id and text to the one that stays went with it: one of each comes back.
    return out.unionByName(df.join(twice, same, "left_semi").dropDuplicates([id_col, text_col]))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_groups(docs).withColumnRenamed("digest", "text_sha256")


OP5_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

"""Scans of cache and task files, and lookups in keyed tables, by what they read."""

import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from lexweave.operators import tasks
from lexweave.sources import database


def scan_rows(df):
    """(rows that left the scan, tasks of the scan) of a run of df."""
    rows = df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    n = sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.length()) if leaves.apply(i).metrics().contains("numOutputRows"))
    return rows, n


def pruned(df):
    return re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (= |IN )", df._jdf.queryExecution().toString()) is not None


@pytest.fixture(scope="module")
def file(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("db") / "cache.db")
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE translation_cache (cache_key TEXT PRIMARY KEY, chunk_id TEXT NOT NULL, translation TEXT NOT NULL, quality_report TEXT, repaired INTEGER DEFAULT 0, created_at TEXT NOT NULL)")
    db.executemany("INSERT INTO translation_cache VALUES (?, ?, ?, ?, ?, ?)", [(f"k{i:05d}", f"c{i}", f"译文 {i}" + "x" * (300_000 if i == 7 else 0), None if i % 3 else "{}", i % 2, f"2024-05-01T00:{i % 60:02d}:00.250000+00:00") for i in range(5000)])
    db.execute("CREATE TABLE tasks (task_id TEXT PRIMARY KEY, filename TEXT, status TEXT, bilingual INTEGER, progress_current INTEGER, created_at TEXT, updated_at TEXT)")
    db.executemany("INSERT INTO tasks VALUES (?, ?, ?, ?, ?, ?, ?)", [("a", "a.md", "pending", 1, 3, "2024-05-01T10:00:00.123456", None), ("b", None, "processing", None, None, "no time", "2024-05-01 10:00:00")])
    db.commit()
    db.close()
    return path


def test_whole_scan_by_ranges(spark, file):
    cache = database.cache_table(spark, file, 6)
    assert cache.rdd.getNumPartitions() == 6 and cache.dtypes[4:] == [("repaired", "boolean"), ("created_at", "timestamp")]
    rows = {r.cache_key: r for r in cache.collect()}
    assert len(rows) == 5000 and rows["k00007"].translation == "译文 7" + "x" * 300_000 and rows["k00007"].repaired and rows["k00001"].quality_report is None
    assert str(rows["k00059"].created_at) == "2024-05-01 00:59:00.250000"


def test_a_lookup_by_key_reads_its_row(spark, file):
    for cache, want in ((database.cache_table(spark, file).filter("cache_key = 'k00042'"), ["c42"]), (database.cache_table(spark, file).filter(F.col("cache_key").isin("k00001", "k04999", "none")), ["c1", "c4999"]), (database.cache_table(spark, file).filter("cache_key = 'none'"), [])):
        rows, read = scan_rows(cache)
        assert sorted(r.chunk_id for r in rows) == sorted(want) and read == len(want)
        assert cache.rdd.getNumPartitions() == 1


def test_what_the_database_can_t_tell_is_told_after_it(spark, file):
    cache = database.cache_table(spark, file)
    rows, read = scan_rows(cache.filter("chunk_id > 'c499' and repaired and created_at >= timestamp'2024-05-01 00:30:00'"))
    want = [i for i in range(5000) if f"c{i}" > "c499" and i % 2 and i % 60 >= 30]
    assert sorted(int(r.chunk_id[1:]) for r in rows) == want
    assert read == sum(f"c{i}" > "c499" for i in range(5000))
    assert cache.filter("quality_report is null").count() == sum(bool(i % 3) for i in range(5000))


def test_tasks_of_an_older_file(spark, file):
    got = {r.task_id: r for r in database.task_table(spark, file).collect()}
    assert [f.name for f in database.task_table(spark, file).schema] == [c.split()[0] for c in tasks.SCHEMA.split(", ")]
    assert got["a"].bilingual and got["a"].progress_current == 3 and str(got["a"].created_at) == "2024-05-01 10:00:00.123456" and got["a"].glossary_id is None
    assert not got["b"].bilingual and got["b"].progress_current == 0 and got["b"].created_at is None and got["b"].filename is None
    assert tasks.requeue_stale(database.task_table(spark, file), F.to_timestamp(F.lit("2024-05-02"))).filter("status = 'pending'").count() == 2


def test_an_empty_table(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "e.db")
    db.execute("CREATE TABLE tasks (task_id TEXT PRIMARY KEY)")
    db.close()
    assert database.task_table(spark, str(tmp_path / "e.db")).count() == 0


def test_keyed_lookups_read_their_folders(spark, tmp_path):
    rows = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("cache_key"), F.col("id").alias("v")).unionByName(spark.sql("select cast(null as string) as cache_key, -1L as v"))
    path = f"file://{tmp_path}/keyed"
    database.write_keyed(rows, path, "cache_key", 32)
    database.write_keyed(spark.sql("select 'k7' as cache_key, -7L as v"), path, "cache_key", 32)
    one = database.lookup(spark, path, "cache_key", ["k7", None], 32)
    got, read = scan_rows(one)
    assert sorted(r.v for r in got) == [-7, 7] and read < 400 and pruned(one)
    wanted = spark.createDataFrame([("k1",), ("k1",), ("k2",), (None,), ("none",)], "cache_key string")
    many = database.lookup(spark, path, "cache_key", wanted, 32)
    assert sorted(r.v for r in many.collect()) == [1, 2] and pruned(many)

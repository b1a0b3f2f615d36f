"""Cache and task tables: scans of SQLite files that services keep, and keyed tables whose lookups read the keys' folders only."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from lexweave.operators import tasks
from lexweave.shipping import ship

#: Tables as services keep them: name, key, columns (fixed values).
TABLES = {
    "translation_cache": ("cache_key", "cache_key string, chunk_id string, translation string, quality_report string, repaired int, created_at string"),
    "tasks": ("task_id", tasks.SCHEMA.replace("timestamp", "string").replace("boolean", "int")),
}
COMPARISONS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


@dataclass
class Rows(InputPartition):
    """Rows of one range of row numbers; without bounds those that the pushed conditions find by the key's index."""

    first: int | None = None
    last: int | None = None


class Database(DataSource):
    """Format `lexweave_db`. Options: path (a SQLite file that executors see), table (of TABLES), partitions (8)."""

    @classmethod
    def name(cls) -> str:
        return "lexweave_db"

    def schema(self) -> str:
        return TABLES[self.options["table"]][1]

    def reader(self, schema: StructType) -> DatabaseReader:
        return DatabaseReader(schema, self.options)


class DatabaseReader(DataSourceReader):
    """Comparisons of columns with strings and numbers are the database's work; equality on the key is one lookup in one task."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.path, self.table = schema, options["path"], options["table"]
        self.n = int(options.get("partitions", 8))
        self.key = TABLES[self.table][0]
        self.conditions: list[tuple[str, tuple]] = []
        self.by_key = False

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            values = f.value if isinstance(f, In) else (getattr(f, "value", None),)
            usable = column in self.schema.fieldNames() and values and all(isinstance(v, str | int | float) and not isinstance(v, bool) for v in values)
            if usable and type(f) in COMPARISONS:
                self.conditions.append((f'"{column}" {COMPARISONS[type(f)]} ?', tuple(values)))
            elif usable and isinstance(f, In):
                self.conditions.append((f'"{column}" IN ({", ".join("?" * len(values))})', tuple(values)))
            else:
                yield f
                continue
            self.by_key |= column == self.key and isinstance(f, EqualTo | In)

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[InputPartition]:
        if self.by_key:
            return [Rows()]
        db = self._open()
        try:
            first, last = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        finally:
            db.close()
        if first is None:
            return [Rows(0, -1)]
        step = -(-(last - first + 1) // self.n)
        return [Rows(a, min(a + step - 1, last)) for a in range(first, last + 1, step)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        db = self._open()
        try:
            there = {c[1] for c in db.execute(f'PRAGMA table_info("{self.table}")')}
            columns = [f'"{n}"' if n in there else f'NULL AS "{n}"' for n in self.schema.fieldNames()]
            wanted = list(self.conditions)
            if partition.first is not None:
                wanted.append(("rowid BETWEEN ? AND ?", (partition.first, partition.last)))
            where = " AND ".join(c for c, _ in wanted) or "1"
            cursor = db.execute(f'SELECT {", ".join(columns)} FROM "{self.table}" WHERE {where}', [v for _, vs in wanted for v in vs])
            types = [{"string": pa.string(), "int": pa.int32(), "double": pa.float64()}[f.dataType.simpleString()] for f in self.schema.fields]
            while rows := cursor.fetchmany(2048):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=self.schema.fieldNames())
        finally:
            db.close()


def _scan(spark: SparkSession, path: str, table: str, partitions: int) -> DataFrame:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Database)
    return spark.read.format("lexweave_db").option("path", path).option("table", table).option("partitions", partitions).load()


def cache_table(spark: SparkSession, path: str, partitions: int = 8) -> DataFrame:
    """cache_key, chunk_id, translation, quality_report, repaired, created_at of a service's cache file; a filter on the key reads its rows only.

    Columns that an older file lacks are null; times that aren't ISO are null.
    """
    rows = _scan(spark, path, "translation_cache", partitions)
    return rows.withColumns({"repaired": F.coalesce("repaired", F.lit(0)) != 0, "created_at": F.try_to_timestamp("created_at")})


def task_table(spark: SparkSession, path: str, partitions: int = 8) -> DataFrame:
    """The tasks of a service's file, with all columns of tasks.SCHEMA; those that an older file lacks have their defaults."""
    rows = _scan(spark, path, "tasks", partitions)
    return tasks.migrated(rows.withColumns({"bilingual": F.col("bilingual") != 0, "created_at": F.try_to_timestamp("created_at"), "updated_at": F.try_to_timestamp("updated_at")}))


def write_keyed(rows: DataFrame, path: str, key: str, buckets: int = 64, mode: str = "append") -> None:
    """rows in folders by their key's hash, the way lookup() finds them. Rows of a null key are in a folder of their own."""
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    rows.withColumn("bucket", bucket).repartition("bucket", F.pmod(F.xxhash64(key, F.lit(1)), F.lit(4))).write.partitionBy("bucket").mode(mode).parquet(path)


def lookup(spark: SparkSession, path: str, key: str, wanted: DataFrame | list, buckets: int = 64) -> DataFrame:
    """Rows of a keyed table whose key is wanted: a list of keys, or a table with a column of the key's name.

    Only the folders of wanted keys are read: their numbers, at most `buckets`, are told first. Repeated keys count once, null ones find nothing.
    """
    stored = spark.read.parquet(path)
    keys = spark.createDataFrame([(k,) for k in wanted], stored.select(key).schema) if isinstance(wanted, list) else wanted.select(key)
    asked = keys.filter(F.col(key).isNotNull()).distinct().withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    at = [r.bucket for r in asked.select("bucket").distinct().collect()]
    found = stored.filter(F.col("bucket").isin(at))
    found = found.filter(F.col(key).isin(wanted)) if isinstance(wanted, list) else found.join(asked.select(key), key, "left_semi")
    return found.select(*[c for c in stored.columns if c != "bucket"])

"""Tables written to the folder that driver and executors share.

Iterative operators cut their lineage by writing a table there and reading it back, so a lost executor
costs a re-read, not a re-computation of everything before it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.shipping import ship

__all__ = ["Workspace", "conf", "free_names", "meet_in_parts", "salted_rank", "shared_root", "ship", "sorted_blocks", "sorted_groups"]
_own: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, on one machine only (as in tests), a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="lexweave-"))
    return f"file://{_own[0]}"


class Workspace:
    """One operator call's tables, under a name of their own."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/lexweave/{name}-{uuid.uuid4().hex}"
        self._n = 0
        self._saved: list[DataFrame] = []

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """df, written once and read back: stable under retries, and of a size that the planner knows."""
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._lexweave_path = path
        self._saved.append(out)
        return out

    def clear(self, *keep: DataFrame) -> None:
        """Delete every table saved so far but those in `keep`."""
        paths = {df._lexweave_path for df in keep}
        self.drop(*(df for df in self._saved if df._lexweave_path not in paths))
        self._saved = list(keep)

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark._jvm
        for df in frames:
            if path := getattr(df, "_lexweave_path", None):
                at = jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def salted_rank(counts: DataFrame, group: list[str], salt: str, n: str) -> DataFrame:
    """counts: one row per (group, salt) with n rows. Adds `before`: rows of the group in smaller salts.

    With row_number() over (group, salt) this gives a gapless rank in each group, although no task ever holds
    more than one salt's share of a group.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*group).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum(n).over(w), F.lit(0)))


def free_names(taken: Iterable[str], *names: str) -> list[str]:
    """`names`, each with as many underscores behind it as it takes to be none of `taken` (in any case)."""
    used, out = {t.casefold() for t in taken}, []
    for name in names:
        while name.casefold() in used:
            name += "_"
        used.add(name.casefold())
        out.append(name)
    return out


@contextmanager
def conf(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session for as long as a block runs."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def meet_in_parts(ws: Workspace, rows: DataFrame, keys: list[str], by: str, cap: int) -> DataFrame:
    """rows, dealt so that any two rows with equal keys meet in a group of at most about 2 * cap rows.

    A key with up to `cap` rows is one group. A larger one is cut by a hash of `by` into parts of about `cap` rows; each two
    parts, and each part alone, make a group. Adds part, other (the group, with the keys) and inside (the row belongs
    to `part`; else to `other`). In a group with part = other all rows are inside.
    """
    large = rows.groupBy(*keys).count().filter(F.col("count") > cap)
    large = ws.save(large.select(*keys, F.ceil(F.col("count") / cap).cast("int").alias("parts")), "large-groups")
    if large.isEmpty():
        return rows.withColumns({"part": F.lit(0), "other": F.lit(0), "inside": F.lit(True)})
    # At most rows / cap keys are large, each with one row here. Only their rows are dealt to several groups.
    rest = rows.join(large, keys, "left_anti").withColumns({"part": F.lit(0), "other": F.lit(0), "inside": F.lit(True)})
    placed = rows.join(large, keys).withColumn("mine", F.pmod(F.xxhash64(by), F.col("parts")).cast("int"))
    places = F.concat(
        F.transform(F.sequence(F.col("mine"), F.col("parts") - 1), lambda p: F.struct(p.alias("part"), F.col("mine").alias("other"), (p == F.col("mine")).alias("inside"))),
        F.transform(F.filter(F.sequence(F.lit(0), F.col("mine")), lambda o: o < F.col("mine")), lambda o: F.struct(F.col("mine").alias("part"), o.alias("other"), F.lit(True).alias("inside"))),
    )
    return placed.withColumn("place", F.explode(places)).select(*rows.columns, "place.part", "place.other", "place.inside").unionByName(rest)


def sorted_blocks(batches, n_keys: int):
    """(numpy columns, where groups start, and the end) of whole groups, from Arrow batches sorted by their first n_keys columns."""
    import numpy as np

    held = None
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
        start = _starts(columns[:n_keys])
        yield columns, start[:-1]
        held = [c[start[-2] if len(start) > 1 else 0 :] for c in columns]  # the last group may go on in the next batch
    if held is not None:
        yield held, _starts(held[:n_keys])


def sorted_groups(batches, n_keys: int):
    """Groups of at least two rows, as lists of numpy columns, from Arrow batches sorted by their first n_keys columns."""
    for columns, start in sorted_blocks(batches, n_keys):
        yield from _groups(columns, start)


def _starts(keys):
    import numpy as np

    n = len(keys[0])
    new = np.zeros(n, bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    if n:
        new[0] = True
    return [*np.flatnonzero(new).tolist(), n]


def _groups(columns, start):
    for a, b in zip(start, start[1:], strict=False):
        if b - a > 1:
            yield [c[a:b] for c in columns]

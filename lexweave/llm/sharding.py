"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns `vnodes` points on a ring of 64-bit hashes. A row's key belongs to the arc that ends at the next
point clockwise, so to that point's shard. A shard takes rows up to its capacity; rows beyond it go on clockwise to the
next shard with room. With `slack` 0 the capacities add up to the number of rows, so counts differ by one at most.

Only counts per arc (shards x vnodes rows, a bound that does not depend on the data) reach the driver. It decides which
rank interval of each arc goes to which shard; rows find their interval by their rank in the arc. Ranks come from
salted sub-groups of the arc, so a key with a third of all rows is ranked by many tasks.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Workspace, salted_rank

MASK = (1 << 64) - 1


def ring(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(point, shard) in ring order; a shard's points don't depend on how many shards there are."""
    points = {}
    for shard in range(shards):
        for v in range(vnodes):
            points.setdefault(int.from_bytes(hashlib.blake2b(f"{shard}/{v}".encode(), digest_size=8).digest(), "big", signed=True), shard)
    return sorted(points.items())


def arc_of(position: Column, points: list[int]) -> Column:
    """Index of the first point at or after the position, wrapping; by binary search inside the JVM."""

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo % len(points))
        mid = (lo + hi) // 2
        return F.when(position <= F.lit(points[mid]), search(lo, mid)).otherwise(search(mid + 1, hi))

    return search(0, len(points))


def assign_arcs(counts: dict[int, int], owners: list[int], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot): which ranks of each arc go to which shard.

    First every shard takes its own arcs, in ring order, up to its capacity; what is left over in an arc
    then walks clockwise to the next points whose shard has room.
    """
    used, out, over = [0] * len(capacity), [], []
    for arc, shard in enumerate(owners):
        n = counts.get(arc, 0)
        take = min(n, capacity[shard] - used[shard])
        if take:
            out.append((arc, 0, take, shard, used[shard]))
            used[shard] += take
        if n > take:
            over.append((arc, take, n))
    for arc, start, end in over:
        step = arc
        while start < end:
            step += 1
            if step > arc + len(owners):
                raise ValueError("the shards have less room than there are rows")
            shard = owners[step % len(owners)]
            take = min(end - start, capacity[shard] - used[shard])
            if take > 0:
                out.append((arc, start, start + take, shard, used[shard]))
                used[shard] += take
                start += take
    return out


def capacities(total: int, shards: int, slack: float) -> list[int]:
    if slack > 0:
        return [-int(-(1 + slack) * total // shards)] * shards
    return [total // shards + (s < total % shards) for s in range(shards)]


def shard_rows(df: DataFrame, key: str, shards: int, vnodes: int = 64, slack: float = 0.0, salt_rows: int = 200, carry: tuple[str, ...] = ()) -> DataFrame:
    """Deal the rows of df to shards; returns carry columns, key, shard int, slot long (gapless from 0 in each shard).

    Null keys are a key like any other; repeated rows are dealt one by one; an empty table gives no rows. `carry` names
    or keeps small columns: texts should be joined later, by key. Other columns are ignored, so none can clash.
    """
    if shards < 1 or vnodes < 1 or slack < 0:
        raise ValueError("shards and vnodes must be positive, slack not negative")
    spark: SparkSession = df.sparkSession
    ws = Workspace(spark, "sharding")
    circle = ring(shards, vnodes)
    points, owners = [p for p, _ in circle], [s for _, s in circle]
    position = F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("\x00null")))
    rows = ws.save(
        df.select(F.col(key), *[F.col(c) for c in carry if c != key], position.alias("__pos"), F.monotonically_increasing_id().alias("__uid"))
        .withColumn("__arc", arc_of(F.col("__pos"), points)),
        "rows",
    )
    total = rows.count()
    salts = max(16, min(4096, -(-total // (salt_rows * len(points)))))
    rows = rows.withColumn("__salt", F.pmod(F.xxhash64("__uid"), F.lit(salts)).cast("int"))
    counts = rows.groupBy("__arc", "__salt").agg(F.count("*").alias("__n"))
    per_arc = {r[0]: r[1] for r in counts.groupBy("__arc").agg(F.sum("__n")).collect()}  # shards x vnodes rows at most
    pieces = assign_arcs(per_arc, owners, capacities(total, shards, slack))
    # One interval an arc and one more for each time a shard fills up while it takes overflow.
    table = spark.createDataFrame(pieces, "p_arc int, p_from long, p_to long, shard int, p_slot long")
    before = salted_rank(counts, ["__arc"], "__salt", "__n").select(F.col("__arc").alias("b_arc"), F.col("__salt").alias("b_salt"), "before")
    w = Window.partitionBy("__arc", "__salt").orderBy("__pos", "__uid")
    ranked = rows.withColumn("__rn", F.row_number().over(w).cast("long"))
    ranked = ranked.join(before, (F.col("__arc") == F.col("b_arc")) & (F.col("__salt") == F.col("b_salt")))
    ranked = ranked.withColumn("__rank", F.col("__rn") - 1 + F.col("before"))
    out = ranked.join(F.broadcast(table), (F.col("__arc") == F.col("p_arc")) & (F.col("__rank") >= F.col("p_from")) & (F.col("__rank") < F.col("p_to")))
    return out.select(key, *[c for c in carry if c != key], "shard", (F.col("p_slot") + F.col("__rank") - F.col("p_from")).alias("slot"))


def home_shard(value: str, shards: int, vnodes: int, position: int) -> int:
    """The shard that owns a hash position, without loads (for tests and lookups)."""
    circle = ring(shards, vnodes)
    return circle[bisect.bisect_left([p for p, _ in circle], position) % len(circle)][1]


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 7 under the law `rows`: counts are one apart at most."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce("text", F.lit(""))
    small = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    dealt = shard_rows(small, "doc_id", 8, carry=("size", "text_crc32"))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

"""Embedding near-duplicates by cross-polytope hashing.

A vector is rotated by three rounds of random signs and a fast Hadamard transform; its hash is the axis, with its sign, of
the largest coordinate. A bucket joins the hashes of several such rotations: as many as it takes for unrelated vectors to
share few buckets, whatever their number. Each of a number of tables puts a vector into the buckets of its `probes` nearest
axes in every rotation, so near pairs meet even where a hash flips; the probability that a pair at the threshold does is
measured on simulated pairs, and there are as many tables as the asked recall needs.

Buckets are counted by their numbers alone; only members of buckets with company are sent, with their vectors. Pairs of a
bucket are verified by their cosine in double precision; a pair that meets in several buckets counts in the one of the
least number. Equal vectors enter once, with the number of their copies. A bucket of over `cap` vectors is cut into parts,
and every two parts meet in a task of their own, so nothing is capped. Tasks return sums and stars, not pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .shared import Workspace, meet_in_parts, ship, sorted_blocks

NONE, TABLE = np.iinfo(np.int64).max, 255


def hadamard(x: np.ndarray) -> np.ndarray:
    """Columns of x (a power of two long) times the Hadamard matrix, in d log d steps, scaled to keep lengths."""
    d, n = x.shape
    h, y = 1, x.copy()
    while h < d:
        # Columns are vectors, so that each step runs over long contiguous rows.
        pairs = y.reshape(d // (2 * h), 2, h, n)
        sums = pairs[:, 0] + pairs[:, 1]
        np.subtract(pairs[:, 0], pairs[:, 1], out=pairs[:, 1])
        pairs[:, 0] = sums
        h *= 2
    return y / y.dtype.type(np.sqrt(d))


def rotated_axes(x: np.ndarray, tables: int, rotations: int, probes: int, seed: int) -> np.ndarray:
    """The `probes` nearest signed axes of unit rows, of shape (rows, tables, rotations, probes)."""
    n, d = x.shape
    wide = _wide(d)
    start = np.zeros((wide, n), np.float32)
    start[:d] = x.T
    out, each = np.empty((n, tables, rotations, probes), np.int32), np.arange(n)
    for t in range(tables):
        for r in range(rotations):
            signs = np.random.default_rng([seed, d, t, r]).choice(np.array((-1, 1), np.float32), (3, wide))
            y = start
            for s in signs:
                y = hadamard(y * s[:, None])
            size = np.abs(y)
            for p in range(probes):
                near = size.argmax(axis=0)
                out[:, t, r, p] = 2 * near + (y[near, each] < 0)
                size[near, each] = -1
    return out


def _wide(d: int) -> int:
    return 1 << max(1, (d - 1).bit_length())


def bucket_keys(axes: np.ndarray, family: np.ndarray) -> np.ndarray:
    """Signed 64-bit bucket numbers (rows, tables, probes ** rotations) of axes in a family of vectors that may link; the last byte is the table."""
    n, tables, rotations, probes = axes.shape
    out = np.empty((n, tables, probes**rotations), np.uint64)
    for p, chosen in enumerate(product(range(probes), repeat=rotations)):
        z = family.view(np.uint64)[:, None] + np.arange(1, tables + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for r, i in enumerate(chosen):
            z = _mixed(z ^ axes[:, :, r, i].astype(np.uint64))
        out[:, :, p] = z & ~np.uint64(TABLE) | np.arange(tables, dtype=np.uint64)
    return out.view(np.int64)


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def plan_tables(n: int, d: int, threshold: float, probes: int, recall: float, pairs: int = 4000) -> tuple[int, int]:
    """(tables, rotations) for n vectors of d components: a pair at the threshold shares a bucket with a probability of `recall`."""
    wide = _wide(d)
    rotations = max(3, math.ceil(math.log(max(n, 2)) / math.log(2 * wide)))
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(2, pairs, d))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(axis=1)[:, None] * a
    norm = np.linalg.norm(b, axis=1)[:, None]
    b = threshold * a + math.sqrt(max(0.0, 1 - threshold**2)) * np.divide(b, norm, out=np.zeros_like(b), where=norm > 0)
    x, y = (rotated_axes(v, 1, 1, min(probes, wide), 3)[:, 0, 0] for v in (a, b))
    meet = (x[:, :, None] == y[:, None, :]).any(axis=(1, 2)).mean() ** rotations
    tables = max(1, math.ceil(math.log(1 - recall) / math.log(1 - min(max(meet, 1e-9), 1 - 1e-9))))
    if tables > TABLE:
        raise ValueError(f"a recall of {recall} at {threshold} takes {tables} tables, over {TABLE}")
    return tables, rotations


def _prepare(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """id, label, key (digest of the vector; null if it links with nothing), vec (its components as they came)."""
    floats = _floats(vectors, vector_col)
    slim = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, vecs = [], []
            for label, v in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                x = None if label is None or not v.is_valid or v.values.null_count else np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64) + 0.0
                good = x is not None and len(x) and np.isfinite(x).all() and x.any()
                vecs.append(x.astype(floats).tobytes() if good else None)
                keys.append(hashlib.sha256(vecs[-1]).digest() if good else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(vecs, pa.binary())], names=["id", "label", "key", "vec"])

    return slim.mapInArrow(work, "id long, label string, key binary, vec binary").withColumn("uid", F.monotonically_increasing_id())


def _floats(vectors: DataFrame, vector_col: str) -> type:
    return np.float32 if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else np.float64


def _unit(vecs: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Doubles, scaled row by row; their lengths; rows of length 1. width: bytes of a component."""
    x = np.frombuffer(b"".join(vecs), f"f{width}").reshape(len(vecs), -1).astype(np.float64)
    scale = np.abs(x).max(axis=1)[:, None]  # so that squares of tiny or huge numbers stay finite
    y = x / scale
    norm = np.sqrt((y * y).sum(axis=1))
    return y, norm, y / norm[:, None]


def embedding_groups(
    vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", recall: float = 0.9999, probes: int = 2, cap: int = 1024, seed: int = 7
) -> DataFrame:
    """id_col, n_links long, component_id long, kept boolean; one row per row.

    Only vectors of equal, non-null labels and equal length link, at a cosine of `threshold` or more; a pair at the threshold is
    found with a probability of `recall`, nearer ones with a higher one. Null, empty and zero vectors and those with null or
    non-finite components link with nothing; their component is their id. Repeated rows are vectors of their own and link. Null ids
    never name a component unless no other id can. Other columns are ignored. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    ws = Workspace(spark, "embeddings")
    rows = ws.save(_prepare(vectors, id_col, vector_col, label_col), "rows")
    width = np.dtype(_floats(vectors, vector_col)).itemsize
    reps = rows.filter("key is not null").groupBy("label", "key", (F.octet_length("vec") / width).cast("int").alias("d")).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("m"), F.min("uid").alias("rid"))
    # Whose vectors may link: of equal label and length.
    reps = ws.save(reps.withColumn("family", F.xxhash64("label", "d")), "distinct")
    n, longest = reps.agg(F.count(F.lit(1)), F.max("d")).first()
    tables, rotations = plan_tables(n, longest or 1, threshold, probes, recall)
    layout = (tables, rotations, "i1" if _wide(longest or 1) <= 64 else "i2" if _wide(longest or 1) < 1 << 14 else "i4")

    def hash_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.array([len(v) for v in batch.column(2).to_pylist()])
            for length in np.unique(lengths).tolist():
                part = batch.take(pa.array(np.flatnonzero(lengths == length)))
                for i in range(0, part.num_rows, 4096):
                    some = part.slice(i, 4096)
                    unit = _unit(some.column(2).to_pylist(), width)[2]
                    axes = rotated_axes(unit, tables, rotations, min(probes, _wide(unit.shape[1])), seed)
                    yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array([a.tobytes() for a in axes.astype(layout[2])], pa.binary())], names=["rid", "family", "axes"])

    first = rows.join(reps.select("rid", "family"), F.col("uid") == F.col("rid")).select("rid", "family", "vec")
    hashed = ws.save(first.mapInArrow(hash_all, "rid long, family long, axes binary"), "axes")

    def to_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                some = batch.slice(i, 2048)
                for at, keys in _keys(some.column(2).to_pylist(), some.column(1).to_numpy(zero_copy_only=False), layout):
                    rid = some.column(0).to_numpy(zero_copy_only=False)[at]
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(rid, keys[0].size))], names=["bucket", "rid"])

    buckets = hashed.mapInArrow(to_keys, "bucket long, rid long")
    shared = ws.save(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket"), "shared-buckets")
    live = ws.save(buckets.join(shared, "bucket", "left_semi"), "live")
    dealt = meet_in_parts(ws, live, ["bucket"], "rid", cap).select("bucket", "part", "other", "inside", "rid")
    sent = ws.save(live.select("rid").distinct(), "live-vectors")
    sent = hashed.join(sent, "rid", "left_semi").join(rows.select(F.col("uid").alias("rid"), "vec"), "rid").join(reps.select("rid", "m"), "rid")
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.join(ws.save(sent, "sent"), "rid").select("bucket", "part", "other", "inside", "rid", "m", "family", "axes", "vec").repartition(n_parts, "bucket", "part", "other")

    def counted_here(axes: np.ndarray, family: np.ndarray, a: np.ndarray, b: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Which of the pairs (a, b) share `bucket` first: in no table before, and as the least common one of its table."""
        first = np.zeros(len(a), bool)
        size = np.array([len(x) for x in axes[a].tolist()])
        for n in np.unique(size).tolist():
            own = np.flatnonzero(size == n)
            used, back = np.unique(np.concatenate([a[own], b[own]]), return_inverse=True)
            raw = np.frombuffer(b"".join(axes[used].tolist()), layout[2]).reshape(len(used), *layout[:2], -1)
            x, z, table = back[: len(own)], back[len(own) :], bucket[own] & TABLE
            left = np.arange(len(own))
            for t in range(tables):
                # A table is shared where every rotation has an axis in common; few pairs outlast the first tables.
                todo = left[table[left] > t]
                met = np.zeros(len(own), bool)
                for k in range(0, len(todo), 1 << 16):
                    some = todo[k : k + (1 << 16)]
                    met[some] = (raw[x[some], t][:, :, :, None] == raw[z[some], t][:, :, None, :]).any(axis=(2, 3)).all(axis=1)
                left = left[~met[left]]
            for k in range(0, len(left), 1 << 12):
                some = left[k : k + (1 << 12)]
                at = np.arange(len(some))
                ka, kb = (bucket_keys(raw[i[some]], np.ascontiguousarray(family[used[i[some]]], np.int64))[at, table[some]] for i in (x, z))
                least = np.where(ka[:, :, None] == kb[:, None, :], ka[:, :, None], NONE).min(axis=(1, 2))
                first[own[some]] = least == bucket[own[some]]
        return first

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, start in sorted_blocks(batches, 3):
            bucket, part, other, inside, rid, m, family, axes, vec = columns
            if not len(bucket):
                continue
            start = np.array(start, np.int64)
            # Vectors of a block as doubles, by their length, and where each lies among those of its length.
            long, place, made = np.array([len(v) for v in vec.tolist()]), np.empty(len(vec), np.int64), {}
            for length in np.unique(long).tolist():
                at = np.flatnonzero(long == length)
                place[at] = np.arange(len(at))
                y, norm, _ = _unit(vec[at].tolist(), width)
                made[length] = y, norm
            pairs: list[tuple[np.ndarray, np.ndarray]] = []

            def told() -> Iterator[pa.RecordBatch]:
                if pairs:
                    a, b = np.concatenate([p for p, _ in pairs]), np.concatenate([q for _, q in pairs])
                    pairs.clear()
                    first = counted_here(axes, family, a, b, bucket[a])
                    yield _stars(rid, m, a[first], b[first])

            # Most buckets hold two vectors: all of a block at once.
            size = np.diff(start)
            two = start[:-1][size == 2]
            two = two[(part[two] == other[two]) & (family[two] == family[two + 1]) & (long[two] == long[two + 1])]
            for length, (y, norm) in made.items():
                p = two[long[two] == length]
                x, z = place[p], place[p + 1]
                near = p[(y[x] * y[z]).sum(axis=1) / (norm[x] * norm[z]) >= threshold]
                pairs.append((near, near + 1))
            held = 0
            for lo, hi in zip(start[:-1][size > 1].tolist(), start[1:][size > 1].tolist(), strict=True):
                alone = part[lo] == other[lo]
                if hi - lo == 2 and alone:
                    continue
                own = inside[lo:hi].astype(bool)
                for length in np.unique(long[lo:hi]).tolist():
                    y, norm = made[length]
                    mine, rest = (lo + np.flatnonzero((long[lo:hi] == length) & k) for k in (own, own if alone else ~own))
                    x, z = place[mine], place[rest]
                    cosine = (y[x] @ y[z].T) / (norm[x][:, None] * norm[z][None, :])
                    i, j = np.nonzero((cosine >= threshold) & (family[mine][:, None] == family[rest][None, :]))
                    a, b = mine[i], rest[j]
                    if alone:
                        a, b = a[a < b], b[a < b]
                    pairs.append((a, b))
                    held += len(a)
                if held > 1 << 16:
                    yield from told()
                    held = 0
            yield from told()

    found = ws.save(dealt.sortWithinPartitions("bucket", "part", "other").mapInArrow(verify, "rid long, links long, root long"), "found")
    parts = connected_components(ws, found.select(F.col("rid").alias("a"), F.col("root").alias("b")))
    sums = ws.save(found.groupBy("rid").agg(F.sum("links").alias("links")), "links")
    named = reps.select("label", "key", "rep", "m", "rid").join(parts, F.col("rid") == F.col("node"), "left").withColumn("c", F.coalesce("component", "rid"))
    named = ws.save(named.join(sums, "rid", "left").select("label", "key", "rep", "m", "c", F.coalesce("links", F.lit(0)).alias("links")), "named")
    names = ws.save(named.groupBy("c").agg(F.min("rep").alias("component_id")), "names")
    named = ws.save(named.join(names, "c").select("label", "key", (F.col("links") + F.col("m") - 1).alias("n_links"), "component_id"), "classes")
    ws.clear(rows, named)
    out = rows.select("id", "label", "key").join(named, ["label", "key"], "left")
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def _stars(rid: np.ndarray, m: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """rid, links, root: of the pairs' members the number of their links, and the smallest rid of their cluster among these pairs."""
    used, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, who, copies = back[: len(a)], back[len(a) :], rid[used], m[used]
    links, least = np.zeros(len(used), np.int64), who.copy()
    np.add.at(links, a, copies[b])
    np.add.at(links, b, copies[a])
    while True:
        before = least.copy()
        np.minimum.at(least, a, least[b])
        np.minimum.at(least, b, least[a])
        if (before == least).all():
            return pa.RecordBatch.from_arrays([pa.array(who), pa.array(links), pa.array(least)], names=["rid", "links", "root"])


def _keys(axes: list[bytes], family: np.ndarray, layout: tuple[int, int, str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their bucket numbers) for each size of axes; vectors of a few components have fewer axes to probe."""
    sizes = np.array([len(a) for a in axes])
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        raw = np.frombuffer(b"".join([axes[i] for i in at]), layout[2]).reshape(len(at), *layout[:2], -1)
        yield at, bucket_keys(raw, np.ascontiguousarray(family[at], np.int64))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

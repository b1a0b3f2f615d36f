"""Near-duplicate texts by SimHash: sketches in BK-trees per shard, then a check of the shingles themselves.

At a Jaccard similarity of 0.8 of five-word shingles a 64-bit SimHash differs in about ten bits, beyond what blocks of its
bits can index: keys of its bits either miss pairs or fill with strangers as the corpus grows. So shards are chosen by
min-wise keys of the shingles: each of BANDS keys joins ROWS minima under as many orders of the shingles, so two
texts share a key with probability 1 - (1 - J**5)**16, 0.998 at 0.8, and texts that have nothing in common share none, however
many there are. Keys of one text alone are dropped before anything is sent. A shard is a BK-tree over sketches of
256 bits; its search follows only edges within the radius. What the trees link are loose groups; inside them, and nowhere
else, sets of shingles are compared exactly: first with the group's root, then, as Jaccard distances obey the triangle
inequality, only those that the root leaves open, in blocks that are split over tasks. No pairs are written.

Sets of few shingles give votes that flip too often for this. Those of up to FEW meet by equality of a shingle in their
prefixes instead: of two sets of similarity 0.8 the least 0.2 n + 1 shingles of each, in one order, have one in common.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import Workspace, conf, meet_in_parts, ship, sorted_groups
from .simhash import FIND_WORDS, BKTree, bit_counts, lowered

#: Bits of the sketch and a radius that holds a pair of similarity 0.8 (38.8 bits apart, deviation 5.7) but for 1 in 1000.
SKETCH, RADIUS = 256, 57
#: Min-wise keys of a text, and the minima that each joins.
BANDS, ROWS = 16, 5
#: Pairs of sets of up to so many shingles are found exactly, whatever their fingerprints; so is any pair with a set of up to 0.8 times as many.
FEW = 80
#: Spark's own runtime Bloom filter, for scans of any size.
BLOOM = {"spark.sql.optimizer.runtime.bloomFilter.enabled": "true", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0", "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1g"}
#: Odd multipliers: each puts 64-bit hashes in another order.
ORDERS = np.random.default_rng(11).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str | None, shingle: int, seed: int = 42) -> np.ndarray:
    """The sorted set of 64-bit hashes of the runs of `shingle` words (fewer words: all of them; none: empty)."""
    found = FIND_WORDS(lowered(text))
    if not found:
        return np.zeros(0, np.uint64)
    grams = [" ".join(found)] if len(found) <= shingle else map(" ".join, zip(*[found[i:] for i in range(shingle)], strict=False))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(g, seed) for g in grams), np.uint64))


def remixed(hashes: np.ndarray, words: int) -> np.ndarray:
    """(n, words) independent 64-bit hashes from one, by a multiply-shift mixer."""
    out = np.empty((len(hashes), words), np.uint64)
    for w in range(words):
        z = hashes + np.uint64(0x9E3779B97F4A7C15 * (w + 1) % (1 << 64))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, w] = z ^ (z >> np.uint64(31))
    return out


def sketch(hashes: np.ndarray, bits: int = SKETCH) -> bytes:
    """A SimHash of `bits` bits."""
    words = bits // 64
    ones = np.zeros(bits, np.int64)
    for i in range(0, len(hashes), 1 << 12):
        ones += bit_counts(remixed(hashes[i : i + (1 << 12)], words))
    return np.packbits(2 * ones > len(hashes)).tobytes()


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """BANDS signed 64-bit keys of a set that is not empty."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 1 << 12):
        np.minimum(least, (hashes[i : i + (1 << 12), None] * ORDERS).min(axis=0), out=least)
    mixed = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        mixed = remixed(mixed ^ row, 1)[:, 0]
    return mixed.view(np.int64)


def shards_of(ws: Workspace, reps: DataFrame) -> DataFrame:
    """reps(rid, keys, held) -> key, rid, held: the members of each key that more than one has, written."""
    keys = reps.select("rid", F.explode("keys").alias("key"))
    shared = ws.save(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "shared-keys")
    live = ws.save(keys.join(shared, "key", "left_semi"), "live-keys")
    return ws.save(live.join(reps.select("rid", "held"), "rid").select("key", "rid", "held"), "shards")


def near_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, tree_rows: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, text_key, component_id, kept: the rows, told by their id and xxhash64 of their text, that are near other ones.

    Texts are near when the Jaccard similarity of their sets of shingles reaches `similarity` (exactly), or they have no word.
    component_id is the smallest id of the group, kept is true for one row of it: that id's (of its texts the one of the least key).
    Rows with a null id are left out; an id on several rows may be in several groups; rows equal in both are one. An empty
    table gives no rows. Pairs are found with the probability of sharing a key: 0.998 at similarity 0.8, more above it; those of few
    shingles (FEW) always.
    """
    spark = docs.sparkSession
    ship(spark)
    ws = Workspace(spark, "near-text")
    text = F.col(text_col).cast("string")
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text")).filter("id is not null")

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, sketches, few, keys = [], [], [], []
            for t in batch.column(2).to_pylist():
                h = shingle_hashes(t, shingle)
                large = len(h) > similarity * FEW
                sets.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
                sketches.append(sketch(h) if large else None)
                few.append(h.view(np.int64) if 0 < len(h) <= FEW else None)
                keys.append(band_keys(h) if large else None)
            columns = [pa.array(sets, pa.binary()), pa.array(sketches, pa.binary()), pa.array(few, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["id", "text_key", "same", "sketch", "few", "keys"])

    rows = ws.save(slim.mapInArrow(prints, "id long, text_key long, same binary, sketch binary, few array<long>, keys array<long>"), "fingerprints")
    # Rows of equal sets are one from here on: a small table, which the tasks of a hot set combine before the exchange.
    reps = rows.groupBy("same").agg(F.min(F.struct("id", "text_key")).alias("at"), *[F.any_value(c).alias(c) for c in ("sketch", "few", "keys")])
    reps = ws.save(reps.withColumn("rid", F.monotonically_increasing_id()), "distinct")
    shards = shards_of(ws, reps.filter("keys is not null").select("rid", "keys", F.col("sketch").alias("held")))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = meet_in_parts(ws, shards, ["key"], "rid", tree_rows).select("key", "part", "other", "inside", "rid", "held")
    dealt = dealt.repartition(n, "key", "part", "other").sortWithinPartitions("key", "part", "other")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for _, _, _, inside, rid, prints in sorted_groups(batches, 3):
            values = [int.from_bytes(s, "little") for s in prints.tolist()]
            out += _loose(values, rid.tolist(), inside.tolist())
            if len(out) > 10000:
                yield _pairs(out)
                out = []
        yield _pairs(out)

    loose = ws.save(connected_components(ws, ws.save(dealt.mapInArrow(search, "a long, b long"), "loose-links")), "loose")
    placed = reps.select("rid", "at.id", "at.text_key").join(loose, F.col("rid") == F.col("node")).select("rid", F.col("component").alias("loose"), F.col("id").alias("r_id"), F.col("text_key").alias("r_key"))
    # Most texts are in no loose group: where texts must be exchanged for this join, a Bloom filter of the groups' ids goes before.
    placed = ws.save(placed, "placed").filter("rid >= 0")
    members = slim.join(placed, (F.col("id") == F.col("r_id")) & (F.col("text_key") == F.col("r_key"))).select("rid", "loose", "text")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_hashes(t, shingle).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.large_binary()).cast(pa.binary())], names=["rid", "loose", "shingles"])

    with conf(spark, BLOOM):
        members = ws.save(members.mapInArrow(to_sets, "rid long, loose long, shingles binary"), "members")
    # One root a group, so this join has one row a key on one side.
    roots = ws.save(members.filter("rid = loose").groupBy("loose").agg(F.any_value("shingles").alias("root")), "roots")

    def from_root(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = []
            for own, root in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                a, b = np.frombuffer(own, np.uint64), np.frombuffer(root, np.uint64)
                shared = len(np.intersect1d(a, b, assume_unique=True))
                far.append(1 - shared / (len(a) + len(b) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(far, pa.float64())], names=["rid", "loose", "far"])

    far = ws.save(members.join(roots, "loose").select("rid", "loose", "shingles", "root").mapInArrow(from_root, "rid long, loose long, far double"), "far")
    reach = 1 - similarity + 1e-9
    links = far.filter(f"far <= {reach} and rid <> loose").select(F.col("rid").alias("a"), F.col("loose").alias("b"))
    # Two members within reach of each other differ by no more than that in their distance to the root.
    open_from = ws.save(far.filter(f"far > {reach}").groupBy("loose").agg((F.min("far") - reach).alias("open_from")), "open")
    undecided = far.join(open_from, "loose").filter("far >= open_from").select("rid").distinct()
    undecided = ws.save(members.join(ws.save(undecided, "undecided"), "rid", "left_semi"), "undecided-sets")
    met = meet_in_parts(ws, undecided, ["loose"], "rid", 128).select("loose", "part", "other", "inside", "rid", "shingles")
    met = met.repartition(n, "loose", "part", "other").sortWithinPartitions("loose", "part", "other")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part, other, inside, ids, packed in sorted_groups(batches, 3):
            yield _pairs(_exact(ids, [np.frombuffer(p, np.uint64) for p in packed.tolist()], inside.astype(bool), part[0] == other[0], similarity))

    links = ws.save(links.unionByName(met.mapInArrow(compare, "a long, b long")), "links")

    # Sets of few shingles: members of the same prefix shingle, with their whole sets.
    n_prefix = (F.size("few") - F.ceil(similarity * F.size("few") - 1e-6) + 1).cast("int")
    short = shards_of(ws, reps.filter("few is not null").select("rid", F.slice("few", F.lit(1), F.least(n_prefix, F.size("few"))).alias("keys"), F.col("few").alias("held")))
    at = meet_in_parts(ws, short, ["key"], "rid", 128).select("key", "part", "other", "inside", "rid", "held")
    at = at.repartition(n, "key", "part", "other").sortWithinPartitions("key", "part", "other")

    def compare_few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part, other, inside, ids, held in sorted_groups(batches, 3):
            yield _pairs(_exact(ids, [np.asarray(h).view(np.uint64) for h in held.tolist()], inside.astype(bool), part[0] == other[0], similarity))

    near = ws.save(connected_components(ws, ws.save(links.unionByName(at.mapInArrow(compare_few, "a long, b long")), "all-links")), "near")
    # Rows of a set take its group; a group of one row isn't one.
    groups = ws.save(reps.select("same", "rid").join(near, F.col("rid") == F.col("node"), "left").select("same", F.coalesce("component", "rid").alias("c")), "sets")
    placed = ws.save(rows.select("id", "text_key", "same").join(groups, "same").select("id", "text_key", "c").distinct(), "rows")
    first = placed.groupBy("c").agg(F.min(F.struct("id", "text_key")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    out = placed.join(ws.save(first, "first"), "c").select(F.col("id").alias(id_col), "text_key", F.col("first.id").alias("component_id"), (F.struct("id", "text_key") == F.col("first")).alias("kept"))
    out = ws.save(out, "groups")
    ws.clear(out)
    return out


def _pairs(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])


def _loose(values: list[int], rids: list[int], inside: list[bool]) -> list[tuple[int, int]]:
    tree, where = BKTree(), []
    for i, own in enumerate(inside):
        if own:
            tree.add(values[i])
            where.append(i)
    parent = list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i, value in enumerate(values):
        for j in tree.within(value, RADIUS):
            a, b = root(i), root(where[j])
            if a != b:
                parent[max(a, b)] = min(a, b)
    return [(rids[i], rids[r]) for i in range(len(values)) if (r := root(i)) != i]


def _exact(ids: np.ndarray, sets: list[np.ndarray], inside: np.ndarray, alone: bool, similarity: float) -> list[tuple[int, int]]:
    """A star for each cluster of members whose sets are similar: all pairs of one part, or of one part with another."""
    n = len(ids)
    size = np.array([len(s) for s in sets])
    if not size.any():
        return [(int(ids[0]), int(i)) for i in ids[1:]]
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
    _, gram = np.unique(flat, return_inverse=True)
    # Shared shingles of all pairs: a product of the members' indicator rows, some columns at a time.
    order = np.argsort(gram, kind="stable")
    gram, owner = gram[order], owner[order]
    left, right = (np.arange(n), np.arange(n)) if alone else (np.flatnonzero(inside), np.flatnonzero(~inside))
    shared = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, int(gram[-1]) + 1, 4096):
        a, b = np.searchsorted(gram, (start, start + 4096))
        has = np.zeros((n, 4096), np.float32)
        has[owner[a:b], gram[a:b] - start] = 1
        shared += has[left] @ has[right].T
    union = size[left][:, None] + size[right][None, :] - shared
    close = np.where(union > 0, shared >= similarity * union - 1e-6, True)
    i, j = np.nonzero(close)
    least, a, b = ids.copy(), left[i], right[j]
    while True:
        before = least.copy()
        np.minimum.at(least, a, least[b])
        np.minimum.at(least, b, least[a])
        if (before == least).all():
            break
    return [(int(x), int(y)) for x, y in zip(ids, least, strict=True) if x != y]

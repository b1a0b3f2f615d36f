"""SimHash near-duplicates, found by BK-trees.

A pair of fingerprints within `radius` bits agrees in at least `keys` of `keys + radius` blocks of bits. For every
choice of `keys` blocks, fingerprints that agree there form a shard with a BK-tree of its own: a node's children hang on
the Hamming distance to it, and a search follows only the edges within the radius of the distance found. So each pair
within the radius meets in some shard: the search is exact. Copies of a fingerprint enter once.

A shard with more than `tree_rows` fingerprints is split: each part makes a tree, and every member of the shard is sent to
each part's tree, so no task holds more than two parts. Trees are sent by exchange to the tasks that search
them; a broadcast of all trees would have no bound. Links leave a task as one star for each cluster it
saw, not as pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .shared import Workspace, meet_in_parts, ship, sorted_groups

WORD = r"[^\x20\x09-\x0D]+"
LOWER = {c: c + 32 for c in range(65, 91)}


FIND_WORDS = regex.compile(WORD).findall


def lowered(text: str | None) -> str:
    """A-Z lower-cased, other letters as they are."""
    text = text or ""
    return text.lower() if text.isascii() else text.translate(LOWER)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the unsigned 64-bit hashes have each bit, from the highest; of (n, words) for all words in a row."""
    rows = hashes.astype(">u8").view(np.uint8).reshape(len(hashes), -1)
    out = np.zeros(8 * rows.shape[1], np.int64)
    for i in range(0, len(rows), 255):  # so that counts fit a byte, which sums fastest
        out += np.add.reduce(np.unpackbits(rows[i : i + 255], axis=1), axis=0, dtype=np.uint8)
    return out


def fingerprint(hashes: np.ndarray) -> int:
    """Bit b is 1 if it is set in over half of the unsigned 64-bit hashes; of none: 0."""
    if not len(hashes):
        return 0
    return int.from_bytes(np.packbits(2 * bit_counts(hashes) > len(hashes)).tobytes(), "big")


def text_fingerprint(text: str | None, shingle: int, seed: int) -> int:
    """Of the XXH64 of each run of `shingle` words (fewer words: all of them; none: 0), A-Z lower-cased."""
    found = FIND_WORDS(lowered(text))
    if not found:
        return 0
    grams = [" ".join(found)] if len(found) <= shingle else map(" ".join, zip(*[found[i:] for i in range(shingle)], strict=False))
    digest = xxhash.xxh64_intdigest
    return fingerprint(np.fromiter((digest(g, seed) for g in grams), np.uint64))


def fingerprints(docs: DataFrame, shingle: int, seed: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id long, fp long (the 64 bits as a signed number) of whole texts."""
    ship(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((text_fingerprint(t, shingle, seed) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, "id long, fp long")


class BKTree:
    """Distinct 64-bit numbers; a child hangs on its Hamming distance to its parent."""

    __slots__ = ("values", "children")

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        at, new = 0, len(self.values) - 1
        while new:
            distance = (self.values[at] ^ value).bit_count()
            if (below := self.children[at].get(distance)) is None:
                self.children[at][distance] = new
                return
            at = below

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Indexes of the values within the radius."""
        todo = [0] if self.values else []
        while todo:
            at = todo.pop()
            distance = (self.values[at] ^ value).bit_count()
            if distance <= radius:
                yield at
            todo += [c for edge, c in self.children[at].items() if distance - radius <= edge <= distance + radius]


def _stars(fps: list[int], reps: list[int], tree_part: list[bool], radius: int) -> list[tuple[int, int]]:
    """(rep, smallest rep of its cluster) of the linked members of one group; the tree holds the members in tree_part."""
    tree, where = BKTree(), []
    for i, inside in enumerate(tree_part):
        if inside:
            tree.add(fps[i])
            where.append(i)
    parent = list(range(len(fps)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, fp in enumerate(fps):
        for j in tree.within(fp, radius):
            a, b = root(i), root(where[j])
            if a != b:
                a, b = (a, b) if reps[a] < reps[b] else (b, a)
                parent[b] = a
    return [(reps[i], reps[r]) for i in range(len(fps)) if (r := root(i)) != i]


def link_stars(ws: Workspace, distinct: DataFrame, radius: int, keys: int = 2, tree_rows: int = 1024) -> DataFrame:
    """distinct(fp, rep), a written table of different fingerprints -> a, b: edges with the components of all pairs within the radius.

    rep must not be null. Equal fingerprints on several rows are compared like others. Other columns are ignored; an empty table gives no rows.
    """
    blocks = keys + radius
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum(((1 << (cuts[b + 1] - cuts[b])) - 1) << cuts[b] for b in chosen) for chosen in combinations(range(blocks), keys)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    assert len(masks) == comb(blocks, keys)
    shards = distinct.select("fp", "rep", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed])).alias("t", "key"))
    rows = meet_in_parts(ws, shards, ["t", "key"], "fp", tree_rows).select("t", "key", "part", "other", "inside", "fp", "rep")
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "t", "key", "part", "other").sortWithinPartitions("t", "key", "part", "other")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for _, _, _, _, inside, fp, rep in sorted_groups(batches, 4):
            out += _stars(fp.view(np.uint64).tolist(), rep.tolist(), inside.tolist(), radius)
            if len(out) > 10000:
                yield _edges(out)
                out = []
        yield _edges(out)

    ship(distinct.sparkSession)
    return rows.mapInArrow(work, "a long, b long")


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])


def simhash_groups(docs: DataFrame, shingle: int, radius: int, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, fp long, component_id: the smallest id that links between fingerprints reach.

    One row per row. Null, empty and blank texts have fingerprint 0, which links like any other. Rows with a null id get
    the component of their fingerprint; they don't lend it an id unless no other row has one (then it is null). Repeated
    rows are kept. Other columns are ignored. An empty table gives no rows.
    """
    ws = Workspace(docs.sparkSession, "simhash")
    prints = ws.save(fingerprints(docs, shingle, seed, id_col, text_col), "fingerprints")
    distinct = ws.save(prints.groupBy("fp").agg(F.min("id").alias("rep")), "distinct")
    known = distinct.filter("rep is not null")
    parts = connected_components(ws, ws.save(link_stars(ws, known, radius), "links"))
    classes = ws.save(distinct.join(parts, distinct["rep"] == parts["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id")), "classes")
    return prints.join(classes, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), shingle=3, radius=2)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

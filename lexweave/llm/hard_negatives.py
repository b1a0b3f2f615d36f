"""Hard negatives by branch and bound in ball trees.

Rows are dealt by length, label and a projection into parts of a bounded number of rows, each a few ball trees: balls of halved sets
of vectors, with their centre and radius. The inner product of a query q with any vector of a ball lies within |q| * radius of that
with the centre, so a ball is passed over where all its scores are above or below the query's window, or strictly beneath its
current k-th. Queries meet the trees in a grid of cells, a part of the trees and a group of the queries each; cells return the
first k a query, and those are ranked over all cells.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Workspace, ship

LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
FOUND = "query long, tag long, score long, id long, uid long"


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer rows as int64, exact; beyond 64 bits the nearest that fits."""
    if not a.shape[1]:
        return np.zeros((len(a), len(b)), np.int64)
    top = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * a.shape[1]
    for kind, exact in ((np.float32, 1 << 24), (np.float64, 1 << 53)):
        if top < exact:
            return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, LOWEST, HIGHEST).astype(np.int64)


class Tree:
    """A ball tree over integer vectors (n, d); nodes are rows first..last in the tree's own order."""

    def __init__(self, vecs: np.ndarray, ids: np.ndarray, uids: np.ndarray, labels: list[str], leaf: int = 128):
        self.names = sorted(set(labels))
        code = np.searchsorted(np.array(self.names, object), np.array(labels, object)) if labels else np.zeros(0, np.int64)
        x = vecs.astype(np.float64)
        order = np.arange(len(x))
        nodes, centres, todo = [], [], [(0, len(x), -1)]
        while todo:
            lo, hi, parent = todo.pop()
            at = order[lo:hi]
            centre = x[at].mean(axis=0)
            far = np.sqrt(((x[at] - centre) ** 2).sum(axis=1))
            label = code[at[0]] if (code[at] == code[at[0]]).all() else -1
            # left and right are filled in by the children; -1 marks a leaf.
            nodes.append([lo, hi, -1, -1, label, float(far.max(initial=0.0))])
            centres.append(centre)
            me = len(nodes) - 1
            if parent >= 0:
                nodes[parent][2 if nodes[parent][2] < 0 else 3] = me
            if hi - lo > leaf and far.max() > 0:
                a = x[at[far.argmax()]]
                b = x[at[((x[at] - a) ** 2).sum(axis=1).argmax()]]
                half = (hi - lo) // 2
                order[lo:hi] = at[np.argpartition((x[at] - a) @ (b - a), half)]
                todo += [(lo, lo + half, me), (lo + half, hi, me)]
        self.nodes, self.centres = nodes, np.array(centres)
        self.vecs, self.ids, self.uids, self.code = vecs[order], ids[order], uids[order], code[order]


class Queries:
    """Queries of one cell with what each has found so far: at most k rows, best first."""

    def __init__(self, rows: list[tuple], k: int, same: bool):
        self.uid = np.array([r[0] for r in rows], np.int64)
        self.labels = [r[1] for r in rows]
        self.floor, self.ceiling, self.tag = (np.array([r[i] for r in rows], np.int64) for i in (2, 3, 4))
        self.vecs = _matrix([r[5] for r in rows])
        self.wide = self.vecs.astype(np.float64)
        self.norm = np.sqrt((self.wide**2).sum(axis=1))
        self.k, self.same = k, same
        self.found = np.zeros((4, 0), np.int64)  # query's place, score, id, uid

    def search(self, tree: Tree) -> None:
        if not len(tree.nodes) or tree.vecs.shape[1] != self.vecs.shape[1]:
            return
        codes = {name: i for i, name in enumerate(tree.names)}
        label = np.array([codes.get(x, -2) for x in self.labels])
        todo = [(0, np.arange(len(self.uid)))]
        while todo:
            at, active = todo.pop()
            lo, hi, left, right, pure, radius = tree.nodes[at]
            middle = self.wide[active] @ tree.centres[at]
            reach = self.norm[active] * radius
            slack = 1e-9 * (np.abs(middle) + reach) + 1e-3
            keep = (middle + reach + slack >= self.floor[active]) & (middle - reach - slack <= self.ceiling[active])
            if pure >= 0:
                keep &= (label[active] == pure) == self.same
            active = active[keep]
            if not len(active):
                continue
            if left < 0:
                self._leaf(tree, lo, hi, active, label)
                continue
            # The half where scores are higher comes first, so that k-th scores rise soon.
            first, second = (left, right) if self.wide[active].sum(axis=0) @ (tree.centres[left] - tree.centres[right]) >= 0 else (right, left)
            todo += [(second, active), (first, active)]

    def _leaf(self, tree: Tree, lo: int, hi: int, active: np.ndarray, label: np.ndarray) -> None:
        scores = products(self.vecs[active], tree.vecs[lo:hi])
        fits = (scores >= self.floor[active][:, None]) & (scores <= self.ceiling[active][:, None])
        fits &= (label[active][:, None] == tree.code[lo:hi][None, :]) == self.same
        fits &= self.uid[active][:, None] != tree.uids[lo:hi][None, :]
        i, j = np.nonzero(fits)
        if not len(i):
            return
        come = np.stack([active[i], scores[i, j], tree.ids[lo + j], tree.uids[lo + j]])
        touched = np.zeros(len(self.uid), bool)
        touched[come[0]] = True
        mine = touched[self.found[0]]
        both = np.concatenate([self.found[:, mine], come], axis=1)
        both = both[:, np.lexsort((both[3], both[2], ~both[1], both[0]))]  # ~x is -x - 1, for all of int64
        start = np.searchsorted(both[0], both[0])
        rank = np.arange(both.shape[1]) - start
        full = both[:, rank == self.k - 1]
        self.floor[full[0]] = np.maximum(self.floor[full[0]], full[1])
        self.found = np.concatenate([self.found[:, ~mine], both[:, rank < self.k]], axis=1)

    def results(self) -> pa.RecordBatch:
        at = self.found[0]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (self.uid[at], self.tag[at], *self.found[1:])], names=["query", "tag", "score", "id", "uid"])


def _matrix(vecs: list[bytes]) -> np.ndarray:
    """Integer rows from bytes: their width in the first byte, then the components."""
    return np.array([np.frombuffer(v, f"<i{v[0]}", offset=1) for v in vecs])


def _bytes(x: np.ndarray) -> bytes:
    width = 2 if np.abs(x.astype(np.float64)).max(initial=0) < 1 << 15 else 8
    return bytes([width]) + x.astype(f"<i{width}").tobytes()


def _prepare(ws: Workspace, rows: DataFrame, anchor: Column) -> DataFrame:
    """uid, id, label, anchor, d, place (a projection), vec."""
    usable = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & F.forall("vec", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))))
    slim = usable.select(F.col("id").cast("long").alias("id"), F.col("label").cast("string").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.transform("vec", lambda x: F.floor(x)).alias("vec"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = [np.asarray(v.values.to_numpy(zero_copy_only=False), np.int64) for v in batch.column(3)]
            place = [float(x @ np.random.default_rng(11).normal(size=len(x))) for x in vecs]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([len(x) for x in vecs], pa.int32()), pa.array(place, pa.float64()), pa.array([_bytes(x) for x in vecs], pa.binary())], names=["id", "label", "anchor", "d", "place", "vec"])

    made = slim.mapInArrow(work, "id long, label string, anchor boolean, d int, place double, vec binary")
    return ws.save(made.withColumn("uid", F.monotonically_increasing_id()), "rows")


def _trees(ws: Workspace, rows: DataFrame, part_rows: int, tree_rows: int) -> DataFrame:
    """part int, nth long, labels, data: ball trees of up to tree_rows rows; parts of up to twice part_rows rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        done = 0

        def built() -> pa.RecordBatch:
            nonlocal held, done
            tree = Tree(_matrix([r[4] for r in held]), np.array([r[1] for r in held], np.int64), np.array([r[0] for r in held], np.int64), [r[2] for r in held])
            out = [TaskContext.get().partitionId(), done // (2 * part_rows), done, tree.names, pickle.dumps(tree)]
            done, held = done + len(held), []
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(out, (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.binary()), strict=True)], names=["task", "chunk", "nth", "labels", "data"])

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and (len(held) == tree_rows or row[3] != held[0][3]):
                    yield built()
                held.append(row)
        if held:
            yield built()

    wanted = max(1, -(-rows.count() // part_rows))
    dealt = rows.select("uid", "id", "label", "d", "vec", "place").repartitionByRange(wanted, "d", "label", "place", "uid")
    dealt = dealt.sortWithinPartitions("d", "label", "place", "uid").drop("place")
    trees = ws.save(dealt.mapInArrow(work, "task int, chunk int, nth long, labels array<string>, data binary"), "built")
    # However many tasks the rows were dealt to: neighbouring small ones make a part together.
    used, chunks = trees.agg(F.max("task") + 1, F.max("chunk") + 1).first()
    part = F.floor(F.col("task") * wanted / (used or 1)).cast("int") * (chunks or 1) + F.col("chunk")
    return trees.select(part.alias("part"), (F.col("task").cast("long") * (1 << 40) + F.col("nth")).alias("nth"), "labels", "data")


def _search(ws: Workspace, trees: DataFrame, parts: int, queries: DataFrame, k: int, same: bool, group_queries: int) -> DataFrame:
    """queries(uid, label, lo, hi, tag, vec) -> query, tag, score, id, uid, rank: each query's first k rows with lo <= score <= hi, of its label or of any other."""
    n_groups = max(1, -(-queries.count() // group_queries))
    if same:  # only where the label is
        at = trees.select("part", F.explode("labels").alias("label")).distinct()
        met = queries.join(at, "label")
    else:
        met = queries.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    met = met.select("part", F.pmod(F.xxhash64("uid"), F.lit(n_groups)).cast("int").alias("grp"), F.lit(1).alias("kind"), F.col("uid").alias("nth"), "label", "lo", "hi", "tag", F.col("vec").alias("data"))
    none = F.lit(None)
    sent = trees.select("part", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))).alias("grp"), F.lit(0).alias("kind"), "nth", none.cast("string").alias("label"), *[none.cast("long").alias(c) for c in ("lo", "hi", "tag")], "data")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, here, asked = None, [], []

        def answered() -> Iterator[pa.RecordBatch]:
            for d in {len(q[5]) // q[5][0] if q[5] else 0 for q in asked}:
                some = Queries([q for q in asked if len(q[5]) // q[5][0] == d], k, same)
                for tree in here:
                    some.search(tree)
                yield some.results()
            asked.clear()

        for batch in batches:
            for part, grp, kind, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (part, grp) != cell:
                    yield from answered()
                    cell, here = (part, grp), []
                if kind == 0:
                    here.append(pickle.loads(row[-1]))
                elif here:
                    asked.append(tuple(row))
                    if len(asked) == group_queries:
                        yield from answered()
        yield from answered()

    cells = sent.unionByName(met).repartition(int(ws.spark.conf.get("spark.sql.shuffle.partitions")), "part", "grp").sortWithinPartitions("part", "grp", "kind", "nth")
    w = Window.partitionBy("query", "tag").orderBy(F.col("score").desc(), "id", "uid")
    return ws.save(cells.mapInArrow(work, FOUND).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k), "found")


def mine_negatives(
    rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, part_rows: int = 16384, tree_rows: int = 2048, group_queries: int = 4096
) -> DataFrame:
    """rows(id, label, vec array<double>) -> anchor_id, positive_id, rank int, negative_id, positive_score, negative_score.

    A score is the inner product of the components' floors. Anchors are rows for which `anchor` holds. An anchor's positives are its
    first `positives` other rows of equal label; each one's negatives are the first `negatives` rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score. Higher scores come first, ties by smaller id.

    Rows with a null id, label or vector, or a null or non-finite component take no part. Repeated rows and ids are rows of their own.
    Vectors meet only those of equal length. Scores beyond 64 bits count as the nearest that fits. Positives without a negative have no
    row. Other columns are ignored. An empty table gives no rows. A cell holds up to 2 * part_rows rows and group_queries queries in memory.
    """
    ws = Workspace(rows.sparkSession, "negatives")
    ship(rows.sparkSession)
    all_rows = _prepare(ws, rows.select("id", "label", F.col("vec").cast("array<double>").alias("vec"), anchor.alias("anchor")), F.col("anchor"))
    trees = _trees(ws, all_rows, part_rows, tree_rows)
    parts = (trees.agg(F.max("part")).first()[0] or 0) + 1
    anchors = all_rows.filter("anchor")
    asked = anchors.select("uid", "label", F.lit(LOWEST).cast("long").alias("lo"), F.lit(HIGHEST).cast("long").alias("hi"), F.lit(0).cast("long").alias("tag"), "vec")
    near = _search(ws, trees, parts, asked, positives, True, group_queries)
    # Positives of equal score have equal windows: asked once. Bounds are whole numbers, reckoned without overflow.
    share = lambda k: F.col("score").cast("decimal(38,0)") * k / 100
    windows = near.select(F.col("query").alias("uid"), "score").distinct().withColumns({"lo": F.ceil(share(low)).cast("long"), "hi": F.floor(share(high)).cast("long")}).filter("lo <= hi")
    asked = ws.save(windows.join(anchors.select("uid", "label", "vec"), "uid").select("uid", "label", "lo", "hi", F.col("score").alias("tag"), "vec"), "windows")
    far = _search(ws, trees, parts, asked, negatives, False, group_queries)
    pairs = near.select("query", F.col("score").alias("tag"), F.col("id").alias("positive_id")).join(far, ["query", "tag"])
    out = pairs.join(anchors.select(F.col("uid").alias("query"), F.col("id").alias("anchor_id")), "query").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("tag").alias("positive_score"), F.col("score").alias("negative_score")
    )
    out = ws.save(out, "negatives")
    ws.clear(out)
    return out


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth embedding; every seventh one's label is the next."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table.select(F.col("vec_id").alias("id"), label.alias("label"), F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 256).alias("vec"))
    return mine_negatives(rows, F.col("id") % 100 == 0)

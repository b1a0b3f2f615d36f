"""Operator 11 against plain search, and its trees by themselves."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.llm import hard_negatives

from ..conftest import SF


def plain(rows, is_anchor, positives=5, negatives=10, low=30, high=90):
    """rows (id, label, integer vector) -> sorted result rows, all products in Python's whole numbers."""
    out = []
    for a, (i, label, x) in enumerate(rows):
        if not is_anchor(i):
            continue
        scored = [(-sum(p * q for p, q in zip(x, y, strict=True)), j, b, other) for b, (j, other, y) in enumerate(rows) if b != a and len(x) == len(y)]
        scored.sort()
        same = [s for s in scored if s[3] == label][:positives]
        rest = [s for s in scored if s[3] != label]
        for p, pid, *_ in same:
            some = [s for s in rest if low * -p <= 100 * -s[0] <= high * -p][:negatives]
            out += [(i, pid, r, s[1], -p, -s[0]) for r, s in enumerate(some, 1)]
    return sorted(out)


def got(frame):
    return sorted(tuple(r) for r in frame.collect())


@pytest.mark.parametrize("sf", [SF, SF.replace("0.001", "0.1")])
def test_query_against_plain_search(spark, sf):
    rows = []
    for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect():
        if r.label is not None and r.embedding is not None and all(x is not None and math.isfinite(x) for x in r.embedding):
            rows.append((r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, [math.floor(256 * float(x)) for x in r.embedding]))
    result = hard_negatives.op11_hard_negatives(spark, sf)
    assert result.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]
    assert got(result) == plain(rows, lambda i: i % 100 == 0)


@pytest.mark.parametrize("seed", range(3))
def test_small_parts_ties_and_hot_labels(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        vec = [rng.randint(-3, 3) for _ in range(4)] if rng.random() < 0.6 else [2, 1, 0, 1]
        rows.append((rng.randint(0, 300), rng.choice("aaaabc"), vec))
    frame = spark.createDataFrame([(i, x, [v + 0.25 for v in y]) for i, x, y in rows], "id long, label string, vec array<double>")
    result = hard_negatives.mine_negatives(frame, F.col("id") % 10 == 0, part_rows=40, tree_rows=16, group_queries=8)
    assert got(result) == plain(rows, lambda i: i % 10 == 0)


def test_balls_hold_their_rows_and_bounds_prune():
    rng = np.random.default_rng(2)
    spots = rng.integers(-200, 200, (20, 8))
    x = spots[rng.integers(0, 20, 4000)] + rng.integers(-5, 6, (4000, 8))
    tree = hard_negatives.Tree(x, np.arange(4000), np.arange(4000), ["a"] * 4000, leaf=32)
    for lo, hi, left, right, _, radius in tree.nodes:
        centre = tree.vecs[lo:hi].mean(axis=0)
        assert np.sqrt(((tree.vecs[lo:hi] - centre) ** 2).sum(axis=1)).max() <= radius + 1e-6
        assert (left < 0) == (right < 0)
    assert sorted(tree.uids.tolist()) == list(range(4000))
    seen = []
    queries = hard_negatives.Queries([(-1, "b", hard_negatives.LOWEST, hard_negatives.HIGHEST, 0, hard_negatives._bytes(x[7]))], 5, False)
    leaf = queries._leaf
    queries._leaf = lambda t, lo, hi, *a: (seen.append(hi - lo), leaf(t, lo, hi, *a))
    queries.search(tree)
    best = np.sort(x @ x[7])[::-1][:5]
    assert queries.found[1].tolist() == best.tolist() and sum(seen) < 1000


def test_products_are_exact():
    for top in (100, 10**6, 2**40, 2**62):
        a, b = (np.array([[random.Random(s).randint(-top, top) for _ in range(5)] for s in range(k, k + 4)]) for k in (0, 9))
        want = [[min(max(sum(int(p) * int(q) for p, q in zip(x, y, strict=True)), -(2**63)), 2**63 - 1) for y in b] for x in a]
        assert hard_negatives.products(a, b).tolist() == want


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(100, "a", [1.0, 2.0]), (100, "a", [1.0, 2.0]), (1, None, [1.0, 1.0]), (2, "a", None), (None, "a", [9.0, 9.0]), (3, "b", [nan, 1.0]), (4, "b", [1.0, inf]), (5, "b", [1.0, None]), (6, "b", [1.0, 1.0]), (7, "b", [0.0, 1.9]), (8, "b", [3.0]), (9, "b", []), (200, "c", []), (10, "c", []), (300, "d", [1e30, 1.0]), (11, "d", [1e30, 1.0]), (12, "b", [1e19, 0.0])]
    frame = spark.createDataFrame(rows, "id long, label string, vec array<double>").withColumns({"uid": F.lit("u"), "anchor": F.lit(1), "part": F.lit("p"), "rank": F.lit(2)})
    clip = lambda v: max(-(2**63), min(2**63 - 1, math.floor(v)))
    usable = [(i, x, [clip(v) for v in y]) for i, x, y in rows if i is not None and x is not None and y is not None and all(v is not None and math.isfinite(v) for v in y)]
    result = got(hard_negatives.mine_negatives(frame, F.col("id") % 100 == 0))
    small = [r for r in plain(usable, lambda i: i in (100, 200)) if abs(r[5]) < 2**53]
    assert [r for r in result if r[0] in (100, 200)] == small
    assert hard_negatives.mine_negatives(frame.limit(0), F.col("id") % 100 == 0).count() == 0
    assert hard_negatives.mine_negatives(frame, F.col("id") < 0).count() == 0

"""Packing token sequences by patterns of few documents, fitted to the length histogram by non-negative least squares.

Documents are tokenised once and cut into pieces; only the histogram of piece lengths (at most `size` rows) reaches the
driver. There every way to fill a sequence exactly with up to three lengths is a pattern. How often each one is used is
the least-squares fit of the patterns' lengths to the histogram with counts of at least zero; a fit found by an active set
uses no more patterns than there are lengths, so its counts are large where the corpus is, and rounding them leaves little.
What rounding leaves is packed best fit, longest lengths first, in counts. Pieces then find their sequence by their rank
among the pieces of their length (packing.py), which salted sub-groups give.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .packing import pack, tokenised_pieces
from .shared import Workspace

Patterns = list[tuple[int, list[tuple[int, int]]]]


def full_patterns(lengths: np.ndarray, size: int) -> np.ndarray:
    """Rows of three indexes into `lengths` (ascending, distinct; len(lengths) stands for none): all sets of one to three that add up to `size`."""
    n = len(lengths)
    at = np.full(size + 1, -1)
    at[lengths] = np.arange(n)
    a, b = np.triu_indices(n)
    rest = size - lengths[a] - lengths[b]
    c = np.where(rest > 0, at[np.clip(rest, 0, size)], np.where(rest == 0, n, -1))
    some = (c == n) | (c >= b)
    rows = np.stack([a[some], b[some], c[some]], axis=1)
    alone = np.flatnonzero(lengths == size)
    return np.concatenate([rows, np.stack([alone, np.full_like(alone, n), np.full_like(alone, n)], axis=1)])


def fit_counts(patterns: np.ndarray, counts: np.ndarray, steps: int = 400) -> np.ndarray:
    """How often each pattern is used: least squares of what they use up against `counts`, none below zero.

    An active set: patterns whose use would lower the error most come in, as many at once as share no length; the free ones are
    solved for, and those that would fall below zero go out. It ends where the error falls no further, or after `steps`; every step's
    counts are valid, and what they leave is packed otherwise, so an early end costs fill and no piece.
    """
    n, m = len(counts), len(patterns)
    x, free = np.zeros(m), np.zeros(m, bool)
    scale = float(counts.max(initial=1))
    target = counts / scale
    column = np.zeros((n + 1, 0))

    def used() -> np.ndarray:
        return np.bincount(patterns.ravel(), np.repeat(x, 3), n + 1)[:n]

    error, at_once, best = np.inf, n, x
    for _ in range(steps):
        residual = np.append(target - used(), 0.0)
        gain = residual[patterns].sum(axis=1)
        now = float(residual @ residual)
        # No progress with many at once: one at a time, which can't go round in circles.
        at_once = max(1, at_once // 4) if now > error * (1 - 1e-6) else at_once
        if at_once == 1 and now > error * (1 - 1e-9):
            break
        if now < error:
            error, best = now, x.copy()
        want = np.flatnonzero(~free & (gain > 1e-9))
        if not len(want):
            break
        taken = np.zeros(n + 1, bool)
        come = []
        for j in want[np.argsort(-gain[want], kind="stable")[: 8 * n]].tolist():
            if len(come) == at_once:
                break
            if not taken[patterns[j]].any():
                come.append(j)
                taken[patterns[j]] = True
                taken[n] = False
        free[come] = True
        while free.any():
            at = np.flatnonzero(free)
            column = np.zeros((n + 1, len(at)))
            np.add.at(column, (patterns[at].ravel(), np.repeat(np.arange(len(at)), 3)), 1.0)
            column = column[:n]
            z = np.linalg.solve(column.T @ column + 1e-8 * np.eye(len(at)), column.T @ target)
            low = z <= 0
            if not low.any():
                x[:] = 0
                x[at] = z
                break
            if at_once > 1:
                # Out with all of them: fewer solutions, checked by the error that comes of it.
                x[at[low]] = 0
                free[at[low]] = False
                continue
            old = x[at]
            step = np.min(old[low] / np.maximum(old[low] - z[low], 1e-300))
            moved = old + step * (z - old)
            x[:] = 0
            x[at] = np.where(low & (moved <= 1e-12), 0.0, np.maximum(moved, 0.0))
            free[at[low & (x[at] == 0)]] = False
    return best * scale


def best_fit(histogram: dict[int, int], size: int) -> Patterns:
    """Longest first, each into the fullest sequence with room, else a new one; in counts: steps grow with the number of lengths."""
    packs: dict[int, list[tuple[int, tuple[tuple[int, int], ...]]]] = defaultdict(list)
    totals = np.zeros(size + 1, bool)

    def add(total: int, count: int, pattern: tuple[tuple[int, int], ...]) -> None:
        packs[total].append((count, pattern))
        totals[total] = True

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            fits = np.flatnonzero(totals[: size - length + 1])
            # A sequence that has taken one is the fullest until no more fit.
            total = int(fits[-1]) if len(fits) else 0
            times = min((size - total) // length, left)
            count, pattern = packs[total].pop() if total else (left, ())
            totals[total] = bool(total and packs[total])
            used = min(count, left // times)
            if total and count > used:
                add(total, count - used, pattern)
            add(total + times * length, used, (*pattern, (length, times)))
            left -= used * times
    return [(count, list(pattern)) for total in sorted(packs) for count, pattern in packs[total]]


def fitted_patterns(histogram: dict[int, int], size: int) -> Patterns:
    """Sequences as (count, [(length, times), ...]), from {length: pieces}; every piece lies in exactly one.

    Counts are rounded to the nearest and, as that costs fill where they are small, also down; the way with fewer sequences is taken.
    """
    lengths = np.array(sorted(n for n, k in histogram.items() if k), np.int64)
    counts = np.array([histogram[n] for n in lengths.tolist()], np.int64)
    patterns = full_patterns(lengths, size)
    fitted = fit_counts(patterns, counts.astype(float)) if len(patterns) else np.zeros(0)
    ways = [_rounded(lengths, counts, patterns, np.floor(fitted + up).astype(np.int64), size) for up in (0.5, 0.0)]
    return min(ways, key=lambda way: sum(count for count, _ in way))


def _rounded(lengths: np.ndarray, counts: np.ndarray, patterns: np.ndarray, wanted: np.ndarray, size: int) -> Patterns:
    """Patterns as often as wanted, while their lengths last, and what is left best fit."""
    left, out = counts.copy(), []
    for j in np.argsort(-wanted, kind="stable")[: np.count_nonzero(wanted)].tolist():
        parts, times = np.unique(patterns[j][patterns[j] < len(lengths)], return_counts=True)
        count = min(int(wanted[j]), int((left[parts] // times).min()))
        if count:
            left[parts] -= count * times
            out.append((count, [(int(lengths[p]), int(t)) for p, t in zip(parts, times, strict=True)]))
    return out + best_fit({int(n): int(k) for n, k in zip(lengths, left, strict=True) if k}, size)


def cut_first(tokens: int, size: int) -> list[int]:
    """Lengths of a document's pieces: what doesn't fill a sequence comes first, then full ones."""
    return ([tokens % size] if tokens % size else []) + [size] * (tokens // size)


def best_fit_documents(docs: DataFrame, size: int = 1024, end_id: int = 2, file: bytes | None = None) -> DataFrame:
    """Tokenise, cut and pack documents (doc_id, text); one row a piece: its columns as packing.PIECES, piece int, sequence_id long, offset long.

    Only documents of over `size` tokens are cut, into full pieces behind a shorter first one. A null or empty text has no token but
    end_id; texts of any length are encoded whole; repeated rows are packed one by one; null ids stay null; other columns are ignored.
    Ties of rank are broken by all columns, so results don't depend on the order of rows. An empty table gives no rows.
    """
    ws = Workspace(docs.sparkSession, "best-fit")
    pieces = ws.save(tokenised_pieces(docs, size, end_id, file, cuts=cut_first), "pieces")
    packed = pack(pieces, size, place=fitted_patterns)
    return packed.withColumn("piece", F.ceil(F.col("start") / size).cast("int"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = best_fit_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return packed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")

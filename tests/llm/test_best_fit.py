"""Operator 12: patterns against plain packing, the query against the tokenizer file's own library, and edge cases."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.llm import best_fit

from ..conftest import SF


def placed(patterns):
    out = Counter()
    for count, pattern in patterns:
        for length, times in pattern:
            out[length] += count * times
    return out


def test_every_pattern_fills_a_sequence_and_none_is_missing():
    rng = random.Random(1)
    for _ in range(30):
        size = rng.randint(3, 40)
        lengths = sorted(rng.sample(range(1, size + 1), rng.randint(1, size)))
        got = {tuple(sorted(lengths[i] for i in row if i < len(lengths))) for row in best_fit.full_patterns(np.array(lengths), size).tolist()}
        here = set(lengths)
        want = {(a,) for a in here if a == size} | {(a, size - a) for a in here if size - a in here and a <= size - a}
        want |= {(a, b, size - a - b) for a in here for b in here if a <= b <= size - a - b and size - a - b in here}
        assert got == want


def test_counts_are_the_least_squares_with_none_below_zero():
    rng = np.random.default_rng(3)
    for _ in range(20):
        size = int(rng.integers(6, 30))
        lengths = np.arange(1, size + 1)
        counts = rng.integers(0, 500, size).astype(float)
        patterns = best_fit.full_patterns(lengths, size)
        x = best_fit.fit_counts(patterns, counts)
        a = np.zeros((size + 1, len(patterns)))
        np.add.at(a, (patterns.ravel(), np.repeat(np.arange(len(patterns)), 3)), 1.0)
        a = a[:size]
        # Plain projected gradient steps, very many of them.
        y, step = np.zeros(len(patterns)), 1 / np.linalg.norm(a, 2) ** 2
        for _ in range(20000):
            y = np.maximum(0, y - step * (a.T @ (a @ y - counts)))
        assert (x >= 0).all()
        assert np.linalg.norm(a @ x - counts) <= np.linalg.norm(a @ y - counts) * 1.01 + 1e-3 * counts.sum()


def test_best_fit_is_best_fit_piece_by_piece():
    rng = random.Random(5)
    for _ in range(60):
        size = rng.randint(4, 60)
        histogram = {rng.randint(1, size): rng.randint(1, 30) for _ in range(rng.randint(1, 20))}
        open_ = []
        for length in sorted(histogram, reverse=True):
            for _ in range(histogram[length]):
                fits = [t for t in open_ if t + length <= size]
                if fits:
                    open_.remove(max(fits))
                    open_.append(max(fits) + length)
                else:
                    open_.append(length)
        patterns = best_fit.best_fit(dict(histogram), size)
        assert placed(patterns) == histogram
        assert Counter({t: n for t, n in Counter(open_).items()}) == sum((Counter({sum(n * k for n, k in p): c}) for c, p in patterns), Counter())


@pytest.mark.parametrize("seed", range(4))
def test_few_sequences_and_no_piece_lost(seed):
    rng, size = np.random.default_rng(seed), 256
    lengths = np.clip(rng.lognormal(4.4, 0.9, 40000).astype(int), 1, size)
    histogram = {int(n): int(k) for n, k in zip(*np.unique(lengths, return_counts=True), strict=True)}
    patterns = best_fit.fitted_patterns(histogram, size)
    assert placed(patterns) == histogram and all(sum(n * k for n, k in p) <= size for _, p in patterns)
    sequences = sum(c for c, _ in patterns)
    assert sequences <= sum(c for c, _ in best_fit.best_fit(histogram, size))
    assert sequences <= 1.005 * -(-int(lengths.sum()) // size)


def test_odd_histograms():
    for histogram in ({}, {1024: 7}, {1: 5}, {600: 10}, {512: 3}, {1023: 4, 1: 2}):
        assert placed(best_fit.fitted_patterns(histogram, 1024)) == histogram
    assert sum(c for c, _ in best_fit.fitted_patterns({600: 10, 424: 10}, 1024)) == 10


def test_query_against_tokenizers(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = {k: [*(library.encode(t, add_special_tokens=False).ids if t else []), 2] for k, t in docs.items()}
    rows = best_fit.op12_best_fit_packing(spark, SF).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == ids.keys()
    for k, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.piece)
        n, at = len(ids[k]), 0
        assert [r.piece for r in pieces] == list(range(len(pieces))) and len(pieces) == -(-n // 1024)
        for r in pieces:
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[k][at : at + r.length], "<u4").tobytes())
            assert r.length == 1024 or r.piece == 0
            at += r.length
        assert at == n
    for sequence in by_sequence.values():
        at = 0
        for r in sorted(sequence, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert len(by_sequence) <= 1.01 * -(-sum(map(len, ids.values())) // 1024)


def test_edges(spark):
    rows = [(1, None, "x"), (2, "", "y"), (2, "", "y"), (None, "the and of", "z"), (5, "word " * 9000, None), (6, "a" * 1_200_000, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string").withColumns({"piece": F.lit("p"), "length": F.lit(2), "sequence_id": F.lit(3)})
    got = best_fit.best_fit_documents(docs).collect()
    tokens = Counter()
    for r in got:
        tokens[r.doc_id] += r.length
    assert tokens[1] == 1 and tokens[2] == 2 and tokens[None] == 4 and tokens[5] >= 9001
    assert sum(r.length == 1024 for r in got if r.doc_id == 6) == tokens[6] // 1024
    assert best_fit.best_fit_documents(docs.limit(0)).count() == 0
    other = best_fit.best_fit_documents(docs.repartition(3)).select("doc_id", "start", "sequence_id", "offset")
    assert sorted(map(str, other.collect())) == sorted(str(r) for r in spark.createDataFrame(got).select("doc_id", "start", "sequence_id", "offset").collect())

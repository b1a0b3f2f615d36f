"""An inverted index of a glossary by its terms' rarest q-grams, with a Bloom filter before it.

A term is filed under one gram: of its runs of Q characters the one that the fewest terms have; a shorter term under itself. A text's
grams are numbered in one pass over its characters in Arrow batches, and only those that the filter may know leave it, once each.
They meet the index by equality. Whether a term is really there is told by the text afterwards, so neither the filter nor the
numbers have to be exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.shipping import ship
from lexweave.tables import written

#: Characters of a gram; bits of the filter for a term, and at most (8 MB, however large a glossary is).
Q, BITS_A_TERM, MOST_BITS = 6, 16, 1 << 26
#: The gram of an empty term: every text has it.
ALWAYS = 0
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def gram_numbers(text: str, length: int) -> np.ndarray:
    """A signed 64-bit number for each run of `length` characters, from the first one on; equal runs have equal ones."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    n = len(points) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.full(n, length, np.uint64)
    for j in range(length):
        h = (h ^ points[j : j + n]) * MULTIPLIER
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


class TermIndex:
    """index: gram long and the glossary's columns, a row a term; candidates(text): the grams of a text that may be in it."""

    def __init__(self, glossary: DataFrame):
        spark = glossary.sparkSession
        ship(spark)

        @F.pandas_udf("array<long>")
        def grams_of(terms: pd.Series) -> pd.Series:
            def one(term: str) -> np.ndarray:
                return np.unique(gram_numbers(term, min(Q, len(term)))) if term else np.array([ALWAYS])

            return terms.map(one)

        known = written(glossary.filter("term is not null").withColumn("__low", F.lower("term")), "terms")
        spread = written(known.select("__low", F.char_length("__low").alias("n")).distinct().withColumn("gram", F.explode(grams_of(F.col("__low")))), "grams")
        shared = spread.groupBy("gram").agg(F.count(F.lit(1)).alias("terms"))
        rarest = spread.join(shared, "gram").groupBy("__low").agg(F.min(F.struct("terms", "gram")).alias("r"), F.first("n").alias("n"))
        filed = written(rarest.select("__low", F.col("r.gram").alias("__gram"), F.least("n", F.lit(Q)).alias("n")), "filed")
        self.index = known.join(filed.select("__low", "__gram"), "__low").drop("__low")
        count, lengths = filed.agg(F.count(F.lit(1)), F.array_sort(F.collect_set("n"))).first()
        bits = 1 << 12
        while bits < min(MOST_BITS, count * BITS_A_TERM):
            bits *= 2
        self.bits = bits
        words = filed.select(F.explode(F.array(*[_bit(F.col("__gram"), probe, bits) for probe in range(3)])).alias("bit"))
        words = words.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("mask"))
        table = np.zeros(bits // 64, np.int64)
        for row in words.toLocalIterator():  # as many as the filter has words, at most
            table[row.word] = row.mask
        self._table = spark.sparkContext.broadcast(table)
        self._lengths = [n for n in lengths if n]
        self._always = 0 in lengths

    def candidates(self, text: Column) -> Column:
        """array<long>: each gram of a non-null text that may be one of the index, once."""
        table, lengths, bits, always = self._table, self._lengths, self.bits, self._always

        @F.pandas_udf("array<long>")
        def found(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            words = table.value.view(np.uint64)

            def one(text: str) -> np.ndarray:
                out = [np.array([ALWAYS] if always else [], np.int64)]
                for length in lengths:
                    h = gram_numbers(text, length)
                    for probe in range(3):
                        bit = _bit_of(h, probe, bits)
                        h = h[(words[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) == 1]
                    out.append(h)
                return np.unique(np.concatenate(out))

            for series in texts:
                yield series.map(one)

        return found(text)


def _bit(gram: Column, probe: int, bits: int) -> Column:
    """A gram's bit of a probe: bits 3.. of the number, turned; see _bit_of."""
    return F.shiftrightunsigned(gram, 3 + 18 * probe).bitwiseAND(F.lit(bits - 1).cast("long"))


def _bit_of(gram: np.ndarray, probe: int, bits: int) -> np.ndarray:
    return ((gram.view(np.uint64) >> np.uint64(3 + 18 * probe)) & np.uint64(bits - 1)).astype(np.int64)

"""A look for phrases said several times in a row, in Arrow batches: whatever has one is told, and little else."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexweave.shipping import ship

#: Characters that are compared at once (a byte of each, so eight of them are one number), and characters a round.
GRAM, BLOCK = 8, 1 << 17


def may_repeat(texts: list[str], said: int, least: int, most: int) -> np.ndarray:
    """True for each text with a phrase of `least` (4 or more) to `most` characters said `said` (5 or more) times in a row, line ends or not; for few others.

    A phrase of p characters equals what stands p later for (said - 1) * p characters on. So a gram every (said - 1) * p - GRAM + 1 characters meets it,
    and as it has room for p more on one of its sides, the gram p before or p after is the same again. Texts are looked at as one, in blocks that overlap by a loop.
    """
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint8)
    ends, may = np.cumsum([len(t) for t in texts]), np.zeros(len(texts), bool)
    for begin in range(0, len(points), BLOCK):
        part = points[begin : begin + BLOCK + said * most]
        n = len(part) - GRAM + 1
        if n <= 0:
            continue
        grams = np.ndarray(n, "<u8", part, strides=(1,))
        for p in range(least, most + 1):
            step = (said - 1) * p - GRAM + 1
            later = grams[p::step]
            at = np.flatnonzero(grams[::step][: len(later)] == later) * step
            if len(at):
                before = (at >= p) & (grams[np.maximum(at - p, 0)] == grams[at])
                after = (at + 2 * p < n) & (grams[np.minimum(at + 2 * p, n - 1)] == grams[at])
                may[np.searchsorted(ends, begin + at[before | after], "right")] = True
    return may


def looked(text: Column, said: int, least: int, most: int) -> Column:
    """may_repeat of each text; false for a null."""
    ship()

    @F.arrow_udf("boolean")
    def look(texts: pa.Array) -> pa.Array:
        return pa.array(may_repeat(texts.fill_null("").to_pylist(), said, least, most))

    return look(F.make_valid_utf8(text))

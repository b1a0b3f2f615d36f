"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; runs of other characters than letters count as one space. Every n-gram of 1 to `orders` characters
falls into one of `buckets`. Training sums counts per language and bucket over all labelled rows, combined in
each task; only these sums (languages x buckets) reach the driver. The log-probability matrix goes to the workers as a
broadcast of that size, and whole batches of texts are scored at once from the buckets they hit.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Workspace, ship

#: Unicode letters of the basic plane, by rule.
LETTER = np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x10000)])
MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)


def grams(texts: list[str | None], orders: int, bits: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """[(bucket, text index) of the n-grams of each order], and whether each text has a letter."""
    low = [(t or "").lower() for t in texts]
    code = np.frombuffer(("\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(low)), np.fromiter((len(t) + 1 for t in low), np.int64, len(low)))
    letter = LETTER[np.minimum(code, 0xFFFF)]
    if (wide := code > 0xFFFF).any():
        values, back = np.unique(code[wide], return_inverse=True)
        letter = letter.copy()
        letter[wide] = np.array([unicodedata.category(chr(c))[0] == "L" for c in values.tolist()])[back]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first character after a word stands for all up to the next
    code, owner, letter = np.where(letter, code, 32)[keep].astype(np.uint32), owner[keep], letter[keep]
    found = []
    for n in range(1, orders + 1):
        size = max(0, len(code) - n + 1)
        h = np.full(size, n, np.uint32) * MIX[4]
        for i in range(n):
            h = (h ^ code[i : i + size]) * MIX[i % 4]
            h ^= h >> np.uint32(15)
        whole = owner[:size] == owner[n - 1 : n - 1 + size]
        found.append(((h >> np.uint32(32 - bits)).astype(np.int64)[whole], owner[:size][whole]))
    return found, np.bincount(owner[letter], minlength=len(low)) > 0


def parts(texts: list[str | None], most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` characters together, at least one text each."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


class Model:
    """Log-probabilities of languages (columns, in order of their names) by bucket, and of the languages themselves."""

    def __init__(self, langs: list[str], weights: np.ndarray, prior: np.ndarray, orders: int, bits: int):
        self.langs, self.weights, self.prior, self.orders, self.bits = langs, weights, prior, orders, bits

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and its posterior probability; ("und", 0) for texts that are null or have no letter."""
        names, scores = [], []
        for a, b in parts(texts):
            found, has = grams(texts[a:b], self.orders, self.bits)
            total = np.tile(self.prior, (b - a, 1))
            for bucket, owner in found:
                if len(bucket):
                    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                    total[owner[first]] += np.add.reduceat(self.weights[bucket], first, axis=0)
            if not self.langs:
                has[:] = False
                total = np.zeros((b - a, 1))
            best = total.argmax(axis=1)
            sure = 1 / np.exp(total - total.max(axis=1)[:, None]).sum(axis=1)
            names += [self.langs[i] if h else "und" for i, h in zip(best.tolist(), has.tolist(), strict=True)]
            scores += np.where(has, sure, 0.0).tolist()
        return names, scores


def train(labelled: DataFrame, orders: int = 3, bits: int = 14, smoothing: float = 0.5, max_langs: int = 1000) -> Model:
    """Fit on all rows (lang, text) with neither null. `max_langs` bounds the matrix (and what reaches the driver); more languages raise.

    Texts without a letter teach nothing; whole texts of any length are counted; repeated rows count each; other columns are ignored.
    An empty table gives a model without languages, which says und.
    """
    spark = labelled.sparkSession
    ship(spark)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def rows() -> pa.RecordBatch:
            lang, bucket, n = [], [], []
            for name, s in sums.items():
                at = np.flatnonzero(s)
                lang += [name] * len(at)
                bucket.append(at - 1)
                n.append(s[at])
            sums.clear()
            none = np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(np.concatenate([none, *bucket])), pa.array(np.concatenate([none, *n]))], names=["lang", "bucket", "n"])

        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in parts(texts):
                names, which = np.unique(langs[a:b], return_inverse=True)
                found, has = grams(texts[a:b], orders, bits)
                add = np.zeros((len(names), (1 << bits) + 1), np.int64)
                add[:, 0] = np.bincount(which[has], minlength=len(names))  # bucket -1: texts
                for bucket, owner in found:
                    add[:, 1:] += np.bincount((which[owner] << bits) + bucket, minlength=len(names) << bits).reshape(len(names), -1)
                for name, row in zip(names.tolist(), add, strict=True):
                    sums[name] = sums[name] + row if name in sums else row
                if len(sums) > 64:
                    yield rows()
        yield rows()

    counts = labelled.filter("lang is not null and text is not null").select("lang", "text").mapInArrow(count, "lang string, bucket long, n long")
    ws = Workspace(spark, "languages")
    sums = ws.save(counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "counts")
    # Languages are counted before their buckets are brought here, so none is cut off.
    n_langs = sums.filter("bucket < 0").count()
    if n_langs > max_langs:
        ws.clear()
        raise ValueError(f"{n_langs} languages, more than {max_langs}")
    table = sums.toPandas()
    ws.clear()
    texts = table[table.bucket < 0].sort_values("lang")
    langs = texts.lang.tolist()
    column = {name: i for i, name in enumerate(langs)}
    sums = np.full((1 << bits, len(langs)), smoothing)
    seen = table[(table.bucket >= 0) & table.lang.isin(column)]
    np.add.at(sums, (seen.bucket.to_numpy(), seen.lang.map(column).to_numpy(int)), seen.n.to_numpy())
    prior = texts.n.to_numpy(float)
    return Model(langs, np.log(sums / sums.sum(axis=0)) if langs else sums, np.log(prior / prior.sum()) if langs else np.zeros(0), orders, bits)


def predict(docs: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the language (string) and its posterior (double) under `names`; other columns stay, ones of these two names are replaced.

    Null texts and those without a letter, of any length, get und and 0. Ties go to the first language by name. Repeated rows get equal
    answers. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)  # languages x buckets numbers
    kept = [c for c in docs.columns if c not in names]
    at = kept.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = sent.value.predict(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*kept, *names])

    slim = docs.select(*kept)
    return slim.mapInArrow(work, T.StructType([*slim.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.filter(~held_out(F.col("doc_id"))).select("lang", "text"))
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return _without_text(out, model)


def _without_text(docs: DataFrame, model: Model) -> DataFrame:
    """As predict(), but whole texts don't come back from the workers."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = sent.value.predict(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.mapInArrow(work, "doc_id long, held_out boolean, lang_pred string, score double")

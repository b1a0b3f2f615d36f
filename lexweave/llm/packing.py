"""Packing token sequences by shortest-pack-first over the length histogram.

Documents are tokenised once and cut into pieces; only the histogram of piece lengths (at most `size` rows) reaches
the driver. It places lengths longest first, always into the shortest pack that has room, in counts of packing patterns
rather than piece by piece. Pieces then find their pack by their rank among the pieces of their length. Ranks come from
salted sub-groups of each length, so a length with a third of all pieces is ranked by many tasks.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Workspace, salted_rank, ship

PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long"


def pack_histogram(histogram: dict[int, int], size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns as (count, [(length, times), ...]), from {length: pieces}.

    What placing piece by piece, longest first, each into the shortest pack with room (else a new one) gives, in counts.
    Each step uses up a length, opens packs or lengthens a whole pattern, so there are at most 3 patterns a length;
    lengths that differ and add up to `size` bound the entries of a pattern by sqrt(2 * size).
    """
    packs: dict[int, list[tuple[int, tuple[tuple[int, int], ...]]]] = defaultdict(list)
    totals: list[int] = []

    def add(total: int, count: int, pattern: tuple[tuple[int, int], ...]) -> None:
        if not packs[total]:
            heapq.heappush(totals, total)
        packs[total].append((count, pattern))

    def longer(pattern: tuple[tuple[int, int], ...], length: int) -> tuple[tuple[int, int], ...]:
        if pattern and pattern[-1][0] == length:
            return (*pattern[:-1], (length, pattern[-1][1] + 1))
        return (*pattern, (length, 1))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if totals and totals[0] + length <= size:
                total = totals[0]
                count, pattern = packs[total].pop()
                if not packs[total]:
                    heapq.heappop(totals)
                if count > left:
                    add(total, count - left, pattern)
                    count = left
                add(total + length, count, longer(pattern, length))
                left -= count
            else:
                times = size // length
                full, rest = divmod(left, times)
                if full:
                    add(times * length, full, ((length, times),))
                if rest:
                    add(rest * length, 1, ((length, rest),))
                left = 0
    return [(count, list(pattern)) for total in sorted(packs) for count, pattern in packs[total]]


def slots(patterns: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, packs of the pattern, first offset), by length and rank."""
    taken: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for count, pattern in patterns:
        offset = 0
        for length, times in pattern:
            rows.append((length, taken[length], sequence, count, offset))
            taken[length] += count * times
            offset += length * times
        sequence += count
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def cut(tokens: int, size: int) -> list[int]:
    """Lengths of a document's pieces: full sequences, then what is left; what fits in a sequence stays whole."""
    return [size] * (tokens // size) + ([tokens % size] if tokens % size else [])


_encoders: dict[str, object] = {}


def encoder(data: bytes, pattern: str):
    """The tokenizer file's vocabulary in tiktoken, which gives the same ids about five times as fast."""
    import tiktoken

    key = hashlib.sha256(data).hexdigest()
    if key not in _encoders:
        # Byte-level vocabularies write a byte as a printable character: itself, or else the next from U+0100 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        file = json.loads(data)
        special = {t["content"]: t["id"] for t in file.get("added_tokens", ())}
        ranks = {bytes(byte_of[c] for c in piece): i for piece, i in file["model"]["vocab"].items() if piece not in special}
        _encoders[key] = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    return _encoders[key]


def tokenizer_file(path: str | None = None) -> bytes:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, "rb") as f:
        return f.read()


def tokenised_pieces(docs: DataFrame, size: int, end_id: int, file: bytes | None = None, pattern: str | None = None, cuts: Callable[[int, int], list[int]] = cut) -> DataFrame:
    """doc_id, text -> a row for each piece (PIECES). A document is its ids and end_id; `cuts` gives the lengths of its pieces.

    A null or empty text has no ids but end_id; texts of any length are encoded whole; repeated rows give pieces each; null ids stay
    null; other columns are ignored. An empty table gives no rows.
    """
    import public_tokenizers

    ship(docs.sparkSession)
    data, pat = docs.sparkSession.sparkContext.broadcast(file or tokenizer_file()), pattern or public_tokenizers.PATTERN

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, tail = encoder(data.value, pat), np.array([end_id], np.uint32)
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                rows: list[tuple[int | None, int, int, int, int]] = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = np.concatenate([enc.encode_to_numpy(text, allowed_special="all"), tail]).astype("<u4") if text else tail
                    at = 0
                    for n in cuts(len(ids), size):
                        rows.append((doc, at, n, zlib.crc32(ids[at : at + n].tobytes()), len(ids)))
                        at += n
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, PIECES)


def pack(pieces: DataFrame, size: int = 2048, length_col: str = "length", salt_rows: int = 200, max_salts: int = 4096, place: Callable = pack_histogram) -> DataFrame:
    """pieces with sequence_id long and offset long added: where each piece lies, gapless from 0 in its sequence. `place` turns the histogram into patterns.

    `pieces` should be a written table: it is read twice. Lengths must lie in 1..size; rows of other lengths raise.
    Repeated rows are packed one by one. Ties of rank are broken by all columns, so results don't depend
    on the order in which rows are read. An empty table gives no rows.
    """
    ship(pieces.sparkSession)
    histogram = {r[0]: r[1] for r in pieces.groupBy(length_col).count().limit(size + 1).collect()}
    if any(n is None or not 1 <= n <= size for n in histogram):
        raise ValueError(f"piece lengths must lie in 1..{size}")
    plan = slots(place(histogram, size))
    salts = [max(1, min(max_salts, -(-histogram.get(n, 0) // salt_rows))) for n in range(size + 1)]
    names = [c for c in pieces.columns]
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(c) for c in names]), F.element_at(F.lit(salts), F.col(length_col) + 1)).cast("int"))
    counts = salted.groupBy(length_col, "__salt").agg(F.count("*").alias("__n"))
    before = salted_rank(counts, [length_col], "__salt", "__n").select(F.col(length_col).alias("__l"), F.col("__salt").alias("__s"), "before")
    w = Window.partitionBy(length_col, "__salt").orderBy(*names)
    ranked = salted.withColumn("__rn", F.row_number().over(w)).join(before, (F.col(length_col) == F.col("__l")) & (F.col("__salt") == F.col("__s")))
    ranked = ranked.select(*names, (F.col("__rn") - 1 + F.col("before")).cast("long").alias("__rank"))
    schema = pieces.schema.simpleString()[len("struct<") : -1] + ",sequence_id:bigint,offset:bigint"
    at_length = names.index(length_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = plan[:, 0] << 44 | plan[:, 1]
        for batch in batches:
            length = batch.column(at_length).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column(len(names)).to_numpy(zero_copy_only=False)
            slot = plan[np.searchsorted(first, length << 44 | rank, side="right") - 1] if len(plan) else np.zeros((len(rank), 5), np.int64)
            nth = rank - slot[:, 1]
            sequence, offset = slot[:, 2] + nth % slot[:, 3], slot[:, 4] + nth // slot[:, 3] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(work, schema)


def pack_documents(docs: DataFrame, size: int = 2048, end_id: int = 1, file: bytes | None = None) -> DataFrame:
    """Tokenise, cut and pack documents (doc_id, text); one row a piece: PIECES, sequence_id and offset.

    Nulls, long texts, repeated rows and other columns as in tokenised_pieces(); ties of rank as in pack(). An empty table gives no rows.
    """
    ws = Workspace(docs.sparkSession, "packing")
    return pack(ws.save(tokenised_pieces(docs, size, end_id, file), "pieces"), size)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return packed.select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset")

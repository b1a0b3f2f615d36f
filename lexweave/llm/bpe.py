"""Byte-level BPE: encoding by ranked merges over the bytes of distinct words, decoding by joining pieces.

A text is cut by the vocabulary's pattern; each distinct word is folded once and its ids are kept in a cache in the Python
worker, bounded in entries and bytes. Short words are folded together, one merge a round, as numpy arrays; long ones
by a heap, so that a word of a megabyte takes n log n steps. The ranks go to the workers as a broadcast of the
vocabulary file (a fixed size, whatever the data).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ship

BIG = np.int64(1) << 40
#: Words longer than this many bytes are folded by the heap; words kept in a worker's cache, and their bytes; texts folded together.
LONG, CACHE, CACHE_BYTES, TOGETHER = 48, 1 << 18, 64 << 20, 256


def read_ranks(data: bytes) -> dict[bytes, int]:
    """A .tiktoken file: a base64 piece and its rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class Bpe:
    """Ranks with lookups for folding; `encode` and `decode` for single texts."""

    def __init__(self, data: bytes, pattern: str):
        self.ranks = read_ranks(data)
        self.pieces = {v: k for k, v in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        self.bytes_to_id = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.width = max(self.pieces) + 1
        pairs = {}
        for piece, rank in self.ranks.items():
            for cut in range(1, len(piece)):
                a, b = self.ranks.get(piece[:cut]), self.ranks.get(piece[cut:])
                if a is not None and b is not None:
                    pairs[a * self.width + b] = rank
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)
        self.cache: dict[str, bytes] = {}
        self.held = 0

    def fold_long(self, word: bytes) -> list[int]:
        ids = self.bytes_to_id[np.frombuffer(word, np.uint8)].tolist()
        parts = [word[i : i + 1] for i in range(len(word))]
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(r, i, 2) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, size = heapq.heappop(heap)
            j = after[i] if parts[i] else len(parts)
            if j >= len(parts) or len(parts[i]) + len(parts[j]) != size or self.ranks.get(parts[i] + parts[j]) != rank:
                continue
            parts[i] += parts[j]
            ids[i], parts[j], after[i] = rank, b"", after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < len(parts) and (r := self.ranks.get(parts[left] + parts[right])) is not None:
                    heapq.heappush(heap, (r, left, len(parts[left]) + len(parts[right])))
        return [x for x, p in zip(ids, parts, strict=True) if p]

    def fold(self, words: list[bytes]) -> list[bytes]:
        """Ids of each non-empty word, as little-endian unsigned 32-bit integers; merges the leftmost pair of least rank in all words at once."""
        n = len(words)
        ids = self.bytes_to_id[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(n), np.fromiter(map(len, words), np.int64, n))
        ended: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            rank = np.full(len(ids), BIG)
            key = ids[:-1] * self.width + ids[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = (self.keys[at] == key) & (owner[:-1] == owner[1:])
            rank[:-1][hit] = self.values[at[hit]]
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.r_[first, len(ids)]))
            over = least == BIG
            if over.any():
                ended.append((owner[over], ids[over]))
            merge = np.flatnonzero((rank == least) & ~over)
            merge = merge[np.r_[True, owner[merge][1:] != owner[merge][:-1]]] if len(merge) else merge
            ids[merge] = rank[merge]
            over[merge + 1] = True
            ids, owner = ids[~over], owner[~over]
        owner, ids = np.concatenate([o for o, _ in ended]), np.concatenate([i for _, i in ended])
        order = np.argsort(owner, kind="stable")
        flat, ends = ids[order].astype("<u4").tobytes(), np.cumsum(np.bincount(owner, minlength=n)) * 4
        starts = np.r_[0, ends[:-1]]
        return [flat[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]

    def learn(self, missing: list[str]) -> None:
        """Put words into the cache."""
        short, short_bytes = [], []
        self.held += sum(map(len, missing))
        for word in missing:
            raw = word.encode()
            if (whole := self.ranks.get(raw)) is not None:
                self.cache[word] = whole.to_bytes(4, "little")
            elif len(raw) > LONG:
                self.cache[word] = np.array(self.fold_long(raw), "<u4").tobytes()
            else:
                short.append(word)
                short_bytes.append(raw)
        if short:
            self.cache.update(zip(short, self.fold(short_bytes), strict=True))

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        out = []
        for i in range(0, len(texts), TOGETHER):
            if len(self.cache) > CACHE or self.held > CACHE_BYTES:
                self.cache.clear()
                self.held = 0
            cut = [self.find(t) for t in texts[i : i + TOGETHER]]
            self.learn(list(set().union(*cut) - self.cache.keys()))
            get = self.cache.__getitem__
            out += [b"".join(map(get, words)) for words in cut]
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_many([text])[0], "<u4").tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


_made: dict[tuple[str, str], Bpe] = {}


def coder(data: bytes, pattern: str) -> Bpe:
    """One Bpe a worker process, kept between tasks."""
    key = (hashlib.sha256(data).hexdigest(), pattern)
    if key not in _made:
        _made[key] = Bpe(data, pattern)
    return _made[key]


def vocabulary(path: str | None = None) -> bytes:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        return f.read()


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def encode_batches(batches: Iterator[pa.RecordBatch], bpe: Bpe, text_at: int) -> Iterator[pa.RecordBatch]:
    """The text column becomes a list of ids; the others stay."""
    for batch in batches:
        texts = batch.column(text_at).to_pylist()
        raw = bpe.encode_many([t or "" for t in texts])
        offsets = np.cumsum([0, *map(len, raw)], dtype=np.int64) // 4
        ids = pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raw), "<u4").astype(np.int32)))
        columns = [ids if i == text_at else c for i, c in enumerate(batch.columns)]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:text_at], "ids", *batch.schema.names[text_at + 1 :]])


def decode_batches(batches: Iterator[pa.RecordBatch], bpe: Bpe) -> Iterator[pa.RecordBatch]:
    """Adds the binary column `decoded` to batches with a list column `ids`."""
    for batch in batches:
        ids = batch.column(batch.schema.names.index("ids"))
        values, offsets = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_pylist()
        decoded = [bpe.decode(values[a:b].tolist()) for a, b in zip(offsets, offsets[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.large_binary())], names=[*batch.schema.names, "decoded"])


def _small_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [c.cast(pa.list_(pa.int32())) if pa.types.is_large_list(c.type) else c.cast(pa.binary()) if pa.types.is_large_binary(c.type) else c for c in batch.columns]
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: bytes | None = None, pattern: str | None = None) -> DataFrame:
    """id_col and ids array<int> for every row.

    A null or empty text has no ids; whole texts and words of any length are encoded; repeated rows give equal rows; other columns
    are ignored, so none can clash. An empty table gives no rows.
    """
    spark = df.sparkSession
    ship(spark)
    data, pat = spark.sparkContext.broadcast(vocab or vocabulary()), pattern or default_pattern()
    slim = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _small_lists(encode_batches(batches, coder(data.value, pat), 1))

    return slim.mapInArrow(work, f"id {slim.schema['id'].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocab: bytes | None = None) -> DataFrame:
    """id_col and decoded binary for every row; null and empty lists give empty bytes. An id that the vocabulary lacks raises.

    Repeated rows give equal rows; other columns are ignored. An empty table gives no rows.
    """
    spark = df.sparkSession
    ship(spark)
    data, pat = spark.sparkContext.broadcast(vocab or vocabulary()), default_pattern()
    slim = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small_lists(decode_batches(batches, coder(data.value, pat))):
            yield batch.select([0, 2])

    return slim.mapInArrow(work, f"id {slim.schema['id'].dataType.simpleString()}, decoded binary").withColumnRenamed("id", id_col)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded, decoded from its ids, and both digested, in one pass over the rows."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    data, pat = spark.sparkContext.broadcast(vocabulary()), default_pattern()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(data.value, pat)
        parts = (batch.slice(i, 1024) for batch in batches for i in range(0, batch.num_rows, 1024))
        for batch in decode_batches(encode_batches(parts, bpe, 1), bpe):
            ids, decoded = batch.column(1), batch.column(2).to_pylist()
            raw, at = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_pylist()
            spans = list(zip(at, at[1:], strict=False))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([b - a for a, b in spans], pa.int64()),
                    pa.array([hashlib.sha256(raw[a:b].tobytes()).hexdigest() for a, b in spans]),
                    pa.array([hashlib.sha256(d).hexdigest() for d in decoded]),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

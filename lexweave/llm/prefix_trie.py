"""A trie of conversation prefixes by distributed MSD radix partitioning over dictionary-encoded turns.

Every distinct turn (role, text) gets an id, so a conversation is a sequence of ids; equal sequences are one, with the number
of their conversations. A bucket holds the sequences that share a prefix. It is extended by what all of them share, which its
smallest and largest sequence tell, and then dealt by the next id: one radix digit. Buckets of more than `bucket_turns` turns are
dealt again in the next round, all at once; a smaller one, or one sequence alone, goes to one task, where multikey quicksort orders
it and its recursion on equal ids is the trie below. Sums over subtrees of dealt buckets come from their descendants' sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Workspace, ship

NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NO_ENDS = hashlib.sha256(b"").hexdigest()
ROOT = "0"


def encode_turns(ws: Workspace, turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) -> conv_id, ids array<long>, chars array<int>: a row a conversation.

    Turns are ordered by turn (null first), then role and text; a null role or text counts as empty; repeated rows are turns of
    their own; rows of a null conv_id belong to no conversation and are left out; other columns are ignored. A conversation's ids
    have to fit in a row, its texts haven't: they are exchanged once, for their order, then only digests are. An empty table gives no rows.
    """
    said = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    digest = F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    placed = ws.save(said.select("conv_id", F.row_number().over(w).alias("at"), digest.alias("digest"), F.char_length("text").alias("chars")), "turns")
    known = ws.save(placed.groupBy("digest").agg(F.first("chars").alias("n")).select("digest", F.monotonically_increasing_id().alias("id")), "dictionary")
    whole = placed.join(known, "digest").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "id", "chars"))).alias("t"))
    out = ws.save(whole.select("conv_id", F.col("t.id").alias("ids"), F.col("t.chars").alias("chars")), "encoded")
    ws.drop(placed, known)
    return out


def splice_heads(encoded: DataFrame, every: int = 100, up_to: int = 6) -> DataFrame:
    """Conversations rebuilt on shared heads: the first h turns of conversation c - c % every, then c's own after its first h; h = crc32(c) % up_to."""
    heads = encoded.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("head"), F.slice("ids", 1, up_to - 1).alias("head_ids"), F.slice("chars", 1, up_to - 1).alias("head_chars"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % up_to).cast("int")

    def rebuilt(head: str, own: str, kind: str) -> Column:
        first = F.slice(F.coalesce(F.col(head), F.array().cast(kind)), F.lit(1), h)
        return F.concat(first, F.slice(F.col(own), h + 1, F.greatest(F.size(own) - h, F.lit(0)))).alias(own)

    both = encoded.join(heads, F.col("conv_id") - F.col("conv_id") % every == F.col("head"), "left")
    return both.select("conv_id", rebuilt("head_ids", "ids", "array<bigint>"), rebuilt("head_chars", "chars", "array<int>"))


def prefix_trie(ws: Workspace, sequences: DataFrame, bucket_turns: int = 1024) -> DataFrame:
    """sequences(conv_id, ids, chars) -> a row a node (NODES) of their prefix trie, the root (depth 0) included.

    conv_id: smallest member; n_convs: members; saved_tokens: summed over the subtree, (n_convs - 1) * chars of the node's last turn;
    ends_sha256: of the comma-joined ids, ascending, of those that end at the node. Conversations without turns end at the root.
    Equal conversations, however many, are one sequence; a repeated conv_id counts each time. Ties have none: a node is told by its
    prefix. Other columns are ignored. An empty table gives no rows. Rounds are as many as there are branching depths at which
    more than `bucket_turns` turns of different conversations still share a prefix.
    """
    spark = sequences.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = ws.save(sequences.select("conv_id", "ids", "chars", F.unhex(F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)).alias("key")), "sequences")
    ends = _end_hashes(keyed.select("key", "conv_id"), parts)
    classes = keyed.groupBy("key").agg(F.first("ids").alias("ids"), F.first("chars").alias("chars"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv"))
    level = classes.join(ends, "key").select(F.lit(ROOT).alias("bucket"), F.lit(-1).alias("above"), F.lit(None).cast("long").alias("up"), "ids", "chars", "n", "conv", "sha")
    level = ws.save(level, "level-0")
    paths = None
    dealt, local = [], []
    turn = 0
    while True:
        turn += 1
        lowest, highest = F.min(F.struct("ids", "chars")).alias("lo"), F.max("ids").alias("hi")
        stats = level.groupBy("bucket").agg(lowest, highest, F.first("above").alias("above"), F.first("up").alias("up"), F.sum("n").alias("n"), F.min("conv").alias("conv"))
        differ = F.array_position(F.zip_with("lo.ids", "hi", lambda a, b: a.eqNullSafe(b)), False).cast("int")
        stats = stats.withColumn("depth", F.when(differ == 0, F.size("lo.ids")).otherwise(differ - 1))
        # The turns that depths above+1 .. depth add; the root adds none.
        spans = F.concat(F.when(F.col("above") < 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")), F.slice(F.col("lo.chars"), F.greatest(F.col("above"), F.lit(0)) + 1, F.col("depth") - F.greatest(F.col("above"), F.lit(0))))
        if paths is None:
            stats = stats.withColumns({"parent": F.lit(None).cast("string"), "path": F.array(F.lit(ROOT))})
        else:
            stats = stats.join(paths, "bucket")
        stats = ws.save(stats.select("bucket", "parent", "path", "above", "depth", "up", "n", "conv", spans.alias("spans")), f"buckets-{turn}")
        placed = level.drop("up", "above").join(stats.select("bucket", "depth", F.col("conv").alias("up")), "bucket")
        placed = ws.save(placed.withColumn("digit", F.get("ids", F.col("depth"))), f"placed-{turn}")
        ended = placed.filter("digit is null").select("bucket", F.col("sha").alias("ends"))
        dealt.append(ws.save(stats.join(ended, "bucket", "left"), f"dealt-{turn}"))
        kids = placed.filter("digit is not null").groupBy("bucket", "digit").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size("ids") - F.col("depth")).alias("turns"))
        large = kids.filter((F.col("rows") > 1) & (F.col("turns") > bucket_turns)).select("bucket", "digit", F.concat(F.lit(f"{turn}-"), F.monotonically_increasing_id().cast("string")).alias("child"))
        large = ws.save(large, f"large-{turn}")
        onward = ws.save(placed.filter("digit is not null").join(large, ["bucket", "digit"], "left"), f"onward-{turn}")
        local.append(onward.filter("child is null").select("bucket", "digit", F.col("depth").alias("above"), "up", F.slice("ids", F.col("depth") + 1, F.size("ids")).alias("ids"), F.slice("chars", F.col("depth") + 1, F.size("ids")).alias("chars"), "n", "conv", "sha"))
        ws.drop(placed, level)
        if large.isEmpty():
            break
        level = onward.filter("child is not null").select(F.col("child").alias("bucket"), F.col("depth").alias("above"), "up", "ids", "chars", "n", "conv", "sha")
        level = ws.save(level, f"level-{turn}")
        paths = large.join(stats.select("bucket", "path"), "bucket").select(F.col("child").alias("bucket"), F.col("bucket").alias("parent"), F.concat("path", F.array("child")).alias("path"))
    rest = reduce(DataFrame.unionByName, local).repartition(parts, "bucket", "digit").sortWithinPartitions("bucket", "digit")
    below = ws.save(rest.mapInArrow(_finish, f"bucket string, top boolean, {NODES}"), "below")
    nodes = _dealt_nodes(reduce(DataFrame.unionByName, dealt), below.filter("top")).unionByName(below.drop("bucket", "top"))
    out = ws.save(nodes, "nodes")
    ws.clear(out)
    return out


def _dealt_nodes(dealt: DataFrame, tops: DataFrame) -> DataFrame:
    """Nodes of buckets that were dealt on, from what lies below them."""
    under = tops.groupBy("bucket").agg(F.count(F.lit(1)).alias("local"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    kids = dealt.filter("parent is not null").groupBy("parent").agg(F.count(F.lit(1)).alias("kids")).withColumnRenamed("parent", "bucket")
    own = dealt.join(under, "bucket", "left").join(kids, "bucket", "left").withColumn("children", F.coalesce("local", F.lit(0)) + F.coalesce("kids", F.lit(0)))
    spent = (F.col("n") - 1) * F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x)
    # A bucket with no child is a leaf: the only sequence of all.
    each = own.select(F.explode("path").alias("bucket"), (F.coalesce("leaves", F.lit(0)) + (F.col("children") == 0).cast("long")).alias("leaves"), (F.coalesce("saved", F.lit(0)) + spent).alias("saved"))
    sums = each.groupBy("bucket").agg(F.sum("leaves").alias("all_leaves"), F.sum("saved").alias("all_saved"))
    every = own.join(sums, "bucket").select("bucket", "above", "depth", "up", "n", "conv", "children", "ends", "all_leaves", "all_saved", F.posexplode("spans").alias("i", "chars"))
    before = F.coalesce(F.sum((F.col("n") - 1) * F.col("chars")).over(Window.partitionBy("bucket").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = F.col("above") + 1 + F.col("i")
    last = at == F.col("depth")
    return every.select(
        F.col("conv").alias("conv_id"),
        at.cast("long").alias("depth"),
        F.when(F.col("i") == 0, F.col("up")).otherwise(F.col("conv")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(last, F.col("children")).otherwise(1).cast("long").alias("n_children"),
        F.col("all_leaves").alias("n_leaves"),
        (F.col("all_saved") - before).alias("saved_tokens"),
        F.when(last, F.coalesce("ends", F.lit(NO_ENDS))).otherwise(NO_ENDS).alias("ends_sha256"),
    )


def _end_hashes(members: DataFrame, parts: int, run: int = 1024) -> DataFrame:
    """key, sha: SHA-256 of each key's comma-joined ids, ascending. Runs of ids are joined by many tasks; one hashes a key's runs in order, a run at a time."""

    def join_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, ids in _runs(batches, run):
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], names=["key", "first", "ids"])

    def hash_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        done: list[tuple[bytes, str]] = []
        for batch in batches:
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k != key:
                    if sha is not None:
                        done.append((key, sha.hexdigest()))
                    key, sha = k, hashlib.sha256(ids.encode())
                else:
                    sha.update(f",{ids}".encode())
            yield _keys_of(done)
            done = []
        if sha is not None:
            yield _keys_of([(key, sha.hexdigest())])

    runs = members.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(join_runs, "key binary, first long, ids string")
    return runs.repartition(parts, "key").sortWithinPartitions("key", "first").mapInArrow(hash_keys, "key binary, sha string")


def _keys_of(done: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([s for _, s in done], pa.string())], names=["key", "sha"])


def _runs(batches: Iterator[pa.RecordBatch], run: int) -> Iterator[tuple[bytes, list[int]]]:
    """Up to `run` consecutive ids of one key at a time."""
    key, held = None, []
    for batch in batches:
        for k, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if held and (k != key or len(held) == run):
                yield key, held
                held = []
            key = k
            held.append(i)
    if held:
        yield key, held


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of whole local buckets, from rows sorted by bucket and digit."""
    schema = pa.schema([("bucket", pa.string()), ("top", pa.bool_()), *[(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in NODES.split(", ")]])
    key, held = None, []
    out: list[tuple] = []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if row[:2] != key:
                out.extend(bucket_nodes(held))
                key, held = row[:2], []
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out = []
            held.append(row)
    out.extend(bucket_nodes(held))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def bucket_nodes(rows: list[tuple]) -> list[tuple]:
    """rows (bucket, digit, above, up, ids, chars, n, conv, sha): different sequences that begin with one id -> (bucket, top, *NODES).

    Multikey quicksort: rows are parted by their id at a depth into those below, equal to and above a pivot's; the equal ones are a node
    and go one deeper. Parents come before their children, so sums run backwards over the list.
    """
    if not rows:
        return []
    bucket, _, above, up = rows[0][:4]
    nodes: list[list] = []  # parent, depth, n, conv, children, leaves, saved, sha
    todo = [(rows, 0, -1)]
    while todo:
        some, d, parent = todo.pop()
        # Ids are at least 0, so -1 is a sequence's end.
        at = [r[4][d] if d < len(r[4]) else -1 for r in some]
        pivot = at[len(at) // 2]
        less, more = ([r for r, x in zip(some, at, strict=True) if side(x)] for side in (lambda x: x < pivot, lambda x: x > pivot))
        equal = [r for r, x in zip(some, at, strict=True) if x == pivot]
        todo.extend((part, d, parent) for part in (less, more) if part)
        if pivot < 0:
            nodes[parent][7] = equal[0][8]
            continue
        n, conv = sum(r[6] for r in equal), min(r[7] for r in equal)
        nodes.append([parent, above + d + 1, n, conv, 0, 0, (n - 1) * equal[0][5][d], NO_ENDS])
        if parent >= 0:
            nodes[parent][4] += 1
        todo.append((equal, d + 1, len(nodes) - 1))
    for node in reversed(nodes):
        if not node[4]:
            node[5] = 1
        if node[0] >= 0:
            nodes[node[0]][5] += node[5]
            nodes[node[0]][6] += node[6]
    return [(bucket, p < 0, conv, depth, up if p < 0 else nodes[p][3], n, children, leaves, saved, sha) for p, depth, n, conv, children, leaves, saved, sha in nodes]


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "prefix-trie")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return prefix_trie(ws, splice_heads(encode_turns(ws, turns)))

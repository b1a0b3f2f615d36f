"""Operator 13 against a plain trie in memory."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lexweave.llm import prefix_trie
from lexweave.llm.shared import Workspace

from ..conftest import SF


def plain(conversations):
    """{conv_id: [(role, text), ...]} -> sorted node rows."""
    members = defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    sums = {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
        sums[p] = (sum(sums[k][0] for k in kids[p]) or 1, own + sum(sums[k][1] for k in kids[p]))
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(conversations[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), *sums[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def ordered(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    return {c: [t[2:] for t in sorted(v)] for c, v in own.items()}


def spliced(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("sf", [SF, SF.replace("0.001", "0.1")])
def test_query_against_a_plain_trie(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = prefix_trie.op13_prefix_trie(spark, sf)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert rows_of(got) == plain(spliced(ordered(rows)))


@pytest.mark.parametrize("bucket_turns", [1, 4, 30])
def test_small_buckets_give_the_same_trie(spark, bucket_turns):
    rng = random.Random(bucket_turns)
    conversations = {}
    for c in range(160):
        kind = rng.random()
        base = [("u", "hot " * 3)] * 7 if kind < 0.4 else []
        conversations[c] = base + [("u", rng.choice("abc") * rng.randint(0, 3)) for _ in range(rng.randint(0, 5))]
    for c in range(160, 200):
        conversations[c] = conversations[3]
    rows = [(c, i, *t) for c, turns in conversations.items() for i, t in enumerate(turns)]
    ws = Workspace(spark, "trie-test")
    encoded = prefix_trie.encode_turns(ws, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    have = {r.conv_id for r in encoded.select("conv_id").collect()}
    none = spark.createDataFrame([(c, [], []) for c in conversations if c not in have] or [], "conv_id long, ids array<long>, chars array<int>")
    got = prefix_trie.prefix_trie(ws, encoded.unionByName(none), bucket_turns)
    assert rows_of(got) == plain(conversations)


def test_edges(spark):
    rows = [(1, None, None, None), (1, None, None, None), (1, 0, "user", "é😀"), (None, 1, "user", "x"), (2, 1, "user", ""), (300, 0, "user", "long " * 200_000), (301, 5, "user", "a"), (301, 5, "assistant", "b"), (-250, 1, None, "z")]
    schema = "conv_id long, turn long, role string, text string"
    turns = spark.createDataFrame(rows, schema).withColumns({"digest": F.lit("d"), "at": F.lit(1), "id": F.lit("i"), "chars": F.lit(3)})
    for frame in (turns, turns.repartition(3)):
        ws = Workspace(spark, "trie-test")
        got = prefix_trie.prefix_trie(ws, prefix_trie.encode_turns(ws, frame))
        assert rows_of(got) == plain(ordered(rows))
    ws = Workspace(spark, "trie-test")
    assert prefix_trie.prefix_trie(ws, prefix_trie.splice_heads(prefix_trie.encode_turns(ws, turns.limit(0)))).count() == 0


def test_a_deep_comb_and_one_conversation(spark):
    comb = {c: [("u", "t")] * c for c in range(1, 40)}
    for conversations in (comb, {7: [("u", "x"), ("a", "y")]}):
        rows = [(c, i, *t) for c, turns in conversations.items() for i, t in enumerate(turns)]
        ws = Workspace(spark, "trie-test")
        got = prefix_trie.prefix_trie(ws, prefix_trie.encode_turns(ws, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), 700)
        assert rows_of(got) == plain(conversations)

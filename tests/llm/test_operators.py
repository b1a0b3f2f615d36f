"""The ten operators against brute force, round trips, held-out accuracy and edge cases."""

import collections
import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.llm import bpe, chat, embedding_dedup, exact_dedup, language_id, near_text, packing, pii, sharding, simhash, url_filter
from lexweave.llm.components import connected_components
from lexweave.llm.shared import Workspace

from ..conftest import SF

EDGES = [(1, None, "x"), (2, "", "y"), (2, "", "y"), (None, "the and of", "z"), (5, "the and of", None), (5, "the and of", None), (7, "word " * 4000, "w")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def edges(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns whose names operators use inside."""
    return spark.createDataFrame(EDGES, "doc_id long, text string, id string").withColumns({"fp": F.lit(1), "rep": F.lit("r"), "length": F.lit(2), "lang": F.lit("en"), "score": F.lit(0.5), "digest": F.lit("d"), "kept": F.lit(True)})


def components(n, links):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


# op1


def test_shards_hold_their_law(spark):
    got = sharding.op1_sharding(spark, SF).toPandas()
    sizes = got.groupby("shard").slot.agg(["count", "min", "max", "nunique"])
    assert len(sizes) == 8 and sizes["count"].max() - sizes["count"].min() <= 1
    assert (sizes["min"] == 0).all() and (sizes["max"] == sizes["count"] - 1).all() and (sizes["nunique"] == sizes["count"]).all()
    text = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    assert all(r.size == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in got.itertuples())


def test_overflow_continues_clockwise():
    owners = [0, 1, 2, 1]
    assert sharding.assign_arcs({0: 5, 1: 1}, owners, [2, 2, 2]) == [(0, 0, 2, 0, 0), (1, 0, 1, 1, 0), (0, 2, 3, 1, 1), (0, 3, 5, 2, 0)]


def test_limited_movement():
    """With slack, adding a shard moves little more than that shard's share."""

    def place(shards):
        circle = sharding.ring(shards, 64)
        rng = np.random.default_rng(1)
        arcs = np.searchsorted([p for p, _ in circle], rng.integers(-(2**63), 2**63 - 1, 4000)) % len(circle)
        ranks, seen = [], collections.Counter()
        for a in arcs.tolist():
            ranks.append(seen[a])
            seen[a] += 1
        table = sharding.assign_arcs(dict(seen), [s for _, s in circle], sharding.capacities(4000, shards, 0.25))
        return [next(s for a, lo, hi, s, _ in table if a == arc and lo <= r < hi) for arc, r in zip(arcs.tolist(), ranks, strict=True)]

    moved = sum(a != b for a, b in zip(place(8), place(9), strict=True))
    assert moved < 4000 * 0.3


def test_limited_movement_without_slack(spark):
    """From 8 to 9 shards of equal counts about a ninth of the rows should move."""
    rows = spark.range(20000).select(F.col("id").alias("doc_id"))
    a = {r.doc_id: r.shard for r in sharding.shard_rows(rows, "doc_id", 8).collect()}
    b = {r.doc_id: r.shard for r in sharding.shard_rows(rows, "doc_id", 9).collect()}
    assert 0.11 <= sum(a[i] != b[i] for i in a) / len(a) < 0.2


def test_shard_edges(spark, edges):
    got = sharding.shard_rows(edges, "doc_id", 3).toPandas()
    assert len(got) == len(EDGES) and sorted(got["shard"].value_counts()) == [2, 2, 3]
    assert sharding.shard_rows(edges.limit(0), "doc_id", 3).count() == 0
    hot = spark.range(3000).select(F.lit(1).alias("k"))
    assert sharding.shard_rows(hot, "k", 4, salt_rows=50).groupBy("shard").count().select("count").distinct().count() == 1


# op2


def test_chat_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{SF}/conversations.parquet'")
    got, want = chat.op2_chat_prefix_targets(spark, SF).toPandas(), con.sql(chat.OP2_SQL).df()
    rows = lambda f: sorted(map(tuple, f[list(got.columns)].astype(str).to_numpy().tolist()))
    assert rows(got) == rows(want)


def test_chat_round_trip(spark):
    texts = ["<|im_end|>\n<|im_start|>user\nx", "a\\s\\p<|<\\p", "", None, "<", "|>\n\n", "\\", "é😀\n"]
    rows = [(c, i, r, t) for c in range(3) for i, (r, t) in enumerate(zip(["system", "user", "assistant", "assi\nstant\\n", None, "assistant", "user", "assistant"], random.Random(c).sample(texts, 8), strict=True))]
    rows += [(9, 0, "user", "only"), (9, 0, "user", "only"), (None, None, "assistant", "q")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit(1))
    out = chat.format_chats(turns)
    read = out.select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_length")).alias("loss")).collect()
    for conv in (0, 1, 2, 9, None):
        said = [(r or "", t or "") for c, _, r, t in rows if c == conv]
        mine = sorted((r for r in read if r.conv_id == conv), key=lambda r: r.example)
        whole = [r for r in mine if r.complete]
        assert len(whole) == 1 and [tuple(t) for t in whole[0].turns] == said
        for r in mine:
            assert [tuple(t) for t in r.turns] == said[: r.n_turns]
        assert [r.loss for r in mine if r.loss_start is not None] == [t for r, t in said if r == "assistant"]
    assert chat.format_chats(turns.limit(0)).count() == 0


# op3


def test_added_tokens_in_texts_have_their_ids(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a<|endoftext|>b", "<|endoftext|>", "x <|endoftext|> <|endoftext|>\n\ny", "a <|endoftext |> b"]
    got = {r.doc_id: r for r in packing.tokenised_pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 2048, 1).collect()}
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4")
        assert got[i].doc_tokens == len(ids) and got[i].ids_crc32 == zlib.crc32(ids.tobytes())


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.op3_packing(spark, SF).toPandas()
    text = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    for doc, pieces in got.groupby("doc_id"):
        ids, at = np.array([*tok.encode(text[doc], add_special_tokens=False).ids, 1], "<u4"), 0
        for p in pieces.sort_values("start").itertuples():
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for _, seq in got.groupby("sequence_id"):
        end = 0
        for p in seq.sort_values("offset").itertuples():
            assert p.offset == end
            end += p.length
        assert end <= 2048
    assert got.sequence_id.nunique() == got.sequence_id.max() + 1 and got["length"].sum() / 2048 / got.sequence_id.nunique() > 0.97


def test_pack_histogram_places_everything():
    rng = random.Random(2)
    for _ in range(30):
        size = rng.choice([8, 64, 100])
        hist = {n: rng.choice([1, 3, 1000]) for n in rng.sample(range(1, size + 1), rng.randint(1, 8))}
        placed = collections.Counter()
        for count, pattern in packing.pack_histogram(hist, size):
            assert sum(n * k for n, k in pattern) <= size
            for n, k in pattern:
                placed[n] += count * k
        assert placed == hist


def test_pack_histogram_is_shortest_pack_first_piece_by_piece():
    rng = random.Random(3)
    for _ in range(40):
        size = rng.choice([8, 64, 100])
        hist = {n: rng.choice([1, 2, 7, 40]) for n in rng.sample(range(1, size + 1), rng.randint(1, 8))}
        packs = []
        for n in sorted(hist, reverse=True):
            for _ in range(hist[n]):
                # The shortest pack with room; a pack of this very length is filled before another is opened.
                at = min((i for i, p in enumerate(packs) if p + n <= size), key=lambda i: packs[i], default=None)
                if at is None:
                    packs.append(n)
                else:
                    packs[at] += n
        got = collections.Counter()
        for count, pattern in packing.pack_histogram(hist, size):
            got[sum(n * k for n, k in pattern)] += count
        assert sum(got.values()) == len(packs) and got == collections.Counter(packs)


def test_what_fits_stays_whole():
    assert packing.cut(2047, 2048) == [2047] and packing.cut(2048, 2048) == [2048] and packing.cut(5000, 2048) == [2048, 2048, 904]


def test_ties_of_rank_don_t_depend_on_the_order_of_rows(spark):
    rows = [(i % 40, 0, 300 + i % 3, i % 5, 600) for i in range(900)]
    got = []
    for order in (rows, rows[::-1]):
        frame = spark.createDataFrame(order, packing.PIECES).repartition(3 + len(got))
        got.append(sorted(map(tuple, packing.pack(frame, salt_rows=20).collect())))
    assert got[0] == got[1]


def test_very_long_texts(spark):
    """Millions of characters in one text, and in one word."""
    long, word = "the cat and of words " * 150_000, "x" * 1_000_000
    docs = spark.createDataFrame([(1, long), (2, long), (3, word), (4, long + "!")], "doc_id long, text string")
    assert sorted((r.doc_id, r.keep_id) for r in exact_dedup.exact_groups(docs).collect()) == [(1, 2), (2, 2), (3, 3), (4, 4)]
    assert sorted((r.doc_id, r.component_id) for r in simhash.simhash_groups(docs, 3, 2).collect()) == [(1, 1), (2, 1), (3, 3), (4, 1)]
    assert sorted((r.doc_id, r.component_id) for r in near_text.near_groups(docs).collect()) == [(1, 1), (2, 1), (4, 1)]
    model = language_id.train(docs.selectExpr("if(doc_id = 3, 'xx', 'en') as lang", "text"))
    assert {r.doc_id: r.lang_pred for r in language_id.predict(docs, model).collect()} == {1: "en", 2: "en", 3: "xx", 4: "en"}
    turns = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", word)], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(turns).select(F.char_length("formatted"), "loss_length").first()[1] == len(word)
    pages = spark.createDataFrame([(1, "http://a.org/" + "s/" * 100_000), (2, "http://a.org/" + word)], "page_id long, url string")
    assert url_filter.filter_urls(pages, spark.createDataFrame([], "url_id long, is_good boolean"), []).count() == 2


def test_pack_edges(spark, edges):
    got = packing.pack_documents(edges).toPandas()
    assert got.drop_duplicates(["doc_id", "start", "doc_tokens"])["length"].sum() == 1 + 1 + 4 + 4 + 4002
    assert not got.duplicated(["sequence_id", "offset"]).any()
    assert packing.pack_documents(edges.limit(0)).count() == 0


# op4


def test_bpe_is_tiktoken(spark):
    import public_tokenizers
    import tiktoken

    coder = bpe.Bpe(bpe.vocabulary(), public_tokenizers.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    rng = random.Random(1)
    texts = ["".join(rng.choices(["a", "th", "the", " ", "é", "中", "\n", "!", "'s", "1", "😀", "\t", "ing"], k=rng.randint(0, 50))) for _ in range(500)]
    texts += ["a" * 3000, " " * 5000 + "x", "theing" * 3000, "é中😀" * 500]
    for t, raw in zip(texts, coder.encode_many(texts), strict=True):
        ids = np.frombuffer(raw, "<u4").tolist()
        assert ids == enc.encode_ordinary(t) and coder.decode(ids) == t.encode()


def test_bpe_query(spark, docs, edges):
    text = dict(docs.select("doc_id", "text").collect())
    for r in bpe.op4_byte_bpe(spark, SF).collect():
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
    back = bpe.decode(bpe.encode(edges)).collect()
    assert sorted(bytes(r.decoded) for r in back) == sorted((t or "").encode() for _, t, _ in EDGES)


# op5


def test_exact_dedup_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    got, want = exact_dedup.op5_exact_dedup(spark, SF).toPandas(), con.sql(exact_dedup.OP5_SQL).df()
    rows = lambda f: sorted(map(tuple, f[list(got.columns)].astype(str).to_numpy().tolist()))
    assert rows(got) == rows(want)


def test_equal_digests_are_told_apart_by_bytes(docs):
    exact = exact_dedup.exact_groups(docs).drop("digest").toPandas().sort_values("doc_id")
    weak = exact_dedup.exact_groups(docs, digest=lambda t: F.sha2(F.substr(t, F.lit(1), F.lit(1)), 256)).drop("digest").toPandas().sort_values("doc_id")
    assert exact.astype(str).to_numpy().tolist() == weak.astype(str).to_numpy().tolist()


def test_a_second_run_goes_on_with_the_state(spark, tmp_path):
    state = str(tmp_path / "state")
    parts = [[(1, "a"), (5, "b"), (6, None)], [(2, "a"), (3, "b"), (7, "c"), (8, "")], [(9, "new")]]
    got = []
    for n, part in enumerate(parts):
        spark.createDataFrame(part, "doc_id long, text string").write.parquet(f"{tmp_path}/part-{n}")
        rows = exact_dedup.exact_groups(spark.read.parquet(f"{tmp_path}/part-{n}"), state=state).collect()
        got.append(sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in rows))
    assert got[0] == [(1, 1, 1, True), (5, 5, 1, True), (6, 6, 1, True)]
    assert got[1] == [(2, 2, 2, True), (3, 5, 2, False), (7, 7, 1, True), (8, 8, 2, True)] and got[2] == [(9, 9, 1, True)]


def test_locators_find_contents(spark, docs):
    rows = docs.select("doc_id", "text", exact_dedup.locator_of(docs).alias("at")).limit(5)
    found = exact_dedup.located(spark, rows.select(F.col("doc_id").cast("string").alias("digest"), "at.*"))
    assert dict(found.collect()) == {str(r.doc_id): r.text for r in rows.collect()}


def test_exact_dedup_edges(edges):
    got = exact_dedup.exact_groups(edges).toPandas()
    assert len(got) == len(EDGES) and got.kept.sum() == 3
    kept = exact_dedup.drop_copies(edges)
    assert kept.columns == edges.columns and sorted(r.doc_id for r in kept.collect()) == [2, 5, 7]
    assert exact_dedup.drop_copies(edges.limit(0)).count() == 0


# op6


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 64))
    x = np.vstack([c + s * rng.normal(size=(40, 64)) for c, s in zip(centres, np.linspace(0.05, 0.5, 12), strict=True)] + [np.repeat(centres[:1], 30, 0)]).astype(np.float32)
    label = np.arange(len(x)) % 2
    frame = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<float>, label int")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    close = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(close, False)
    want = components(len(x), np.argwhere(np.triu(close)).tolist())
    got = embedding_dedup.embedding_groups(frame, cap=16).toPandas().sort_values("vec_id")
    assert got.n_links.tolist() == close.sum(1).tolist() and got.component_id.tolist() == want


def test_embedding_query_against_brute_force(spark, tmp_path):
    """The table and, of every vector, a nearer and a farther copy."""
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    rng, copies = np.random.default_rng(1), [rows]
    for k, far in enumerate((0.2, 0.42), 1):
        moved = [None if v is None else (np.asarray(v) + far * np.linalg.norm(v) / 8 * rng.normal(size=len(v))).astype(np.float32) for v in rows.embedding]
        copies.append(rows.assign(vec_id=rows.vec_id + k * 10**6, embedding=moved))
    import pandas as pd

    rows = pd.concat(copies, ignore_index=True)
    rows.to_parquet(f"{tmp_path}/embeddings.parquet")
    good = [v is not None and len(v) > 0 and np.isfinite(v).all() and np.any(v) for v in rows.embedding]
    x = np.stack([np.asarray(v, np.float64) if g else np.zeros(64) for v, g in zip(rows.embedding, good, strict=True)])
    norm = np.linalg.norm(x, axis=1)
    cosine = (x @ x.T) / np.where(norm, norm, 1)[:, None] / np.where(norm, norm, 1)[None, :]
    near = (cosine >= 0.93) & (rows.label.to_numpy()[:, None] == rows.label.to_numpy()[None, :]) & np.array(good)[:, None] & np.array(good)[None, :]
    np.fill_diagonal(near, False)
    got = embedding_dedup.op6_embedding_dedup(spark, str(tmp_path)).toPandas().set_index("vec_id").loc[rows.vec_id]
    assert (got.n_links.to_numpy() <= near.sum(axis=1)).all() and got.n_links.sum() >= 0.99 * near.sum() > 0
    if got.n_links.sum() == near.sum():
        groups = components(len(rows), list(zip(*np.nonzero(near), strict=True)))
        least = {c: min(rows.vec_id[i] for i, d in enumerate(groups) if d == c) for c in set(groups)}
        assert got.component_id.tolist() == [least[c] for c in groups]


def test_embedding_plan_grows_with_the_corpus():
    plans = [embedding_dedup.plan_tables(n, 64, 0.93, 2, 0.999) for n in (1000, 50_000, 10**7, 10**9)]
    assert [r for _, r in plans] == [3, 3, 4, 5] and [t for t, _ in plans] == sorted(t for t, _ in plans) and plans[-1][0] < 20
    assert embedding_dedup.plan_tables(0, 1, 0.93, 2, 0.999)[0] >= 1


def test_embedding_edges(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [0.0, 0.0], 1), (4, None, 1), (5, [1.0, nan], 1), (6, [1.0, 0.0], None), (7, [1.0, 0.0], 2), (1, [1.0, 0.0], 1), (8, [1.0, None], 1), (9, [1.0, 0.1], 1), (10, [1.0, 0.1, 0.0], 1), (11, [], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"rid": F.lit(1), "key": F.lit("k")})
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_groups(frame).collect())
    assert got == [(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), *[(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8)], (9, 3, 1, False), (10, 0, 10, True), (11, 0, 11, True)]
    assert embedding_dedup.embedding_groups(frame.limit(0)).count() == 0


# op7


def test_url_parts_and_rules(spark):
    rows = [(1, None), (2, "nohost"), (3, "HTTP://EXAMPLE.com"), (4, "x://a.net/es/?q"), (4, "x://a.net/es/?q"), (5, "http://www.Example.com/en/1?x://y"), (6, "http://m.example.com/en/#/z"), (7, "h://xample.com/"), (8, "h://notexample.com/en/"), (None, "x://É.net/a/b/c/d/e/f/g/h/i/j" + "/k" * 3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit("h"), "shape": F.lit("s")})
    labels = spark.createDataFrame([(2, True), (2, None), (None, False)], "url_id long, is_good boolean")
    got = collections.defaultdict(list)
    for r in url_filter.filter_urls(pages, labels, url_filter.RULES).collect():
        got[r.page_id].append((r.host, r.path[:4], r.rule, r.verdict))
    assert got[1] == [("", "", None, "allow")] and got[2][0][:3] == ("", "", None) and got[3] == [("example.com", "", None, "allow")]
    assert got[4] == [("a.net", "/es/", "net/es/", "block")] * 2
    assert got[5] == [("www.example.com", "/en/", "www.example.com/en/", "allow")]
    assert got[6] == [("m.example.com", "/en/", "example.com/en/", "block")]
    assert got[7][0][2:] == ("com/", "allow") and got[8][0][2:] == ("com/", "allow") and got[None][0][0] == "É.net"
    assert url_filter.filter_urls(pages.limit(0), labels, url_filter.RULES).count() == 0


def test_impure_templates_are_rejected(spark):
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.org/"), F.when(F.col("id") % 2 == 0, "good/").otherwise("spam/"), "id").alias("url"))
    labels = pages.select(F.col("page_id").alias("url_id"), (F.col("page_id") % 2 == 0).alias("is_good")).filter("url_id % 4 < 2")
    got = {(r.template, r.verdict) for r in url_filter.filter_urls(pages, labels, []).collect()}
    assert {v for t, v in got if "good" in t} == {"allow"} and {v for t, v in got if "spam" in t} == {"block"}


@pytest.mark.parametrize("sections", [40, 60])
def test_a_bad_section_stays_apart_among_any_number(spark, sections):
    """Of inner branches, of branches below them, and of leaves."""
    n = F.col("id") % sections
    bad = n == 7
    name = F.concat(F.lit("s"), F.translate(n.cast("string"), "0123456789", "abcdefghij"))
    urls = [("http://one.org/", name, F.lit("/x")), ("http://two.org/top/", name, F.lit("/mid/x")), ("http://leaf.org/", name, F.lit(""))]
    pages = None
    for k, (head, mid, tail) in enumerate(urls):
        part = spark.range(sections * 60).select((F.col("id") + k * 100000).alias("page_id"), F.concat(F.lit(head), mid, tail).alias("url"), (~bad).alias("is_good"))
        pages = part if pages is None else pages.unionByName(part)
    labels = pages.filter("page_id div 60 % 3 < 2").select(F.col("page_id").alias("url_id"), "is_good")
    got = url_filter.filter_urls(pages.drop("is_good"), labels, []).join(pages.select("page_id", "is_good"), "page_id")
    assert got.filter("(verdict = 'allow') <> is_good").count() == 0
    assert got.select("host", "template").distinct().count() == 6


def brute_templates(rows, depth=8, z=2.58, weight=10.0):
    """rows of (host, shape, good, bad), one a page -> {(host, shape): (template, purity)}; a plain tree in memory."""
    sums = {}
    for host, form, g, b in rows:
        old = sums.get((host, form), (0, 0))
        sums[host, form] = (old[0] + g, old[1] + b)
    good, bad = (sum(v[i] for v in sums.values()) for i in (0, 1))
    rate = (good + 1) / (good + bad + 2)

    def add(into, key, v):
        old = into.get(key, (0, 0))
        into[key] = (old[0] + v[0], old[1] + v[1])

    def differing(nodes):
        """nodes {(family, name): (good, bad)} -> those whose rate differs from that of the family's other nodes."""
        family = {}
        for (f, _), v in nodes.items():
            add(family, f, v)
        out = set()
        for (f, name), (g, b) in nodes.items():
            n, m = g + b, sum(family[f])
            if n and m - n:
                p = family[f][0] / m
                if abs(g / n - (family[f][0] - g) / (m - n)) > z * math.sqrt(p * (1 - p) * (1 / n + 1 / (m - n))):
                    out.add((f, name))
        return out

    cut = {k: k[1].split("/", depth) for k in sums}
    inner, leaves = {}, {}
    for k, v in sums.items():
        for level in range(2, len(cut[k]) + 1):
            add(inner if level < len(cut[k]) else leaves, ((k[0], *cut[k][: level - 1]), cut[k][level - 1]), v)
    apart = set()
    for nodes, own in ((inner, 1), (leaves, 0)):
        for family, name in differing(nodes):
            way = [*family[1:], name]
            apart |= {((family[0], *way[: level - 1]), way[level - 1]) for level in range(2, len(way) + own)}
    way = {k: cut[k][:-1] for k in sums}
    for level in range(2, max(map(len, cut.values()), default=0)):
        nodes, size = {}, Counter()
        for k, v in sums.items():
            if len(way[k]) >= level:
                add(nodes, ((k[0], *way[k][: level - 1]), way[k][level - 1]), v)
        size.update(f for f, _ in nodes)
        merged = {n for n in nodes if size[n[0]] > 1} - differing(nodes) - apart
        for k in sums:
            if len(way[k]) >= level and ((k[0], *way[k][: level - 1]), way[k][level - 1]) in merged:
                way[k] = [*way[k][: level - 1], "*", *way[k][level:]]
    ends = {}
    for k, v in sums.items():
        add(ends, ((k[0], *way[k]), cut[k][-1]), v)
    own = differing(ends)
    last = {n: n[1] if n in own else "*" for n in ends}
    total, hosts = {}, {}
    for n, v in ends.items():
        add(total, (n[0], last[n]), v)
        add(hosts, n[0][0], v)
    out = {}
    for k in sums:
        n = ((k[0], *way[k]), cut[k][-1])
        (g, b), (hg, hb) = total[n[0], last[n]], hosts[k[0]]
        host = (hg + weight * rate) / (hg + hb + weight)
        out[k] = ("/".join(x for x in ("/".join(way[k]), last[n]) if x), (g + weight * host) / (g + b + weight))
    return out


def check_templates(spark, pages, labels):
    got = url_filter.filter_urls(pages, labels, [], min_purity=0.5).collect()
    marks = {r.url_id: r.is_good for r in labels.collect()}
    shapes = {r.page_id: r.form for r in pages.select("page_id", url_filter.shape(url_filter.host_and_path(F.col("url"))[1]).alias("form")).collect()}
    want = brute_templates([(r.host, shapes[r.page_id], int(marks.get(r.page_id) is True), int(marks.get(r.page_id) is False)) for r in got])
    for r in got:
        template, purity = want[r.host, shapes[r.page_id]]
        assert r.template == template and r.purity == pytest.approx(purity, abs=1e-9) and (r.verdict == "allow") == (r.purity >= 0.5)
    return got


def test_templates_against_a_plain_tree(spark):
    rng = random.Random(6)
    rows, marks = [], []
    for i in range(4000):
        host, way = rng.choice("abc"), [rng.choice(["s", "t", "u", "v" + "w" * rng.randrange(60)]) for _ in range(rng.choice([1, 2, 3, 4, 12]))]
        rows.append((i, f"http://{host}.org/" + "/".join(way)))
        if rng.random() < 0.5:
            marks.append((i, rng.random() < (0.1 if "t" in way[:3] else 0.9)))
    pages, labels = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(marks, "url_id long, is_good boolean")
    got = check_templates(spark, pages, labels)
    assert {r.verdict for r in got} == {"allow", "block"} and any("*" in r.template for r in got)


def test_url_query_against_a_plain_tree(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    labels = url_filter.page_labels(pages, spark.read.parquet(f"{SF}/labels.parquet")).dropDuplicates(["url_id"])
    want = {r.page_id: r for r in check_templates(spark, pages, labels)}
    rows = url_filter.op7_url_templates(spark, SF).collect()
    assert len(rows) == pages.count()
    for r in rows:
        ruled = [(v, n) for v, n in url_filter.RULES if (r.host == n.split("/")[0] or r.host.endswith("." + n.split("/")[0])) and r.path.startswith("/" + n.partition("/")[2])]
        verdict, rule = max(ruled, key=lambda x: len(x[1]), default=(want[r.page_id].verdict, None))
        assert (r.rule, r.verdict, r.template) == (rule, verdict, want[r.page_id].template)


# op8


def test_simhash_against_brute_force(spark):
    got = simhash.op8_simhash(spark, SF).toPandas().sort_values("doc_id")
    fps = np.array([int(x, 16) for x in got.fingerprint], np.uint64)
    links = [(i, j) for i in range(len(fps)) for j in (np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 2) + i + 1).tolist()]
    ids = got.doc_id.tolist()
    assert [ids[c] for c in components(len(fps), links)] == got.component_id.tolist()


def test_fingerprint_by_hand(spark):
    import xxhash

    text = "A b  C\td b C d"
    words = text.lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.text_fingerprint(text, 3, 42) == want
    native = spark.createDataFrame([("a b c",)], "t string").select(F.xxhash64("t")).first()[0]
    assert simhash.text_fingerprint("A B c", 3, 42) == native % (1 << 64)


def test_split_shards_lose_no_link(spark):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    fps = list({base ^ (sum(1 << rng.randrange(63) for _ in range(rng.randint(0, 4))) & (2**63 - 1)) for _ in range(600)} | {rng.getrandbits(64) for _ in range(100)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    ws = Workspace(spark, "test")
    distinct = ws.save(spark.createDataFrame([(x, i) for i, x in enumerate(signed)], "fp long, rep long"), "distinct")
    found = {r.node: r.component for r in connected_components(ws, simhash.link_stars(ws, distinct, 2, tree_rows=50)).collect()}
    want = components(len(fps), [(i, j) for i, j in itertools.combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= 2])
    assert [found.get(i, i) for i in range(len(fps))] == want


def test_simhash_edges(edges):
    got = sorted((r.doc_id or 0, r.component_id) for r in simhash.simhash_groups(edges, 5, 3).collect())
    assert got == [(0, 5), (1, 1), (2, 1), (2, 1), (5, 5), (5, 5), (7, 7)]
    assert simhash.simhash_groups(edges.limit(0), 5, 3).count() == 0


def brute_near(texts):
    sets = [set(near_text.shingle_hashes(t, 5).tolist()) for t in texts]
    links = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if (not sets[i] and not sets[j]) or (sets[i] or sets[j]) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    return components(len(texts), links)


def test_near_texts_against_brute_force(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(120)]
        for edits in (0, 1, 2, 3, 12):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    texts += ["", " \n", "short text", "SHORT text"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("rep", F.lit(0))
    found = {r.doc_id: r.component_id for r in near_text.near_groups(frame, tree_rows=8).collect()}
    assert [found.get(i, i) for i in range(len(texts))] == brute_near(texts)
    assert near_text.near_groups(frame.limit(0)).count() == 0


# op9


def test_language_of_held_out_rows(spark, docs):
    got = language_id.op9_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.held_out == held.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    assert (held.lang == held.lang_pred).mean() > 0.95 and got.score.between(0, 1).all()


def test_language_edges(spark, docs, edges):
    model = language_id.train(docs.select("lang", "text"))
    got = language_id.predict(edges, model)
    assert got.columns == [*[c for c in edges.columns if c != "score"], "lang_pred", "score"]
    by = {(r.text or "")[:3]: (r.lang_pred, r.score) for r in got.collect()}
    assert by[""] == ("und", 0.0) and by["the"][0] == "en"
    assert model.predict([None, "", "12 $$", "😀"]) == (["und"] * 4, [0.0] * 4)
    assert language_id.train(docs.select("lang", "text").limit(0)).predict(["the"]) == (["und"], [0.0])
    assert language_id.predict(edges.limit(0), model).count() == 0


def test_candidates_a_document_do_not_grow_with_the_corpus(spark):
    """Unrelated texts share no shard however many there are; near pairs meet in some."""
    rng = np.random.default_rng(3)
    a_doc = []
    for n in (500, 4000):
        rows = []
        for i in range(n):
            h = rng.integers(0, 1 << 63, 200, np.uint64)
            near = np.concatenate([h[:178], rng.integers(0, 1 << 63, 22, np.uint64)]) if i % 10 == 0 else None
            rows += [(len(rows), near_text.sketch(h), near_text.band_keys(h).tolist())]
            if near is not None:
                rows += [(len(rows), near_text.sketch(near), near_text.band_keys(near).tolist())]
        frame = spark.createDataFrame(rows, "rid long, held binary, keys array<long>")
        ws = Workspace(spark, "test")
        shards = near_text.shards_of(ws, ws.save(frame, "reps")).groupBy("key").agg(F.collect_list("rid").alias("rids")).collect()
        a_doc.append(sum(len(s.rids) * (len(s.rids) - 1) / 2 for s in shards) / len(rows))
        met = {tuple(sorted(p)) for s in shards for p in itertools.combinations(s.rids, 2)}
        assert len(met) >= 0.99 * n / 10
    assert a_doc[1] < 1.5 * a_doc[0] < 3


def test_ids_on_several_texts_and_rows(spark):
    base = [f"w{i}" for i in range(300)]
    texts = [(1, " ".join(base)), (2, " ".join(base[:-1])), (2, "another text of its own " + " ".join(base[::-1])), (2, " ".join(base[:-1])), (None, " ".join(base)), (3, " ".join(base).upper())]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_text.near_groups(spark.createDataFrame(texts, "doc_id long, text string")).collect())
    assert got == [(1, 1, True), (2, 1, False), (3, 1, False)]


def test_near_pairs_of_short_texts_are_all_found(spark):
    words = [[f"w{i}x{k}" for k in range(9)] for i in range(400)]
    rows = [(2 * i + k, " ".join(w[: 9 - k])) for i, w in enumerate(words) for k in range(2)]
    got = {r.doc_id: r.component_id for r in near_text.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


# op10

KEY = b"test"


def test_surrogates_keep_type_and_format():
    text = 'Mail Jo.Doe@Mail3.example.com, jo.doe@mail3.EXAMPLE.com. Call +1 (202) 555-0147 or 202-555-0147. IP 152.143.123.131. Card 4111 1111 1111 1111. token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'
    new, kinds = pii.replace_text(text, KEY)
    assert kinds == ["email", "email", "phone", "phone", "ip", "card", "secret"]
    for old in ("Jo.Doe", "mail3", "555-0147", "152.143", "4111 1111", "24be64"):
        assert old not in new
    mails = [new[a:b] for a, b, k in pii.mentions(new) if k == "email"]
    phones = [new[a:b] for a, b, k in pii.mentions(new) if k == "phone"]
    assert mails[0] == mails[1] and pii.canonical("phone", phones[0]) == pii.canonical("phone", phones[1]) and phones[0].startswith("+1 (")
    card = next(new[a:b] for a, b, k in pii.mentions(new) if k == "card")
    assert pii.luhn(card.replace(" ", "")) and [len(p) for p in card.split()] == [4, 4, 4, 4]


def test_names_match_gender_script_and_corefer():
    new, _ = pii.replace_text("Mr. John Smith met Mrs Anna Smith and Dr. SMITH; Г-н Иван Петров.", KEY)
    words = new.replace(".", " ").replace(";", " ").split()
    john, smith, anna, smith2, caps = words[1], words[2], words[5], words[6], words[9] if words[8] == "Dr" else words[8]
    assert smith == smith2 and caps == smith.upper() and john != anna and anna[-1] == "a"
    assert all(pii.script(w) == "CYRILLIC" for w in words[-2:])


def test_every_mention_of_a_titled_name_gets_its_surrogate(spark):
    new, _ = pii.replace_text("Smith knew it. Mr. John Smith called. John said ... SMITH left in Smith's car, not Smithson's; john-smith. MR. SMITH and dr. Lee.", KEY)
    assert not set(new.replace("-", " ").replace("'", " ").replace(".", "").casefold().split()) & {"john", "smith", "lee"} and "not Smithson's" in new
    given, family = new.split()[4:6]
    assert new.startswith(family.strip(".") + " knew") and f"{given} said ... {family.upper()} left in {family}'s car" in new and f"{given}-{family}".lower() in new and f"MR. {family.upper()}" in new
    words = pii.replace_text("Dr Jane Smith met Ms Jane Smith.", KEY)[0].split()
    assert words[1] == words[5] and words[1].endswith("a")
    assert pii.replace_text("Frau Dr. Anna Weber", KEY)[0].split()[2][-1] == "a"
    secret = "a1" * 100
    assert secret not in pii.replace_text(f"x {secret}", KEY)[0] and pii.mentions("ab" * 100000) == []
    # Between texts: the gender that one of them tells holds in the other.
    docs = spark.createDataFrame([(1, "Dr Jane Smith"), (2, "Ms Jane Smith"), (3, "Jane Smith")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.replace_pii(docs, KEY).collect()}
    assert got[1].split()[1:] == got[2].split()[1:] != ["Jane", "Smith"] and got[3] == "Jane Smith"


def test_surrogate_clashes_are_resolved(spark):
    ws = Workspace(spark, "test")
    rows = [("ssn", f"{i:03d}") for i in range(100, 400)]
    entities = ws.save(spark.createDataFrame([(k, pii.seal(KEY, c)) for k, c in rows], "kind string, canon binary"), "entities")
    other = {(r.kind, pii.unseal(KEY, bytes(r.canon))): r.attempt for r in pii.clashes(ws, entities, KEY).collect()}
    drawn = [pii.surrogate(k, c, KEY, other.get((k, c), 0)) for k, c in rows]
    assert other and len(set(drawn)) == len(rows) and not set(drawn) & {c for _, c in rows}
    docs = spark.createDataFrame([(i, f"no {c[:3]}-11-{c}0") for i, (_, c) in enumerate(rows)], "doc_id long, text string")
    assert pii.replace_pii(docs, KEY).select("text").distinct().count() == len(rows)


def test_documents_with_clashing_entities_get_other_surrogates(spark):
    letters = "abcdefghij"
    names = ["N" + "".join(letters[int(d)] for d in f"{i:04d}") for i in range(4000)]
    docs = spark.createDataFrame([(i % 1000, f"Mr. {n} came", "x") for i, n in enumerate(names)], "doc_id long, text string, id string")
    first = {pii.replace_text(f"Mr. {n} came", KEY)[0] for n in names}
    got = pii.replace_pii(docs, KEY).toPandas()
    assert len(first) < len(names) and got.text.nunique() == len(names) and got.columns.tolist() == ["doc_id", "text", "id", "pii_kinds"]


def test_pii_edges(spark, edges):
    got = pii.replace_pii(edges, KEY)
    assert got.columns == [*edges.columns, "pii_kinds"] and sorted(map(str, (r.text for r in got.collect()))) == sorted(str(t) for _, t, _ in EDGES)
    assert pii.replace_pii(edges.limit(0), KEY).count() == 0
    assert pii.mentions("x" * 200000) == [] and pii.mentions("1" * 100000) == []


def test_names_by_titles_and_cues_and_numbers_by_check_digits():
    gone = lambda text: set(re.findall(r"\w+", text)) - set(re.findall(r"\w+", pii.replace_text(text, KEY)[0]))
    assert gone("Mr Smith met Mrs Jones today.") == {"Smith", "Jones"}
    assert gone("Mr. Smith and Dr. Brown spoke.") == {"Smith", "Brown"}
    assert gone("Mr. John Smith met Anna Jones. Smith said hi, then John left. Anna smiled.") == {"John", "Smith", "Anna", "Jones"}
    assert gone("Kind regards,\nAnna Jones") == {"Anna", "Jones"} and gone("From: Jane Doe <x>") == {"Jane", "Doe"}
    assert gone("Jane Doe (jane@x.com) wrote") >= {"Jane", "Doe"} and gone("My name is Peter O'Neil.") == {"Peter", "O", "Neil"}
    assert gone("Met Office data, the New York office, order 123456789012345, GB83 WEST 1234 5698 7654 32") == set()
    iban = pii.replace_text("GB82 WEST 1234 5698 7654 32 AND", KEY)[0]
    assert iban.endswith(" AND") and pii.mod97(iban[:-4].replace(" ", "")) == 1 and iban[:2] == "GB" and "WEST" not in iban
    assert pii.replace_text("4451718024887799 27", KEY)[0].endswith(" 27")
    assert gone("call 07911 123456 now") == {"07911", "123456"} and gone("std::vector a::b") == set()
    short = pii.replace_text("2001:db8::7334 and fe80::1", KEY)[0]
    assert "::" in short and "7334" not in short and short.startswith("2001:") and "fe80::" in short
    dates = pii.replace_text("born on 12 March 1980, DOB: 03/04/1975, date of birth: 1990-01-31; released 2001-02-03", KEY)[0]
    assert "1990-01-31" not in dates and re.search(r"born on \d\d [A-Z][a-z]+ 19\d\d, DOB: \d\d/\d\d/19\d\d, date of birth: \d{4}-\d\d-\d\d; released 2001-02-03", dates)
    assert pii.replace_text("born 1980-03-12", KEY)[0][5:] == pii.surrogate("birth", "1980-03-12", KEY)
    assert gone("at 221 Baker Street; Hauptstraße 12") == {"221", "Baker", "Hauptstraße", "12"}
    assert pii.unseal(KEY, pii.seal(KEY, "Ä\ud800")) == "Ä\ud800" and pii.seal(KEY, "a") == pii.seal(KEY, "a") != pii.seal(b"x", "a")


def test_detection_is_linear():
    for text in ("Aa-" * 60000, "Ab Cd " * 30000, "12:" * 60000, "0::" * 60000, "name " * 40000, "12 Aa Bb Cc " * 15000, "GB82 " * 40000, "0123 " * 40000, "1 " * 80000):
        began = time.time()
        pii.mentions(text)
        assert time.time() - began < 5, text[:12]


def test_pii_query_against_brute_force(spark, docs):
    rows = {r.doc_id: r.text for r in docs.collect()}
    spark.conf.set(pii.KEY_CONF, "of the test")
    try:
        got = {r.doc_id: r for r in pii.op10_pii(spark, SF).collect()}
    finally:
        spark.conf.unset(pii.KEY_CONF)
    key = b"of the test"
    attempts, kinds = brute_surrogates([t for t in rows.values() if t], key)
    assert sorted(got) == sorted(rows)
    for i, text in rows.items():
        want, found = (None, []) if text is None else pii.replace_text(text, key, lambda k, c: attempts.get((k, c), 0), lambda k, c: kinds.get((k, c), k))
        assert (got[i].text, got[i].n_replaced, got[i].kinds) == (want, len(found), ",".join(sorted(set(found))))


def brute_surrogates(texts, key):
    """(attempts of entities, kinds of names without a gender), in memory."""
    seen = [{(k, pii.canonical(k, t[a:b])) for a, b, k in pii.mentions(t)} for t in texts]
    told = {}
    for entities in seen:
        for k, c in entities:
            if k in ("name-m", "name-f"):
                told.setdefault(c, Counter())[k] += 1
    kinds = {("name-n", c): "name-f" if n["name-f"] > n["name-m"] else "name-m" for c, n in told.items()}
    entities = {(kinds.get((k, c), k), c) for found in seen for k, c in found}
    attempts = dict.fromkeys(entities, 0)
    while True:
        taken, bad = {}, []
        for k, c in sorted(entities, key=lambda e: (attempts[e], pii.seal(key, e[1]))):
            new = pii.surrogate(k, c, key, attempts[k, c])
            if (k, new) in entities or (k, new) in taken:
                bad.append((k, c))
            taken[k, new] = True
        if not bad:
            return attempts, kinds
        for e in bad:
            attempts[e] += 1


def test_no_entity_lies_in_clear_in_shared_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("lexweave.llm.shared.shared_root", lambda _: f"file://{tmp_path}")
    names = ["Nabcd" + "".join("abcdefghij"[int(d)] for d in f"{i:04d}") for i in range(3000)]
    pii.replace_pii(spark.createDataFrame([(i, f"Mr. {n} came") for i, n in enumerate(names)], "doc_id long, text string"), KEY).count()
    left = [p for p in tmp_path.rglob("*.parquet")]
    assert left and len({p.parent for p in left}) == 1
    import pyarrow.parquet as pq

    assert b"nabcd" not in b"".join(str(pq.read_table(p).to_pylist()).lower().encode() for p in left)

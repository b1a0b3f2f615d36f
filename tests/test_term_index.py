"""The glossary's index: equal results at every size, and few rows of texts that reach it."""

import random

import pytest
from pyspark.sql import functions as F

from lexweave.operators import glossary as G
from lexweave.operators import term_index

from .conftest import SF


def test_numbers_are_those_of_equal_runs():
    text = "abcabcé😀abc"
    for n in (1, 3, 6, 20):
        runs = [text[i : i + n] for i in range(len(text) - n + 1)]
        got = term_index.gram_numbers(text, n).tolist()
        assert len(got) == len(runs) and all((got[i] == got[j]) == (runs[i] == runs[j]) for i in range(len(runs)) for j in range(len(runs)))


@pytest.mark.parametrize("small", [1 << 30, 0])
def test_matches_are_those_of_a_plain_search(spark, small):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé文字 ") for _ in range(rng.randint(1, 9)))
    texts = [(i, "".join(word() for _ in range(rng.randint(0, 30))), word() if i % 3 else None) for i in range(120)] + [(200, "x" * 300_000 + "Needle in hay", None), (201, None, None), (202, "", ""), (203, "dup term", None), (203, "dup term", None)]
    terms = [(i, word().upper() if i % 4 else word(), "r") for i in range(150)] + [(200, "needle in", "n"), (201, "needle out", "n"), (202, "", "e"), (203, None, "n"), (204, "dup", "d"), (205, "dup", "d")]
    got = G.matches(spark.createDataFrame(texts, "id long, text string, context string"), spark.createDataFrame(terms, "pos int, term string, rendering string"), "text", "context", small)
    hay = lambda t: "\n".join(x for x in t[1:] if x).lower()
    want = sorted((t[0], p) for t in texts if hay(t) for p, term, _ in terms if term is not None and term.lower() in hay(t))
    assert sorted((r.id, r.pos) for r in got.collect()) == want and got.columns == ["id", "text", "context", "pos", "term", "rendering"]


def test_a_large_glossary_meets_few_places(spark):
    """10 MB of terms, most of which are in no text: of the texts' characters below 1 % reach the index."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.col("text"))
    made = spark.range(320_000).select(F.col("id").cast("int").alias("pos"), F.concat(F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 16), F.lit(" "), F.substring(F.sha2(F.concat(F.lit("x"), "id"), 256), 1, 16)).alias("term"), F.lit("r").alias("rendering"))
    real = docs.select(F.col("doc_id").cast("int").alias("pos"), F.substring("text", 40, 30).alias("term"), F.lit("real").alias("rendering")).filter("length(term) = 30")
    glossary = made.unionByName(real)
    assert glossary.agg(F.sum(F.octet_length("term"))).first()[0] > 8 << 20
    index = term_index.TermIndex(glossary)
    met = docs.filter("text <> ''").select(F.size(index.candidates(F.lower("text"))).alias("n"), F.char_length("text").alias("chars")).agg(F.sum("n"), F.sum("chars")).first()
    assert met[0] < 0.01 * met[1]
    found = G.matches(docs, glossary, small=0).select("doc_id", "pos", "rendering").collect()
    plain = docs.crossJoin(F.broadcast(real)).filter("contains(lower(text), lower(term))").select("doc_id", "pos", "rendering").collect()
    assert sorted(found) == sorted(plain) and len(found) > 100


def test_an_empty_glossary(spark):
    none = spark.createDataFrame([], "pos int, term string, rendering string")
    texts = spark.createDataFrame([(1, "a")], "id long, text string")
    assert G.matches(texts, none).count() == 0 == G.matches(texts, none, small=-1).count()

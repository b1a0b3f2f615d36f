"""Repeated phrases and runs of Latin words: what the patterns find, against plain ones, and what they cost."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lexweave.functions import text as X

from .test_brute import loops

PLAIN_LOOP, PLAIN_REPEAT, PLAIN_SPAN = "(?d)(.{5,50}?)\\1{9,}+", "(?d)(.{5,30}?)\\1{4,}+", "(?U)[A-Za-z]++(?:\\s++[A-Za-z]++){11,}+"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) + rng.choice(["", "", "", ".", ","]) for _ in range(n))


@pytest.fixture(scope="module")
def texts(spark):
    """Phrases of 4 to 52 characters said 3 to 12 times, at all distances from a step's end, one after another, over lines and beside their own first letters."""
    rng, out = random.Random(5), ["", "a" * 49, "a" * 50, "a" * 5000, "\n" * 90, "ab\n" * 40, "😀译b" * 30, "abcde" * 9, "abcde" * 10 + "abc"]
    for _ in range(700):
        parts = []
        for _ in range(rng.randint(1, 3)):
            phrase = "".join(rng.choice("abcd é译😀\r\n" if rng.random() < 0.2 else "abcde fgh译") for _ in range(rng.choice([4, 5, 6, 7, 13, 24, 25, 26, 29, 30, 31, 49, 50, 51, 52])))
            parts += [prose(rng, 12)[: rng.randint(0, 60)], phrase * rng.randint(3, 12), phrase[: rng.randint(0, 5)]]
        out.append("".join(parts) + prose(rng, 9)[: rng.randint(0, 30)])
    return spark.createDataFrame(list(enumerate(out)), "id int, text string").cache()


def test_loops_are_the_plain_patterns(texts):
    changed = 0
    for r in texts.select("text", X.collapse_loops(F.col("text")).alias("got"), F.regexp_replace("text", PLAIN_LOOP, "$1").alias("plain"), F.regexp_replace("text", *X.LOOPS[0]).alias("first")).collect():
        assert (r.first, r.got) == (r.plain, loops(r.text))
        changed += r.got != r.text
    assert 150 < changed < 690


def test_repetition_is_the_plain_pattern(texts):
    found = texts.select("text", X.repetition_issue(F.col("text")).isNotNull().alias("got"), F.col("text").rlike(PLAIN_REPEAT).alias("plain")).collect()
    assert [r.text for r in found if r.got != r.plain] == [] and 300 < sum(r.got for r in found) < 705


def test_spans_are_the_plain_pattern(spark):
    rng = random.Random(6)
    rows = [("".join(rng.choice(["ab", "x", " ", " ", "\n", "  ", "é", "1", ". "]) for _ in range(rng.randint(0, 120))) + " a\t b" * rng.randint(3, 8),) for _ in range(400)]
    got = spark.createDataFrame(rows, "text string").select(X.untranslated_span(F.col("text")).alias("got"), F.regexp_extract("text", PLAIN_SPAN, 0).alias("plain")).collect()
    assert all(r.got == r.plain for r in got) and 50 < sum(r.got != "" for r in got) < 400


def test_texts_of_any_length(spark):
    long = spark.range(1).select(F.repeat(F.concat(F.lit("wandering "), F.sha2(F.lit("a"), 512), F.lit(" of all")), 20000).alias("text"))
    long = long.select(F.concat("text", F.lit("the same " * 12)).alias("text"))
    r = long.select(X.repetition_issue(F.col("text")).isNotNull().alias("flag"), F.char_length("text").alias("n"), F.char_length(X.collapse_loops(F.col("text"))).alias("left")).first()
    assert r.flag and r.n - r.left == 99 and r.n > 2_000_000


@pytest.mark.parametrize("name", ["loop", "repeat"])
def test_cost(spark, name):
    """Clean texts, and clean texts with a loop at their end, pass several times faster than by the plain pattern."""
    rng = random.Random(7)
    rows = spark.createDataFrame([(prose(rng, 20000) + ("the same phrase " * 20 if name == "loop" else ""),) for _ in range(4)], "text string").coalesce(1).cache()
    ways = {"loop": (F.regexp_replace("text", PLAIN_LOOP, "$1"), F.regexp_replace("text", *X.LOOPS[0])), "repeat": (F.col("text").rlike(PLAIN_REPEAT), X.repetition_issue(F.col("text")))}
    took = []
    for way in ways[name]:
        seconds = []
        for _ in range(3):
            began = time.monotonic()
            rows.select(F.xxhash64(way).alias("h")).collect()
            seconds.append(time.monotonic() - began)
        took.append(min(seconds))
    assert took[0] > 2 * took[1]

"""What is looked for before a slow rule runs: it never keeps a rule from what it would change."""

import random

from pyspark.sql import functions as F

from lexweave.functions import text as X
from lexweave.operators import glossary as G

from .test_loops import PLAIN_REPEAT, prose, texts  # noqa: F401 a fixture


def plain(text, rules):
    for pattern, new in rules:
        text = F.regexp_replace(text, pattern, new)
    return text


def plain_strip(text):
    return F.regexp_replace(F.regexp_replace(text, "(?U)^\\s++", ""), "(?U)(?<!\\s)\\s++$", "")


def test_no_guard_hides_a_loop(texts):  # noqa: F811
    t = F.col("text")
    assert texts.filter(t.rlike(X.NO_LOOP) & t.rlike(X.LOOPS[0][0]) & (F.regexp_replace(t, *X.LOOPS[0]) != t)).count() == 0
    assert texts.filter(t.rlike(X.NO_REPEAT) & t.rlike(PLAIN_REPEAT)).count() == 0
    assert texts.filter(t.rlike(X.NO_LOOP)).count() > 50 and texts.filter(t.rlike(X.NO_REPEAT)).count() > 10


def test_rules_are_the_plain_chain(spark, texts):  # noqa: F811
    rng = random.Random(8)
    bits = ["（注：x）", "(注：y)", "【修正后的译文】： ", "[修正后的译文] ", "Here is the translation: ", "HERE IS THE TRANſLATION：", "translation ", "```markdown\n", "\n```", "```", "译文", "译文" * 12, "。。。。。", "！" * 4, "；；；"]
    words = [w + blank for w in ("the", "ſee", "SEE ", "İbn", "öl") for blank in (" ", "\n", "\u00a0", "\u2009", "\u3000", "  ")]
    blanks = ["", " ", "\t\n", "\u00a0", "\u2028", "\u0085", "\u3000", "\r\n", "\u200b"]
    rows = [(None,), ("",)]
    for _ in range(1500):
        body = [rng.choice(bits) if rng.random() < 0.4 else rng.choice(words) * rng.randint(1, 13) if rng.random() < 0.5 else prose(rng, 4) for _ in range(rng.randint(0, 5))]
        rows.append((rng.choice(blanks) + "".join(body) + rng.choice(blanks),))
    rows = spark.createDataFrame(rows, "text string").union(texts.select("text"))
    t = F.col("text")
    got = rows.select("text", X.clean_output(t).alias("got"), plain_strip(plain(t, [*X.BOILERPLATE, *X.LOOPS])).alias("want"), X.strip(t).alias("short"), plain_strip(t).alias("bare"))
    wrong = got.filter(~F.col("got").eqNullSafe(F.col("want")) | ~F.col("short").eqNullSafe(F.col("bare")))
    assert [r.text for r in wrong.collect()] == [] and got.filter("got <> text").count() > 700


def test_markdown_counts_are_the_plain_ones(spark):
    rng = random.Random(9)
    mix = lambda: "".join(rng.choice(["# a\n", "\n## b", "#", "![x](y)", "[x](y)", "![", "](", "```", "z "]) for _ in range(rng.randint(0, 8)))
    rows = spark.createDataFrame([(mix(), mix()) for _ in range(400)] + [(None, "# a"), ("![x](y)", None)], "a string, b string")
    told = rows.select("a", "b", X.markdown_issues(F.col("a"), F.col("b"))["message"].alias("got"), *[F.struct(*[F.regexp_count(c, F.lit(p)).alias(c) for c in ("a", "b")]).alias(n) for n, p, _ in X.COUNTERS])
    for r in told.collect():
        assert r.got == [f"{n}: {r[n].a} -> {r[n].b}" for n, _, _ in X.COUNTERS if None not in tuple(r[n]) and r[n].a != r[n].b]


def test_a_text_is_lower_cased_once(spark):
    """Not once a term, where the terms are filtered."""
    terms = spark.createDataFrame([(0, "a", "x"), (1, "b", "y")], "pos int, term string, rendering string")
    plan = G.with_terms(spark.createDataFrame([(1, "É a")], "id int, text string"), terms, "id")._jdf.queryExecution().analyzed().toString().lower()
    assert "contains(" in plan and "contains(lower(" not in plan and "contains(coalesce(lower(" not in plan

"""Quality reports over large tables: what is looked for first, and on how many tasks."""

import random

import pytest
from pyspark.sql import functions as F

from lexweave.functions import repeats
from lexweave.functions import text as X
from lexweave.operators import glossary as G
from lexweave.plans.queries import QUERIES
from lexweave.tables import dealt

from .conftest import SF
from .test_loops import PLAIN_REPEAT, PLAIN_SPAN, prose, texts  # noqa: F401 a fixture


def test_the_look_hides_no_repeat(spark, texts):  # noqa: F811
    t = F.col("text")
    told = texts.select("text", repeats.looked(t, 5, 5, 30).alias("may"), t.rlike(PLAIN_REPEAT).alias("plain")).collect()
    assert [r.text for r in told if r.plain and not r.may] == [] and sum(r.plain for r in told) > 300
    odd = spark.createDataFrame([(None,), ("",), ("ab",)], "text string").select(repeats.looked(t, 5, 5, 30).alias("may")).union(spark.sql("select cast(repeat(x'ff6162636465', 5) as string) as text").select(repeats.looked(t, 5, 5, 30)))
    assert [r.may for r in odd.collect()] == [False, False, False, True]


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 17])
def test_the_look_finds_its_text(monkeypatch, block):
    """Wherever a repeat begins in a block, it is told of the text that has it, and of no other."""
    monkeypatch.setattr(repeats, "BLOCK", block)
    rng = random.Random(block)
    for p in range(5, 31):
        phrase = "".join(rng.sample("abcdefghijklmnopqrstuvwxyzéü译😀", p))
        rows = [prose(rng, rng.randint(0, 40)) for _ in range(4)]
        rows.insert(at := rng.randint(0, 4), prose(rng, rng.randint(0, 9)) + phrase * 5 + prose(rng, 2))
        assert repeats.may_repeat(rows, 5, 5, 30).tolist() == [k == at for k in range(5)]


def test_the_look_lets_prose_pass():
    rng = random.Random(3)
    assert repeats.may_repeat([prose(rng, 600) for _ in range(300)], 5, 5, 30).sum() < 3
    assert len(repeats.may_repeat([], 5, 5, 30)) == 0


@pytest.mark.parametrize("words", [1, 2, 4, 12])
def test_spans_of_any_number_of_words(spark, words):
    rng = random.Random(words)
    rows = [("".join(rng.choice(["ab", "x", " ", " ", "\n", " ", "  ", "é", "1", ". "]) for _ in range(rng.randint(0, 90))) + " a\t b" * rng.randint(0, 8) + rng.choice(["", "é", " "]),) for _ in range(400)]
    plain = PLAIN_SPAN.replace("{11,}", f"{{{words - 1},}}")
    got = spark.createDataFrame([*rows, (None,)], "text string").select(X.untranslated_span(F.col("text"), words).alias("got"), F.regexp_extract("text", plain, 0).alias("plain")).collect()
    assert [r for r in got if r.got != r.plain] == [] and sum(bool(r.got) for r in got) > 40


def test_renderings_count_whole_or_in_part(spark):
    rows = [(t, r) for t in ("a (b)", "a", "(b)", " (b) x", "", "b", None) for r in ("a (b)", " (b)", "  (b)", "a  (b) (c)", "b", "", "(b", " ", None)]
    whole, part = F.contains("t", F.col("r")), F.trim(F.split_part("r", F.lit(" ("), F.lit(1)))
    plain = ((part != "") & F.contains("t", part)) | whole
    got = spark.createDataFrame(rows, "t string, r string").select("t", "r", G._used(F.col("t"), F.col("r")).alias("got"), plain.alias("plain")).collect()
    assert [r for r in got if r.got != r.plain] == []


def test_a_file_is_dealt_to_all_cores(spark, tmp_path):
    """A table of one file is one task's; the texts of the report are then dealt out, those of many files stay where they are."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan(QUERIES["qa_report_by_lang"](spark, SF))
    spark.range(800).repartition(8).write.parquet(f"{tmp_path}/many")
    spark.range(800).coalesce(1).write.parquet(f"{tmp_path}/one")
    many, one = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("many", "one"))
    assert dealt(many) is many
    sizes = dealt(one).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 8 and sum(r["count"] for r in sizes) == 800

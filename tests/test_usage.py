"""Collectors tell what was asked, while plans run and without asking or reading again."""

import time

import pytest
from pyspark.sql import functions as F

from lexweave.operators import translate, usage
from lexweave.streaming import runs


class Counted:
    """Fails on 'bad', needs a second attempt on 'slow'; tells tokens for all but 'mute'."""

    def __init__(self, log):
        self.log = log

    def translate(self, prompt, text):
        with open(self.log, "a") as f:
            f.write(f"{text}\n")
        if text == "bad" or text == "slow" and open(self.log).read().count("slow") < 2:
            raise ValueError("no")
        if text == "mute":
            return "silent"
        return {"content": text.upper(), "usage_metadata": {"input_tokens": len(prompt), "output_tokens": len(text)}}


ROWS = [("p", "one"), ("pp", "three"), ("p", "bad"), ("ppp", "slow"), ("p", "mute")]
WANT = {"prompt_tokens": 6, "completion_tokens": 12, "total_tokens": 18, "call_count": 7, "rows": 5, "succeeded": 4}


def test_collector_tells_a_run_s_totals(spark, tmp_path):
    log = tmp_path / "log"
    collector = usage.UsageCollector()
    answers = collector.watch(translate.call_model(spark.createDataFrame(ROWS, "prompt string, text string").coalesce(1), Counted(str(log)), "translate", 1, 0.0))
    answers.write.parquet(str(tmp_path / "out"))
    assert collector.snapshot() == WANT and len(log.read_text().split()) == WANT["call_count"]
    told = spark.read.parquet(str(tmp_path / "out")).agg(F.sum("prompt_tokens"), F.sum("completion_tokens"), F.sum("tokens"), F.sum(1 + F.col("retry_count"))).first()
    assert list(told) == [WANT[c] for c in usage.COUNTS]
    # A second run adds to the first, and a collector that was reset begins anew.
    more = collector.watch(translate.call_model(spark.createDataFrame([("p", "x")], "prompt string, text string"), Counted(str(log)), "translate"))
    more.collect()
    assert collector.snapshot()["total_tokens"] == WANT["total_tokens"] + 2
    collector.reset()
    assert set(collector.snapshot().values()) == {0}


def test_an_empty_run_counts_nothing(spark, tmp_path):
    collector = usage.UsageCollector()
    collector.watch(translate.call_model(spark.createDataFrame([], "prompt string, text string"), Counted(str(tmp_path / "log")), "translate")).collect()
    assert set(collector.snapshot().values()) == {0}


def test_progress_is_told_batch_by_batch(spark, tmp_path):
    events = []
    listener = usage.ProgressListener("told", events.append)
    spark.streams.addListener(listener)
    try:
        rows = spark.createDataFrame([(i, "p", f"t{i}") for i in range(9)], "id long, prompt string, text string")

        def run(stream, root):
            answers = usage.watch_stream(translate.call_model(stream, translate.StubModel(), "translate"), "told")
            runs.append_run(answers, f"{root}/out", f"{root}/checkpoint")

        root = runs.fed_in_turns(rows, (F.col("id") / 3).cast("int"), 3, run, "usage-test")
        for _ in range(100):
            if listener.totals["rows"] == 9:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert [e["done"] for e in events] == [3, 6, 9] and [e["batch"] for e in events] == [0, 1, 2]
    assert listener.totals["call_count"] == 9 == spark.read.parquet(f"{root}/out").count()


@pytest.mark.parametrize(("provider", "messages", "want"), [
    ((5, 6, 20), [(1, 1, 2)], (5, 6, 20)),
    (None, [(1, 2, 3), (4, None, 4)], (5, 2, 7)),
    ((5, 6, 0), [(1, 2, None)], (6, 8, 14)),
    ((5, None, None), None, (5, 0, 5)),
    (None, None, (0, 0, 0)),
    (None, [], (0, 0, 0)),
])
def test_usage_of_a_call(spark, provider, messages, want):
    schema = "p struct<prompt_tokens:int,completion_tokens:int,total_tokens:int>, m array<struct<input_tokens:int,output_tokens:int,total_tokens:int>>"
    row = spark.createDataFrame([(provider, messages)], schema).select(usage.usage_of(F.col("p"), F.col("m")).alias("u")).first().u
    assert tuple(row) == want


def test_the_limiter_is_asked_once_a_call(spark, monkeypatch):
    import threading

    asked = []

    class Bucket:
        def __init__(self, *a):
            self.turn = threading.Lock()

        def acquire(self):
            asked.append(1)

    class Twice:
        n = 0

        def translate(self, prompt, text):
            Twice.n += 1
            if Twice.n % 2:
                raise ValueError("again")
            return "ok"

    monkeypatch.setattr(translate, "TokenBucket", Bucket)
    rows = spark.createDataFrame([("p", "a"), ("p", "b")], "prompt string, text string")
    frames = []
    # The function that workers run, called here.
    monkeypatch.setattr(type(rows), "mapInPandas", lambda self, work, schema: frames.append(work))
    translate.call_model(rows, Twice(), "translate", 1, 0.0, translate.Limits(1, 60))
    import pandas as pd

    out = next(frames[0](iter([pd.DataFrame({"prompt": ["p", "p"], "text": ["a", "b"]})])))
    assert out["retry_count"].tolist() == [1, 1] and len(asked) == 2


def test_the_failing_model_of_model_calls_keeps_nothing_of_what_it_answered():
    """A task's model is asked of every row of its share, so what it remembers of each would grow with the input."""
    from lexweave.plans.queries import FlakyModel

    model = FlakyModel()
    for n in range(300):
        tries = 0
        for tries in range(3):
            try:
                assert model.translate(str(n % 3), f"t{n}")[0] == f"T{n}" and n % 3 == tries
                break
            except ValueError:
                assert tries < (n % 3 or 0) + (n % 3 == 2)
    assert not any(vars(model).values())

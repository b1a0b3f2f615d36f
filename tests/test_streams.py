"""Streams with keyed state: runs that restart at their checkpoint give what a plain loop over all rows gives."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from lexweave.operators import tasks
from lexweave.streaming import ordered, queue, runs, watch

DAY = dt.datetime(2024, 5, 1)
EVENTS = "task_id long, event_id long, ts timestamp, total long, kind string"


def plain_watch(rows, stale):
    """(task, event, ts, status, current, total known) in the order that a clock would tell them; every task's quiet times included."""
    clock = max(r[2] for r in rows if r[0] is not None and r[2] is not None)
    by_task = defaultdict(list)
    for r in rows:
        if r[0] is not None and r[2] is not None:
            by_task[r[0]].append(r)
    out = []
    for task, own in by_task.items():
        cut = min((r[2] for r in own if r[4] == "cancel"), default=None)
        events = sorted((r for r in own if r[4] == "event" and (cut is None or r[2] <= cut)), key=lambda r: (r[2], r[1]))
        total = None
        for n, r in enumerate(events, 1):
            total = r[3] if r[3] is not None else total
            out.append((task, r[1], r[2], "processing", n, total))
            due = r[2] + dt.timedelta(seconds=stale)
            if due < (events[n][2] if n < len(events) else cut if cut is not None else clock):
                out.append((task, None, due, "pending", n, total))
        if cut is not None:
            out.append((task, None, cut, "cancelled", len(events), total))
    return sorted(out, key=str)


def watched(spark, rows, turns, stale=900):
    frame = spark.createDataFrame(rows, EVENTS)

    def run(stream, root):
        told = watch.watch_tasks(stream.filter("kind = 'event'"), stream.filter("kind = 'cancel'"), stale)
        runs.append_run(told, f"{root}/out", f"{root}/checkpoint")

    root = runs.fed_in_turns(frame, runs.time_portion(frame, "ts", turns), turns, run, "watch-test")
    return spark.read.parquet(f"{root}/out")


@pytest.mark.parametrize("turns", [1, 4])
def test_watched_tasks_are_those_of_a_plain_loop(spark, turns):
    rng = random.Random(turns)
    rows = [(None, 1, DAY, 5, "event"), (3, 2, None, 5, "event"), (40, None, DAY, None, "cancel"), (40, 9, DAY, 7, "event"), (40, 10, DAY + dt.timedelta(seconds=1), 7, "event")]
    for i in range(300):
        # Task 0 has a third of all events; times leave room for quiet spells.
        task = 0 if rng.random() < 0.33 else rng.randint(1, 12)
        kind = "cancel" if i > 150 and rng.random() < 0.02 else "event"
        rows.append((task, 100 + i if kind == "event" else None, DAY + dt.timedelta(seconds=rng.randint(0, 20_000), microseconds=rng.randint(0, 999_999)), rng.choice([None, 50, 60]) if kind == "event" else None, kind))
    rows.append((99, 1, DAY + dt.timedelta(days=1), 2, "event"))
    got = watched(spark, rows, turns).collect()
    want = plain_watch(rows, 900)
    assert sorted(((r.task_id, r.event_id, r.ts, r.status, r.current) for r in got), key=str) == [w[:5] for w in want]
    totals = {(w[0], w[1], w[2], w[3]): w[5] for w in want}
    for r in got:
        total = totals[r.task_id, r.event_id, r.ts, r.status]
        assert r.percentage == (None if total is None else pytest.approx(r.current * 100 / total, abs=0.01))
        assert r.error == {"processing": None, "pending": tasks.REQUEUED, "cancelled": tasks.CANCELLED}[r.status]
    assert {r.status for r in got} == {"processing", "pending", "cancelled"}


def test_stream_and_batch_tell_the_same_progress(spark):
    rng = random.Random(8)
    rows = [(rng.randint(0, 5), i, DAY + dt.timedelta(seconds=rng.randint(0, 500)), 40, "event") for i in range(120)]
    columns = ["task_id", "event_id", "current", "percentage", "elapsed", "speed", "eta_minutes"]
    batch = tasks.progress(spark.createDataFrame(rows, EVENTS)).select(*columns)
    stream = watched(spark, rows, 3).filter("status = 'processing'").select(*columns)
    assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, batch.collect()))


def test_a_timer_puts_a_task_back_once_and_its_next_event_takes_it_up(spark):
    at = lambda s: DAY + dt.timedelta(seconds=s)
    # Task 1 falls quiet; the clock of task 2 goes on, run by run.
    rows = [(1, 1, at(0), 9, "event"), (2, 2, at(10), 9, "event"), (2, 3, at(2000), 9, "event"), (2, 4, at(4000), 9, "event"), (1, 5, at(5000), 9, "event"), (2, 6, at(5001), 9, "event")]
    got = watched(spark, rows, 6).filter("task_id = 1").orderBy("ts", "status").select("ts", "status", "current").collect()
    assert [tuple(r) for r in got] == [(at(0), "processing", 1), (at(900), "pending", 1), (at(5000), "processing", 2)]


def test_nothing_of_a_cancelled_task_comes_afterwards(spark):
    at = lambda s: DAY + dt.timedelta(seconds=s)
    rows = [(1, 1, at(0), 9, "event"), (1, None, at(5), None, "cancel"), (1, None, at(6), None, "cancel"), (1, 2, at(7), 9, "event"), (1, 3, at(100), 9, "event"), (2, 4, at(9000), 9, "event")]
    for turns in (1, 5):
        got = watched(spark, rows, turns).filter("task_id = 1").orderBy("ts").select("ts", "status").collect()
        assert [tuple(r) for r in got] == [(at(0), "processing"), (at(5), "cancelled")]


@pytest.mark.parametrize("turns", [1, 4])
def test_ordered_sink_writes_each_part_once(spark, turns):
    rng = random.Random(turns)
    rows = [(None, 0, "x"), (1, None, "x")]
    for doc in range(12):
        n = 60 if doc == 0 else rng.randint(0, 12)
        have = [i for i in range(3, 3 + n) if rng.random() < 0.9 or doc == 0]
        rows += [(doc, i, f"{doc}.{i} " + "long " * (20_000 if doc == 0 and i == 5 else 0)) for i in have] + [(doc, 1, "below start")]
    rows += [(0, 7, "0.7 ")]  # repeated
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc long, idx int, content string").withColumn("buffer_size", F.lit("b"))

    def run(stream, root):
        ordered.write_in_order(stream, f"{root}/parts", f"{root}/checkpoint", start=3)
        ordered.write_in_order(stream, f"{root}/parts", f"{root}/checkpoint", start=3)  # nothing new: nothing is written again

    root = runs.fed_in_turns(frame, F.pmod(F.xxhash64("doc", "idx"), F.lit(turns)), turns, run, "ordered-test")
    parts = ordered.written_parts(spark, f"{root}/parts")
    want = [tuple(r) for r in ordered.emitted_prefix(frame.filter("doc is not null and idx is not null").select("doc", "idx", "content"), 3).select("doc", "idx", "content").collect()]
    assert sorted(map(tuple, parts.select("doc", "idx", "content").collect())) == sorted(want)
    written, held = defaultdict(int), defaultdict(set)
    for doc, *_ in want:
        written[doc] += 1
    for doc, i, _ in rows:
        if doc is not None and i is not None and i >= 3 + written[doc]:
            held[doc].add(i)
    for r in ordered.counters(spark, f"{root}/parts").collect():
        assert (r.written_count, r.buffer_size) == (written[r.doc], len(held[r.doc]))
    # A part is never written before one of a smaller index.
    last = {}
    for r in parts.orderBy("doc", "idx").collect():
        assert last.get(r.doc, 0) <= r.batch
        last[r.doc] = r.batch


def test_an_empty_folder_gives_no_rows(spark):
    none = spark.createDataFrame([], EVENTS)
    root = runs.fed_in_turns(none, F.lit(0), 1, lambda s, root: runs.append_run(watch.watch_tasks(s), f"{root}/out", f"{root}/checkpoint"), "watch-test")
    assert spark.read.schema("task_id long").parquet(f"{root}/out").count() == 0


def worked(spark, root, turns, handle, cancelled=None):
    for names in turns:
        spark.createDataFrame([(n, f"{n}.md") for n in names], "task_id string, filename string").write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema("task_id string, filename string").parquet(f"{root}/in")
        queue.work_off(stream, handle, f"{root}/out", f"{root}/checkpoint", cancelled)
    return {r.task_id: (r.status, r.result_url, r.error) for r in queue.outcomes(spark, f"{root}/out").collect()}


def test_queue_hands_out_each_task_once(spark, tmp_path):
    seen = []

    def handle(claimed):
        seen.append(sorted(r.task_id for r in claimed.collect()))
        return claimed.filter("task_id <> 'lost'").select("task_id", F.lit("completed").alias("status"), F.concat(F.lit("/"), "filename").alias("result_url"))

    got = worked(spark, f"file://{tmp_path}", [["a", "b", "a", None, "lost"], ["b", "c"], ["a"]], handle)
    assert [s for s in seen if s] == [["a", "b", "lost"], ["c"]]
    assert got == {**{n: ("completed", f"/{n}.md", None) for n in "abc"}, "lost": ("failed", None, None)}


def test_a_task_cancelled_before_or_while_it_is_worked_on_stays_so(spark, tmp_path):
    gone, seen = ["early"], []

    def handle(claimed):
        seen.extend(r.task_id for r in claimed.collect())
        gone.append("meanwhile")
        return claimed.select("task_id", F.lit("completed").alias("status"))

    got = worked(spark, f"file://{tmp_path}", [["early", "meanwhile", "other"]], handle, lambda: spark.createDataFrame([(g,) for g in gone], "task_id string"))
    assert sorted(seen) == ["meanwhile", "other"]
    assert {k: v[0] for k, v in got.items()} == {"early": "cancelled", "meanwhile": "cancelled", "other": "completed"}
    assert got["meanwhile"] == ("cancelled", None, tasks.CANCELLED)


def test_a_batch_that_failed_is_claimed_again(spark, tmp_path):
    failures = ["x"]

    def handle(claimed):
        if failures:
            failures.pop()
            raise ValueError("worker lost")
        return claimed.select("task_id", F.lit("completed").alias("status"))

    with pytest.raises(StreamingQueryException):
        worked(spark, f"file://{tmp_path}", [["a", "b"]], handle)
    got = worked(spark, f"file://{tmp_path}", [["c"]], handle)
    assert {k: v[0] for k, v in got.items()} == dict.fromkeys("abc", "completed")


class Counted:
    """A state that counts the calls it gets: each is a message between Spark and its worker."""

    def __init__(self):
        self.calls, self.values, self.timers = [], {}, set()

    def getValueState(self, name, schema):
        return self

    def getMapState(self, name, keys, values):
        return self

    def __getattr__(self, name):
        act = {
            "get": lambda: self.values.get(None), "update": lambda v: self.values.update({None: v}), "exists": lambda: None in self.values,
            "containsKey": lambda k: k in self.values, "getValue": lambda k: self.values.get(k), "updateValue": lambda k, v: self.values.update({k: v}), "removeKey": lambda k: self.values.pop(k),
            "registerTimer": lambda at: self.timers.add(at), "deleteTimer": lambda at: self.timers.remove(at), "listTimers": lambda: iter(self.timers),
        }[name]
        return lambda *a: (self.calls.append(name), act(*a))[1]


def test_a_document_asks_its_state_no_more_than_it_must():
    from pyspark.sql import Row

    from lexweave.streaming import ordered

    held, emitter = Counted(), ordered.Emitter(0)
    emitter.init(held)
    feed = lambda *idx: [(r.idx, r.content, r.written_count, r.buffer_size) for r in emitter.handleInputRows((7,), iter([Row(idx=i, content=f"c{i}") for i in idx]), None)]
    assert feed(3, 1, 3) == [(None, None, 0, 2)] and held.calls == ["get", "updateValue", "updateValue", "update"]
    held.calls.clear()
    assert feed(0, 3) == [(0, "c0", 1, 0), (1, "c1", 2, 0), (None, None, 2, 1)]
    assert feed(2) == [(2, "c2", 3, 0), (3, "c3", 4, 0), (None, None, 4, 0)]


def test_a_task_asks_its_state_no_more_than_it_must():
    from pyspark.sql import Row

    from lexweave.streaming import watch

    state, watcher = Counted(), watch.Watcher(900)
    watcher.init(state)
    feed = lambda *us: [(r.event_id, r.us, r.status, r.current) for r in watcher.handleInputRows((7,), iter([Row(event_id=u, us=u, total=5, kind=watch.EVENT) for u in us]), None)]
    assert feed(2_000_000, 1_000_000) == [(1_000_000, 1_000_000, "processing", 1), (2_000_000, 2_000_000, "processing", 2)]
    assert state.calls == ["get", "update", "registerTimer"] and state.timers == {902_000}
    state.calls.clear()
    assert feed(902_000_001) == [(watch.NO_ID, 902_000_000, "pending", 2), (902_000_001, 902_000_001, "processing", 3)]
    assert state.calls == ["get", "update", "deleteTimer", "registerTimer"] and state.timers == {1_802_001}

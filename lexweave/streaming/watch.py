"""Tasks watched as a stream: their progress, their staleness and their cancellation, in keyed state.

One value a task is kept: how many events came, the first and the last one's time, whether it was put back or cancelled. A timer of
event time runs from each task's last event; when the watermark passes it, the task goes back into the queue. A cancellation is an
event of the same stream, so from where it comes on nothing of the task is emitted any more.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lexweave.operators import tasks
from lexweave.shipping import ship

STATE = "current long, total long, first long, last long, back boolean, cancelled long"
EVENT, CANCEL = 0, 1
#: Stand for null in columns that have to stay whole numbers on their way through Python.
NO_ID, NO_TOTAL = -(1 << 63), -1
OUT = "task_id long, event_id long, us long, status string, current long, total long, first long, error string"
TOLD = Row("task_id", "event_id", "us", "status", "current", "total", "first", "error")


class Watcher(StatefulProcessor):
    """Rows (task_id, event_id, ts, total, kind) of a micro-batch -> rows OUT; `stale_after` in seconds."""

    def __init__(self, stale_after: int):
        self.stale = stale_after * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("task", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # One call to the state tells whether there is one; rows stay rows, as a frame a task costs more than its few rows.
        current, total, first, last, back, cancelled = self.state.get() or (0, NO_TOTAL, None, None, False, None)
        if cancelled is not None:
            return
        own, calls = [], []
        for r in rows:
            if r.kind == EVENT:
                own.append((r.us, r.event_id, r.total))
            else:
                calls.append(r.us)
        own.sort(key=lambda e: e[:2])
        cancelled = min(calls) if calls else None
        timer = None if last is None or back else _expiry(last + self.stale)
        for us, event, given in own:
            if cancelled is not None and us > cancelled:
                break
            first = us if first is None else first
            # Where the next event is later than a timer would have run out, it has run out, whichever batch the event is in.
            if last is not None and not back and us - last > self.stale:
                yield _row(key[0], NO_ID, last + self.stale, "pending", current, total, first, tasks.REQUEUED)
            current, last, back, total = current + 1, us, False, total if given == NO_TOTAL else given
            yield _row(key[0], event, us, "processing", current, total, first, None)
        if cancelled is not None:
            if last is not None and not back and cancelled - last > self.stale:
                yield _row(key[0], NO_ID, last + self.stale, "pending", current, total, first, tasks.REQUEUED)
            yield _row(key[0], NO_ID, cancelled, "cancelled", current, total, first, tasks.CANCELLED)
        self.state.update((current, total, first, last, back, cancelled))
        following = _expiry(last + self.stale) if cancelled is None and last is not None and not back else None
        if timer != following:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if following is not None:
                self.handle.registerTimer(following)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        current, total, first, last, back, cancelled = self.state.get()
        if back or cancelled is not None or last is None:
            return
        self.state.update((current, total, first, last, True, None))
        yield _row(key[0], NO_ID, last + self.stale, "pending", current, total, first, tasks.REQUEUED)


def _expiry(us: int) -> int:
    """A timer's milliseconds."""
    return -(-us // 1000)


def _row(*values) -> Row:
    return TOLD(*values)


def watch_tasks(events: DataFrame, cancellations: DataFrame | None = None, stale_after: int = 900, delay: str = "0 seconds") -> DataFrame:
    """Streams events(task_id, event_id, ts, total) and cancellations(task_id, ts) -> a stream of what happens to tasks.

    A row each event (status processing), each time a task has been quiet for `stale_after` seconds (pending, with the error that
    operators.tasks tells) and each cancellation (cancelled, once a task): task_id, event_id (null but for events), ts, status,
    current, percentage, elapsed, speed, eta_minutes, error. Counts go on after a task was put back. Events that come after a
    cancellation, in the stream or by their time, give nothing; those of its very time still count. Events of a micro-batch are taken
    by time, then event_id, so events should come in time order from batch to batch; what is later than the watermark by over
    `delay` is dropped by Spark. Rows of a null task or time are left out; a null total is the task's last one known;
    a null event_id stays null.
    Other columns are ignored. A task's times in one micro-batch are held together: bound batches by maxBytesPerTrigger.
    """
    ship(events.sparkSession)
    slim = lambda df, kind, *cols: df.filter("task_id is not null and ts is not null").select(F.col("task_id").cast("long").alias("task_id"), *cols, F.col("ts").cast("timestamp").alias("ts"), F.lit(kind).alias("kind"))
    held = lambda c, none: F.coalesce(c.cast("long"), F.lit(none))
    rows = slim(events, EVENT, held(F.col("event_id"), NO_ID).alias("event_id"), held(F.col("total"), NO_TOTAL).alias("total"))
    if cancellations is not None:
        rows = rows.unionByName(slim(cancellations, CANCEL, F.lit(NO_ID).alias("event_id"), F.lit(NO_TOTAL).cast("long").alias("total")))
    rows = rows.withColumn("us", F.unix_micros("ts")).withWatermark("ts", delay)
    told = rows.groupBy("task_id").transformWithState(Watcher(stale_after), OUT, "Append", "EventTime")
    told = told.withColumns({"ts": F.timestamp_micros("us"), "first": F.timestamp_micros("first"), "event_id": F.nullif(F.col("event_id"), F.lit(NO_ID)), "total": F.nullif(F.col("total"), F.lit(NO_TOTAL).cast("long"))})
    return tasks.rates(told, F.col("first")).select("task_id", "event_id", "ts", "status", "current", "percentage", "elapsed", "speed", "eta_minutes", "error")

"""What model calls cost, gathered while plans run: observed metrics of batches, and of each micro-batch of a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

#: Names of what a collector tells (fixed values).
COUNTS = ("prompt_tokens", "completion_tokens", "total_tokens", "call_count")


def usage_of(provider: Column, messages: Column) -> Column:
    """struct of the first three COUNTS for one call.

    provider struct<prompt_tokens, completion_tokens, total_tokens>: what the provider tells of the whole call. Where that has no total,
    messages array<struct<input_tokens, output_tokens, total_tokens>> are added up; where they have none either, it is prompt and
    completion tokens together. Nulls, in either or of them, count as 0.
    """
    told = lambda field: F.coalesce(provider[field].cast("long"), F.lit(0).cast("long"))
    added = lambda field: F.coalesce(F.aggregate(messages, F.lit(0).cast("long"), lambda a, m: a + F.coalesce(m[field].cast("long"), F.lit(0).cast("long"))), F.lit(0).cast("long"))
    silent = told("total_tokens") == 0
    prompt = told("prompt_tokens") + F.when(silent, added("input_tokens")).otherwise(0)
    completion = told("completion_tokens") + F.when(silent, added("output_tokens")).otherwise(0)
    total = F.when(~silent, told("total_tokens")).otherwise(added("total_tokens"))
    return F.struct(prompt.alias("prompt_tokens"), completion.alias("completion_tokens"), F.when(total == 0, prompt + completion).otherwise(total).alias("total_tokens"))


def _metrics() -> list[Column]:
    """Sums over answers; a row stands for as many calls as it took attempts."""
    known = lambda c: F.coalesce(F.sum(F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long"))), F.lit(0).cast("long"))
    return [known("prompt_tokens").alias("prompt_tokens"), known("completion_tokens").alias("completion_tokens"), known("tokens").alias("total_tokens"), F.coalesce(F.sum(F.col("retry_count") + 1), F.lit(0)).cast("long").alias("call_count"), F.count(F.lit(1)).alias("rows"), F.count_if("success").alias("succeeded")]


class UsageCollector:
    """Adds up the calls of every answers frame that went through watch(), once each was run; asks no model and reads nothing again.

    Spark tells observed metrics of an action once, when it succeeds, so what a retried task or a lost executor did twice counts once.
    """

    def __init__(self) -> None:
        self._seen: list[Observation] = []

    def watch(self, answers: DataFrame) -> DataFrame:
        """answers as translate.call_model() gives them; the same rows. The first action on them counts."""
        seen = Observation()
        self._seen.append(seen)
        return answers.observe(seen, *_metrics())

    def snapshot(self) -> dict[str, int]:
        """COUNTS, and rows and succeeded, of what was watched since the last reset; waits for actions that are under way."""
        told = [seen.get for seen in self._seen]
        return {name: sum(t.get(name) or 0 for t in told) for name in (*COUNTS, "rows", "succeeded")}

    def reset(self) -> None:
        self._seen.clear()


class ProgressListener(StreamingQueryListener):
    """Calls back after every micro-batch of the streams that watch_stream() marked with this name, while they run.

    The callback gets a dict: batch, COUNTS, rows and succeeded of the batch, and done: all rows so far. `totals` has the sums so far.
    """

    def __init__(self, name: str, callback: Callable[[dict], None] = lambda event: None):
        self.name, self.callback = name, callback
        self.totals = dict.fromkeys((*COUNTS, "rows", "succeeded"), 0)
        self._batches: set[tuple[str, int]] = set()

    def onQueryStarted(self, event) -> None: ...

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        told = event.progress.observedMetrics.get(self.name)
        batch = (str(event.progress.id), event.progress.batchId)
        if told is None or batch in self._batches:
            return
        self._batches.add(batch)
        counts = {k: v or 0 for k, v in told.asDict().items()}
        if not counts["rows"]:
            return
        for k, v in counts.items():
            self.totals[k] += v
        self.callback({"batch": event.progress.batchId, **counts, "done": self.totals["rows"]})


def watch_stream(answers: DataFrame, name: str) -> DataFrame:
    """A stream of answers whose micro-batches tell their counts to the ProgressListener of this name."""
    return answers.observe(name, *_metrics())

"""Chunks through a pluggable model: prompt, call with retries, cleaning, validation, bounded repair.

The model is the only part that isn't declarative. It sees Arrow batches, several of whose rows are asked at once; a call that
fails makes a row that says so and never fails the task. Cached chunks are split off by a join before, so the model is not called for
them. Limits hold for the whole cluster: rows are dealt to no more tasks than calls may be in flight, and each task keeps its share of the rate.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexweave.functions import text as X
from lexweave.shipping import ship
from lexweave.tables import written

from . import glossary as G


class TextModel(Protocol):
    def translate(self, prompt: str, text: str) -> str: ...

    def repair(self, prompt: str, text: str) -> str: ...


class StubModel:
    """Deterministic: a fixed mark before the text; repairs give a fixed sentence."""

    def translate(self, prompt: str, text: str) -> str:
        return f"译文：{text}"

    def repair(self, prompt: str, text: str) -> str:
        return "修复后的译文"


def prompt_text(section: Column, context: Column, terms: Column) -> Column:
    """terms: array<struct<term, rendering>>, in glossary order."""
    lines = F.array_join(F.transform(terms, lambda t: F.concat(F.lit("- "), t["term"], F.lit(": "), t["rendering"])), "\n")
    return F.concat_ws("\n\n", F.concat(F.lit("Section: "), section), F.nullif(context, F.lit("")), F.nullif(lines, F.lit("")))


@dataclass(frozen=True)
class Limits:
    """What all tasks together may do: calls in flight, and calls per minute (None: no rate)."""

    in_flight: int = 10
    per_minute: float | None = 200


class TokenBucket:
    """At most `rate` calls at once and per `per` seconds on average; threads that ask wait their turn."""

    def __init__(self, rate: float, per: float = 60.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.per, self.clock, self.sleep = rate, per, clock, sleep
        self.most = max(rate, 1.0)  # a share below one call still lets one through
        self.level, self.last, self.turn = self.most, clock(), threading.Lock()

    def acquire(self) -> None:
        with self.turn:
            now = self.clock()
            self.level, self.last = min(self.most, self.level + (now - self.last) * self.rate / self.per), now
            if self.level < 1:
                self.sleep((1 - self.level) * self.per / self.rate)
                # What came in while it slept is spent.
                self.level, self.last = 0.0, self.clock()
            else:
                self.level -= 1


def dealt(rows: DataFrame, limits: Limits | None) -> tuple[DataFrame, int, float | None]:
    """(rows in as many tasks as may call at once, calls in flight a task, calls per minute a task)."""
    if limits is None:
        return rows, 1, None
    tasks = max(1, min(limits.in_flight, rows.sparkSession.sparkContext.defaultParallelism))
    return rows.repartition(tasks, F.xxhash64("prompt", "text")), max(1, limits.in_flight // tasks), limits.per_minute and limits.per_minute / tasks


def said_text(answer: object) -> tuple[str, int | None]:
    """(text, tokens) of what a model gave; see said()."""
    text, _, _, tokens = said(answer)
    return text, tokens


def said(answer: object) -> tuple[str, int | None, int | None, int | None]:
    """(text, prompt tokens, completion tokens, all tokens) of what a model gave: a string, an object or mapping with `content`, a list of
    parts, or a tuple of text and token counts.

    Tokens are the total that it tells (usage_metadata or usage: total_tokens), else input and output ones, else unknown.
    """
    if isinstance(answer, tuple):
        counts = [*answer[1:3], None, None][:2]
        return str(answer[0]), *counts, sum(answer[1:])
    get = lambda o, name: o.get(name) if isinstance(o, dict) else getattr(o, name, None)
    content = answer if isinstance(answer, str | list) or get(answer, "content") is None else get(answer, "content")
    text = "".join(p if isinstance(p, str) else str(get(p, "text") or "") for p in content) if isinstance(content, list) else str(content)
    usage = None if isinstance(answer, str | list) else get(answer, "usage_metadata") or get(answer, "usage")
    if not usage:
        return text, None, None, None
    parts = [int(get(usage, a) or get(usage, b) or 0) for a, b in (("input_tokens", "prompt_tokens"), ("output_tokens", "completion_tokens"))]
    return text, *parts, int(get(usage, "total_tokens") or sum(parts))


def call_model(rows: DataFrame, model: TextModel, method: str, retries: int = 2, pause: float = 1.0, limits: Limits | None = None) -> DataFrame:
    """rows(prompt, text, ...) with answer, success, retry_count, duration (seconds), tokens, prompt_tokens, completion_tokens.

    Waits pause * 2**k between attempts. limits: see Limits, a row's attempts together wait for their turn once; without, a task asks one
    row at a time and as fast as the model answers. Tokens are null where the answer doesn't tell them (said). Also for streams, without limits.
    """
    ship(rows.sparkSession)
    names = [f.name for f in rows.schema.fields]
    rows, at_once, per_minute = dealt(rows, limits)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = getattr(model, method, None)
        bucket = TokenBucket(per_minute) if per_minute else None

        def one(prompt: str, text: str) -> tuple[str, bool, int, float, int | None, int | None, int | None]:
            began, answer = time.monotonic(), ""
            if bucket:
                bucket.acquire()
            for k in range(retries + 1):
                try:
                    answer, asked, given, tokens = said(ask(prompt, text))
                    return answer, True, k, time.monotonic() - began, tokens, asked, given
                except Exception as e:  # noqa: BLE001 any failure of a model is a row's failure
                    answer = f"[翻译失败: {e}]"
                    if k < retries and pause:
                        time.sleep(pause * 2**k)
            return answer, False, retries, time.monotonic() - began, None, None, None

        with ThreadPoolExecutor(at_once) as pool:
            for frame in frames:
                pairs = zip(frame["prompt"], frame["text"], strict=True)
                told = list(pool.map(lambda p: one(*p), pairs) if at_once > 1 else (one(*p) for p in pairs))
                yield frame[names].assign(**{c: pd.Series([t[i] for t in told], index=frame.index, dtype=t) for i, (c, t, _) in enumerate(ADDED)})

    return rows.mapInPandas(work, T.StructType([*rows.schema.fields, *(T.StructField(c, t) for c, _, t in ADDED)]))


#: Columns that a call adds, with their types in pandas and Spark.
ADDED = [("answer", "object", T.StringType()), ("success", "bool", T.BooleanType()), ("retry_count", "int32", T.IntegerType()), ("duration", "float64", T.DoubleType()), *((c, "Int64", T.LongType()) for c in ("tokens", "prompt_tokens", "completion_tokens"))]


def repair_text(original: Column, translation: Column, issues: Column, terms: Column, section: Column) -> Column:
    """What a checker is told by default: the text, its translation, what is wrong with it, and the terms."""
    told = F.array_join(F.transform(issues, lambda i: F.concat(F.lit("- "), i["message"])), "\n")
    lines = F.array_join(F.transform(terms, lambda t: F.concat(F.lit("- "), t["term"], F.lit(": "), t["rendering"])), "\n")
    return F.concat_ws("\n\n", F.concat(F.lit("Section: "), section), original, translation, told, F.nullif(lines, F.lit("")))


TERMS = "array<struct<pos:int,term:string,rendering:string>>"


def translate_chunks(
    chunks: DataFrame,
    glossary: DataFrame,
    model: TextModel | None = None,
    attempts: int = 1,
    retries: int = 2,
    pause: float = 0.0,
    prompt: Callable[[Column, Column, Column], Column] = prompt_text,
    max_checks: int = 25,
    repair: Callable[[Column, Column, Column, Column, Column], Column] = repair_text,
    checker: TextModel | None = None,
    qa: bool = True,
    limits: Limits | None = None,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """chunks(chunk_id, text, section_title, context_text, [section_path]) -> chunk_id, original, translation, success, retry_count, duration, tokens, issues, passed, repaired.

    `prompt` and `repair` may use the chunks' other columns; those of `carry` come along. `checker` repairs (default: the model itself). Without `qa` every
    translation passes as it is. A chunk whose first report asks for it is repaired up to `attempts` times, until it passes; an
    answer that isn't worse replaces it, and a call that fails leaves it. Answers are written as they come, so that no plan over
    them asks the model again; the calls run when this is called.
    """
    model = model or StubModel()
    section = X.breadcrumb(F.col("section_path")) if "section_path" in chunks.columns else F.col("section_title")
    rows = G.with_terms(chunks, glossary, "chunk_id", "text", "context_text").withColumns({"terms": F.col("terms").cast(TERMS), "section": section})
    rows = rows.withColumn("prompt", prompt(F.col("section"), F.col("context_text"), F.col("terms")))
    told = written(call_model(rows.select("chunk_id", "text", "prompt", "terms", "section", *carry), model, "translate", retries, pause, limits).drop("prompt"), "answers")
    told = told.withColumn("translation", F.when(F.col("success"), X.clean_output(F.col("answer"))).otherwise(F.col("answer")))
    done = told.select("chunk_id", F.col("text").alias("original"), "translation", "success", "retry_count", "duration", "tokens", "terms", "section", F.lit(False).alias("repaired"), *carry)
    if not qa:
        return done.drop("terms", "section").withColumns({"issues": F.array().cast(f"array<{X.ISSUE}>"), "issue_count": F.lit(0), "passed": F.lit(True)})
    done = G.quality_reports(done, glossary, "chunk_id", max_checks=max_checks).withColumn("wanted", F.col("success") & X.should_repair(F.col("issues")))
    done = written(done, "reports") if attempts else done
    for _ in range(attempts):
        # Only rows that need it reach the model: a filter, then the call, then a union.
        need = F.col("wanted") & ~F.col("passed")
        asked = done.filter(need).withColumn("prompt", repair(F.col("original"), F.col("translation"), F.col("issues"), F.col("terms"), F.col("section"))).withColumnRenamed("translation", "text")
        asked = asked.withColumnsRenamed({c: f"old_{c}" for c in ("success", "retry_count", "duration", "tokens", "issues", "issue_count", "passed")})
        fixed = written(call_model(asked, checker or model, "repair", retries, pause, limits).drop("prompt").withColumnRenamed("text", "old_translation"), "repairs")
        fixed = fixed.withColumn("translation", F.when(F.col("success"), X.clean_output(F.col("answer"))).otherwise(F.col("old_translation")))
        fixed = G.quality_reports(fixed, glossary, "chunk_id", max_checks=max_checks)
        better = F.col("success") & X.is_better(F.col("issues"), F.col("old_issues"))
        chosen = F.when(better, F.col("issues")).otherwise(F.col("old_issues"))
        fixed = fixed.select(
            "chunk_id", "original", F.when(better, F.col("translation")).otherwise(F.col("old_translation")).alias("translation"), F.col("old_success").alias("success"), F.col("old_retry_count").alias("retry_count"),
            (F.col("old_duration") + F.col("duration")).alias("duration"), F.when(F.col("old_tokens").isNotNull() | F.col("tokens").isNotNull(), F.coalesce("old_tokens", F.lit(0)) + F.coalesce("tokens", F.lit(0))).alias("tokens"),
            "terms", "section", (F.col("repaired") | better).alias("repaired"), chosen.alias("issues"), "wanted", *carry,
        )
        fixed = fixed.withColumn("issue_count", F.size("issues")).withColumn("passed", F.col("issue_count") == 0)
        done = done.filter(~need).unionByName(fixed)
    return done.drop("terms", "section", "wanted")

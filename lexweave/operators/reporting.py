"""Figures of runs and evaluations, and the texts that report them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The three comparisons and their variants, in order (fixed values).
COMPARISONS = [("engine", "graph"), ("engine", "native"), ("roles", "on"), ("roles", "off"), ("glossary", "on"), ("glossary", "off")]


def run_summary(results: DataFrame, key: str) -> DataFrame:
    """results(key, success, repaired, cached, duration) -> counts, seconds and chunks a minute (0 where no time has passed)."""
    flag = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    g = results.groupBy(key).agg(F.count("*").alias("chunks"), flag("success").alias("completed"), flag("repaired").alias("repaired"), flag("cached").alias("cached"), F.sum("duration").alias("seconds"))
    speed = F.when(F.col("seconds") > 0, F.round(F.col("chunks") * 60 / F.col("seconds"), 1)).otherwise(0.0)
    return g.select(key, "chunks", "completed", (F.col("chunks") - F.col("completed")).alias("failed"), "repaired", "cached", speed.alias("per_minute"))


def measures(calls: DataFrame) -> DataFrame:
    """calls(variant, sample_id, began, ended, usage tokens) -> latency_s by the clock, total_tokens, calls of each variant and sample."""
    seconds = (F.unix_micros(F.max("ended")) - F.unix_micros(F.min("began"))) / 1e6
    return calls.groupBy("variant", "sample_id").agg(F.round(seconds, 3).alias("latency_s"), F.sum(tokens_of()).alias("total_tokens"), F.count("*").alias("calls"))


def tokens_of() -> Column:
    """A call's tokens: the total a provider tells, else prompt and completion; what is missing counts 0."""
    zero = F.lit(0).cast("long")
    return F.coalesce(F.col("total").cast("long"), F.coalesce(F.col("prompt_tokens").cast("long"), zero) + F.coalesce(F.col("completion_tokens").cast("long"), zero))


def cost(measured: DataFrame, judged: DataFrame) -> DataFrame:
    """Tokens and calls of contestants and of the judge together."""
    both = measured.select("total_tokens", "calls").unionByName(judged.select("total_tokens", "calls"))
    return both.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("total_tokens", "calls")])


def variant_runs(samples: DataFrame) -> DataFrame:
    """Every sample under every variant: six rows a sample, without a join."""
    variants = F.array(*[F.struct(F.lit(n).alias("ordinal"), F.lit(c).alias("comparison"), F.lit(v).alias("variant")) for n, (c, v) in enumerate(COMPARISONS)])
    return samples.select("*", F.inline(variants))


def variant_line(label: Column) -> Column:
    """A row of a score table."""
    score = lambda c: F.format_string("%.2f", F.col(c))
    cells = [label, F.col("n").cast("string"), *[score(f"mean_{c}") for c in ("accuracy", "fluency", "terminology", "overall")], F.col("tokens").cast("string"), score("mean_latency_s")]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def consistency_lines(phrases: DataFrame, most: int = 30) -> DataFrame:
    """nth, line: the most frequent phrases of a report, ties by phrase."""
    mark = F.when(F.col("consistent"), "✅").otherwise("❌")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", "phrase", F.col("occurrences").cast("string"), mark, F.coalesce(F.nullif("signature", F.lit("")), F.lit("—"))), F.lit(" |"))
    # A limit under an order is taken by partition, so no task sorts all phrases.
    top = phrases.orderBy(F.desc("occurrences"), "phrase").limit(most)
    rows = F.array_sort(F.collect_list(F.struct((-F.col("occurrences")).alias("o"), "phrase", line.alias("line"))))
    return top.agg(rows.alias("rows")).select(F.posexplode("rows").alias("nth", "r")).select("nth", F.col("r.line").alias("line"))


def format_counts(text: Column) -> Column:
    """What a formatter meets in a raw document: a struct of counts, each a column of its own instead of a shared counter."""
    n = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    return F.struct(
        n("(?dm)^#{1,6}[^#\\n]").alias("headers"),
        n("(?dm)^:::+ *\\{?\\.?(?:quote|blockquote|center|block)\\b").alias("quotes"),
        n("(?dm)^:::+ *\\{?\\.?(?:toc|tableofcontents)\\b").alias("contents"),
        n("\\*").alias("emphasis"),
        n("\\[\\]\\{#[^}]+\\}").alias("anchors"),
        n("<!--").alias("comments"),
        n("!\\[[^\\]]*\\]\\([^)]+\\)").alias("images"),
        F.floor(n("(?dm)^[ \\t]*```") / 2).cast("long").alias("code_blocks"),
        F.lit(1).cast("long").alias("enhanced"),  # every text gets the layout of books
    )

"""Whole runs: documents to rendered translations, and samples to judged variants. Models are called when a plan is made, and their answers written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.config import Config
from lexweave.functions import text as X
from lexweave.operators import chunking, evaluation, prompts, rendering, reporting, translate
from lexweave.operators import glossary as G
from lexweave.tables import written


EMPTY_REPORT = {"passed": False, "issue_count": 1}


def translated_chunks(
    docs: DataFrame,
    terms: DataFrame,
    model: translate.TextModel | None = None,
    analyst: translate.TextModel | None = None,
    checker: translate.TextModel | None = None,
    cache: DataFrame | None = None,
    sizes: chunking.ChunkSizes | None = None,
    words: prompts.Wording = prompts.Wording(),  # noqa: B008
    repairs: int = 1,
    name: str = "stub",
    max_checks: int = 25,
    qa: bool = True,
    limits: translate.Limits | None = None,
    settings: Config | None = None,
) -> DataFrame:
    """docs(doc_id, text) -> doc, idx, chunk, original, translation, success, retry_count, duration, tokens, issue_count, passed, repaired, cached, cache_key of every chunk.

    A chunk's identity is (document, index), as equal documents have equal chunk ids. cache(cache_key, cached_translation) is met before
    the model; cache_updates() gives what a run adds to it. The key holds all that shapes an answer: settings, wording, model, chunk, profile
    and the chunk's terms. A failed chunk has one issue and no report.
    """
    chunks = chunking.chunks_of(docs, sizes)
    if analyst:
        chunks = chunks.join(written(prompts.profiles(docs, chunks, analyst, words), "profiles"), "doc_id")
    else:
        chunks = chunks.withColumn("profile", F.struct(F.lit("").alias("summary"), *[F.array().cast("array<string>").alias(n) for n in ("style_notes", "terminology_hints", "section_overview")]))
    chunks = chunks.withColumns({"id": F.col("chunk_id"), "chunk_id": F.struct("doc_id", "idx")})
    if cache is None:
        hits, misses = None, chunks.withColumn("cache_key", F.lit(None).cast("string"))
    else:
        chunks = G.with_terms(chunks, terms, "chunk_id", "text", "context_text").withColumnRenamed("terms", "found")
        used = F.array_sort(F.transform("found", lambda t: F.struct(t["term"].alias("term"), t["rendering"].alias("rendering"))))
        p = F.col("profile")
        mark = X.profile_fingerprint(p["summary"], p["style_notes"], p["terminology_hints"], p["section_overview"])
        key = X.cache_key("v4", prompts.fingerprint(words, settings), name, F.col("id"), mark, used)
        hits, misses = rendering.cache_split(written(chunks.withColumn("cache_key", key).drop("found"), "keyed"), cache)
        hits = hits.select("chunk_id", F.col("id").alias("chunk"), F.col("text").alias("original"), F.col("cached_translation").alias("translation"), "success", F.lit(0).alias("retry_count"), F.lit(0.0).alias("duration"), F.lit(None).cast("long").alias("tokens"), F.lit(0).alias("issue_count"), F.lit(True).alias("passed"), F.lit(False).alias("repaired"), "cached", "cache_key")
    ask = lambda section, context, found: prompts.translation_prompt(words, F.col("profile"), found, section, context)
    mend = lambda original, translation, issues, found, section: prompts.repair_prompt(words, original, translation, issues, found, section)
    told = translate.translate_chunks(misses, terms, model, repairs, prompt=ask, max_checks=max_checks, repair=mend, checker=checker, qa=qa, limits=limits, carry=("id", "cache_key"))
    told = told.withColumnRenamed("id", "chunk")
    lost = ~F.col("success")
    out = told.select("chunk_id", "chunk", "original", "translation", "success", "retry_count", "duration", "tokens", F.when(lost, F.lit(EMPTY_REPORT["issue_count"])).otherwise(F.col("issue_count")).alias("issue_count"), (F.col("passed") & ~lost).alias("passed"), "repaired", F.lit(False).alias("cached"), "cache_key")
    out = out if hits is None else out.unionByName(hits)
    return out.select(F.col("chunk_id.doc_id").alias("doc"), F.col("chunk_id.idx").alias("idx"), *[c for c in out.columns if c != "chunk_id"])


def cache_updates(results: DataFrame) -> DataFrame:
    """What translated_chunks() adds to its cache: the successes that weren't in it, one row a key; merge them by tasks.merge_latest."""
    fresh = results.filter("success and not cached and cache_key is not null")
    return fresh.groupBy("cache_key").agg(F.min("translation").alias("cached_translation"))


def run_result(results: DataFrame) -> DataFrame:
    """results(doc, idx, translation, success) -> doc, translation (the good chunks in order, a blank line between), failed_chunks, ok, bad."""
    good = F.array_sort(F.collect_list(F.when(F.col("success"), F.struct("idx", "translation"))))
    return results.groupBy("doc").agg(
        F.array_join(F.transform(good, lambda x: x["translation"]), "\n\n").alias("translation"),
        F.array_sort(F.collect_list(F.when(~F.col("success"), F.col("idx")))).alias("failed_chunks"),
        F.count_if("success").alias("ok"),
        F.count_if(~F.col("success")).alias("bad"),
    )


def translated_documents(docs: DataFrame, terms: DataFrame, bilingual: bool = False, **options) -> DataFrame:
    """doc, markdown: every document with a chunk, rendered in the order of its chunks."""
    return rendering.render(translated_chunks(docs, terms, **options), bilingual)


def judged(runs: DataFrame, judge: translate.TextModel, template: str) -> DataFrame:
    """runs(sample_id, source, translation, terms) -> sample_id, accuracy, fluency, terminology, rationale; an answer without JSON scores nothing."""
    asked = runs.select("sample_id", F.col("source").alias("text"), prompts.judge_prompt(template, F.col("source"), F.col("translation"), F.col("terms")).alias("prompt"))
    told = written(translate.call_model(asked, judge, "translate", 0), "verdicts").filter(F.col("success") & X.json_object(F.col("answer")).isNotNull())
    return told.select("sample_id", *[X.score(F.col("answer"), n).alias(n) for n in ("accuracy", "fluency", "terminology")], X.rationale(F.col("answer")).alias("rationale"))


def variants_run(samples: DataFrame, terms: DataFrame, model: translate.TextModel, analyst: translate.TextModel | None = None, checker: translate.TextModel | None = None, **options) -> DataFrame:
    """samples(sample_id, text) -> comparison, variant, sample_id, source, translation, total_tokens, latency_s, calls: six runs of every sample.

    A variant changes what its name says: without roles there is neither analyst nor repair, without the glossary no term. Both engines
    are the same plan here, and differ by their name alone.
    """
    docs, out = samples.select(F.col("sample_id").alias("doc_id"), "text"), None
    for ordinal, (comparison, variant) in enumerate(reporting.COMPARISONS):
        roles, known = (comparison, variant) != ("roles", "off"), terms.limit(0) if (comparison, variant) == ("glossary", "off") else terms
        told = translated_chunks(docs, known, model, analyst if roles else None, checker, qa=roles, name=f"{comparison}-{variant}", **options)
        whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "translation"))), lambda x: x["translation"]), "\n\n")
        source = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "original"))), lambda x: x["original"]), "\n\n")
        calls = F.sum(1 + F.col("retry_count") + F.col("repaired").cast("int"))
        run = told.groupBy(F.col("doc").alias("sample_id")).agg(source.alias("source"), whole.alias("translation"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens"), F.round(F.sum("duration"), 3).alias("latency_s"), calls.alias("calls"))
        run = run.select(F.lit(ordinal).alias("ordinal"), F.lit(comparison).alias("comparison"), F.lit(variant).alias("variant"), "*")
        out = run if out is None else out.unionByName(run)
    return out


def comparison_groups(aggregates: DataFrame) -> DataFrame:
    """aggregates(comparison, ordinal, variant, ...) -> comparison, variants: a list in their order."""
    columns = [c for c in aggregates.columns if c not in ("comparison", "ordinal")]
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", F.struct(*columns).alias("v")))), lambda x: x["v"])
    return aggregates.groupBy("comparison").agg(F.min("ordinal").alias("ordinal"), listed.alias("variants"))


def report_json(aggregates: DataFrame, summary: DataFrame, phrases: DataFrame, spent: DataFrame, meta: dict[str, str] | None = None) -> DataFrame:
    """One row, json: meta, comparisons, consistency with its phrases (by count, then phrase) and cost, as an object."""
    groups = comparison_groups(aggregates).agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "comparison", "variants"))), lambda g: F.struct(g["comparison"].alias("name"), g["variants"].alias("variants"))).alias("comparisons"))
    told = phrases.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("occurrences")).alias("o"), "phrase", "occurrences", "consistent", "signature"))), lambda p: F.struct(*[p[c].alias(c) for c in ("phrase", "occurrences", "consistent", "signature")])).alias("phrases"))
    # Each side is one row.
    both = summary.crossJoin(told).select(F.struct("rate", F.col("total").alias("total_phrases"), F.col("consistent").alias("consistent_phrases"), "decision", "phrases").alias("consistency"))
    paid = spent.select(F.struct("total_tokens", F.col("calls").alias("total_calls")).alias("cost"))
    about = F.create_map(*[F.lit(x) for pair in sorted((meta or {}).items()) for x in pair]) if meta else F.create_map().cast("map<string,string>")
    return groups.crossJoin(both).crossJoin(paid).select(F.to_json(F.struct(about.alias("meta"), "comparisons", "consistency", "cost")).alias("json"))


def report(aggregates: DataFrame, summary: DataFrame, phrases: DataFrame, spent: DataFrame) -> str:
    """The text of an evaluation's report; six score lines, one summary and thirty phrases reach the driver."""
    rows = aggregates.select("ordinal", "comparison", reporting.variant_line(F.col("variant")).alias("line")).orderBy("ordinal").collect()
    head = ["| Variant | Samples | Accuracy | Fluency | Terminology | Overall | Tokens | Latency |", "|-|-|-|-|-|-|-|-|"]
    out = ["# Evaluation"]
    for title in dict.fromkeys(r.comparison for r in rows):
        out += ["", f"## {title}", "", *head, *(r.line for r in rows if r.comparison == title)]
    s, c = summary.first(), spent.first()
    out += ["", "## Consistency", "", f"{s.consistent} of {s.total} phrases, rate {s.rate:.2%}: {s.decision}", "", "| Phrase | Times | Same | Signature |", "|-|-|-|-|"]
    out += [r.line for r in reporting.consistency_lines(phrases).orderBy("nth").collect()]
    return "\n".join([*out, "", f"{c.total_tokens} tokens in {c.calls} calls", ""])


def consistency_of(results: DataFrame, terms: DataFrame, threshold: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """results(idx, original, translation, [success]) of one document -> (phrases, summary). Failed chunks have no translation to compare."""
    results = results.filter("success") if "success" in results.columns else results
    phrases = evaluation.phrase_consistency(results.select(F.col("idx").cast("long").alias("seg"), F.col("original").alias("source"), "translation"), terms)
    return phrases, evaluation.consistency_summary(phrases, threshold)

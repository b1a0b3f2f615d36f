"""Results to documents: ordered mono- and bilingual Markdown, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions import text as X


def header(name: Column, bilingual: bool, source: Column | None = None) -> Column:
    """source: a file name to be named below, as for a file translated from a command line."""
    told = [F.lit("> 源文件: "), source, F.lit("\n\n")] if source is not None else [F.lit("\n")]
    return F.concat(F.lit("# "), name, F.lit(" - 中文翻译" + ("（双语对照）" if bilingual else "") + "\n\n> 由 AI 自动翻译\n"), *told)


def placeholder(index: Column, original: Column) -> Column:
    """Stands for a failed chunk: its number and the first 500 characters of its source."""
    return F.concat(F.lit("> [翻译失败: chunk "), index.cast("string"), F.lit("]\n\n```\n"), F.substring(original, 1, 500), F.lit("...\n```"))


def render(results: DataFrame, bilingual: bool) -> DataFrame:
    """results(doc, idx, original, translation, success) -> doc, markdown; one exchange by document."""
    shown = F.when(~F.col("success"), placeholder(F.col("idx"), F.col("original")))
    shown = shown.otherwise(F.concat(X.quote_lines(F.col("original")), F.lit("\n\n"), F.col("translation"), F.lit("\n\n---")) if bilingual else F.col("translation"))
    parts = results.select("doc", "idx", F.concat(F.lit("\n\n"), shown, F.lit("\n\n")).alias("part"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "part"))), lambda p: p["part"]), "")
    return parts.groupBy("doc").agg(body.alias("body")).select("doc", F.concat(header(F.col("doc").cast("string"), bilingual), "body").alias("markdown"))


def stream_format(original: Column, translation: Column) -> Column:
    """As chunks are streamed: source lines quoted but blank ones, images that the translation has left out."""
    seen = X.image_paths(translation)
    lines = F.filter(F.split(original, "\n"), lambda line: ~F.coalesce(F.array_contains(seen, F.nullif(F.regexp_extract(line, "!\\[[^\\]]*\\]\\(([^)]+)\\)", 1), F.lit(""))), F.lit(False)))
    return F.concat(F.array_join(X.quote_nonblank(lines), "\n"), F.lit("\n\n"), translation, F.lit("\n\n---"))


def bilingual_pairs(documents: DataFrame) -> DataFrame:
    """documents(doc, markdown) -> doc, nth, source, translation.

    A section's first run of quoted lines is the source, all that follows it the translation; both need text, or an image.
    The notes below a document's header are no source, so the first pair isn't lost with them; elsewhere a source that holds such
    a note makes no pair.
    """
    body = F.regexp_replace("markdown", "(?d)\\A# [^\\n]*\\n\\n> 由 AI 自动翻译\\n(?:> 源文件: [^\\n]*\\n)?", "")
    parts = documents.select("doc", F.posexplode(F.split(body, "\\n---+\\n|\\n---+\\s*\\z")).alias("nth", "s"))
    source = F.regexp_extract("s", "(?d)(?:\\A|\\n)((?:>[^\\n]*+(?:\\n|\\z))++)", 1)
    rest = F.substr(F.col("s"), F.position(source, F.col("s")) + F.char_length(source))
    pairs = parts.filter(source != "").select("doc", "nth", X.strip(F.regexp_replace(source, "(?dm)^>[ ]?", "")).alias("source"), X.strip(rest).alias("translation"))
    image = F.col("source").contains("![") | F.col("translation").contains("![")
    note = F.col("source").contains("由 AI 自动翻译") | F.col("source").contains("源文件:")
    return pairs.filter(~note & (F.col("source") != "") & (F.col("translation") != "") & (image | (F.col("source").rlike("[A-Za-z]{4}") & F.col("translation").rlike("[\\u4e00-\\u9fff]{2}"))))


def cache_split(chunks: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits as results, misses) of chunks(cache_key, ...) against cache(cache_key, cached_translation)."""
    hits = chunks.join(cache, "cache_key").withColumns({"success": F.lit(True), "retry_count": F.lit(0), "duration": F.lit(0.0), "cached": F.lit(True)})
    return hits, chunks.join(cache.select("cache_key"), "cache_key", "left_anti")


def hit_events(hits: DataFrame) -> DataFrame:
    """hits(task_id, idx, chunk_id, cached_translation) -> the progress event of each cached chunk."""
    return hits.select("task_id", F.col("idx").alias("chunk_index"), "chunk_id", F.lit("completed").alias("status"), F.col("cached_translation").alias("translation"), F.lit(0.0).alias("duration"), F.lit(True).alias("cached"))


def looks_bilingual(markdown: Column) -> Column:
    """By the first 4000 characters: the mark of the header, or a quoted line and a rule."""
    head = F.substring(markdown, 1, 4000)
    return F.coalesce(F.contains(head, F.lit("（双语对照）")) | (F.contains(head, F.lit("\n> ")) & F.contains(head, F.lit("\n---"))), F.lit(False))


def backfilled(results: DataFrame) -> DataFrame:
    """results(doc, bilingual, mono, dual) with the variant that older runs left out: doc, bilingual, mono, dual.

    Of a bilingual task a mono text that looks bilingual is the dual one; mono is stripped from dual where it is missing or looks
    bilingual. Of another task only a missing mono text is made.
    """
    from .markdown import to_monolingual

    old = F.col("bilingual") & F.col("dual").isNull() & looks_bilingual(F.col("mono"))
    known = results.withColumn("dual", F.when(old, F.col("mono")).otherwise(F.col("dual")))
    need = F.col("dual").isNotNull() & (F.col("mono").isNull() | (F.col("bilingual") & looks_bilingual(F.col("mono"))))
    made = to_monolingual(known.filter(need).select("doc", F.col("dual").alias("markdown"))).select(F.col("doc").alias("d"), F.col("markdown").alias("made"))
    return known.join(made, F.col("doc") == F.col("d"), "left").select("doc", "bilingual", F.when(need, F.col("made")).otherwise(F.col("mono")).alias("mono"), "dual")


def preview(documents: DataFrame) -> DataFrame:
    """documents(doc, markdown) -> doc, count, paragraphs: the pairs that a page shows side by side, in order."""
    pairs = bilingual_pairs(documents).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("nth", "source", "translation"))).alias("p"))
    return pairs.select("doc", F.size("p").alias("count"), F.transform("p", lambda x: F.struct(x["source"].alias("source"), x["translation"].alias("translation"))).alias("paragraphs"))

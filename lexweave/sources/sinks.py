"""Sinks: rendered documents, glossaries, reports and bundles. Tables stay with Spark's writers; names and layouts are columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def download_name(filename: Column, suffix: str = "") -> Column:
    """The file's stem, or `translation` where it has none. A dot in front is part of the stem."""
    base = F.regexp_extract(filename, "[^/]*\\z", 0)
    stem = F.trim(F.regexp_replace(base, "(?<=.)\\.[^.]+\\z", ""))
    return F.concat(F.coalesce(F.nullif(stem, F.lit("")), F.lit("translation")), F.lit(suffix))


def upload_path(task_id: Column, filename: Column, folder: str) -> Column:
    return F.concat(F.lit(folder + "/"), task_id, F.lit("_"), F.regexp_extract(filename, "[^/]*\\z", 0))


def glossary_id(name: Column) -> Column:
    """What a glossary of a name is stored as; another of the same id replaces it."""
    return F.replace(F.lower(name), F.lit(" "), F.lit("_"))


def json_string(value: Column) -> Column:
    """A value quoted as JSON; characters outside ASCII stay."""
    quoted = F.to_json(F.array(value))
    return F.substring(quoted, F.lit(2), F.char_length(quoted) - 2)


def glossary_json(glossary: DataFrame) -> DataFrame:
    """glossary(glossary_id, pos, term, rendering) -> glossary_id, json: an object in glossary order, indented by two."""
    line = F.concat(F.lit("  "), json_string(F.col("term")), F.lit(": "), json_string(F.col("rendering")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"])
    return glossary.groupBy("glossary_id").agg(F.concat(F.lit("{\n"), F.array_join(lines, ",\n"), F.lit("\n}")).alias("json"))


def download_refusal(status: Column, bilingual: Column, form: Column, variant: Column) -> Column:
    """Why a result can't be downloaded, null where it can; a status of null is a result without a task, which is only bound by form and variant."""
    return (
        F.when(~form.isin("md", "html", "zip"), "format")
        .when(~variant.isin("mono", "bilingual"), "variant")
        .when(status.isNotNull() & ~status.isin("completed", "partial_success"), "unfinished")
        .when(status.isNotNull() & ~F.coalesce(bilingual, F.lit(False)) & ((variant == "bilingual") | (form == "html")), "monolingual")
    )


def result_name(filename: Column, form: Column, variant: Column) -> Column:
    """What a downloaded result is called."""
    end = F.when(form == "html", ".bilingual.html").when(form == "zip", ".assets.zip").when(variant == "bilingual", ".bilingual.md").otherwise(".cn.md")
    return F.concat(download_name(filename), end)


def edited_glossaries(stored: DataFrame, written: DataFrame, removed: DataFrame) -> DataFrame:
    """stored(glossary_id, json) after overwrites by written(glossary_id, json) and deletions of removed(glossary_id)."""
    kept = stored.join(written.select("glossary_id").distinct(), "glossary_id", "left_anti").select("glossary_id", "json")
    return kept.unionByName(written.select("glossary_id", "json")).join(removed.select("glossary_id").distinct(), "glossary_id", "left_anti")


def write_texts(documents: DataFrame, path: str, text_col: str = "markdown", id_col: str = "doc", groups: int = 256) -> None:
    """documents as JSON lines of (doc, text) in `groups` folders by a hash of their id, so that single documents are found by theirs.

    Tasks write what they hold, in as many folders as they meet; no folder a document. What lies at path is replaced.
    """
    group = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(groups)).cast("int")
    documents.select(F.col(id_col).cast("string").alias("doc"), F.col(text_col).alias("text"), group.alias("part")).repartition("part").write.mode("overwrite").partitionBy("part").json(path)


def read_text(spark: SparkSession, path: str, doc: str, groups: int = 256) -> DataFrame:
    """One document of write_texts(), from its folder alone."""
    rows = spark.read.schema("doc string, text string, part int").json(path)
    return rows.filter((F.col("part") == F.pmod(F.xxhash64(F.lit(doc)), F.lit(groups))) & (F.col("doc") == doc)).drop("part")

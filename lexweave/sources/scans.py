"""Scans: documents, glossaries, manifests, uploads."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.shipping import ship


def markdown_files(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: path, source_type, text."""
    df = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    return df.select("path", source_type(F.col("path")).alias("source_type"), F.col("value").alias("text"))


def source_type(path: Column) -> Column:
    """By suffix; an unknown one raises."""
    suffix = F.lower(F.regexp_extract(path, "\\.[^.]+$", 0))
    return F.when(suffix == ".pdf", "pdf").when(suffix == ".epub", "epub").when(suffix == ".mobi", "mobi").when(suffix.isin(".md", ".markdown"), "markdown").otherwise(F.raise_error(F.concat(F.lit("unsupported: "), path)))


def glossary_terms(json_text: DataFrame) -> DataFrame:
    """json_text(glossary_id, json) -> glossary_id, pos, term, rendering, in the object's order; bad JSON gives no rows."""
    entries = F.map_entries(F.from_json("json", "map<string,string>"))
    return json_text.select("glossary_id", F.posexplode(entries).alias("pos", "e")).select("glossary_id", "pos", F.col("e.key").alias("term"), F.col("e.value").alias("rendering"))


def glossary_listing(spark: SparkSession, folder: str) -> DataFrame:
    """glossary_id, name, term_count, modified of each readable *.json, newest first."""
    df = spark.read.text(f"{folder}/*.json", wholetext=True).select("value", "_metadata.file_name", F.col("_metadata.file_modification_time").alias("modified"))
    terms = F.from_json("value", "map<string,string>")
    name = F.regexp_replace("file_name", "\\.json$", "")
    return df.filter(terms.isNotNull()).select(name.alias("glossary_id"), F.initcap(F.replace(name, F.lit("_"), F.lit(" "))).alias("name"), F.size(terms).alias("term_count"), "modified").orderBy(F.desc("modified"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).schema("samples array<struct<id:string,kind:string,source_file:string,glossary_file:string>>").json(path).select(F.inline("samples"))


def samples(spark: SparkSession, path: str) -> DataFrame:
    """The manifest's samples with what they name: id, kind, source_text, entries map (empty without a glossary). Files lie beside the manifest."""
    base = path.rpartition("/")[0] or "."
    listed = manifest(spark, path)
    named = lambda c: F.regexp_replace(F.concat(F.lit(base + "/"), F.col(c)), "/(?:\\./)+", "/")
    texts = spark.read.option("recursiveFileLookup", "true").text(base, wholetext=True).select(F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/").alias("at"), "value")
    entries = F.coalesce(F.from_json("g.value", "map<string,string>"), F.create_map().cast("map<string,string>"))
    out = listed.withColumns({"s_at": named("source_file"), "g_at": named("glossary_file")})
    out = out.join(texts.alias("t"), F.col("s_at") == F.col("t.at")).join(texts.alias("g"), F.col("g_at") == F.col("g.at"), "left")
    return out.select("id", "kind", F.col("t.value").alias("source_text"), entries.alias("entries"))


def glossary_by_id(glossaries: DataFrame, glossary_id: str) -> DataFrame:
    """glossaries(glossary_id, json) -> entries map of one; no row where it is missing or isn't an object."""
    return glossaries.filter(F.col("glossary_id") == glossary_id).select("glossary_id", F.from_json("json", "map<string,string>").alias("entries")).filter("entries is not null")


def converted(files: DataFrame, convert: Callable[[str, bytes], str | None], source_types: tuple[str, ...] = ("pdf", "epub", "mobi")) -> DataFrame:
    """files(path, content) of the given types -> path, source_type, markdown, error. `convert` is the caller's converter; a failure is its row's."""
    ship(files.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, errors = [], []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                try:
                    texts.append(convert(path, content))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 any failure of a converter is its row's
                    texts.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["path", "source_type", "markdown", "error"])

    typed = files.select("path", source_type(F.col("path")).alias("source_type"), "content").filter(F.col("source_type").isin(*source_types))
    return typed.mapInArrow(work, "path string, source_type string, markdown string, error string")


def reusable(sources: DataFrame, files: DataFrame) -> DataFrame:
    """sources(doc, path, folder) x files(path, length) -> doc, reuse: what an earlier conversion of an EPUB or MOBI left; no row without one.

    The Markdown file of the source's own stem in its folder, else the first by path below it; empty files don't count.
    """
    wanted = sources.filter(F.lower("path").rlike("\\.(?:epub|mobi)$")).select("doc", "folder", F.concat(F.col("folder"), F.lit("/"), F.regexp_extract("path", "([^/]*?)\\.[^./]*$", 1), F.lit(".md")).alias("own"))
    left = files.filter("length > 0 and endswith(path, '.md')").select("path", F.explode(_folders(F.col("path"))).alias("in"))
    found = wanted.join(left, F.col("folder") == F.col("in"))
    return found.groupBy("doc").agg(F.min_by("path", F.struct(F.col("path") != F.col("own"), "path")).alias("reuse"))


def _folders(path: Column) -> Column:
    """Every folder that a path lies below, so that files meet folders by equality."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def submissions(df: DataFrame) -> DataFrame:
    """df(text, content_base64): exactly one of both must be there; text, or the decoded bytes, as `body`."""
    ok = F.col("text").isNull() != F.col("content_base64").isNull()
    return df.withColumn("accepted", ok).withColumn("body", F.when(ok, F.coalesce("text", F.decode(F.try_to_binary("content_base64", F.lit("base64")), "UTF-8"))))

"""Images of rendered documents: where their files lie, documents that point at copies of them, and pages that hold them.

Links meet a listing of files by equality of paths and names, never by looking at folders one by one.
"""

from __future__ import annotations

import os
import shutil
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions import text as X
from lexweave.shipping import ship

#: Media types by a file's suffix (fixed values); others are plain bytes.
MEDIA_TYPES = {".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".svg": "image/svg+xml", ".webp": "image/webp", ".bmp": "image/bmp", ".ico": "image/vnd.microsoft.icon", ".tif": "image/tiff", ".tiff": "image/tiff"}


def asset_roots(results: str, temp: str, doc: Column) -> Column:
    """The folders in which a document's images are looked for, in order; the first is the document's own."""
    at = lambda *parts: F.concat_ws("/", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.array(F.lit(results), at(results, "assets", doc), at(temp, doc), at(temp, doc, "images"), at(temp, doc, "images", "images"))


def _below(root: Column, path: Column) -> Column:
    path = F.regexp_replace(path, "^(?:\\./)+", "")
    return F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(root, F.lit("/"), path))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*\\z", 0)


def resolved_images(documents: DataFrame, files: DataFrame) -> DataFrame:
    """documents(doc, markdown, roots array<string>) x files(path) -> doc, link, path: the file of each image link that has one.

    First the link and then its file name below each root, in order; else a file of that name anywhere below the first root that
    has one, the least path of several. Links without a file give no row; a link that a document repeats gives one.
    """
    links = documents.select("doc", "roots", F.explode(F.array_distinct(X.image_paths(F.col("markdown")))).alias("link")).withColumn("name", file_name(F.col("link")))
    ways = F.flatten(F.transform("roots", lambda r: F.array(_below(r, F.col("link")), _below(r, F.col("name")))))
    listed = files.select("path", file_name(F.col("path")).alias("f_name"))
    direct = links.select("doc", "link", F.posexplode(ways).alias("nth", "way")).join(listed, F.col("way") == F.col("path")).select("doc", "link", F.lit(0).alias("step"), "nth", "path")
    search = links.select("doc", "link", "name", F.posexplode("roots").alias("nth", "root"))
    deep = search.join(listed, (F.col("name") == F.col("f_name")) & F.startswith("path", F.concat("root", F.lit("/")))).select("doc", "link", F.lit(1).alias("step"), "nth", "path")
    return direct.unionByName(deep).groupBy("doc", "link").agg(F.min_by("path", F.struct("step", "nth", "path")).alias("path"))


def synced(documents: DataFrame, found: DataFrame, folder: str) -> DataFrame:
    """documents(doc, markdown) with found(doc, link, path) -> doc, markdown, assets: sorted names of the images that `folder`/doc gets.

    If one image of a document is found, all its image links point there; else it stays as it is.
    """
    names = found.groupBy(F.col("doc").alias("d")).agg(F.array_sort(F.collect_set(file_name(F.col("path")))).alias("assets"))
    moved = F.regexp_replace(F.col("markdown"), F.lit("(!\\[[^\\]]*\\]\\()(?:[^)]*/)?([^)/]+\\))"), F.concat(F.lit("$1"), F.lit(folder + "/"), F.col("doc").cast("string"), F.lit("/$2")))
    return documents.join(names, F.col("doc") == F.col("d"), "left").select("doc", F.when(F.col("assets").isNotNull(), moved).otherwise(F.col("markdown")).alias("markdown"), F.coalesce("assets", F.array().cast("array<string>")).alias("assets"))


def variant_assets(synced_variants: DataFrame) -> DataFrame:
    """(doc, assets) of several variants of documents -> doc, assets: sorted distinct names of all of them."""
    return synced_variants.select("doc", F.explode("assets").alias("name")).groupBy("doc").agg(F.array_sort(F.collect_set("name")).alias("assets"))


def copies(found: DataFrame, folder: str) -> DataFrame:
    """found(doc, link, path) -> source, target of each file to copy, once."""
    return found.select(F.col("path").alias("source"), F.concat_ws("/", F.lit(folder), F.col("doc").cast("string"), file_name(F.col("path"))).alias("target")).distinct()


def copy_files(pairs: DataFrame) -> DataFrame:
    """pairs(source, target) -> target, bytes; files are copied by the tasks, over any file system that pyarrow opens. A rerun writes them again."""
    ship(pairs.sparkSession)

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        def opened(path: str) -> tuple[fs.FileSystem, str]:
            return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))

        for batch in batches:
            sizes = []
            for source, target in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                (a, at), (b, to) = opened(source), opened(target)
                b.create_dir(os.path.dirname(to), recursive=True)
                with a.open_input_stream(at) as read, b.open_output_stream(to) as write:
                    shutil.copyfileobj(read, write)
                sizes.append(a.get_file_info(at).size)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(sizes, pa.int64())], names=["target", "bytes"])

    return pairs.select("source", "target").mapInArrow(copy, "target string, bytes long")


def inlined(pages: DataFrame, found: DataFrame, contents: DataFrame) -> DataFrame:
    """pages(doc, html) with found(doc, link, path) and contents(path, content) -> doc, html whose found images are data URIs."""
    media = F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair])
    kind = F.coalesce(F.try_element_at(media, F.lower(F.regexp_extract("path", "\\.[^./]+\\z", 0))), F.lit("application/octet-stream"))
    uri = F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.replace(F.base64("content"), F.lit("\r\n"), F.lit("")))
    escaped = F.replace(F.replace(F.replace("link", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    held = found.join(contents, "path").select("doc", F.struct(escaped.alias("link"), uri.alias("uri")).alias("p")).groupBy(F.col("doc").alias("d")).agg(F.sort_array(F.collect_list("p")).alias("p"))
    src = lambda x: F.concat(F.lit('<img src="'), x, F.lit('"'))
    filled = F.aggregate(F.coalesce("p", F.array().cast("array<struct<link:string,uri:string>>")), F.col("html"), lambda h, p: F.replace(h, src(p["link"]), src(p["uri"])))
    return pages.join(held, F.col("doc") == F.col("d"), "left").select("doc", filled.alias("html"))


def zip_folder(folder: str, out: str, prefix: str) -> str:
    """A deflated archive of a local folder's files below `prefix`, in order of their paths; an empty one where the folder is missing."""
    os.makedirs(os.path.dirname(out) or ".", exist_ok=True)
    with zipfile.ZipFile(out, "w", compression=zipfile.ZIP_DEFLATED) as archive:
        for at, dirs, names in os.walk(folder):
            dirs.sort()
            for name in sorted(names):
                path = os.path.join(at, name)
                archive.write(path, os.path.join(prefix, os.path.relpath(path, folder)))
    return out

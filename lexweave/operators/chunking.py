"""Section-aware chunk planning: lines to blocks, blocks to chunks of a bounded size.

Packing is a fold over a document's blocks, which has no form in built-in functions, so it runs in an Arrow UDF per batch of
documents; ids, titles and context are columns over its result. Known quirks of the fold are kept: a section's path lingers
after an oversized block, and separators at the ends of split pieces are lost.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import text as X
from lexweave.shipping import ship

HEADING = re.compile(r"^(#{1,6})\s+(.*)$")
#: Where an oversized block is cut, in order of preference (fixed values).
CUTS = ("\n\n", "\n", "。", "！", "？", ". ", "! ", "? ", " ")
CHUNKS = "array<struct<text:string,section_path:array<string>>>"


@dataclass(frozen=True)
class ChunkSizes:
    """The most characters of a chunk, of its context, and the least a chunk should have."""

    chunk: int = 3600
    context: int = 1400
    target: int | None = None
    least: int | None = None

    @property
    def shortest(self) -> int:
        target = min(self.target or int(self.chunk * 0.9), self.chunk)
        return self.least or max(600, int(target * 0.4))


def text_blocks(text: str) -> Iterator[tuple[str, tuple[str, ...], bool]]:
    """(text, section path, is heading) of paragraphs, headings and fenced code."""
    path: tuple[str, ...] = ()
    held: list[str] = []
    fenced = False

    def release() -> Iterator[tuple[str, tuple[str, ...], bool]]:
        if held:
            yield "\n".join(held), path, False
            held.clear()

    for line in text.splitlines():
        if line.strip().startswith("```"):
            if not fenced:
                yield from release()
            held.append(line)
            fenced = not fenced
            if not fenced:
                yield from release()
        elif fenced:
            held.append(line)
        elif heading := HEADING.match(line):
            yield from release()
            path = (*path[: len(heading[1]) - 1], heading[2].strip())
            yield line, path, True
        elif line.strip():
            held.append(line)
        else:
            yield from release()
    yield from release()


def _refill(parts: list[str], cut: str, limit: int) -> Iterator[str]:
    """Parts joined again as far as they fit."""
    held = ""
    for part in parts:
        longer = (held + cut + part if held else part).strip()
        if held and len(longer) > limit:
            yield held.strip()
            held = part
        else:
            held = longer
    if held.strip():
        yield held.strip()


def split_block(text: str, limit: int) -> list[str]:
    pieces = [text]
    for cut in CUTS:
        if not any(len(p) > limit and cut in p for p in pieces):
            continue
        pieces = [q for p in pieces for q in (_refill(p.split(cut), cut, limit) if len(p) > limit and cut in p else (p,))]
        if max(map(len, pieces), default=0) <= limit:
            return pieces
    return [p[i : i + limit] for p in pieces for i in range(0, len(p), limit)]


def plan_chunks(text: str, sizes: ChunkSizes) -> list[tuple[str, tuple[str, ...]]]:
    """(text, section path) of a document's chunks."""
    packed: list[tuple[str, tuple[str, ...]]] = []
    held: list[str] = []
    section: tuple[str, ...] | None = None
    for raw, path, heading in text_blocks(text):
        block = raw.strip()
        if not block:
            continue
        full = bool(held) and sum(map(len, held)) + 2 * len(held) + len(block) > sizes.chunk
        if held and (heading or full or path != section) or len(block) > sizes.chunk and held:
            packed.append(("\n\n".join(held), section or ()))
            held, section = [], None
        section = path if section is None else section
        if len(block) > sizes.chunk:
            packed += [(piece, path) for piece in split_block(block, sizes.chunk)]
        else:
            held.append(block)
    if held:
        packed.append(("\n\n".join(held), section or ()))
    return _merge_short(packed, sizes)


def _merge_short(chunks: list[tuple[str, tuple[str, ...]]], sizes: ChunkSizes) -> list[tuple[str, tuple[str, ...]]]:
    out: list[tuple[str, tuple[str, ...]]] = []

    def joins(a: tuple[str, tuple[str, ...]], b: tuple[str, tuple[str, ...]]) -> bool:
        return a[1] == b[1] and len(a[0]) + 2 + len(b[0]) <= sizes.chunk

    for chunk in chunks:
        if out and len(out[-1][0]) < sizes.shortest and joins(out[-1], chunk):
            out[-1] = (f"{out[-1][0]}\n\n{chunk[0]}", chunk[1])
        else:
            out.append(chunk)
    if len(out) > 1 and len(out[-1][0]) < sizes.shortest and joins(out[-2], out[-1]):
        last = out.pop()
        out[-1] = (f"{out[-1][0]}\n\n{last[0]}", last[1])
    return out


def chunks_of(docs: DataFrame, sizes: ChunkSizes | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a chunk: id, idx, chunk_id, text, section_path, section_title, context_text; documents are planned where they lie."""
    ship(docs.sparkSession)
    sizes = sizes or ChunkSizes()

    @F.pandas_udf(CHUNKS)
    def plan(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"text": c, "section_path": list(p)} for c, p in plan_chunks(t or "", sizes)])

    rows = docs.select(F.col(id_col), F.posexplode(plan(F.col(text_col))).alias("idx", "c")).select(id_col, "idx", "c.text", "c.section_path")
    return with_context(rows.withColumn("section_title", X.section_title(F.col("section_path"))), sizes.context, id_col)


def with_context(chunks: DataFrame, window: int, id_col: str = "doc_id") -> DataFrame:
    w = Window.partitionBy(id_col).orderBy("idx")
    path = F.col("section_path")
    previous, title = F.coalesce(F.lag("text").over(w), F.lit("")), F.coalesce(F.lag("section_title").over(w), F.lit(""))
    context = X.context_text(path, title, F.col("section_title"), previous, window)
    return chunks.select(id_col, "idx", X.chunk_id(F.col("idx"), path, F.col("text")).alias("chunk_id"), "text", "section_path", "section_title", context.alias("context_text"))


def fenced_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a line: id, nth, line, fence (it opens or closes one), inside (a fence is open after it)."""
    lines = docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("nth", "line"))
    lines = lines.withColumn("fence", F.startswith(X.strip(F.col("line")), F.lit("```")))
    w = Window.partitionBy(id_col).orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("inside", F.count_if("fence").over(w) % 2 == 1)


def line_paths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a line: id, nth, line, heading (outside of code), path array<string>: the headings that it stands below, itself included.

    Headings nest by their place in the stack, as in chunks. Only a document's headings are gathered, not its lines. Null texts have no line.
    """
    lines = fenced_lines(docs, id_col, text_col)
    mark, title = (F.regexp_extract("line", HEADING.pattern, group) for group in (1, 2))
    lines = lines.withColumn("heading", ~F.col("fence") & ~F.col("inside") & (mark != ""))
    w = Window.partitionBy(id_col).orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("above", F.count_if("heading").over(w))
    found = lines.filter("heading").groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("above", F.char_length(mark).alias("level"), X.strip(title).alias("title")))).alias("h"))
    paths = found.select(id_col, F.posexplode(X.heading_paths(F.col("h"))).alias("n", "path")).select(id_col, (F.col("n") + 1).cast("long").alias("above"), "path")
    return lines.join(paths, [id_col, "above"], "left").select(id_col, "nth", "line", "heading", F.coalesce("path", F.array().cast("array<string>")).alias("path"))

"""Markdown formatting by blocks, bilingual to monolingual, HTML tables, profiles.

Blocks need a state machine over lines, so `format_markdown` is one Arrow UDF; everything else is column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import text as X
from lexweave.shipping import ship

from . import artifacts

OPEN_DIV = re.compile(r"^:{3,}\s*\{?([^}]*)\}?\s*$")
ITEM = re.compile(r"^\s*(?:[-*+]|\d+\.)\s+")
QUOTED = {"quote", "blockquote", "center", "block"}
CONTENTS = {"toc", "tableofcontents"}


def blocks(lines: list[str]) -> Iterator[tuple[str, list[str], str]]:
    """(kind, lines, div type) of fences, divs, headers, lists and paragraphs; blank lines end a block."""
    i = 0
    while i < len(lines):
        line, start = lines[i], i
        bare = line.strip()
        i += 1
        if not bare:
            continue
        if bare.startswith("```"):
            while i < len(lines) and not lines[i].strip().startswith("```"):
                i += 1
            i += 1
            yield "fence", lines[start:i], ""
        elif bare.startswith(":::"):
            kind, depth = OPEN_DIV.match(bare), 1
            while i < len(lines) and depth:
                inner = lines[i].strip()
                if inner.startswith(":::"):
                    depth += 1 if inner.strip(":").strip() else -1
                i += 1
            yield "div", lines[start + 1 : i - (depth == 0)], (kind[1] if kind else "").strip().lstrip(".#").split(" ")[0].lower()
        elif re.match(r"#{1,6}", bare):
            yield "header", [bare], ""
        elif ITEM.match(line):
            while i < len(lines) and lines[i].strip() and (ITEM.match(lines[i]) or lines[i].startswith("  ")):
                i += 1
            yield "list", lines[start:i], ""
        else:
            while i < len(lines) and lines[i].strip() and not re.match(r"\s*(?:```|:::|#{1,6}\s)", lines[i]) and not ITEM.match(lines[i]):
                i += 1
            yield "paragraph", lines[start:i], ""


def _stem(name: str) -> str:
    return name[: name.rfind(".")] if 0 < name.rfind(".") < len(name) - 1 else name


def _figure(m: re.Match) -> str:
    """An image with attributes gets a short path; an alternative text of PIC is the file's stem, as is a missing one beside attributes."""
    alt, path, attributes = m[1], m[2], m[3]
    name = path.rstrip("/").rpartition("/")[2]
    if alt == "PIC" or (attributes and alt.upper() in ("", "PIC")):
        alt = _stem(name)
    if attributes:
        path = ("images/" if "images/" in path else "") + name
    return f"![{alt}]({path})"


INLINE = [
    (re.compile(r"<!--.*?-->", re.S), ""),
    (re.compile(r"\[\]\{#[^}]*\}"), ""),
    (re.compile(r"\[([^\[\]]*)\]\{\.emphasis[^}]*\}"), r"**\1**"),
    (re.compile(r"\[([^\[\]]*)\]\{\.italic[^}]*\}"), r"*\1*"),
    (re.compile(r"!\[([^\]]*)\]\(([^)]+)\)(\{[^}]*\})?"), _figure),
    (re.compile(r"(\[[^\]]*\]\([^)]*\))\{[^}]*\}"), r"\1"),
    (re.compile(r"(!\[[^\]]*\]\()[^)]*/images/([^)/]+\))"), r"\1images/\2"),
    (re.compile(r"\{(?:\.[\w\-]+|style=[^}]*)\}"), ""),
    (re.compile(r"\\$", re.M), ""),
]


def clean_inline(text: str) -> str:
    """Outside of code spans: no comments, anchors or attributes; emphasis as marks; image paths short."""
    parts = re.split(r"(`[^`]*`)", text)
    for k in range(0, len(parts), 2):
        for pattern, new in INLINE:
            parts[k] = pattern.sub(new, parts[k])
    return "".join(parts)


def _header(line: str) -> str:
    level = re.match(r"#+", line)[0][:6]
    title = clean_inline(re.sub(r"\{[^}]*\}", "", line[len(level) :])).strip()
    return f"{level} {title}" if title else ""


def _render(lines: list[str]) -> list[str]:
    out = []
    for kind, own, div in blocks(lines):
        if kind == "fence":
            out.append("\n".join(own))
        elif kind == "header":
            out.append(_header(own[0]))
        elif kind == "div" and div in CONTENTS:
            out.append("\n".join(["## 目录", "", *(x if ITEM.match(x) else f"- {x.strip()}" for x in map(clean_inline, own) if x.strip())]))
        elif kind == "div" and div in QUOTED:
            out.append("\n".join(f"> {x}" if x.strip() else ">" for x in "\n\n".join(_render(own)).split("\n")))
        elif kind == "div":
            out += _render(own)
        else:
            out.append("\n".join(x.rstrip() for x in clean_inline("\n".join(own)).split("\n")))
    return [x for x in out if x]


def format_text(text: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", "\n\n".join(_render(text.splitlines()))).strip() + "\n"


def format_markdown(text: Column, source_type: str = "epub") -> Column:
    """Residue cleaned, then formatted block by block."""

    ship()

    @F.pandas_udf("string")
    def shaped(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else format_text(t))

    return shaped(artifacts.clean_artifacts(text, source_type))


def to_monolingual(documents: DataFrame) -> DataFrame:
    """documents(doc, markdown) -> doc, markdown without quoted sources, rules, the bilingual mark, repeated images and blank runs."""
    lines = documents.select("doc", F.posexplode(F.split(F.replace("markdown", F.lit("（双语对照）"), F.lit("")), "\n")).alias("n", "line"))
    kept = lines.filter(~F.col("line").rlike("^\\s*-{3,}\\s*$") & (~F.col("line").startswith(">") | F.col("line").startswith("> 由 AI")))
    w = Window.partitionBy("doc").orderBy("n")
    blank = F.trim("line") == ""
    kept = kept.withColumn("again", blank & F.coalesce(F.lag(blank).over(w), F.lit(False))).filter("not again").drop("again")
    text_lines = kept.filter(F.trim("line") != "").withColumn("seen", F.lag("line").over(w))
    twice = text_lines.filter(F.col("line").rlike("^\\s*!\\[") & (F.col("line") == F.col("seen"))).select("doc", "n")
    once = kept.join(twice, ["doc", "n"], "left_anti")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    return once.groupBy("doc").agg(body.alias("m")).select("doc", F.regexp_replace(F.regexp_replace("m", "\\n{3,}+", "\n\n"), "(?<!\\s)\\s++\\z", "").alias("markdown"))


def html_table(pairs: DataFrame, title: str) -> DataFrame:
    """pairs(doc, nth, source, translation) -> doc, html: a page with a row for each pair."""
    row = F.concat(F.lit("<tr><td>"), X.markdown_to_html(F.col("source")), F.lit("</td><td>"), X.markdown_to_html(F.col("translation")), F.lit("</td></tr>"))
    rows = pairs.select("doc", "nth", row.alias("row")).groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "row"))), lambda r: r["row"]), "\n").alias("rows"))
    head = f'<!DOCTYPE html>\n<html lang="zh"><head><meta charset="utf-8"><title>{title}</title></head><body>\n<table>\n'
    return rows.select("doc", F.concat(F.lit(head), "rows", F.lit("\n</table>\n</body></html>\n")).alias("html"))


PROFILE = "struct<summary:string,style_notes:array<string>,terminology_hints:array<string>,section_overview:array<string>>"


def parse_profile(raw: Column, caps: tuple[int, int, int] = (4, 12, 12)) -> Column:
    """A profile out of a model's answer; blanks dropped, lists capped; an empty profile where there is no JSON object."""
    j = F.from_json(X.json_object(raw), PROFILE)

    def items(name: str, cap: int) -> Column:
        clean = F.filter(F.transform(F.coalesce(j[name], F.array().cast("array<string>")), X.strip), lambda x: x != "")
        return F.slice(clean, 1, cap).alias(name)

    return F.struct(X.strip(F.coalesce(j["summary"], F.lit(""))).alias("summary"), *[items(n, c) for n, c in zip(("style_notes", "terminology_hints", "section_overview"), caps, strict=True)])

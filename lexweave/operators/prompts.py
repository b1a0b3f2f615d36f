"""What models are asked: prompts as columns, and the analyst and terminology steps around a document.

A prompt is a chain of titled sections. Wording is a parameter; the labels of a profile are fixed, as prompts and caches tell profiles by them.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.config import Config
from lexweave.functions import text as X

from . import glossary as G
from .markdown import parse_profile
from .translate import TextModel, call_model

#: A profile's parts in a prompt, and what stands for an empty profile or glossary (fixed values).
PROFILE_LABELS = {"summary": "文档摘要: ", "style_notes": "风格约束:", "terminology_hints": "术语提示:", "section_overview": "章节概览:"}
NO_PROFILE = "无额外文档级分析。"
NO_GLOSSARY = "（无术语表）"
NO_TERMS = "（无）"
NO_SECTIONS = "- Document Root"
TERM_LIST = "terms array<struct<term:string,translation:string,note:string>>"


#: Bytes of known terms that a prompt lists.
KNOWN = 1 << 20


@dataclass(frozen=True)
class Wording:
    """Roles and requirements; each may be replaced for a domain."""

    translator: str = "You translate long specialist documents into Chinese and keep to the given terminology."
    translation: tuple[str, ...] = ("Keep all Markdown as it is", "Use the renderings of the glossary", "Answer with the translation alone")
    repairer: str = "You correct a translation without changing its meaning or its Markdown."
    repair: tuple[str, ...] = ("Change only what the listed issues name", "Answer with the whole corrected translation")
    analyst: str = "You brief the translators of a document. Answer with one JSON object: summary, style_notes, terminology_hints, section_overview."
    extractor: str = "You list terms that need one rendering in the whole document. Answer with one JSON object: terms, a list of term, translation, note."


def fingerprint(words: Wording, settings: Config | None = None) -> str:
    """Changes with the settings that shape answers and with any role or requirement."""
    said = json.dumps({"settings": (settings or Config()).fingerprint(), "wording": asdict(words)}, sort_keys=True, ensure_ascii=False)
    return hashlib.sha256(said.encode()).hexdigest()


def numbered(items: tuple[str, ...]) -> str:
    return "\n".join(f"{n}. {item}" for n, item in enumerate(items, 1))


def bullets(items: Column, empty: str) -> Column:
    """- a line an item; `empty` where there is none."""
    return F.coalesce(F.nullif(F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n"), F.lit("")), F.lit(empty))


def term_lines(terms: Column, empty: str = NO_GLOSSARY) -> Column:
    """terms: array<struct<term, rendering>>, in glossary order."""
    return bullets(F.transform(terms, lambda t: F.concat(t["term"], F.lit(": "), t["rendering"])), empty)


def profile_text(profile: Column) -> Column:
    """profile: struct<summary, style_notes, terminology_hints, section_overview>; parts that are empty are left out."""
    summary = F.when(profile["summary"] != "", F.concat(F.lit(PROFILE_LABELS["summary"]), profile["summary"]))
    lists = [F.when(F.size(profile[n]) > 0, F.concat(F.lit(label + "\n"), bullets(profile[n], ""))) for n, label in PROFILE_LABELS.items() if n != "summary"]
    return F.coalesce(F.nullif(F.concat_ws("\n\n", summary, *lists), F.lit("")), F.lit(NO_PROFILE))


def sections(role: str, parts: dict[str, Column], requirements: tuple[str, ...] = ()) -> Column:
    """A role, titled parts in order, then numbered requirements."""
    body = [F.concat(F.lit(f"[{title}]\n"), F.coalesce(part, F.lit(""))) for title, part in parts.items()]
    return F.concat_ws("\n\n", F.lit(role), *body, *([F.lit(numbered(requirements))] if requirements else []))


def translation_prompt(words: Wording, profile: Column, terms: Column, section: Column, context: Column) -> Column:
    """section: the breadcrumb of the chunk's section."""
    return sections(words.translator, {"Profile": profile_text(profile), "Glossary": term_lines(terms), "Section": section, "Context": context}, words.translation)


def repair_prompt(words: Wording, original: Column, translation: Column, issues: Column, terms: Column, section: Column) -> Column:
    told = bullets(F.transform(issues, lambda i: F.concat_ws(" ", F.concat(F.lit("["), i["severity"], F.lit("]")), i["kind"], i["message"])), "")
    return sections(words.repairer, {"Section": section, "Original": original, "Translation": translation, "Issues": told, "Glossary": term_lines(terms)}, words.repair)


def judge_prompt(template: str, source: Column, translation: Column, terms: Column) -> Column:
    """template with {source}, {translation} and {glossary}; what is put in isn't searched again."""
    values = {"{source}": source, "{translation}": translation, "{glossary}": term_lines(terms)}
    parts, rest = [], template
    while rest:
        at, name = min(((rest.find(n), n) for n in values if n in rest), default=(len(rest), None))
        parts += [F.lit(rest[:at])] + ([values[name]] if name else [])
        rest = rest[at + len(name) :] if name else ""
    return F.concat(*parts)


def template_body(text: Column) -> Column:
    """A template file's text after its first line of three dashes; all of it where there is none."""
    return X.strip(F.when(F.contains(text, F.lit("\n---\n")), F.regexp_extract(text, "(?s)\\A.*?\\n---\\n(.*)\\z", 1)).otherwise(text))


def section_lists(chunks: DataFrame, id_col: str = "doc_id", most: int = 12) -> DataFrame:
    """chunks(id, idx, section_path, section_title) -> id, sections: the first `most` distinct breadcrumbs in document order."""
    named = chunks.select(id_col, "idx", X.breadcrumb(F.col("section_path")).alias("title")).filter("title <> ''")
    first = named.groupBy(id_col, "title").agg(F.min("idx").alias("idx"))
    w = Window.partitionBy(id_col).orderBy("idx", "title")
    top = first.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most)
    return top.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "title"))), lambda x: x["title"]).alias("sections"))


def profiles(docs: DataFrame, chunks: DataFrame, model: TextModel, words: Wording = Wording(), id_col: str = "doc_id", text_col: str = "text", excerpt: int = 12000) -> DataFrame:  # noqa: B008
    """id, profile of every document; a failed call or an answer without JSON gives an empty profile. The analyst sees an excerpt, by its design."""
    listed = docs.select(id_col, F.substring(F.coalesce(F.col(text_col), F.lit("")), 1, excerpt).alias("text")).join(section_lists(chunks, id_col), id_col, "left")
    asked = listed.withColumn("prompt", sections(words.analyst, {"Sections": bullets(F.coalesce("sections", F.array().cast("array<string>")), NO_SECTIONS), "Excerpt": F.col("text")}))
    told = call_model(asked.select(id_col, "text", "prompt"), model, "translate", 0)
    return told.select(id_col, parse_profile(F.when(F.col("success"), F.col("answer")).otherwise(F.lit(""))).alias("profile"))


def parse_terms(answers: DataFrame, existing: DataFrame, most: int = 60) -> DataFrame:
    """answers(answer) -> pos, term, translation: the first of each spelling that the glossary doesn't have, at most `most`."""
    j = F.from_json(X.json_object(F.col("answer")), TERM_LIST)
    rows = answers.select(F.posexplode(j["terms"]).alias("pos", "t")).select("pos", "t.term", "t.translation")
    return G.first_by_case(rows, existing).orderBy("pos").limit(most)


def suggested_terms(doc: DataFrame, existing: DataFrame, model: TextModel, words: Wording = Wording(), excerpt: int = 16000, most: int = 60) -> DataFrame:  # noqa: B008
    """Candidates for one document's glossary, from an excerpt, by its design; a failed call gives none.

    The prompt lists the terms that the glossary has: all of them while they have up to KNOWN bytes, else those that are in the excerpt.
    """
    asked = doc.select(F.substring("text", 1, excerpt).alias("text"))
    if (existing.agg(F.sum(F.octet_length("term"))).first()[0] or 0) <= KNOWN:
        known = existing.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"]).alias("known"))
        asked = asked.crossJoin(F.broadcast(known))  # one row of at most KNOWN bytes
    else:
        listed = existing if "rendering" in existing.columns else existing.withColumn("rendering", F.lit(""))
        asked = G.with_terms(asked.withColumn("of", F.sha2("text", 256)), listed.select("pos", "term", "rendering"), "of").withColumn("known", F.col("terms.term"))
    asked = asked.select("text", sections(words.extractor, {"Known": bullets(F.col("known"), NO_TERMS), "Excerpt": F.col("text")}).alias("prompt"))
    return parse_terms(call_model(asked, model, "translate", 0).filter("success"), existing, most)


def term_map(candidates: DataFrame) -> DataFrame:
    """candidates(pos, term, translation) -> entries: one map, in their order."""
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("pos", "term", "translation"))), lambda x: F.struct(x["term"], x["translation"]))
    return candidates.agg(F.map_from_entries(pairs).alias("entries"))

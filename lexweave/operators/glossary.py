"""Terminology: which terms a text has, whether their renderings were used, and glossary edits.

Terms match as substrings, whatever their case. A glossary(pos, term, rendering) of up to SMALL bytes meets texts in one pass without an
exchange of texts: a few terms one by one, more of them by an index (term_index.py). A larger one meets the texts' grams by an exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import text as X
from lexweave.tables import written

from .term_index import TermIndex

#: Bytes of terms and renderings up to which a glossary is broadcast; terms that are searched one by one.
SMALL, FEW = 4 << 20, 32


def matches(texts: DataFrame, glossary: DataFrame, text_col: str = "text", context_col: str | None = None, small: int = SMALL) -> DataFrame:
    """texts x the terms they contain (in the text or its context), with the columns of the glossary(term, ...). Empty terms are in every text.

    Null terms and texts match nothing. Terms of a glossary of up to `small` bytes are told by each text where it is; those of a larger
    one by the digest of the text, which is exchanged once.
    """
    hay = F.lower(F.concat_ws("\n", F.nullif(F.col(text_col), F.lit("")), *([F.nullif(F.col(context_col), F.lit(""))] if context_col else [])))
    rows = texts.withColumn("__hay", hay).filter("__hay <> ''")
    there = F.contains("__hay", F.lower("term"))
    size, terms = glossary.agg(F.sum(sum((F.octet_length(c) for c in ("term", "rendering") if c in glossary.columns), F.lit(0))), F.count("term")).first()
    if (size or 0) <= small and terms <= FEW:
        return rows.join(F.broadcast(glossary), there).drop("__hay")
    filed = TermIndex(glossary)
    if (size or 0) <= small:
        return rows.withColumn("__gram", F.explode(filed.candidates(F.col("__hay")))).join(F.broadcast(filed.index), "__gram").filter(there).drop("__hay", "__gram")
    keyed = rows.withColumn("__key", F.sha2("__hay", 256))
    begun = keyed.select("__key", F.explode(filed.candidates(F.col("__hay"))).alias("__gram")).distinct()
    found = begun.join(filed.index, "__gram").select("__key", *glossary.columns)
    return keyed.join(found, "__key").filter(there).drop("__hay", "__key")


def few_terms(glossary: DataFrame) -> list | None:
    """Rows (pos, term, rendering, low) of a glossary of at most FEW terms and 64 KB, else None."""
    rows = glossary.filter("term is not null").select("pos", "term", "rendering", F.lower("term").alias("low")).limit(FEW + 1).collect()
    return rows if len(rows) <= FEW and sum(len(r.term) + len(r.rendering or "") for r in rows) <= 1 << 14 else None


def _listed(rows: list) -> Column:
    one = lambda r: F.struct(F.lit(r.pos).alias("pos"), F.lit(r.term).alias("term"), F.lit(r.rendering).cast("string").alias("rendering"), F.lit(r.low).alias("low"))
    return F.array(*map(one, rows)) if rows else F.array().cast("array<struct<pos:int,term:string,rendering:string,low:string>>")


def _there(listed: Column, hay: Column) -> Column:
    """Those that hay has, whatever its case; it is lower-cased once, not once a term."""
    return X.let(F.coalesce(F.lower(hay), F.lit("")), lambda low: F.filter(listed, lambda t: (low != "") & F.contains(low, t["low"])))


def with_terms(rows: DataFrame, glossary: DataFrame, id_col: str, text_col: str = "text", context_col: str | None = None) -> DataFrame:
    """rows with terms array<struct<pos, term, rendering>>: those in the text or its context, in order of the glossary.

    A few terms are looked for where the rows are; more are matched and joined by id, over rows that are written before.
    """
    if (listed := few_terms(glossary)) is not None:
        hay = F.concat_ws("\n", F.nullif(F.col(text_col), F.lit("")), *([F.nullif(F.col(context_col), F.lit(""))] if context_col else []))
        kept = _there(_listed(sorted(listed, key=lambda r: (r.pos, r.term, r.rendering or ""))), hay)
        return rows.withColumn("terms", F.transform(kept, lambda t: F.struct(t["pos"].alias("pos"), t["term"].alias("term"), t["rendering"].alias("rendering"))))
    rows = written(rows, "rows")
    found = matches(rows.select(id_col, *{text_col, *([context_col] if context_col else [])}), glossary, text_col, context_col)
    found = found.groupBy(F.col(id_col).alias("__of")).agg(F.sort_array(F.collect_list(F.struct("pos", "term", "rendering"))).alias("terms"))
    joined = rows.join(found, F.col(id_col) == F.col("__of"), "left").drop("__of")
    return joined.withColumn("terms", F.coalesce("terms", F.array().cast("array<struct<pos:int,term:string,rendering:string>>")))


def _used(translation: Column, rendering: Column) -> Column:
    """A rendering counts whole or up to its first " (", if anything is before that. As the whole holds that part, one search tells."""
    preferred = F.trim(F.split_part(rendering, F.lit(" ("), F.lit(1)))
    return F.contains(translation, F.when(preferred != "", preferred).otherwise(rendering))


def adherence(pairs: DataFrame, glossary: DataFrame, id_col: str, max_checks: int = 25) -> DataFrame:
    """pairs(id, original, translation) -> a row for each checked term, with `kept`: its rendering was used.

    The longest terms of the original are checked, at most max_checks; a rendering counts whole or up to its first " (".
    """
    found = matches(pairs, glossary, "original")
    w = Window.partitionBy(id_col).orderBy(F.desc(F.char_length("term")), "pos")
    # Texts are looked at before the exchange that ranks terms, and stay behind.
    judged = found.select(id_col, "pos", "term", "rendering", _used(F.col("translation"), F.col("rendering")).alias("kept"))
    return judged.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= max_checks).select(id_col, "nth", "pos", "term", "rendering", "kept")


def quality_reports(pairs: DataFrame, glossary: DataFrame, id_col: str, words: int = 12, max_checks: int = 25) -> DataFrame:
    """pairs with issues array<struct>, issue_count and passed: untranslated runs, terminology, Markdown parity, repetition.

    A few terms are checked where the pairs are; more are matched, ranked and joined by id.
    """
    told = lambda term, rendering: F.concat(term, F.lit(" -> "), rendering)
    if (listed := few_terms(glossary)) is not None:
        ordered = _listed(sorted(listed, key=lambda r: (-len(r.term), r.pos)))
        checked = F.slice(_there(ordered, F.col("original")), 1, max_checks)
        missed = F.filter(checked, lambda t: ~_used(F.col("translation"), t["rendering"]))
        dropped = F.transform(missed, lambda t: F.struct(F.lit("terminology").alias("kind"), F.lit("medium").alias("severity"), told(t["term"], t["rendering"]).alias("message")))
        joined = pairs
    else:
        missed = adherence(pairs, glossary, id_col, max_checks).filter("not kept")
        terms = missed.groupBy(F.col(id_col).alias("__id")).agg(F.sort_array(F.collect_list(F.struct("nth", F.lit("terminology").alias("kind"), F.lit("medium").alias("severity"), told(F.col("term"), F.col("rendering")).alias("message")))).alias("__terms"))
        joined = pairs.join(terms, F.col(id_col) == F.col("__id"), "left")
        dropped = F.transform(F.coalesce("__terms", F.array().cast("array<struct<nth:int,kind:string,severity:string,message:string>>")), lambda t: F.struct(t["kind"].alias("kind"), t["severity"].alias("severity"), t["message"].alias("message")))
    one = lambda i: F.filter(F.array(i), lambda x: x.isNotNull())
    issues = F.concat(one(X.untranslated_issue(F.col("translation"), words)), dropped, X.markdown_issues(F.col("original"), F.col("translation")), one(X.repetition_issue(F.col("translation"))))
    return joined.withColumn("issues", issues).drop("__id", "__terms").withColumn("issue_count", F.size("issues")).withColumn("passed", F.col("issue_count") == 0)


def upsert_terms(glossary: DataFrame, add: DataFrame, remove: DataFrame) -> DataFrame:
    """Terms of `add` win over old ones; terms of `remove` go."""
    old = glossary.join(add.select("term"), "term", "left_anti").select("term", "rendering")
    return old.unionByName(add.select("term", "rendering")).join(remove.select("term"), "term", "left_anti")


def first_by_case(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """candidates(pos, term, translation): the first of each spelling, without blanks and terms that exist."""
    clean = candidates.filter("trim(term) <> '' and trim(translation) <> ''").withColumn("k", F.lower(F.trim("term")))
    w = Window.partitionBy("k").orderBy("pos")
    fresh = clean.withColumn("n", F.row_number().over(w)).filter("n = 1")
    return fresh.join(existing.select(F.lower("term").alias("k")).distinct(), "k", "left_anti").select("pos", F.trim("term").alias("term"), F.trim("translation").alias("translation"))

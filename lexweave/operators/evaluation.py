"""Variants judged and compared, and the consistency of repeated phrases."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.shipping import ship
from lexweave.tables import exchanged, written

from . import glossary as G

#: Phrases that begin or end with one of these are no candidates (fixed values).
STOPWORDS = [
    "the", "a", "an", "of", "to", "in", "on", "for", "and", "or", "but", "with",
    "as", "at", "by", "is", "are", "was", "were", "be", "been", "it", "its",
    "this", "that", "these", "those", "from", "into", "than", "then", "so",
]

#: Phrases of more characters are compared in pairs within their set of segments instead of by their parts.
WHOLE = 80


def overall() -> Column:
    return F.round((F.col("accuracy") + F.col("fluency") + F.col("terminology")) / 3, 3)


def variant_aggregate(runs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """runs(variant, sample_id, total_tokens, latency_s) joined with one verdict a sample; means to 3 places.

    Where verdicts have a column nth, the last of a sample's counts; else they have one row a sample.
    """
    if "nth" in verdicts.columns:
        scores = F.struct("accuracy", "fluency", "terminology")
        verdicts = verdicts.groupBy("sample_id").agg(F.max_by(scores, "nth").alias("v")).select("sample_id", "v.*")
    mean = lambda c: F.coalesce(F.round(F.avg(c), 3), F.lit(0.0))
    return (
        runs.join(verdicts.withColumn("overall", overall()), "sample_id")
        .groupBy("variant")
        .agg(F.count("*").alias("n"), *[mean(c).alias(f"mean_{c}") for c in ("accuracy", "fluency", "terminology", "overall", "latency_s")], F.sum("total_tokens").cast("long").alias("tokens"))
    )


def phrase_segments(segments: DataFrame, least: int = 2, most: int = 4) -> DataFrame:
    """segments(seg, source) -> distinct (phrase, seg): n-grams within sentences that neither begin nor end with a stopword."""
    sentences = segments.select("seg", F.explode(F.split("source", "[.!?;:\\n]+")).alias("s"))
    words = sentences.select("seg", F.transform(F.regexp_extract_all("s", F.lit("[A-Za-z][A-Za-z'\\-]*"), F.lit(0)), F.lower).alias("w"))
    stop = F.array(*[F.lit(s) for s in STOPWORDS])

    def runs(n: int) -> Column:
        starts = F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.slice("w", i, n))

    grams = words.select("seg", F.explode(F.concat(*[runs(n) for n in range(least, most + 1)])).alias("g"))
    ok = ~F.array_contains(stop, F.try_element_at("g", F.lit(1))) & ~F.array_contains(stop, F.try_element_at("g", F.lit(-1)))
    return grams.filter(ok).select(F.array_join("g", " ").alias("phrase"), "seg").distinct()


def repeated_phrases(segments: DataFrame, terms: DataFrame, occurrences: int = 2) -> DataFrame:
    """terms(pos, term, rendering) -> phrase, occurrences: phrases in at least `occurrences` segments, not covered by a term, nor by a longer phrase of the same segments.

    A set of segments is told by its size, an xor and a sum of hashes of its members, so no phrase gathers a list of them.
    """
    marks = [F.count("*").alias("occurrences"), F.bit_xor(F.xxhash64("seg")).alias("x"), F.sum(F.xxhash64(F.lit(1), "seg").cast("decimal(20,0)")).alias("y")]
    counted = phrase_segments(segments).groupBy("phrase").agg(*marks).filter(F.col("occurrences") >= occurrences)
    terms = terms.filter("term <> ''")
    # Phrases inside a term meet its parts by equality; terms inside a phrase are matched as in any text.
    size = F.char_length("t")
    parts = F.flatten(F.transform(F.sequence(F.lit(1), size), lambda i: F.transform(F.sequence(i, size), lambda j: F.substring(F.col("t"), i, j - i + 1))))
    inside = terms.select(F.lower("term").alias("t")).select(F.explode(F.filter(parts, lambda c: F.contains(c, F.lit(" ")))).alias("phrase")).distinct()
    counted = written(counted, "phrases")
    named = G.matches(counted.select("phrase"), terms, "phrase").select("phrase").distinct()
    free = counted.join(exchanged(inside), "phrase", "left_anti").join(exchanged(named), "phrase", "left_anti")
    keys = ["occurrences", "x", "y"]
    # A longer phrase names what it contains, so that nested phrases are found by equality and no set of segments pairs all its phrases.
    # Parts begin with a letter, hold a blank and end with none; they are exchanged, never broadcast, as they are many times what the file has.
    short = F.char_length("phrase") <= WHOLE
    size, blank = F.char_length("phrase"), F.lit(" ")
    at = lambda i: F.substring(F.col("phrase"), i, F.lit(1))
    starts = F.filter(F.sequence(F.lit(1), size - F.locate(" ", F.reverse("phrase")) + 1), lambda i: at(i).between("a", "z"))
    ends = lambda i: F.filter(F.sequence(F.call_function("locate", blank, F.col("phrase"), i) + 1, size), lambda j: at(j) != blank)
    cuts = F.flatten(F.transform(starts, lambda i: F.transform(ends(i), lambda j: F.substring(F.col("phrase"), i, j - i + 1))))
    inner = free.filter(short).select(*keys, F.explode(cuts).alias("part"), "phrase").filter("part <> phrase").select(*keys, F.col("part").alias("phrase"))
    longer = free.filter(~short).select(*keys, F.col("phrase").alias("q"))
    left = free.join(exchanged(inner), [*keys, "phrase"], "left_anti").alias("l")
    same = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys]
    left = left.join(exchanged(longer.alias("r")), [*same, F.char_length("r.q") > F.char_length("l.phrase"), F.contains("r.q", F.col("l.phrase"))], "left_anti")
    return left.select("phrase", "occurrences")


def common_substring(a: str, b: str) -> str:
    """The longest common substring; of several the one that ends first in a. Lengths are doubled, then halved in on."""

    def first(n: int) -> int:
        if n > min(len(a), len(b)):
            return -1
        seen = {hash(b[j : j + n]) for j in range(len(b) - n + 1)}
        return next((i for i in range(len(a) - n + 1) if hash(a[i : i + n]) in seen and a[i : i + n] in b), -1)

    fits, at, fails = 0, 0, 1
    while (i := first(fails)) >= 0:
        fits, at, fails = fails, i, fails * 2
    while fails - fits > 1:
        n = (fits + fails) // 2
        if (i := first(n)) >= 0:
            fits, at = n, i
        else:
            fails = n
    return a[at : at + fits]


def settled(shared: Column, least: int = 2) -> Column:
    """A signature, blanks and all, that is long enough and has a Chinese character; else empty."""
    return F.when((F.char_length(shared) >= least) & shared.rlike("[一-鿿]"), shared).otherwise("")


def phrase_consistency(segments: DataFrame, terms: DataFrame, occurrences: int = 2, least: int = 2, first: int = 8) -> DataFrame:
    """segments(seg, source, translation) -> phrase, occurrences, signature, consistent. seg is the order and names a segment; a null translation is empty.

    The signature is what all translations of a phrase share, folded in the order of segments. A phrase's first `first` segments are folded
    where they meet; most phrases share too little by then and are done. Of the rest each round finds the first later segment that lacks what
    is shared so far, by a minimum that is combined before it is exchanged, and folds that one in: all between leave the shared string as it is.
    So no task holds more than `first` rows of a phrase, and a phrase has as many rounds as its shared string gets shorter.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        phrase, shared, at, begun = None, "", 0, False
        for frame in frames:
            done = []
            for p, seg, text in zip(frame["phrase"], frame["seg"], frame["translation"], strict=True):
                if not begun or p != phrase:
                    if begun:
                        done.append((phrase, at, shared))
                    phrase, shared, at, begun = p, text or "", seg, True
                else:
                    shared, at = common_substring(shared, text or "") if len(shared) >= least else "", seg
            yield pd.DataFrame(done, columns=["phrase", "at", "shared"])
        if begun:
            yield pd.DataFrame([(phrase, at, shared)], columns=["phrase", "at", "shared"])

    @F.pandas_udf("string")
    def common(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([common_substring(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

    ship(segments.sparkSession)
    phrases = repeated_phrases(segments, terms, occurrences)
    spread = written(phrase_segments(segments).join(exchanged(phrases.select("phrase")), "phrase").withColumn("seg", F.col("seg").cast("long")), "phrase-segments")
    said = segments.select(F.col("seg").cast("long").alias("seg"), F.coalesce("translation", F.lit("")).alias("translation"))
    w = Window.partitionBy("phrase").orderBy("seg")
    head = spread.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= first).join(exchanged(said), "seg")
    head = head.select("phrase", "seg", "translation").repartition("phrase").sortWithinPartitions("phrase", "seg")
    state = written(head.mapInPandas(fold, "phrase string, at long, shared string"), "shared")
    live = state.filter(F.char_length("shared") >= least)
    done = state.filter(F.char_length("shared") < least).select("phrase", "shared")
    while True:
        later = spread.join(exchanged(live), "phrase").filter(F.col("seg") > F.col("at")).join(exchanged(said), "seg")
        lacking = later.filter(~F.contains("translation", F.col("shared"))).groupBy("phrase").agg(F.min("seg").alias("next"), F.min_by("translation", "seg").alias("text"))
        lacking = written(lacking, "lacking")
        done = done.unionByName(live.join(exchanged(lacking.select("phrase")), "phrase", "left_anti").select("phrase", "shared"))
        if lacking.isEmpty():
            break
        shorter = live.select("phrase", "shared").join(exchanged(lacking), "phrase").select("phrase", F.col("next").alias("at"), common(F.col("shared"), F.col("text")).alias("shared"))
        state = written(shorter, "shared")
        live = state.filter(F.char_length("shared") >= least)
        done = done.unionByName(state.filter(F.char_length("shared") < least).select("phrase", "shared"))
    out = spread.groupBy("phrase").agg(F.count(F.lit(1)).alias("occurrences")).join(exchanged(done), "phrase")
    return out.select("phrase", "occurrences", settled(F.col("shared"), least).alias("signature")).withColumn("consistent", F.col("signature") != "")


def consistency_summary(phrases: DataFrame, threshold: float = 0.9) -> DataFrame:
    total, good = F.count(F.lit(1)), F.count_if("consistent")
    rate = F.coalesce(F.round(good / F.nullif(total, F.lit(0)), 4), F.lit(1.0))
    return phrases.agg(total.alias("total"), good.alias("consistent"), rate.alias("rate")).withColumn("decision", F.when(F.col("rate") >= threshold, "no-rag").otherwise("build-rag"))

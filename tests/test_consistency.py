"""Signatures of phrases against a plain fold, hot phrases among them; and the heading stack against a plain one."""

import random
import re

from pyspark.sql import functions as F

from lexweave.functions import text as X
from lexweave.operators import chunking, evaluation


def plain_common(a, b):
    """The longest common substring, the one that ends first in a."""
    best, end = 0, 0
    for i in range(1, len(a) + 1):
        n = 0
        while n < i and a[i - n - 1 : i] in b:
            n += 1
        if n > best:
            best, end = n, i
    return a[end - best : end]


def plain_signature(texts, least=2):
    shared = texts[0]
    for text in texts[1:]:
        shared = plain_common(shared, text)
        if len(shared) < least:
            return ""
    return shared if len(shared) >= least and re.search("[一-鿿]", shared) else ""


def test_signatures_are_those_of_a_plain_fold(spark):
    rng = random.Random(3)
    phrases = ["deep sea", "red stone", "old house", "cold night", "far away"]
    rows = []
    for seg in range(400):
        here = [p for p, often in zip(phrases, (0.8, 0.3, 0.1, 0.02, 0.5), strict=True) if rng.random() < often]
        # "deep sea" keeps a part that gets shorter late; "old house" is translated in two ways; "far away" keeps blanks.
        deep = "深海之中" if seg < 150 else "深海之" if seg < 390 else "深海"
        said = {"deep sea": deep, "red stone": "红石头", "old house": rng.choice(["老房子", "旧屋"]), "cold night": "寒夜", "far away": " 远 "}
        rows.append((seg, ". ".join(here), "".join(f"{rng.choice('abcdefgh')}{said[p]}{rng.choice('mnopq')}" for p in here) or None))
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "seg int, source string, translation string")
    none = spark.createDataFrame([], "pos int, term string, rendering string")
    want = {}
    for p in phrases:
        texts = [t or "" for _, s, t in sorted(rows) if p in s]
        want[p] = (len(texts), plain_signature(texts))
    for first in (1, 8, 1000):
        got = {r.phrase: (r.occurrences, r.signature) for r in evaluation.phrase_consistency(frame, none, first=first).collect()}
        assert got == want
    assert want["deep sea"][1] == "深海" and want["old house"][1] == "" and " " in want["far away"][1]


def test_a_blank_counts_in_a_signature(spark):
    rows = [(0, "deep sea", "a译 b"), (1, "deep sea", "c译 d")]
    none = spark.createDataFrame([], "pos int, term string, rendering string")
    got = evaluation.phrase_consistency(spark.createDataFrame(rows, "seg long, source string, translation string"), none).first()
    assert (got.signature, got.consistent) == ("译 ", True)
    empty = spark.createDataFrame([], "seg long, source string, translation string")
    assert evaluation.phrase_consistency(empty, none).count() == 0


def test_heading_stack_is_positional(spark):
    rng = random.Random(6)
    docs = [(i, "\n".join(rng.choice(["# One ", "## Two", "### Three", "###### Six", "####### no", "#no", "text # x", "```", "  ``` py", ""]) for _ in range(rng.randint(0, 60)))) for i in range(30)]
    docs += [(100, "# A\n### B\n### C\n## D\nx"), (101, None), (102, "")]
    want = []
    for i, text in docs:
        path, fenced = [], False
        for n, line in enumerate(text.split("\n") if text is not None else []):
            fence = line.strip().startswith("```")
            heading = None if fence or fenced else re.match(r"^(#{1,6})\s+(.*)$", line)
            fenced ^= fence
            if heading:
                path = [*path[: len(heading[1]) - 1], heading[2].strip()]
            want.append((i, n, line, heading is not None, path))
    got = chunking.line_paths(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert [r.path for r in got.filter("doc_id = 100").orderBy("nth").collect()] == [["A"], ["A", "B"], ["A", "B", "C"], ["A", "D"], ["A", "D"]]
    assert spark.range(1).select(X.heading_paths(F.expr("cast(array() as array<struct<level:int,title:string>>)")).alias("p")).first().p == []


def plans(monkeypatch):
    """Plans of all tables that evaluation writes from here on."""
    seen, real = [], evaluation.written
    monkeypatch.setattr(evaluation, "written", lambda df, name: (seen.append(df._jdf.queryExecution().executedPlan().toString()), real(df, name))[1])
    return seen


def test_parts_of_phrases_stay_off_the_driver(spark):
    """Each phrase names hundreds of parts, so a file that looks small enough for a broadcast isn't."""
    segments = spark.createDataFrame([(1, "Big deep red-eyed sea. O'er sea."), (2, "Big deep red-eyed sea. O'er sea."), (3, "Deep red-eyed sea")], "seg long, source string")
    got = evaluation.repeated_phrases(segments, spark.createDataFrame([], "pos int, term string, rendering string"))
    assert {(r.phrase, r.occurrences) for r in got.collect()} == {("big deep red-eyed sea", 2), ("o'er sea", 2), ("deep red-eyed sea", 3)}
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_segments_and_phrases_stay_off_the_driver(spark, monkeypatch):
    seen = plans(monkeypatch)
    segments = spark.createDataFrame([(1, "Deep red sea", "译文一"), (2, "Deep red sea", "译文二"), (3, "Deep red sea", "译")], "seg long, source string, translation string")
    got = evaluation.phrase_consistency(segments, spark.createDataFrame([], "pos int, term string, rendering string"), first=1)
    assert [(r.phrase, r.occurrences, r.signature) for r in got.collect()] == [("deep red sea", 3, "")]
    assert len(seen) > 4 and not any("BroadcastHashJoin" in p for p in seen)

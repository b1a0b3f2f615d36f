"""Literal cases of the operators."""

import random

import pytest
from pyspark.sql import functions as F

from lexweave.functions import text as X
from lexweave.operators import artifacts, chunking, evaluation, prompts, rendering, reporting, tasks, translate
from lexweave.operators import glossary as G
from lexweave.plans import document
from lexweave.sources import sinks
from lexweave.streaming import ordered, runs


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("r")).first()[0]


@pytest.mark.parametrize(
    ("said", "want"),
    [
        ("Here is the translation: 正文内容", "正文内容"),
        ("正文内容（注：无关说明）", "正文内容"),
        ("```markdown\n正文内容\n```", "正文内容"),
        ("结束。。。。。。。。", "结束。。。"),
        ("走了" * 6, "走了" * 6),
        ("循环" * 12, "循环"),
        ("　 x \n", "x"),
    ],
)
def test_clean_output(spark, said, want):
    assert one(spark, said, X.clean_output) == want


def test_clean_output_survives_long_texts(spark):
    assert len(one(spark, "word " * 20000, X.clean_output)) < 20
    assert one(spark, "a " * 50000 + "b", X.untranslated_span).startswith("a a a")


def test_chunks_follow_sections():
    text = "# Part One\n\n" + "a" * 60 + "\n\n## Subsection\n\n" + "b" * 60 + "\n\n### Detail\n\n" + "c" * 60
    chunks = chunking.plan_chunks(text, chunking.ChunkSizes(80, 40, None, 10))
    assert [c[1][-1] for c in chunks][0] == "Part One" and len(chunks) >= 3
    paths = [p for _, p, h in chunking.text_blocks("# A\n### B\n### C\n# D") if h]
    assert paths == [("A",), ("A", "B"), ("A", "B", "C"), ("D",)]


def test_short_chunks_merge():
    assert len(chunking.plan_chunks("# Section\n\none\n\ntwo\n\nthree", chunking.ChunkSizes(120, 40, 100, 50))) == 1


def test_stale_section_after_oversized_block():
    chunks = chunking.plan_chunks("# A\n\n" + "x" * 50 + "\n\n# B\n\nyy", chunking.ChunkSizes(20, 10, 20, 1))
    assert ("# B", ("A",)) in chunks and ("yy", ("B",)) in chunks


def test_split_keeps_sizes_and_drops_cut_separators():
    pieces = chunking.split_block("aaaa. bbbb. cccc", 10)
    assert all(len(p) <= 10 for p in pieces) and "".join(pieces) == "aaaa. bbbbcccc"
    assert chunking.split_block("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5]


def test_unclosed_fence_is_one_block():
    assert [b[0] for b in chunking.text_blocks("a\n\n```\n# no\n\nb")] == ["a", "```\n# no\n\nb"]


def test_quality_report(spark):
    pairs = spark.createDataFrame([(1, "Hyperstition expands across the desert.", "Hyperstition expands across the desert.")], "id int, original string, translation string")
    terms = spark.createDataFrame([(0, "Hyperstition", "超虚构 (Hyperstition)")], "pos int, term string, rendering string")
    row = G.quality_reports(pairs, terms, "id", words=4).first()
    assert [i.kind for i in row.issues] == ["untranslated", "terminology"] and not row.passed


def test_lost_image_counts_as_image_and_link(spark):
    df = spark.createDataFrame([("![x](a.png)", "")], "a string, b string")
    found = df.select(X.markdown_issues(F.col("a"), F.col("b")).alias("i")).first().i
    assert [(i.severity) for i in found] == ["high", "medium"]


def test_scores(spark):
    raw = 'noise {"accuracy": 9, "fluency": "0", "rationale": "r"} more'
    assert [one(spark, raw, lambda c, n=n: X.score(c, n)) for n in ("accuracy", "fluency", "terminology")] == [5.0, 1.0, 3.0]
    assert one(spark, "no json", X.rationale) == ""


def test_consistency(spark):
    rows = [(0, "The reward model is good.", "这个奖励模型很好"), (1, "A reward model here.", "此处的奖励模型"), (2, "The flat line ends.", "平线结束"), (3, "A flat line again.", "又是直线")]
    segments = spark.createDataFrame(rows, "seg long, source string, translation string")
    none = spark.createDataFrame([], "term string")
    found = {r.phrase: r for r in evaluation.phrase_consistency(segments, none).collect()}
    assert found["reward model"].signature == "奖励模型" and not found["flat line"].consistent and len(found) == 2
    summary = evaluation.consistency_summary(evaluation.phrase_consistency(segments, none)).first()
    assert (summary.total, summary.rate, summary.decision) == (2, 0.5, "build-rag")
    empty = evaluation.consistency_summary(evaluation.phrase_consistency(segments.limit(0), none)).first()
    assert (empty.rate, empty.decision) == (1.0, "no-rag")


def test_nested_phrases(spark):
    segments = spark.createDataFrame([(0, "deep red sea"), (1, "deep red sea")], "seg long, source string")
    assert [r.phrase for r in evaluation.repeated_phrases(segments, spark.createDataFrame([], "term string")).collect()] == ["deep red sea"]
    more = segments.unionByName(spark.createDataFrame([(2, "red sea")], segments.schema))
    assert {r.phrase for r in evaluation.repeated_phrases(more, spark.createDataFrame([], "term string")).collect()} == {"deep red sea", "red sea"}


def test_large_glossary_matches_as_a_small_one(spark):
    texts = spark.createDataFrame([(1, "The Reward model"), (2, "aaaa"), (3, None), (4, ""), (5, "reward"), (6, "The Reward model")], "id int, text string")
    glossary = spark.createDataFrame([(0, "reward Model", "r"), (1, "aa", "a"), (2, "", "e"), (3, "ward", "w"), (4, "d", "d")], "pos int, term string, rendering string")
    small, large = (sorted(tuple(r) for r in G.matches(texts, glossary, small=n).select("id", "pos").collect()) for n in (1 << 20, 0))
    assert small == large and (2, 1) in small and (1, 0) in small and len(small) == 13


def test_common_substring_against_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ("".join(rng.choices("ab中", k=rng.randrange(12))) for _ in range(2))
        found = [(-(j - i), j) for i in range(len(a)) for j in range(i + 1, len(a) + 1) if a[i:j] in b]
        size, end = min(found, default=(0, 0))
        assert evaluation.common_substring(a, b) == a[end + size : end]


def test_common_substring_ties_end_first():
    assert evaluation.common_substring("abxcd", "cdyab") == "ab"


class Moody:
    def translate(self, prompt, text):
        if "BOOM" in text:
            raise RuntimeError("boom")
        return "译文" if "plain" in text else text

    def repair(self, prompt, text):
        return "修好了"


def test_translation_isolates_failures_and_repairs(spark):
    words = "one two three four five six seven eight nine ten eleven twelve thirteen"
    chunks = spark.createDataFrame([("a", "plain"), ("b", "BOOM"), ("c", words)], "chunk_id string, text string").withColumns({"section_title": F.lit("S"), "context_text": F.lit("")})
    terms = spark.createDataFrame([], "pos int, term string, rendering string")
    done = {r.chunk_id: r for r in translate.translate_chunks(chunks, terms, Moody(), retries=1).collect()}
    assert done["a"].success and not done["a"].repaired and done["a"].passed
    assert not done["b"].success and done["b"].retry_count == 1 and done["b"].translation == "[翻译失败: boom]"
    assert done["c"].repaired and done["c"].passed and done["c"].translation == "修好了"


def test_limiter(spark):
    calls = spark.createDataFrame([(1, i, 0.0) for i in range(3)], "key long, call_id long, at double")
    assert [r.wait for r in ordered.limiter_waits(calls, 2, 60.0).orderBy("call_id").collect()] == [0.0, 0.0, 30.0]


def test_ordered_emission(spark, tmp_path):
    schema = "doc long, idx int, content string"
    rows = [(d, i, f"{d}-{i}") for d in (1, 2) for i in range(6) if (d, i) != (2, 3)]
    random.Random(5).shuffle(rows)
    for n in range(3):
        spark.createDataFrame(rows[n::3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = ordered.emit_in_order(stream).writeStream.outputMode("append").format("memory").queryName("emitted").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True)
    with runs.state_on_disk(spark):
        q.start().awaitTermination()
    got = spark.table("emitted").filter("idx is not null").select("doc", "idx", "content").collect()
    want = ordered.emitted_prefix(spark.createDataFrame(rows, schema)).collect()
    assert sorted(got) == sorted(want) and len(got) == 9
    for d in (1, 2):
        assert [r.idx for r in got if r.doc == d] == sorted(r.idx for r in got if r.doc == d)


def test_render_and_read_back(spark):
    rows = [(1, 0, "First line here\nsecond", "第一段译文", True), (1, 1, "Another source", "第二段译文", True), (1, 2, "lost", "", False)]
    results = spark.createDataFrame(rows, "doc long, idx int, original string, translation string, success boolean")
    text = rendering.render(results, True).first().markdown
    assert text.startswith("# 1 - 中文翻译（双语对照）") and "chunk 2" in text
    pairs = [(r.source, r.translation) for r in rendering.bilingual_pairs(rendering.render(results.filter("success"), True)).orderBy("nth").collect()]
    assert pairs == [("First line here\nsecond", "第一段译文"), ("Another source", "第二段译文")]


def test_artifacts(spark):
    clean = lambda t, s="epub": one(spark, t, lambda c: artifacts.clean_artifacts(c, s))
    assert clean("[*第一* 篇章]{.calibre2}\n\n![PIC](x/images/00005.jpg)\n{.calibre_2}") == "## *第一* 篇章\n\n![00005](images/00005.jpg)\n"
    assert clean("[NICK [LAND]{.calibre3x}]{.calibre9}") == "NICK LAND\n"
    assert clean("[]{#kindlepos123}\ntext", "kindle") == "text\n"
    assert clean("> 1\\) First item\n\n::: {}\n> <svg a>\n:::\nx") == "> 1) First item\n\nx\n"


def test_task_error_text(spark):
    rows = [(1, i, i == 11) for i in range(12)] + [(2, 0, True), (3, 0, False)]
    got = {r.task_id: r for r in tasks.final_status(spark.createDataFrame(rows, "task_id long, chunk_index int, success boolean")).collect()}
    assert got[1].status == "partial_success" and got[1].failed_chunks == "0, 1, 2, 3, 4, 5, 6, 7, 8, 9 ..."
    assert (got[2].status, got[3].status) == ("completed", "failed")


def test_format_markdown(spark):
    from lexweave.operators import markdown

    text = "# Chapter One {#c1 .t}\n\n::: quote\nQuoted line\n:::\n\n```python\nx  =  1\n```\n\n::: toc\n[Section](#section)\n:::\n\n![PIC](a/images/page1.png){width=3}"
    assert markdown.format_text(text) == "# Chapter One\n\n> Quoted line\n\n```python\nx  =  1\n```\n\n## 目录\n\n- [Section](#section)\n\n![page1](images/page1.png)\n"
    assert markdown.format_text("`[a]{.italic}` [b]{.italic}\n\n\n\n```\nopen") == "`[a]{.italic}` *b*\n\n```\nopen\n"


def test_profile_of_garbage_is_empty(spark):
    from lexweave.operators import markdown

    got = one(spark, "[1, 2]", markdown.parse_profile)
    assert got.summary == "" and got.style_notes == [] and got.section_overview == []


def test_scans(spark, tmp_path):
    from lexweave.sources import scans

    (tmp_path / "a.md").write_text("# A\n\nx", encoding="utf-8")
    row = scans.markdown_files(spark, str(tmp_path / "a.md")).first()
    assert (row.source_type, row.text) == ("markdown", "# A\n\nx")
    (tmp_path / "my_terms.json").write_text('{"b": "2", "a": "1"}', encoding="utf-8")
    (tmp_path / "bad.json").write_text("{", encoding="utf-8")
    listed = scans.glossary_listing(spark, str(tmp_path)).collect()
    assert [(r.glossary_id, r.name, r.term_count) for r in listed] == [("my_terms", "My Terms", 2)]
    terms = scans.glossary_terms(spark.createDataFrame([("g", '{"b": "2", "a": "1"}'), ("h", "{")], "glossary_id string, json string")).collect()
    assert [(r.pos, r.term) for r in terms] == [(0, "b"), (1, "a")]
    sent = spark.createDataFrame([("t", None), (None, "aGk="), ("t", "aGk="), (None, None)], "text string, content_base64 string")
    assert [(r.accepted, r.body) for r in scans.submissions(sent).collect()] == [(True, "t"), (True, "hi"), (False, None), (False, None)]
    (tmp_path / "set").mkdir()
    (tmp_path / "set" / "m.json").write_text('{"samples": [{"id": "1", "kind": "k", "source_file": "a.md"}]}', encoding="utf-8")
    assert scans.manifest(spark, str(tmp_path / "set" / "m.json")).first().source_file == "a.md"
    with pytest.raises(Exception, match="unsupported"):
        spark.createDataFrame([("x.doc",)], "p string").select(scans.source_type(F.col("p"))).collect()


class Analyst:
    def translate(self, prompt, text):
        if "fail" in text:
            raise ValueError("down")
        return 'so: {"summary": " s ", "style_notes": ["a"], "terms": [{"term": "New", "translation": "新", "note": ""}, {"term": "OLD", "translation": "旧"}]}'

    repair = translate


class Echo:
    """Answers with the prompt it got."""

    def translate(self, prompt, text):
        return prompt

    def repair(self, prompt, text):
        return prompt


def test_whole_documents(spark):
    """Equal documents keep apart, an empty one has no chunks, a failed analyst gives an empty profile, cached chunks don't meet the model."""
    docs = spark.createDataFrame([(1, "# A\n\nsame old"), (2, "# A\n\nsame old"), (3, None), (4, "fail")], "doc_id int, text string")
    known = spark.createDataFrame([(0, "old", "旧")], "pos int, term string, rendering string")
    empty = spark.createDataFrame([], "cache_key string, cached_translation string")
    got = {r.doc: r for r in document.translated_chunks(docs, known, Echo(), Analyst(), empty, repairs=0).collect()}
    assert set(got) == {1, 2, 4} and all(r.success and not r.cached for r in got.values())
    assert got[1].translation == got[2].translation and "文档摘要: s" in got[1].translation and "- old: 旧" in got[1].translation
    assert prompts.NO_PROFILE in got[4].translation and prompts.NO_GLOSSARY in got[4].translation
    pages = {r.doc: r.markdown for r in document.translated_documents(docs, known, True).collect()}
    assert "> # A" in pages[1] and pages[1].replace("# 1 ", "") == pages[2].replace("# 2 ", "")


def test_suggested_terms(spark):
    known = spark.createDataFrame([(0, "old", "旧")], "pos int, term string, rendering string")
    said = lambda t: [r.term for r in prompts.suggested_terms(spark.createDataFrame([(t,)], "text string"), known, Analyst()).collect()]
    assert said("x") == ["New"] and said("fail") == []


def test_a_large_glossary_is_listed_as_far_as_the_text_has_it(spark, monkeypatch):
    class Told:
        def translate(self, prompt, text):
            return '{"terms": [{"term": "%s", "translation": "x"}]}' % ("both" if "old" in prompt.split("Excerpt")[0] and "absent" not in prompt else "wrong")

    monkeypatch.setattr(prompts, "KNOWN", 8)
    known = spark.createDataFrame([(0, "old", "旧"), (1, "absent term", "无")], "pos int, term string, rendering string")
    doc = spark.createDataFrame([("an old stone",)], "text string")
    assert [r.term for r in prompts.suggested_terms(doc, known, Told()).collect()] == ["both"]


def test_evaluation_report(spark):
    runs = reporting.variant_runs(spark.createDataFrame([(1, "src", "译文")], "sample_id int, source string, translation string")).withColumn("terms", F.array().cast("array<struct<term:string,rendering:string>>"))
    verdicts = document.judged(runs.filter("ordinal = 0"), Echo(), '{"accuracy": 5, "fluency": "4.5", "rationale": "{source}"}')
    v = verdicts.first()
    assert (v.accuracy, v.fluency, v.terminology, v.rationale) == (5.0, 4.5, 3.0, "src")
    measured = runs.select(F.col("variant"), "sample_id", F.lit(7).alias("total_tokens"), F.lit(0.25).alias("latency_s"))
    scores = evaluation.variant_aggregate(measured, verdicts).withColumns({"ordinal": F.lit(0), "comparison": F.lit("engine")})
    phrases = spark.createDataFrame([("b c", 3, "", False), ("a b", 3, "译", True)], "phrase string, occurrences long, signature string, consistent boolean")
    text = document.report(scores, evaluation.consistency_summary(phrases), phrases, spark.createDataFrame([(7, 1)], "total_tokens long, calls long"))
    assert "| graph | 1 | 5.00 | 4.50 | 3.00 | 4.17 | 7 | 0.25 |" in text and "rate 50.00%: build-rag" in text and text.index("| a b | 3 | ✅ | 译 |") < text.index("| b c | 3 | ❌ | — |")


def test_template_and_names(spark):
    assert one(spark, "head\n---\n body\n---\nx\n", prompts.template_body) == "body\n---\nx" and one(spark, "all", prompts.template_body) == "all"
    assert [one(spark, t, sinks.download_name) for t in ("a/b.c.pdf", ".env", " .md", "")] == ["b.c", ".env", "translation", "translation"]
    assert one(spark, 'a"\n译', sinks.json_string) == '"a\\"\\n译"'


def test_texts_written_and_read(spark, tmp_path):
    sinks.write_texts(spark.createDataFrame([(1, "a\nb"), (2, "c")], "doc int, markdown string"), str(tmp_path / "out"))
    assert {r.doc: r.text for i in "12" for r in sinks.read_text(spark, str(tmp_path / "out"), i).collect()} == {"1": "a\nb", "2": "c"}


def test_model_is_asked_once(spark, tmp_path):
    """Every chunk's answer is written, so reading the result twice doesn't call again; only what needs repair is asked again."""

    class Counting:
        def __init__(self, folder):
            self.folder = folder

        def translate(self, prompt, text):
            import pathlib
            import uuid

            pathlib.Path(self.folder, f"{text}-{uuid.uuid4().hex}").touch()
            return "译文"

        repair = translate

    chunks = spark.createDataFrame([("a", "x"), ("b", "y old")], "chunk_id string, text string").selectExpr("*", "'S' AS section_title", "'' AS context_text")
    known = spark.createDataFrame([(0, "old", "旧")], "pos int, term string, rendering string")
    done = translate.translate_chunks(chunks, known, Counting(str(tmp_path)))
    assert done.count() == 2 and {r.chunk_id: r.passed for r in done.collect()} == {"a": True, "b": False}
    assert sorted(p.name.split("-")[0] for p in tmp_path.iterdir()) == ["x", "y old", "译文"]


def test_glossary_checks_stop_at_the_cap(spark):
    known = spark.createDataFrame([(i, f"term{i:02d}", f"译{i}号") for i in range(30)], "pos int, term string, rendering string")
    text = " ".join(f"term{i:02d}" for i in range(30))
    pairs = spark.createDataFrame([("a", text, "译文")], "id string, original string, translation string")
    assert G.adherence(pairs, known, "id").count() == 25 and G.adherence(pairs, known, "id", 40).count() == 30
    chunks = spark.createDataFrame([("a", text, "S", "")], "chunk_id string, text string, section_title string, context_text string")
    for n, options in ((25, {}), (30, {"max_checks": 40})):
        issues = translate.translate_chunks(chunks, known, attempts=0, **options).first().issues
        assert sum(i.kind == "terminology" for i in issues) == n


def test_merge_latest_has_one_result_on_ties(spark):
    schema = "k int, at int, v string"
    old = spark.createDataFrame([(1, 5, "a"), (1, 5, "z"), (2, 5, "z"), (3, 6, "o")], schema)
    new = spark.createDataFrame([(2, 5, "a"), (2, 5, "b"), (2, 5, "b"), (3, 5, "n")], schema)
    assert {tuple(r) for r in tasks.merge_latest(old, new, "k", "at").collect()} == {(1, 5, "z"), (2, 5, "b"), (3, 6, "o")}

"""Settings, calls to models, the task table, files: what isn't a query."""

import json
import os
import threading
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from lexweave import config
from lexweave.functions import text as X
from lexweave.operators import artifacts, assets, evaluation, prompts, rendering, translate
from lexweave.plans import document
from lexweave.sources import scans, sinks

TERMS = [(0, "apple", "苹果"), (1, "stone", "石头")]


@pytest.fixture
def terms(spark):
    return spark.createDataFrame(TERMS, "pos int, term string, rendering string")


# settings


def test_settings_and_fingerprint(tmp_path):
    a = config.Config({"api": {"model": "m", "translator": {"temperature": 0.3}}, "prompt": {"role": "r"}})
    assert a.get("api.model") == "m" and a.get("api.none.deeper", 5) == 5 and a.get("api.translator.temperature") == 0.3
    b = a.with_values(api__translator__temperature=0.5, new__x=1)
    assert a.get("api.translator.temperature") == 0.3 and b.get("new.x") == 1 and a.get("new") is None
    prints = {a.fingerprint(), b.fingerprint(), a.with_values(prompt__role="s").fingerprint(), a.with_values(translation_profile__name="paper").fingerprint()}
    assert len(prints) == 4 and a.fingerprint() == a.with_values(logging__level="x", paths__cache=None).fingerprint() != a.with_values(quality__repairs=2).fingerprint()
    for name in ("one", "two"):
        (tmp_path / f"{name}.json").write_text(json.dumps({"name": name}))
    assert config.current(str(tmp_path / "one.json")).get("name") == "one" and config.current().get("name") == "one"
    assert config.current(str(tmp_path / "two.json")).get("name") == "two"
    words = prompts.Wording()
    assert len({prompts.fingerprint(words), prompts.fingerprint(words, a), prompts.fingerprint(prompts.Wording(repairer="x"))}) == 3


def cleaner(spark):
    return lambda text, *options: spark.createDataFrame([(text,)], "t string").select(artifacts.clean_artifacts(F.col("t"), *options).alias("t")).first().t


def test_rules_merge(spark, tmp_path):
    sets = {"common": {"a": ["x"], "d": {"p": 1}, "n": 1}, "one": {"a": ["y"], "d": {"q": 2}, "n": 2}, "two": {"inherit_from": ["one"], "a": ["z"], "d": {"p": 3}}}
    assert artifacts.resolved("two", sets) == {"a": ["x", "y", "z"], "d": {"p": 3, "q": 2}, "n": 2} and artifacts.resolved("none", sets)["n"] == 1
    assert artifacts.load_rules(str(tmp_path / "no.json")) == {}
    (tmp_path / "r.json").write_text(json.dumps(sets))
    assert artifacts.load_rules(str(tmp_path / "r.json")) == sets
    assert cleaner(spark)("> *\n[]{#a}x\n> >", "epub", {}) == "> *\nx\n> >\n"


def test_artifacts_line_by_line(spark):
    clean = cleaner(spark)
    assert clean("> [Following,^[[3](#x)]{.small}^ Land]{.calibre_1}\n> > > >\n") == "> Following,^[3](#x)^ Land\n"
    assert clean("一]{.calibre6}：]{.Calibre6}狼\n") == "一：狼\n"
    assert clean("[[*]{.calibre_9}]{.calibre2}\n[[[By]{.calibre_1}]{.italic}]{.calibre2}\n[A.]{.calibre2}\n[B]{.calibre7}") == "## *By*\nA.\nB\n"
    assert clean("![x](a/b/c.png)\n![pic](x/images/a.b.png)\n![](n)") == "![x](c.png)\n![a.b](images/a.b.png)\n![n](n)\n"
    assert clean("![a](b.png)\n\n> {w=1} rest") == "![a](b.png) rest\n" and clean("> ::: {#p.mbp_pagebreak}\n> :::\n> x") == "> x\n"
    assert clean("::: {}\ntext\n:::\n") == "text\n:::\n" and clean("::: {}\n<svg>\n:::\nx") == "x\n"
    assert clean("[a [b]{.italic}](l)") == "[a [b](l)\n" and clean("[" * 20000 + "]{.x}") == "[" * 19999 + "\n"
    assert clean("]{.orphan}\n{.c}\n[ ]{.d}\nx") == "x\n" and clean("") == "\n"


def test_divs_take_many_lines_and_passes_their_order(spark):
    clean = cleaner(spark)
    assert clean("::: {}\n" + "line\n" * 50_000 + "<svg>\n:::\nx") == "x\n"
    assert clean("::: {}\n" + "line\n" * 3 + ":::\nx") == "line\nline\nline\n:::\nx\n"
    assert clean("> ::: {#p.mbp_pagebreak}\nx\n::: {#q.mbp_pagebreak}\n:::") == "x\n"
    # Page breaks go first, so attributes may stand below one.
    assert clean("![a](b.png)\n::: {#p.mbp_pagebreak}\n{.c} rest") == "![a](b.png) rest\n"
    assert clean(None) is None and clean("\r\n a \u2028b\n\n\n\n c") == "a \nb\n\n c\n"


# models


def test_token_bucket_by_hand():
    clock, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        clock[0] += s

    bucket = translate.TokenBucket(2, 60, lambda: clock[0], sleep)
    for _ in range(4):
        bucket.acquire()
    assert slept == [30.0, 30.0]
    clock[0] += 600
    for _ in range(2):
        bucket.acquire()
    assert len(slept) == 2


class Slow:
    """Tells how many calls were under way at once, by files."""

    def __init__(self, folder):
        self.folder = folder

    def translate(self, prompt, text):
        mine = os.path.join(self.folder, f"{os.getpid()}-{threading.get_ident()}")
        open(mine, "w").close()
        most = len(os.listdir(self.folder))
        time.sleep(0.05)
        os.remove(mine)
        return {"content": [{"text": f"{most}"}], "usage_metadata": {"input_tokens": 2, "output_tokens": 3}}


def test_calls_in_flight_are_bounded(spark, tmp_path):
    rows = spark.range(60).select(F.lit("p").alias("prompt"), F.col("id").cast("string").alias("text"))
    told = translate.call_model(rows, Slow(str(tmp_path)), "translate", limits=translate.Limits(8, None)).collect()
    most = max(int(r.answer) for r in told)
    assert len(told) == 60 and 2 <= most <= 8 and {r.tokens for r in told} == {5} and min(r.duration for r in told) >= 0.05


def test_what_models_give():
    class Said:
        content = "x"
        usage_metadata = None

    assert translate.said_text("a") == ("a", None) and translate.said_text(Said()) == ("x", None)
    assert translate.said_text(["a", {"text": "b"}, {"type": "image"}]) == ("ab", None)
    assert translate.said_text({"content": "c", "usage": {"total_tokens": 9, "prompt_tokens": 1}}) == ("c", 9) and translate.said_text(("d", 1, 2)) == ("d", 3)


class Echo:
    """Leaves its text as it is; repairs by what the prompt says."""

    def __init__(self, log):
        self.log = log

    def _note(self, what):
        with open(self.log, "a") as f:
            f.write(what + "\n")

    def translate(self, prompt, text):
        self._note("translate")
        return f"译文 {text}"

    def repair(self, prompt, text):
        self._note("repair")
        assert "apple -> 苹果" in prompt and "- apple: 苹果" in prompt and "Part > One" in prompt, prompt
        return text.replace("apple", "苹果")


def chunk(spark, *texts):
    rows = [(str(i), t, "One", "", ["Part", "One"]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "chunk_id string, text string, section_title string, context_text string, section_path array<string>")


def test_repair_sees_the_issues(spark, terms, tmp_path):
    log = str(tmp_path / "log")
    got = {r.chunk_id: r for r in translate.translate_chunks(chunk(spark, "an apple", "nothing"), terms, Echo(log), attempts=3).collect()}
    assert got["0"].translation == "译文 an 苹果" and got["0"].repaired and got["0"].passed and not got["1"].repaired
    assert sorted(open(log).read().split()) == ["repair", "translate", "translate"]
    off = translate.translate_chunks(chunk(spark, "an apple"), terms, Echo(log), qa=False).first()
    assert off.passed and off.issues == [] and off.translation == "译文 an apple"


def test_a_second_run_calls_nothing(spark, terms, tmp_path):
    log = str(tmp_path / "log")
    docs = spark.createDataFrame([(1, "# Part\n\n## One\n\nan apple"), (2, "a stone")], "doc_id long, text string")
    none = spark.createDataFrame([], "cache_key string, cached_translation string")

    class Plain(Echo):
        def repair(self, prompt, text):
            self._note("repair")
            return text.replace("apple", "苹果").replace("stone", "石头")

    first = document.translated_chunks(docs, terms, Plain(log), cache=none)
    cache = document.cache_updates(first)
    cache.write.parquet(str(tmp_path / "cache"))
    cache = spark.read.parquet(str(tmp_path / "cache"))
    calls = open(log).read()
    again = document.translated_chunks(docs, terms, Plain(log), cache=cache)
    same = ["doc", "idx", "chunk", "translation"]
    assert sorted(again.select(same).collect()) == sorted(first.select(same).collect()) and all(r.cached for r in again.collect())
    assert open(log).read() == calls and document.cache_updates(again).count() == 0
    other = document.translated_chunks(docs, terms, Plain(log), cache=cache, words=prompts.Wording(repairer="another"))
    assert not any(r.cached for r in other.collect())


class Broken:
    def translate(self, prompt, text):
        raise ValueError("no")


def test_failed_chunks_have_one_issue(spark, terms):
    r = document.translated_chunks(spark.createDataFrame([(1, "an apple")], "doc_id long, text string"), terms, Broken()).first()
    assert (r.success, r.passed, r.issue_count, r.translation) == (False, False, 1, "[翻译失败: no]")
    out = document.run_result(document.translated_chunks(spark.createDataFrame([(1, "a")], "doc_id long, text string"), terms, Broken())).first()
    assert (out.translation, out.failed_chunks, out.ok, out.bad) == ("", [0], 0, 1)


def test_variants_do_what_they_say(spark, terms, tmp_path):
    samples = spark.createDataFrame([("s", "an apple")], "sample_id string, text string")

    class Told(Echo):
        def translate(self, prompt, text):
            return f"{'T' if '苹果' in prompt else 't'} {text}", 4, 6

        def repair(self, prompt, text):
            return text + " 苹果"

    got = {(r.comparison, r.variant): r for r in document.variants_run(samples, terms, Told(str(tmp_path / "log"))).collect()}
    assert len(got) == 6 and got["engine", "native"].translation == "T an apple 苹果" and got["roles", "off"].translation == "T an apple"
    assert got["glossary", "off"].translation == "t an apple" and got["roles", "off"].calls == 1 and got["roles", "on"].calls == 2 and got["roles", "off"].total_tokens == 10
    totals = spark.createDataFrame([("engine", 1, "native", 2.5), ("engine", 0, "graph", 3.0)], "comparison string, ordinal int, variant string, mean double")
    assert [v.variant for v in document.comparison_groups(totals).first().variants] == ["graph", "native"]
    phrases = spark.createDataFrame([("a b", 2, True, "甲乙"), ("c d", 3, False, "")], "phrase string, occurrences long, consistent boolean, signature string")
    told = json.loads(document.report_json(totals, evaluation.consistency_summary(phrases), phrases, spark.sql("select 5L as total_tokens, 2L as calls"), {"date": "d"}).first().json)
    assert told["meta"] == {"date": "d"} and told["cost"] == {"total_tokens": 5, "total_calls": 2} and [p["phrase"] for p in told["consistency"]["phrases"]] == ["c d", "a b"]
    assert told["comparisons"][0]["variants"][1] == {"variant": "native", "mean": 2.5} and told["consistency"]["rate"] == 0.5


def test_last_verdict_counts(spark):
    runs = spark.createDataFrame([("v", "s", 1, 1.0)], "variant string, sample_id string, total_tokens long, latency_s double")
    verdicts = spark.createDataFrame([(0, "s", 1.0, 1.0, 1.0), (1, "s", 4.0, 5.0, 3.0)], "nth int, sample_id string, accuracy double, fluency double, terminology double")
    r = evaluation.variant_aggregate(runs, verdicts).first()
    assert (r.n, r.mean_accuracy, r.mean_overall) == (1, 4.0, 4.0)


def test_many_terms_by_an_automaton(spark):
    from lexweave.operators import glossary as G

    listed = [(i, f"T{i}x" if i % 7 else "", f"r{i}") for i in range(120)] + [(200, "ÉTÉ", "e"), (201, "t5x", "twice"), (202, None, "none")]
    known = spark.createDataFrame(listed, "pos int, term string, rendering string")
    texts = spark.createDataFrame([(1, "a t5X b été t13x"), (2, ""), (3, None), (4, "nothing")], "id long, text string")
    want = sorted((i, p) for i, t in ((1, "a t5x b été t13x"), (4, "nothing")) for p, term, _ in listed if term is not None and term.lower() in t)
    for small in (1 << 20, 0):
        assert sorted((r.id, r.pos) for r in G.matches(texts, known, small=small).collect()) == want
    assert G.matches(texts, known).columns == ["id", "text", "pos", "term", "rendering"]


# files


def test_images_are_copied_and_zipped(spark, tmp_path):
    (tmp_path / "in/7/deep").mkdir(parents=True)
    (tmp_path / "in/7/deep/a.png").write_bytes(b"\x00png")
    docs = spark.createDataFrame([(7, "![](x/a.png) ![b](no.png)", [str(tmp_path / "in/7")])], "doc long, markdown string, roots array<string>")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path / "in")).select(F.regexp_replace("path", "^file:/+", "/").alias("path"))
    found = assets.resolved_images(docs, files)
    out = str(tmp_path / "assets")
    assert [r.bytes for r in assets.copy_files(assets.copies(found, out)).collect()] == [4]
    assert open(f"{out}/7/a.png", "rb").read() == b"\x00png"
    moved = assets.synced(docs, found, "assets").first()
    assert moved.markdown == "![](assets/7/a.png) ![b](assets/7/no.png)" and moved.assets == ["a.png"]
    both = spark.createDataFrame([(7, ["b", "a"]), (7, ["b"])], "doc long, assets array<string>")
    assert assets.variant_assets(both).first().assets == ["a", "b"]
    names = zipfile.ZipFile(assets.zip_folder(f"{out}/7", str(tmp_path / "z/7.zip"), "assets/7")).namelist()
    assert names == ["assets/7/a.png"] and zipfile.ZipFile(assets.zip_folder(str(tmp_path / "none"), str(tmp_path / "e.zip"), "x")).namelist() == []


def test_texts_are_written_by_groups_and_found(spark, tmp_path):
    docs = spark.range(500).select(F.col("id").alias("doc"), F.concat(F.lit("text\n"), F.col("id").cast("string")).alias("markdown"))
    sinks.write_texts(docs, str(tmp_path / "out"), groups=8)
    assert len([d for d in os.listdir(tmp_path / "out") if d.startswith("part=")]) == 8
    assert sinks.read_text(spark, str(tmp_path / "out"), "37", 8).first().text == "text\n37"


def test_manifest_samples(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s/a.md").write_text("one\ntwo")
    (tmp_path / "s/g.json").write_text('{"apple": "苹果"}')
    (tmp_path / "m.json").write_text(json.dumps({"samples": [{"id": "1", "kind": "k", "source_file": "s/a.md", "glossary_file": "s/g.json"}, {"id": "2", "kind": "k", "source_file": "s/a.md"}]}))
    got = {r.id: (r.source_text, r.entries) for r in scans.samples(spark, str(tmp_path / "m.json")).collect()}
    assert got == {"1": ("one\ntwo", {"apple": "苹果"}), "2": ("one\ntwo", {})}


def test_glossary_sinks(spark):
    stored = spark.createDataFrame([("a", '{"x": "y"}'), ("b", "bad"), ("c", "{}")], "glossary_id string, json string")
    assert scans.glossary_by_id(stored, "a").first().entries == {"x": "y"} and scans.glossary_by_id(stored, "b").count() == 0 == scans.glossary_by_id(stored, "z").count()
    edited = sinks.edited_glossaries(stored, spark.createDataFrame([("a", "{}")], stored.schema), stored.filter("glossary_id = 'b'").select("glossary_id"))
    assert sorted(map(tuple, edited.collect())) == [("a", "{}"), ("c", "{}")]
    candidates = spark.createDataFrame([(1, "b", "乙"), (0, "a", "甲")], "pos int, term string, translation string")
    assert prompts.term_map(candidates).first().entries == {"a": "甲", "b": "乙"}


def test_rendered_texts(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(rendering.header(F.lit("n"), False, F.lit("n.md"))) == "# n - 中文翻译\n\n> 由 AI 自动翻译\n> 源文件: n.md\n\n"
    assert one(rendering.stream_format(F.lit("a\n\n![x](p.png)\nb"), F.lit("译 ![x](p.png)"))) == "> a\n\n> b\n\n译 ![x](p.png)\n\n---"
    assert one(X.breadcrumb(F.array().cast("array<string>"))) == "Document Root"
    assert one(X.markdown_to_html(F.lit("![](a/b.c.png)"))) == '<p><img src="a/b.c.png" alt="b.c"></p>' and one(X.score(F.lit("no object"), "fluency")) is None
    assert one(sinks.upload_path(F.lit("t"), F.lit("x/f.md"), "up")) == "up/t_f.md"
    text = "# t - 中文翻译（双语对照）\n\n> 由 AI 自动翻译\n> 源文件: t.md\n\n\n\n> Some source\n\n一些译文\n\n---\n\n\n\n> 由 AI 自动翻译 words\n\n一些译文\n\n---\n\n"
    docs = spark.createDataFrame([(1, text)], "doc long, markdown string")
    shown = rendering.preview(docs).first()
    assert shown["count"] == 1 and shown.paragraphs[0].source == "Some source"
    assert one(rendering.looks_bilingual(F.lit("x\n> a\n---"))) and not one(rendering.looks_bilingual(F.lit("x" * 4000 + "（双语对照）")))
    hits = spark.createDataFrame([("t", 0, "c", "x")], "task_id string, idx int, chunk_id string, cached_translation string")
    assert rendering.hit_events(hits).first().asDict() == {"task_id": "t", "chunk_index": 0, "chunk_id": "c", "status": "completed", "translation": "x", "duration": 0.0, "cached": True}


def test_workers_get_the_package_from_the_session(tmp_path):
    """Neither the working folder nor PYTHONPATH leads to the package: only what the driver sends does."""
    import subprocess
    import sys

    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = f"""
import sys
sys.path.insert(0, {top!r})
from pyspark.sql import functions as F
from lexweave.session import build_session
from lexweave.operators import artifacts, chunking, markdown, translate
from lexweave.streaming import ordered
spark = build_session("local[2]", "shipped", 2, "1g")
docs = spark.createDataFrame([(1, "# A\\n\\nb")], "doc_id long, text string")
assert chunking.chunks_of(docs).count() == 1
assert docs.select(markdown.format_markdown(F.col("text")), artifacts.clean_artifacts(F.col("text"))).count() == 1
assert translate.call_model(docs.withColumn("prompt", F.lit("p")), translate.StubModel(), "translate").first().answer == "译文：# A\\n\\nb"
assert ordered.limiter_waits(spark.sql("select 1L as key, 1L as call_id, 0D as at"), 1, 1.0).first().wait == 0
print("shipped")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.stdout.strip() == "shipped", done.stderr[-2000:]

"""Registered queries over the engine's operators, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.functions import text as X
from lexweave.operators import artifacts, assets, chunking, evaluation, markdown, prompts, rendering, reporting, tasks, translate, usage
from lexweave.operators import glossary as G
from lexweave.plans import document
from lexweave.sources import database, scans, sinks
from lexweave.streaming import ordered, queue, runs, watch
from lexweave.tables import dealt, shared_folder, written

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

#: A small glossary over the invented languages of the test data.
TERMS = [(0, "tion", "行动 (tion)"), (1, "heit", "自由"), (2, "ment", "时刻 (ment)"), (3, "eau", "水"), (4, "the and", "与"), (5, "ción", "译文"), (6, "Thering", "环 (x)"), (7, "zzz", "无")]
TERMS_SQL = "(VALUES " + ", ".join(f"({p}, '{t}', '{r}')" for p, t, r in TERMS) + ") g(pos, term, rendering)"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def terms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TERMS, "pos int, term string, rendering string")


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and their stub translation."""
    return table(spark, sf, "documents").select("doc_id", F.col("text").alias("original"), F.concat(F.lit("译文："), "text").alias("translation"))


# --- glossary and quality -------------------------------------------------------------------------------------------


@query(f"""SELECT lang, term, count(*) AS docs FROM documents, {TERMS_SQL}
WHERE contains(lower(text), lower(term)) GROUP BY lang, term""")
def glossary_match(spark, sf):
    found = G.matches(table(spark, sf, "documents").select("lang", "text"), terms(spark))
    return found.groupBy("lang", "term").agg(F.count("*").alias("docs"))


ADHERENCE = f"""SELECT *, contains(t, rendering) OR (trim(split_part(rendering, ' (', 1)) <> '' AND contains(t, trim(split_part(rendering, ' (', 1)))) AS kept FROM (
SELECT doc_id, lang, '译文：' || text AS t, pos, term, rendering, row_number() OVER (PARTITION BY doc_id ORDER BY length(term) DESC, pos) AS nth
FROM documents, {TERMS_SQL} WHERE contains(lower(text), lower(term))) WHERE nth <= 25"""


@query(f"SELECT doc_id, nth, term, kept FROM ({ADHERENCE})")
def glossary_adherence(spark, sf):
    return G.adherence(pairs(spark, sf), terms(spark), "doc_id").select("doc_id", F.col("nth").cast("long").alias("nth"), "term", "kept")


SPAN = "[A-Za-z]+(?:[ \\t\\n\\r\\f\\v]+[A-Za-z]+){11,}"


@query(f"SELECT doc_id, substr(regexp_extract(text, '{SPAN}'), 1, 80) AS span FROM documents WHERE regexp_matches(text, '{SPAN}')")
def untranslated_spans(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.substring(X.untranslated_span(F.col("text")), 1, 80).alias("span")).filter("span <> ''")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 0 END AS issues
FROM documents WHERE doc_id % 3 = 0 OR doc_id % 2 = 0""")
def markdown_parity(spark, sf):
    """Documents under a heading with an image, against copies that have lost the one or the other."""
    body = F.concat(F.lit("# T\n\n![x](a.png)\n\n"), "text")
    cut = F.when(F.col("doc_id") % 3 == 0, F.replace(body, F.lit("# T\n"), F.lit("T\n"))).otherwise(body)
    cut = F.when(F.col("doc_id") % 2 == 0, F.replace(cut, F.lit("![x](a.png)"), F.lit(""))).otherwise(cut)
    return table(spark, sf, "documents").select("doc_id", F.size(X.markdown_issues(body, cut)).alias("issues")).filter("issues > 0")


@query()
def repetition_flags(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.repetition_issue(F.col("text")).isNotNull().alias("repeats")).filter("repeats")


@query(f"""WITH a AS ({ADHERENCE}), m AS (SELECT doc_id, count(*) AS n FROM a WHERE NOT kept GROUP BY doc_id),
q AS (SELECT lang, CASE WHEN regexp_matches(text, '{SPAN}') THEN 1 ELSE 0 END AS u, coalesce(n, 0) AS n FROM documents LEFT JOIN m USING (doc_id))
SELECT lang, count(*) AS docs, CAST(sum(u) AS BIGINT) AS untranslated, CAST(sum(n) AS BIGINT) AS terminology FROM q GROUP BY lang""")
def qa_report_by_lang(spark, sf):
    """Minimum slice: scan, theta join, ranked checks, validators and counts of issues by language."""
    docs = dealt(table(spark, sf, "documents").select("doc_id", "lang", F.col("text").alias("original"))).withColumn("translation", F.concat(F.lit("译文："), "original"))
    reports = G.quality_reports(docs, terms(spark), "doc_id")
    of = lambda kind: F.sum(F.size(F.filter("issues", lambda i: i["kind"] == kind))).cast("long").alias(kind)
    return reports.groupBy("lang").agg(F.count("*").alias("docs"), of("untranslated"), of("terminology"))


# --- chunking -------------------------------------------------------------------------------------------------------


def _chunks_sql(limit: int = 3600, shortest: int = 1296, window: int = 1400) -> str:
    """Plans of documents without headings, fences and blank lines: each is one block, cut at separators and refilled, then short pieces merged."""
    strip = lambda x: f"trim({x}, ' ' || chr(9) || chr(10) || chr(13))"
    out = [f"p0 AS (SELECT doc_id, [0] AS pos, {strip('text')} AS t FROM documents WHERE {strip('text')} <> '')"]
    for k, cut in enumerate(chunking.CUTS, 1):
        sep = "'" + cut.replace("\n", "' || chr(10) || '") + "'"
        longer = strip(f"CASE WHEN held <> '' THEN held || {sep} || part ELSE part END")
        full = f"held <> '' AND length({longer}) > {limit}"
        out.append(f"""w{k} AS (SELECT doc_id, pos, unnest(l) AS part, generate_subscripts(l, 1) AS i, len(l) AS n FROM (SELECT doc_id, pos, string_split(t, {sep}) AS l FROM p{k - 1} WHERE length(t) > {limit} AND contains(t, {sep}))),
f{k} AS (SELECT doc_id, pos, i, n, {strip('part')} AS held, NULL::VARCHAR AS emit FROM w{k} WHERE i = 1
UNION ALL SELECT w.doc_id, w.pos, w.i, w.n, CASE WHEN {full} THEN part ELSE {longer} END, CASE WHEN {full} THEN {strip('held')} END FROM f{k} f JOIN w{k} w ON w.doc_id = f.doc_id AND w.pos = f.pos AND w.i = f.i + 1),
p{k} AS (SELECT doc_id, list_append(pos, 0) AS pos, t FROM p{k - 1} WHERE NOT (length(t) > {limit} AND contains(t, {sep}))
UNION ALL SELECT doc_id, list_append(pos, 2 * i), emit FROM f{k} WHERE emit IS NOT NULL
UNION ALL SELECT doc_id, list_append(pos, 2 * i + 1), {strip('held')} FROM f{k} WHERE i = n AND {strip('held')} <> '')""")
    last = len(chunking.CUTS)
    out.append(f"""cut AS (SELECT doc_id, pos, g, substr(t, 1 + g * {limit}, {limit}) AS t FROM p{last}, LATERAL (SELECT unnest(range(0, greatest(1, CAST(ceil(length(t) / {limit}) AS BIGINT)))) AS g)),
num AS (SELECT doc_id, t, row_number() OVER (PARTITION BY doc_id ORDER BY pos, g) AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM cut),
mrg AS (SELECT doc_id, i, n, t AS held, NULL::VARCHAR AS emit FROM num WHERE i = 1
UNION ALL SELECT m.doc_id, m.i, m.n, CASE WHEN length(held) < {shortest} AND length(held) + 2 + length(t) <= {limit} THEN held || chr(10) || chr(10) || t ELSE t END,
CASE WHEN length(held) < {shortest} AND length(held) + 2 + length(t) <= {limit} THEN NULL ELSE held END FROM mrg f JOIN num m ON m.doc_id = f.doc_id AND m.i = f.i + 1),
fin AS (SELECT doc_id, t, row_number() OVER w AS k, count(*) OVER (PARTITION BY doc_id) AS n, lead(t) OVER w AS after, lag(t) OVER w AS before
FROM (SELECT doc_id, i * 2 AS o, emit AS t FROM mrg WHERE emit IS NOT NULL UNION ALL SELECT doc_id, i * 2 + 1, held FROM mrg WHERE i = n) WINDOW w AS (PARTITION BY doc_id ORDER BY o)),
tail AS (SELECT doc_id, k - 1 AS idx, CASE WHEN k = n - 1 AND length(after) < {shortest} AND length(t) + 2 + length(after) <= {limit} THEN t || chr(10) || chr(10) || after ELSE t END AS t
FROM fin WHERE NOT (k = n AND n > 1 AND length(t) < {shortest} AND length(before) + 2 + length(t) <= {limit}))""")
    return f"""WITH RECURSIVE {', '.join(out)}
SELECT doc_id, CAST(idx AS INT) AS idx, printf('chunk-%04d-', idx) || substr(sha1(idx || '||' || t), 1, 12) AS chunk_id, length(t) AS chars,
sha1(CASE WHEN idx = 0 THEN '' ELSE '上一块章节: Document Root' || chr(10) || chr(10) || '上一块末尾:' || chr(10) || right(lag(t) OVER (PARTITION BY doc_id ORDER BY idx), {window}) END) AS context
FROM tail"""


@query(_chunks_sql())
def document_chunks(spark, sf):
    """The plan of every document, with each chunk's identity and context."""
    return chunking.chunks_of(table(spark, sf, "documents")).select("doc_id", "idx", "chunk_id", F.char_length("text").cast("long").alias("chars"), F.sha1("context_text").alias("context"))


@query("""SELECT event_id, printf('chunk-%04d-', event_id + 9000) || substr(sha1((event_id + 9000) || '|' || event_type || ' > ' || user_id || '|' || props), 1, 12) AS chunk_id, event_type || ' > ' || user_id AS breadcrumb FROM events""")
def chunk_identity(spark, sf):
    """Identities of chunks in sections of two levels, with indexes below and above 9999."""
    path = F.array("event_type", F.col("user_id").cast("string"))
    return table(spark, sf, "events").select("event_id", X.chunk_id(F.col("event_id") + 9000, path, F.col("props")).alias("chunk_id"), X.breadcrumb(path).alias("breadcrumb"))


def books(spark, sf) -> DataFrame:
    """A book a source and hundred documents: a heading, then by language a heading and paragraphs."""
    docs = table(spark, sf, "documents").withColumn("book", F.concat_ws("-", "source", F.floor(F.col("doc_id") / 100).cast("string")))
    docs = docs.groupBy("book", "lang").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda d: d["text"]), "\n\n").alias("body"))
    part = F.concat(F.lit("## "), "lang", F.lit("\n\n"), "body")
    return docs.select("book", "lang", part.alias("part")).groupBy("book").agg(F.concat(F.lit("# "), F.col("book"), F.lit("\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lang", "part"))), lambda p: p["part"]), "\n\n")).alias("text"))


@query()
def book_chunks(spark, sf):
    chunks = chunking.chunks_of(books(spark, sf), id_col="book")
    return chunks.groupBy("book", "section_title").agg(F.count("*").alias("chunks"), F.max(F.char_length("text")).alias("longest"), F.bit_xor(F.xxhash64("chunk_id")).alias("ids"))


@query("""SELECT conv_id, turn, concat_ws(chr(10) || chr(10), '当前章节: ' || role,
  CASE WHEN lag(role) OVER w <> role THEN '上一块章节: ' || lag(role) OVER w END,
  CASE WHEN lag(text) OVER w <> '' THEN '上一块末尾:' || chr(10) || right(lag(text) OVER w, 40) END) AS context
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def chunk_context(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("idx"), "text", F.array("role").alias("section_path"), F.col("role").alias("section_title"))
    return chunking.with_context(turns, 40, "conv_id").select("conv_id", F.col("idx").alias("turn"), F.col("context_text").alias("context"))


@query("""SELECT doc_id, nth, fence, count(*) FILTER (WHERE fence) OVER (PARTITION BY doc_id ORDER BY nth) % 2 = 1 AS inside FROM (SELECT doc_id, nth, starts_with(trim(line), '```') AS fence
FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS nth FROM (SELECT doc_id, string_split(replace(text, '. ', '.' || chr(10) || ' ```x' || chr(10)), chr(10)) AS l FROM documents)))""")
def fence_parity(spark, sf):
    """Which lines lie in a fence, in documents whose sentences are parted by fences."""
    fenced = table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit(". "), F.lit(".\n ```x\n")).alias("text"))
    return chunking.fenced_lines(fenced).select("doc_id", F.col("nth").cast("long").alias("nth"), "fence", "inside")


# --- cache and cleaning ---------------------------------------------------------------------------------------------


@query(f"""WITH r AS (SELECT doc_id, string_agg(term || ':' || rendering, chr(10) ORDER BY term, rendering) AS lines FROM documents, {TERMS_SQL}
WHERE contains(lower(text), lower(term)) GROUP BY doc_id)
SELECT doc_id, sha1('v4|p|stub|' || doc_id || '|' || substr(sha1(lang || '|||'), 1, 12) || '|' || coalesce(lines, '')) AS cache_key FROM documents LEFT JOIN r USING (doc_id)""")
def cache_key(spark, sf):
    docs = table(spark, sf, "documents")
    found = G.matches(docs.select("doc_id", "text"), terms(spark)).groupBy(F.col("doc_id").alias("d")).agg(F.collect_list(F.struct("term", "rendering")).alias("found"))
    none = F.array().cast("array<string>")
    profile = X.profile_fingerprint(F.col("lang"), none, none, none)
    return docs.join(found, F.col("doc_id") == F.col("d"), "left").select("doc_id", X.cache_key("v4", "p", "stub", F.col("doc_id").cast("string"), profile, F.col("found")).alias("cache_key"))


@query("SELECT doc_id % 3 = 0 AS cached, count(*) AS chunks, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY 1")
def cache_hit_split(spark, sf):
    chunks = table(spark, sf, "documents").withColumn("cache_key", F.sha1(F.col("doc_id").cast("string").cast("binary"))).select("doc_id", "cache_key", "text")
    cache = chunks.filter("doc_id % 3 = 0").select("cache_key", F.col("text").alias("cached_translation"))
    hits, misses = rendering.cache_split(chunks, cache)
    both = hits.select("cached", F.col("cached_translation").alias("t")).unionByName(misses.select(F.lit(False).alias("cached"), F.col("text").alias("t")))
    return both.groupBy("cached").agg(F.count("*").alias("chunks"), F.sum(F.char_length("t")).cast("long").alias("chars"))


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey % 2 DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1""")
def cache_upsert(spark, sf):
    """The latest row of a key wins (orders of a customer as a cache's writes); ties go to new rows, then to the largest other columns."""
    orders = table(spark, sf, "orders")
    merged = tasks.merge_latest(orders.filter("o_orderkey % 2 = 0"), orders.filter("o_orderkey % 2 = 1"), "o_custkey", "o_orderdate")
    return merged.select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT doc_id, 'Text of ' || doc_id || ' in ' || lang AS cleaned FROM documents")
def clean_boilerplate(spark, sf):
    said = F.concat(F.lit("Here is the translation: "), F.lit("Text of "), F.col("doc_id").cast("string"), F.lit("（注：无关说明） in "), "lang", F.lit(" (注：x)【修正后的译文】：\n```"))
    return table(spark, sf, "documents").select("doc_id", X.clean_output(said).alias("cleaned"))


@query()
def collapse_loops(spark, sf):
    """Documents with loops appended, as a model's answer that ran on."""
    looped = F.concat("text", F.repeat(F.lit("循环"), 12), F.repeat(F.lit("the same phrase "), 20), F.lit("结束。。。。。。"))
    return table(spark, sf, "documents").select("doc_id", F.sha2(X.clean_output(looped), 256).alias("cleaned"))


@query()
def repair_loop(spark, sf):
    """Documents through the stub model, with one round of repair."""
    chunks = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "text", F.lit("Document Root").alias("section_title"), F.lit("").alias("context_text"))
    done = translate.translate_chunks(chunks, terms(spark).withColumn("pos", F.col("pos").cast("int")))
    return done.groupBy("success", "repaired", "passed").agg(F.count("*").alias("chunks"))


# --- evaluation -----------------------------------------------------------------------------------------------------


@query("""SELECT doc_id, CAST(least(5, greatest(1, quality * 9)) AS DOUBLE) AS accuracy, CAST(least(5, greatest(1, toxic * 4)) AS DOUBLE) AS fluency, 3.0::DOUBLE AS terminology, 'r' || doc_id AS rationale FROM labels""")
def judge_scores(spark, sf):
    raw = F.concat(F.lit("```json {\"accuracy\": "), (F.col("quality") * 9).cast("string"), F.lit(", \"fluency\": \""), (F.col("toxic") * 4).cast("string"), F.lit("\", \"rationale\": \"r"), F.col("doc_id").cast("string"), F.lit("\"} ```"))
    return table(spark, sf, "labels").select("doc_id", raw.alias("raw")).select("doc_id", *[X.score(F.col("raw"), n).alias(n) for n in ("accuracy", "fluency", "terminology")], X.rationale(F.col("raw")).alias("rationale"))


@query("""SELECT source AS variant, count(*) AS n, round(avg(quality * 4 + 1), 3) AS mean_accuracy, round(avg(5 - toxic), 3) AS mean_fluency, round(avg(3.0), 3)::DOUBLE AS mean_terminology,
round(avg(round((quality * 4 + 1 + 5 - toxic + 3.0::DOUBLE) / 3, 3)), 3) AS mean_overall, round(avg(n_chars / 8.0::DOUBLE), 3) AS mean_latency_s, CAST(sum(n_chars) AS BIGINT) AS tokens
FROM documents JOIN labels USING (doc_id) GROUP BY source""")
def variant_aggregate(spark, sf):
    runs = table(spark, sf, "documents").select(F.col("source").alias("variant"), F.col("doc_id").alias("sample_id"), F.col("n_chars").alias("total_tokens"), (F.col("n_chars") / 8.0).alias("latency_s"))
    verdicts = table(spark, sf, "labels").select(F.col("doc_id").alias("sample_id"), (F.col("quality") * 4.0 + 1).alias("accuracy"), (5.0 - F.col("toxic")).alias("fluency"), F.lit(3.0).alias("terminology"))
    return evaluation.variant_aggregate(runs, verdicts)


@query("""SELECT c AS comparison, v AS variant, count(*) AS samples FROM labels, (VALUES ('engine', 'graph'), ('engine', 'native'), ('roles', 'on'), ('roles', 'off'), ('glossary', 'on'), ('glossary', 'off')) m(c, v) GROUP BY c, v""")
def variant_matrix(spark, sf):
    return reporting.variant_runs(table(spark, sf, "labels").select("doc_id")).groupBy("comparison", "variant").agg(F.count("*").alias("samples"))


def segments(spark, sf) -> DataFrame:
    """A user's turn and the assistant's answer to it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("r2"), F.lead("text").over(w).alias("t2"))
    return c.filter("role = 'user' AND r2 = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("seg"), F.col("text").alias("source"), F.concat(F.lit("译文："), "t2").alias("translation"))


STOP = ", ".join(f"'{s}'" for s in evaluation.STOPWORDS)
GRAMS_SQL = f"""seg AS (SELECT conv_id * 1000 + turn AS seg, text FROM (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS r2 FROM conversations) WHERE role = 'user' AND r2 = 'assistant'),
sent AS (SELECT seg, unnest(regexp_split_to_array(text, '[.!?;:\\n]+')) AS s FROM seg),
tok AS (SELECT seg, list_transform(regexp_extract_all(s, '[A-Za-z][A-Za-z''\\-]*'), lambda x: lower(x)) AS w FROM sent),
ng AS (SELECT seg, n, unnest(list_transform(range(1, greatest(len(w) - n + 2, 1)), lambda i: w[i:i + n - 1])) AS g FROM tok, (VALUES (2), (3), (4)) v(n)),
df AS (SELECT array_to_string(g, ' ') AS phrase, count(DISTINCT seg) AS occurrences, string_agg(DISTINCT seg, ',' ORDER BY seg) AS k FROM ng WHERE g[1] NOT IN ({STOP}) AND g[-1] NOT IN ({STOP}) GROUP BY 1)"""


@query(f"WITH {GRAMS_SQL} SELECT phrase, occurrences FROM df")
def ngram_df(spark, sf):
    return evaluation.phrase_segments(segments(spark, sf)).groupBy("phrase").agg(F.count("*").alias("occurrences"))


@query(f"""WITH {GRAMS_SQL}, c AS (SELECT * FROM df WHERE occurrences >= 2 AND NOT EXISTS (SELECT 1 FROM {TERMS_SQL} WHERE contains(lower(term), phrase) OR contains(phrase, lower(term))))
SELECT phrase, occurrences FROM c WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.k = c.k AND length(d.phrase) > length(c.phrase) AND contains(d.phrase, c.phrase))""")
def repeated_phrases(spark, sf):
    return evaluation.repeated_phrases(segments(spark, sf), terms(spark))


@query()
def consistency_summary(spark, sf):
    return evaluation.consistency_summary(evaluation.phrase_consistency(segments(spark, sf), terms(spark)))


@query("""SELECT pos, term, translation FROM (SELECT *, row_number() OVER (PARTITION BY lower(term) ORDER BY pos) AS n FROM (SELECT p_partkey * 10 AS pos, p_name AS term, p_type AS translation FROM part
UNION ALL SELECT p_partkey * 10 + 1, upper(p_name), 'x' FROM part UNION ALL SELECT p_partkey * 10 + 3, p_brand, '品牌' || p_partkey FROM part)) WHERE n = 1 AND lower(term) NOT IN (SELECT lower(p_brand) FROM part WHERE p_brand LIKE '%7')""")
def candidate_parse(spark, sf):
    """Candidates out of an answer a part, with text around its JSON, a second spelling and a term that is empty; some brands are known."""
    parts, entry = table(spark, sf, "part"), lambda term, translation: F.concat(F.lit('{"term":"'), term, F.lit('","translation":"'), translation, F.lit('"}'))
    entries = F.concat_ws(",", entry(F.col("p_name"), F.col("p_type")), entry(F.upper("p_name"), F.lit("x")), entry(F.lit(""), F.lit("空")), entry(F.col("p_brand"), F.concat(F.lit("品牌"), F.col("p_partkey").cast("string"))))
    raw = F.concat(F.lit("As asked: "), F.lit('{"terms":['), entries, F.lit("]} That is all."))
    parsed = parts.select("p_partkey", F.from_json(X.json_object(raw), "terms array<struct<term:string,translation:string>>").alias("j"))
    rows = parsed.select("p_partkey", F.posexplode("j.terms").alias("n", "t")).select((F.col("p_partkey") * 10 + F.col("n")).alias("pos"), "t.term", "t.translation")
    return G.first_by_case(rows, parts.filter("p_brand LIKE '%7'").select(F.upper("p_brand").alias("term")))


@query("""WITH old AS (SELECT p_name AS term, min(p_type) AS rendering FROM part GROUP BY p_name), new AS (SELECT DISTINCT p_name AS term, '红' AS rendering FROM part WHERE p_name LIKE 'red %' UNION ALL SELECT DISTINCT p_brand, '品牌' FROM part)
SELECT * FROM (SELECT * FROM old WHERE term NOT IN (SELECT term FROM new) UNION ALL SELECT * FROM new) WHERE term NOT LIKE '% ring'""")
def glossary_merge(spark, sf):
    """A glossary of parts' names: some get another rendering, brands come in, rings go."""
    parts = table(spark, sf, "part")
    old = parts.groupBy(F.col("p_name").alias("term")).agg(F.min("p_type").alias("rendering"))
    add = parts.filter("p_name LIKE 'red %'").select(F.col("p_name").alias("term"), F.lit("红").alias("rendering")).unionByName(parts.select(F.col("p_brand").alias("term"), F.lit("品牌").alias("rendering"))).distinct()
    return G.upsert_terms(old, add, parts.filter("p_name LIKE '% ring'").select(F.col("p_name").alias("term")))


@query("""SELECT pos, term, translation FROM (SELECT doc_id AS pos, trim(term) AS term, trim(translation) AS translation, row_number() OVER (PARTITION BY lower(trim(term)) ORDER BY doc_id) AS n FROM (
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN upper(source) WHEN 1 THEN ' ' || source || ' ' WHEN 2 THEN lang || doc_id % 30 ELSE ' ' END AS term, CASE WHEN doc_id % 7 = 0 THEN '' ELSE ' x' || doc_id END AS translation FROM documents)
WHERE trim(term) <> '' AND trim(translation) <> '') WHERE n = 1 AND lower(term) NOT IN ('src1', 'en2')""")
def candidates_first(spark, sf):
    """Of every spelling the first candidate that has a translation and that the glossary doesn't have."""
    d = F.col("doc_id")
    term = F.when(d % 4 == 0, F.upper("source")).when(d % 4 == 1, F.concat(F.lit(" "), "source", F.lit(" "))).when(d % 4 == 2, F.concat("lang", (d % 30).cast("string"))).otherwise(F.lit(" "))
    rows = table(spark, sf, "documents").select(d.alias("pos"), term.alias("term"), F.when(d % 7 == 0, "").otherwise(F.concat(F.lit(" x"), d.cast("string"))).alias("translation"))
    return G.first_by_case(rows, spark.createDataFrame([("SRC1",), ("en2",)], "term string"))


@query("""SELECT 't' || doc_id AS term, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS rendering FROM documents WHERE doc_id % 5 <> 0
UNION ALL SELECT 'n' || doc_id, 'new' FROM documents WHERE doc_id % 3 = 0""")
def glossary_upsert(spark, sf):
    """A glossary of a term a document after additions, changes and removals."""
    docs, name = table(spark, sf, "documents"), lambda c: F.concat(F.lit(c), F.col("doc_id").cast("string")).alias("term")
    third = docs.filter("doc_id % 3 = 0")
    add = third.select(name("t"), F.lit("new").alias("rendering")).unionByName(third.select(name("n"), F.lit("new").alias("rendering")))
    return G.upsert_terms(docs.select(name("t"), F.lit("old").alias("rendering")), add, docs.filter("doc_id % 5 = 0").select(name("t")))


# --- tasks ----------------------------------------------------------------------------------------------------------

STATUS = "CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'O' THEN 'processing' ELSE 'completed' END"


def order_tasks(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("task_id"), F.expr(STATUS).alias("status"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"))


def now():
    return F.to_timestamp(F.lit("1998-01-01 00:00:00"))


@query(f"""SELECT o_orderkey AS task_id, CASE WHEN o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 5) THEN 'processing' ELSE {STATUS} END AS status FROM orders""")
def task_claim(spark, sf):
    return tasks.claim(order_tasks(spark, sf), now(), 5).select("task_id", "status")


@query(f"""SELECT o_orderkey AS task_id, CASE WHEN o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1998-01-01' - INTERVAL 900 SECOND THEN 'pending' ELSE {STATUS} END AS status FROM orders""")
def task_requeue(spark, sf):
    return tasks.requeue_stale(order_tasks(spark, sf), now()).select("task_id", "status")


@query(f"""SELECT o_orderkey AS task_id, CASE WHEN o_orderkey % 7 = 0 AND o_orderstatus IN ('P', 'O') THEN 'cancelled' ELSE {STATUS} END AS status, o_orderkey % 7 = 0 AND o_orderstatus IN ('P', 'O') AS changed FROM orders""")
def task_cancel(spark, sf):
    t = order_tasks(spark, sf)
    return tasks.cancel(t, t.filter("task_id % 7 = 0"), now()).select("task_id", "status", "changed")


@query(f"SELECT o_orderkey AS task_id, {STATUS} AS status FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def task_page(spark, sf):
    return tasks.page(order_tasks(spark, sf), 40, 20).select("task_id", "status")


@query("""SELECT task_id, CASE WHEN bad = 0 THEN 'completed' WHEN ok = 0 THEN 'failed' ELSE 'partial_success' END AS status, ok, bad,
CASE WHEN bad > 0 THEN array_to_string(list_transform(f[1:10], lambda x: CAST(x AS VARCHAR)), ', ') || CASE WHEN len(f) > 10 THEN ' ...' ELSE '' END ELSE '' END AS failed_chunks
FROM (SELECT l_orderkey AS task_id, count(*) FILTER (WHERE l_returnflag <> 'R') AS ok, count(*) FILTER (WHERE l_returnflag = 'R') AS bad,
list(l_linenumber ORDER BY l_linenumber) FILTER (WHERE l_returnflag = 'R') AS f FROM lineitem GROUP BY l_orderkey)""")
def task_status_rollup(spark, sf):
    out = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("chunk_index"), (F.col("l_returnflag") != "R").alias("success"))
    return tasks.final_status(out)


@query("""WITH t AS (SELECT o_orderkey AS k, o_orderkey % 7 = 0 AS gone, count(*) FILTER (WHERE l_returnflag <> 'R') AS ok, count(*) FILTER (WHERE l_returnflag = 'R') AS bad, count(l_orderkey) AS n
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' GROUP BY ALL)
SELECT CAST(k AS VARCHAR) AS task_id, CASE WHEN gone THEN 'cancelled' WHEN n = 0 THEN 'failed' WHEN bad = 0 THEN 'completed' WHEN ok = 0 THEN 'failed' ELSE 'partial_success' END AS status,
CASE WHEN NOT gone AND ok > 0 THEN '/results/' || k END AS result_url FROM t""")
def queue_drained(spark, sf):
    """Pending orders worked off by a stream in two runs: an order's lines are its chunks; some orders are cancelled beforehand."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("chunk_index"), (F.col("l_returnflag") != "R").alias("success"))
    gone = order_tasks(spark, sf).filter("task_id % 7 = 0")

    def handle(claimed: DataFrame) -> DataFrame:
        done = tasks.final_status(lines.join(claimed.select("task_id"), "task_id", "left_semi"))
        return done.select("task_id", "status", F.when(F.col("ok") > 0, F.concat(F.lit("/results/"), F.col("task_id").cast("string"))).alias("result_url"), F.nullif("failed_chunks", F.lit("")).alias("error"))

    def run(stream: DataFrame, root: str) -> None:
        queue.work_off(stream, handle, f"{root}/outcomes", f"{root}/checkpoint", lambda: gone)

    pending = order_tasks(spark, sf).filter("status = 'pending'").select("task_id", "created_at")
    root = runs.fed_in_turns(pending, F.pmod(F.xxhash64("task_id"), F.lit(2)), 2, run, "queue")
    return queue.outcomes(spark, f"{root}/outcomes").select("task_id", "status", "result_url")


@query("""SELECT event_id, n AS current, round(n * 100.0 / 1000, 2) AS percentage FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)""")
def progress_running(spark, sf):
    events = table(spark, sf, "events").select(F.col("user_id").alias("task_id"), "event_id", "ts", F.lit(1000).alias("total"))
    return tasks.progress(events).select("event_id", "current", F.col("percentage").cast("double").alias("percentage"))


WATCHED = """WITH gone AS (SELECT user_id, min(ts) AS cut FROM events WHERE event_type = 'signup' AND user_id % 7 = 0 GROUP BY user_id),
e AS (SELECT user_id, event_id, ts, cut FROM events LEFT JOIN gone USING (user_id) WHERE event_type <> 'signup' AND (cut IS NULL OR ts <= cut)),
n AS (SELECT *, count(*) OVER w AS current, epoch_us(ts) - epoch_us(first_value(ts) OVER w) AS us, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS following FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
told AS (SELECT user_id AS task_id, event_id, ts, 'processing' AS status, current, us FROM n
UNION ALL SELECT user_id, NULL, ts + INTERVAL 900 SECOND, 'pending', current, us + 900000000 FROM n WHERE coalesce(following, cut, (SELECT max(ts) FROM events)) > ts + INTERVAL 900 SECOND
UNION ALL SELECT user_id, NULL, cut, 'cancelled', coalesce(max(n.current), 0), epoch_us(cut) - epoch_us(min(n.ts)) FROM gone LEFT JOIN n USING (user_id, cut) GROUP BY user_id, cut)
"""


def watched(spark, sf) -> DataFrame:
    """Events as tasks' events, in three runs by time; some tasks are cancelled by an event of their own."""
    events = table(spark, sf, "events").select(F.col("user_id").alias("task_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.lit(1000).alias("total"), "event_type")

    def run(stream: DataFrame, root: str) -> None:
        told = watch.watch_tasks(stream.filter("event_type <> 'signup'"), stream.filter("event_type = 'signup' AND task_id % 7 = 0"))
        runs.append_run(told, f"{root}/out", f"{root}/checkpoint")

    root = runs.fed_in_turns(events, runs.time_portion(events, "ts", 3), 3, run, "watch")
    return spark.read.parquet(f"{root}/out")


@query(WATCHED + "SELECT task_id, event_id, current, round(current * 100.0 / 1000, 2) AS percentage, round(us / 1e6, 3) AS elapsed, CASE WHEN us > 0 THEN ceil((1000 - current) / (current * 60 / (us / 1e6))) END AS eta_minutes FROM told WHERE status = 'processing'")
def progress_stream(spark, sf):
    """What a stream tells of each event, up to its task's cancellation."""
    return watched(spark, sf).filter("status = 'processing'").select("task_id", "event_id", "current", "percentage", F.round("elapsed", 3).alias("elapsed"), F.col("eta_minutes").cast("double").alias("eta_minutes"))


@query(WATCHED + "SELECT task_id, status, epoch_us(ts) AS us, current FROM told WHERE status <> 'processing'")
def stale_and_cancelled(spark, sf):
    """When timers put tasks back into the queue, and when tasks were cancelled; nothing of a task comes later."""
    return watched(spark, sf).filter("status <> 'processing'").select("task_id", "status", F.unix_micros("ts").alias("us"), "current")


#: A turn is a line: users' are headings of all levels, some of the others' open or close code.
TURN_LINE = "CASE WHEN role = 'user' THEN repeat('#', CAST(turn * 5 % 6 + 1 AS INT)) || '  ' || role || turn || ' ' WHEN turn % 4 = 3 THEN '```' ELSE role END"


@query(f"""WITH RECURSIVE t AS (SELECT conv_id, turn, {TURN_LINE} AS line, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS nth FROM conversations WHERE turn IS NOT NULL),
f AS (SELECT *, count(*) FILTER (WHERE line = '```') OVER (PARTITION BY conv_id ORDER BY nth) % 2 = 1 AS inside FROM t),
h AS (SELECT *, line LIKE '#%' AND NOT inside AS heading, count(*) FILTER (WHERE line LIKE '#%' AND NOT inside) OVER (PARTITION BY conv_id ORDER BY nth) AS above FROM f),
s(conv_id, above, path) AS (SELECT conv_id, 0, CAST([] AS VARCHAR[]) FROM h GROUP BY conv_id
UNION ALL SELECT s.conv_id, h.above, list_append(s.path[1:length(regexp_extract(h.line, '^#+')) - 1], trim(ltrim(h.line, '#'))) FROM s JOIN h ON h.conv_id = s.conv_id AND h.heading AND h.above = s.above + 1)
SELECT conv_id, CAST(nth AS INT) AS nth, heading, array_to_string(path, ' > ') AS path FROM h JOIN s USING (conv_id, above)""")
def heading_stack(spark, sf):
    """The headings above each line of conversations written as documents."""
    turns = table(spark, sf, "conversations").filter("turn IS NOT NULL").select("conv_id", "turn", F.expr(TURN_LINE).alias("line"))
    whole = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n").alias("text"))
    lines = chunking.line_paths(whole, "conv_id")
    return lines.select("conv_id", "nth", "heading", F.array_join("path", " > ").alias("path"))


class CountingStub(translate.StubModel):
    """The stub, with token counts: a character is a token."""

    def translate(self, prompt: str, text: str) -> tuple[str, int, int]:
        return super().translate(prompt, text), len(prompt), len(text)


@query("SELECT CAST(sum(length(role)) AS BIGINT) AS prompt_tokens, CAST(sum(length(text)) AS BIGINT) AS completion_tokens, CAST(sum(length(role) + length(text)) AS BIGINT) AS total_tokens, count(*) AS call_count FROM conversations")
def usage_observed(spark, sf):
    """What a collector tells of a run over all turns, without reading its answers again."""
    asked = table(spark, sf, "conversations").select(F.col("role").alias("prompt"), "text")
    collector = usage.UsageCollector()
    written(collector.watch(translate.call_model(asked, CountingStub(), "translate", 0)), "observed")
    told = collector.snapshot()
    return spark.createDataFrame([[told[c] for c in usage.COUNTS]], ", ".join(f"{c} long" for c in usage.COUNTS))


@query("""SELECT conv_id, CAST(sum(p) AS BIGINT) AS prompt_tokens, CAST(sum(c) AS BIGINT) AS completion_tokens, CAST(sum(CASE WHEN t = 0 THEN p + c ELSE t END) AS BIGINT) AS total_tokens, count(*) AS calls FROM (
SELECT conv_id, CASE turn % 3 WHEN 0 THEN 7 WHEN 1 THEN length(role) + length(text) ELSE 4 + length(role) END AS p, CASE turn % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 5 END AS c, CASE turn % 3 WHEN 0 THEN length(text) WHEN 1 THEN length(text) + 1 ELSE 0 END AS t
FROM conversations WHERE length(text) > 0) GROUP BY conv_id""")
def usage_by_message(spark, sf):
    """Usage of calls by the provider's total, by their messages, or by the sum of both kinds, as turns have it."""
    turn, n, role = F.col("turn") % 3, F.char_length("text"), F.char_length("role")
    part = lambda i, o, t: F.struct(i.cast("int").alias("input_tokens"), F.lit(o).alias("output_tokens"), t.cast("int").alias("total_tokens"))
    provider = F.when(turn == 0, F.struct(F.lit(7).alias("prompt_tokens"), F.lit(1).alias("completion_tokens"), n.alias("total_tokens"))).when(turn == 2, F.struct(F.lit(4).alias("prompt_tokens"), F.lit(None).cast("int").alias("completion_tokens"), F.lit(0).alias("total_tokens")))
    messages = F.when(turn == 1, F.array(part(role, 2, n), part(n, 0, F.lit(1)))).when(turn == 2, F.array(part(role, 5, F.lit(None))))
    calls = table(spark, sf, "conversations").filter("length(text) > 0").select("conv_id", usage.usage_of(provider, messages).alias("u"))
    return calls.groupBy("conv_id").agg(*[F.sum(f"u.{c}").alias(c) for c in usage.COUNTS[:3]], F.count("*").alias("calls"))


@query("SELECT doc_id AS k, sha256(text) AS found FROM documents WHERE doc_id IN (SELECT CAST(doc_id AS BIGINT) FROM labels WHERE quality = 1 AND toxic = 1)")
def cache_lookup(spark, sf):
    """Texts kept by key, and those of some labelled documents looked up: only these keys' folders are read."""
    path = shared_folder(spark, f"keyed-{uuid.uuid4().hex}")
    database.write_keyed(table(spark, sf, "documents").select(F.col("doc_id").alias("k"), "text"), path, "k")
    wanted = table(spark, sf, "labels").filter("quality = 1 AND toxic = 1").select(F.col("doc_id").cast("long").alias("k"))
    return database.lookup(spark, path, "k", wanted).select("k", F.sha2("text", 256).alias("found"))


@query("SELECT event_type, count(*) AS calls, CAST(sum(user_id) AS BIGINT) AS prompt_tokens, CAST(sum(user_id + event_id % 100) AS BIGINT) AS total_tokens FROM events GROUP BY event_type")
def token_usage(spark, sf):
    calls = table(spark, sf, "events").select("event_type", F.col("user_id").alias("prompt_tokens"), F.pmod("event_id", F.lit(100)).alias("completion_tokens"), F.lit(None).cast("long").alias("total"))
    return calls.groupBy("event_type").agg(F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum(reporting.tokens_of()).alias("total_tokens"))


# --- rendering ------------------------------------------------------------------------------------------------------

TURN = "CASE WHEN turn % 5 = 4 THEN '> [翻译失败: chunk ' || turn || ']' || chr(10) || chr(10) || '```' || chr(10) || substr(text, 1, 500) || '...' || chr(10) || '```' ELSE {} END"


def conversation_results(spark, sf) -> DataFrame:
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("idx"), F.col("text").alias("original"), F.concat(F.lit("译文："), "text").alias("translation"), (F.col("turn") % 5 != 4).alias("success"))


def _render_sql(title: str, good: str) -> str:
    return f"""SELECT conv_id AS doc, sha256('# ' || conv_id || ' - 中文翻译{title}' || chr(10) || chr(10) || '> 由 AI 自动翻译' || chr(10) || chr(10)
|| string_agg(chr(10) || chr(10) || {TURN.format(good)} || chr(10) || chr(10), '' ORDER BY turn)) AS markdown FROM conversations GROUP BY conv_id"""


@query(_render_sql("", "'译文：' || text"))
def render_mono(spark, sf):
    return rendering.render(conversation_results(spark, sf), False).select("doc", F.sha2("markdown", 256).alias("markdown"))


@query(_render_sql("（双语对照）", "'> ' || replace(text, chr(10), chr(10) || '> ') || chr(10) || chr(10) || '译文：' || text || chr(10) || chr(10) || '---'"))
def render_bilingual(spark, sf):
    return rendering.render(conversation_results(spark, sf), True).select("doc", F.sha2("markdown", 256).alias("markdown"))


#: The pairs read back: a failed chunk has no rule after it, so its quoted note is the source of a pair with all up to the next rule.
PAIRS_SQL = """pairs AS (SELECT conv_id AS doc, turn, CASE WHEN before % 5 = 4 THEN '[翻译失败: chunk ' || before || ']' ELSE text END AS source,
CASE WHEN before % 5 = 4 THEN '```' || chr(10) || substr(said, 1, 500) || '...' || chr(10) || '```' || chr(10) || chr(10) || chr(10) || chr(10) || '> ' || replace(text, chr(10), chr(10) || '> ') || chr(10) || chr(10) ELSE '' END || '译文：' || text AS translation
FROM (SELECT *, lag(turn) OVER w AS before, lag(text) OVER w AS said FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
WHERE turn % 5 <> 4 AND (before % 5 = 4 OR regexp_matches(text, '[A-Za-z]{4}')))"""


@query(f"WITH {PAIRS_SQL} SELECT doc, count(*) AS pairs, sha256(string_agg(source || chr(1) || translation, chr(2) ORDER BY turn)) AS sha256 FROM pairs GROUP BY doc")
def bilingual_parse(spark, sf):
    """Rendered, then read back: the pairs of every document, failed chunks' notes among them."""
    pairs = rendering.bilingual_pairs(rendering.render(conversation_results(spark, sf), True))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", F.concat("source", F.lit("\x01"), "translation").alias("p")))), lambda x: x["p"]), "\x02")
    return pairs.groupBy("doc").agg(F.count("*").alias("pairs"), F.sha2(said, 256).alias("sha256"))


@query(f"WITH {PAIRS_SQL} SELECT doc, CAST(count(*) AS INT) AS count, min_by(substr(source, 1, 20), turn) AS first, max_by(sha256(translation), turn) AS last FROM pairs GROUP BY doc")
def result_preview(spark, sf):
    """What a page shows of a bilingual result: its pairs in order."""
    shown = rendering.preview(rendering.render(conversation_results(spark, sf), True))
    p = F.col("paragraphs")
    return shown.select("doc", "count", F.substring(p[0]["source"], 1, 20).alias("first"), F.sha2(F.element_at(p, -1)["translation"], 256).alias("last"))


def _html_sql(x: str) -> str:
    """The page's rules for one text, in DuckDB."""
    x = f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    for n in range(6, 0, -1):
        x = f"regexp_replace({x}, '(?m)^{'#' * n} (.+)$', '<h{n}>\\1</h{n}>', 'g')"
    for pattern, new in (("\\*\\*\\*(.+?)\\*\\*\\*", "<strong><em>\\1</em></strong>"), ("\\*\\*(.+?)\\*\\*", "<strong>\\1</strong>"), ("\\*(.+?)\\*", "<em>\\1</em>"), ("!\\[([^\\]]*)\\]\\(([^)]+)\\)", '<img src="\\2" alt="\\1">'), ("\\[([^\\]]+)\\]\\(([^)]+)\\)", '<a href="\\2">\\1</a>'), ("`([^`]+)`", "<code>\\1</code>")):
        x = f"regexp_replace({x}, '{pattern}', '{new}', 'g')"
    blank = "' ' || chr(9) || chr(10)"
    parts = f"list_filter(list_transform(string_split({x}, chr(10) || chr(10)), lambda p: trim(p, {blank})), lambda p: p <> '')"
    return f"array_to_string(list_transform({parts}, lambda p: CASE WHEN starts_with(p, '<h') THEN p ELSE '<p>' || replace(p, chr(10), '<br>') || '</p>' END), chr(10))"


MARKED = "'#' || repeat('#', CAST(turn % 6 AS INT)) || ' ' || role || ' *x*' || chr(10) || chr(10) || '**' || role || '** `x` <b> & [t](u) ![i](p.png) ***z***' || chr(10) || text"


@query(f"SELECT conv_id, turn, {_html_sql(MARKED)} AS html FROM conversations")
def markdown_to_html(spark, sf):
    """Every turn under a heading of each level, with marks, links, images and line breaks."""
    text = F.concat(F.lit("#"), F.repeat(F.lit("#"), F.col("turn") % 6), F.lit(" "), "role", F.lit(" *x*\n\n**"), "role", F.lit("** `x` <b> & [t](u) ![i](p.png) ***z***\n"), "text")
    return table(spark, sf, "conversations").select("conv_id", "turn", X.markdown_to_html(text).alias("html"))


@query("""SELECT doc, idx, content FROM (SELECT user_id AS doc, CAST(event_id % 20 AS INT) AS idx, min(event_type) AS content, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 20) AS n
FROM events GROUP BY user_id, event_id % 20) WHERE n = idx + 1""")
def ordered_flush(spark, sf):
    """The written parts of a stream that brings each document's results out of order, in three runs."""
    events = table(spark, sf, "events").groupBy(F.col("user_id").alias("doc"), F.pmod("event_id", F.lit(20)).cast("int").alias("idx")).agg(F.min("event_type").alias("content"))
    return ordered.written_parts(spark, in_three_runs(events)).drop("batch")


@query("""SELECT doc, CAST(count(*) FILTER (WHERE n = idx + 1) AS BIGINT) AS written_count, CAST(count(*) FILTER (WHERE n <> idx + 1) AS BIGINT) AS buffer_size FROM
(SELECT user_id AS doc, event_id % 20 AS idx, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 20) AS n FROM events GROUP BY user_id, event_id % 20) GROUP BY doc""")
def ordered_counters(spark, sf):
    """How much of each document was written and how much waits for a gap, when the stream has ended."""
    events = table(spark, sf, "events").select(F.col("user_id").alias("doc"), F.pmod("event_id", F.lit(20)).cast("int").alias("idx"), F.lit("x").alias("content")).distinct()
    return ordered.counters(spark, in_three_runs(events))


def in_three_runs(results: DataFrame) -> str:
    """Results fed to the ordered sink in three portions, each a run of its own; where they were written."""

    def run(stream: DataFrame, root: str) -> None:
        ordered.write_in_order(stream, f"{root}/parts", f"{root}/checkpoint")

    return f"{runs.fed_in_turns(results, F.pmod(F.xxhash64('doc', 'idx'), F.lit(3)), 3, run, 'ordered')}/parts"


@query("SELECT page_id, '![a](images/' || page_id || '.png) [x] [] ' || chr(10) || chr(10) || 'z' AS fixed FROM pages")
def path_and_bracket_fix(spark, sf):
    raw = F.concat(F.lit("![a](/tmp/x/images/"), F.col("page_id").cast("string"), F.lit(".png) \\[x\\] [ ] \n\n\n\n"), F.lit("z   "))
    fixed = X.unescape_brackets(X.fix_image_paths(raw))
    return table(spark, sf, "pages").select("page_id", F.concat(F.regexp_replace(X.normalize_whitespace(fixed), "\\[\\]\\n", "[] \n")).alias("fixed"))


#: Residue as converters leave it, and the page's own HTML after it.
RESIDUE = "::: {#p.mbp_pagebreak}\n:::\n[Part %d]{.calibre2}\n\n> [text %d]\n> *\n> [ ]\n[a [b]{.italic} c]{.calibre6} \n\n![pic](x/images/a.%d.png)\n{.calibre_2}\n\n1\\) First]{.Calibre3} [[NICK]{.calibre_1}]{.calibre1}[ ]{.calibre_1}LAND\n\n"


def pages_with_residue(spark, sf) -> DataFrame:
    page = F.col("page_id")
    return table(spark, sf, "pages").select("page_id", F.concat(F.format_string(RESIDUE, page, page, page), "html").alias("raw"))


CLEANED = "'## Part ' || page_id || chr(10) || chr(10) || '> text ' || page_id || chr(10) || chr(10) || 'a *b* c' || chr(10) || chr(10) || '![a.' || page_id || '](images/a.' || page_id || '.png)' || chr(10) || chr(10) || '1) First NICK LAND' || chr(10) || chr(10)"


@query(f"SELECT page_id, sha256(trim({CLEANED} || html, chr(10) || ' ') || chr(10)) AS cleaned FROM pages")
def artifact_clean(spark, sf):
    """Every page below generated residue."""
    return pages_with_residue(spark, sf).select("page_id", F.sha2(artifacts.clean_artifacts(F.col("raw")), 256).alias("cleaned"))


@query()
def limiter_simulation(spark, sf):
    calls = table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("call_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return ordered.limiter_waits(calls, 2, 3600.0).groupBy("key").agg(F.count("*").alias("calls"), F.round(F.sum("wait"), 3).alias("waited"))


@query()
def format_markdown(spark, sf):
    """Blocks of every kind in front of every page's HTML."""
    blocks = F.concat(F.lit("## Chapter {#c .x}\n\n::: quote\nQuoted "), F.col("page_id").cast("string"), F.lit("\n:::\n\n```python\nx  = 1\n```\n\n::: toc\n[S](#s)\n:::\n\n![PIC](a/images/p.1.png){w=1}\n\n"), "raw")
    return pages_with_residue(spark, sf).select("page_id", F.sha2(markdown.format_markdown(blocks), 256).alias("formatted"))


@query("""SELECT conv_id AS doc, sha256(rtrim(regexp_replace('# ' || conv_id || ' - 中文翻译' || chr(10) || chr(10) || '> 由 AI 自动翻译' || string_agg(chr(10) || chr(10) ||
CASE WHEN turn % 5 = 4 THEN '```' || chr(10) || substr(text, 1, 500) || '...' || chr(10) || '```' ELSE '译文：' || text END, '' ORDER BY turn), '\\n\\n+', chr(10) || chr(10), 'g'), chr(10))) AS markdown FROM conversations GROUP BY conv_id""")
def bilingual_to_mono(spark, sf):
    """The bilingual rendering, stripped: translations, and the source that a failed chunk shows in its fence."""
    return markdown.to_monolingual(rendering.render(conversation_results(spark, sf), True)).select("doc", F.sha2("markdown", 256).alias("markdown"))


PAGE_SQL = """'<!DOCTYPE html>' || chr(10) || '<html lang="zh"><head><meta charset="utf-8"><title>T</title></head><body>' || chr(10) || '<table>' || chr(10) || {} || chr(10) || '</table>' || chr(10) || '</body></html>' || chr(10)"""
ROWS_SQL = f"string_agg('<tr><td>' || {_html_sql('source')} || '</td><td>' || {_html_sql('translation')} || '</td></tr>', chr(10) ORDER BY turn)"


@query(f"WITH {PAIRS_SQL} SELECT doc, sha256({PAGE_SQL.format(ROWS_SQL)}) AS html FROM pairs GROUP BY doc")
def html_export(spark, sf):
    """Whole pages of all documents' pairs."""
    pages = markdown.html_table(rendering.bilingual_pairs(rendering.render(conversation_results(spark, sf), True)), "T")
    return pages.select("doc", F.sha2("html", 256).alias("html"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '![a](assets/' || doc_id || '/f' || doc_id % 4 || '.png)' ELSE '![a](x/none.png)' END AS markdown, CASE WHEN doc_id % 2 = 0 THEN 'f' || doc_id % 4 || '.png' ELSE '' END AS assets FROM documents")
def asset_sync(spark, sf):
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("![a](x/f"), (F.col("doc_id") % 4).cast("string"), F.lit(".png)"))).otherwise(F.lit("![a](x/none.png)"))
    files = spark.range(4).select(F.concat(F.lit("p/f"), F.col("id").cast("string"), F.lit(".png")).alias("path"))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), text.alias("markdown"), F.array(F.lit("q"), F.lit("p")).alias("roots"))
    out = assets.synced(docs, assets.resolved_images(docs, files), "assets")
    return out.select(F.col("doc").alias("doc_id"), "markdown", F.array_join("assets", ",").alias("assets"))


def image_documents(spark, sf) -> DataFrame:
    """Each document names one image, and one that no one has."""
    doc = F.col("doc_id")
    return table(spark, sf, "documents").select(doc.alias("doc"), F.concat(F.lit("![](x/f"), doc.cast("string"), F.lit(".png) ![b](none.png)")).alias("markdown"), assets.asset_roots("res", "tmp", doc).alias("roots"))


def image_files(spark, sf) -> DataFrame:
    d = F.col("doc_id").cast("string")
    at = lambda n, *parts: F.when(F.col("doc_id") % n == 0, F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts], F.lit("f"), d, F.lit(".png")))
    own = F.array(at(3, "res/assets/", d, "/"), at(5, "tmp/", d, "/images/x/"), at(7, "tmp/", d, "/deep/er/"), at(11, "elsewhere/"))
    return table(spark, sf, "documents").select(F.explode(F.filter(own, lambda p: p.isNotNull())).alias("path"))


FOUND = "CASE WHEN doc_id % 3 = 0 THEN 'res/assets/' || doc_id || '/f' WHEN doc_id % 5 = 0 THEN 'tmp/' || doc_id || '/images/x/f' WHEN doc_id % 7 = 0 THEN 'tmp/' || doc_id || '/deep/er/f' END || doc_id || '.png'"


@query(f"SELECT * FROM (SELECT doc_id, 'x/f' || doc_id || '.png' AS link, {FOUND} AS path FROM documents) WHERE path IS NOT NULL")
def image_resolution(spark, sf):
    """Links by their path, by their name, and by a search below the folders."""
    return assets.resolved_images(image_documents(spark, sf), image_files(spark, sf)).withColumnRenamed("doc", "doc_id")


@query(f"""SELECT doc_id, sha256('<p><img src="' || CASE WHEN {FOUND} IS NULL THEN 'x/f' || doc_id || '.png' ELSE 'data:image/png;base64,' || base64(encode(substr(text, 1, 40))) END || '" alt="f' || doc_id || '"> <img src="none.png" alt="b"></p>') AS html FROM documents""")
def html_inline(spark, sf):
    """Pages whose found images are part of them; a text's beginning stands for the image's bytes."""
    docs = image_documents(spark, sf)
    found = assets.resolved_images(docs, image_files(spark, sf))
    bytes_of = found.join(table(spark, sf, "documents"), F.col("doc") == F.col("doc_id")).select("path", F.encode(F.substring("text", 1, 40), "UTF-8").alias("content"))
    pages = docs.select("doc", X.markdown_to_html(F.col("markdown")).alias("html"))
    return assets.inlined(pages, found, bytes_of).select(F.col("doc").alias("doc_id"), F.sha2("html", 256).alias("html"))


@query(f"SELECT m.doc, m.markdown AS mono, d.markdown AS dual FROM ({ORACLE['bilingual_to_mono']}) m JOIN ({ORACLE['render_bilingual']}) d USING (doc)")
def variant_backfill(spark, sf):
    """Results that lack a variant, or whose mono one is a bilingual text, get both."""
    whole = rendering.render(conversation_results(spark, sf), True)
    old = whole.select("doc", (F.col("doc") % 2 == 0).alias("bilingual"), F.when(F.col("doc") % 4 == 0, F.col("markdown")).alias("mono"), F.when(F.col("doc") % 4 != 0, F.col("markdown")).alias("dual"))
    return rendering.backfilled(old).select("doc", F.sha2("mono", 256).alias("mono"), F.sha2("dual", 256).alias("dual"))


@query("""SELECT conv_id AS doc, sha256(coalesce(string_agg('译文：' || text, chr(10) || chr(10) ORDER BY turn) FILTER (WHERE turn % 5 <> 4), '')) AS translation,
coalesce(string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) FILTER (WHERE turn % 5 = 4), '') AS failed, count(*) FILTER (WHERE turn % 5 <> 4) AS ok, count(*) FILTER (WHERE turn % 5 = 4) AS bad FROM conversations GROUP BY conv_id""")
def run_result(spark, sf):
    r = document.run_result(conversation_results(spark, sf))
    return r.select("doc", F.sha2("translation", 256).alias("translation"), F.array_join(F.col("failed_chunks").cast("array<string>"), ",").alias("failed"), "ok", "bad")


@query("""SELECT user_id AS task_id, event_id AS chunk_index, 'c' || event_id AS chunk_id, 'completed' AS status, event_type AS translation, true AS cached FROM events WHERE event_id % 3 = 0""")
def hit_events(spark, sf):
    """Chunks that the cache has tell their progress as those that were translated."""
    e = table(spark, sf, "events")
    chunks = e.select(F.col("user_id").alias("task_id"), F.col("event_id").alias("idx"), F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("chunk_id"), F.sha1(F.col("event_id").cast("string").cast("binary")).alias("cache_key"))
    cache = e.filter("event_id % 3 = 0").select(F.sha1(F.col("event_id").cast("string").cast("binary")).alias("cache_key"), F.col("event_type").alias("cached_translation"))
    return rendering.hit_events(rendering.cache_split(chunks, cache)[0]).drop("duration")


WORDS = prompts.Wording()
REPAIR_SQL = f"""'{WORDS.repairer}' || chr(10) || chr(10) || '[Section]' || chr(10) || role || chr(10) || chr(10) || '[Original]' || chr(10) || text || chr(10) || chr(10) || '[Translation]' || chr(10) || '译文' || chr(10) || chr(10) || '[Issues]' || chr(10) ||
CASE WHEN turn % 2 = 0 THEN '- [high] untranslated a b' || chr(10) || '- [medium] terminology x -> y' ELSE '- [low] repetition r' END || chr(10) || chr(10) || '[Glossary]' || chr(10) || CASE WHEN turn % 3 = 0 THEN '- x: y' ELSE '（无术语表）' END || chr(10) || chr(10) || '{prompts.numbered(WORDS.repair).replace(chr(10), "' || chr(10) || '")}'"""


@query(f"SELECT conv_id, turn, sha256({REPAIR_SQL}) AS prompt FROM conversations")
def repair_prompts(spark, sf):
    """What a checker is asked: every issue and term is in it."""
    kind = lambda k, w, m: F.struct(F.lit(k).alias("kind"), F.lit(w).alias("severity"), F.lit(m).alias("message"))
    issues = F.when(F.col("turn") % 2 == 0, F.array(kind("untranslated", "high", "a b"), kind("terminology", "medium", "x -> y"))).otherwise(F.array(kind("repetition", "low", "r")))
    known = F.when(F.col("turn") % 3 == 0, F.array(F.struct(F.lit("x").alias("term"), F.lit("y").alias("rendering")))).otherwise(F.array().cast("array<struct<term:string,rendering:string>>"))
    asked = prompts.repair_prompt(WORDS, F.col("text"), F.lit("译文"), issues, known, X.breadcrumb(F.array("role")))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.sha2(asked, 256).alias("prompt"))


# --- the task table and conversions ---------------------------------------------------------------------------------


def whole_tasks(spark, sf) -> DataFrame:
    """Orders as tasks with all columns, each with an error."""
    t = order_tasks(spark, sf).withColumns({"task_id": F.col("task_id").cast("string"), "filename": F.concat(F.lit("o"), F.col("task_id").cast("string"), F.lit(".epub")), "bilingual": F.col("task_id") % 2 == 0, "error": F.lit("old")})
    return tasks.migrated(t)


@query(f"""SELECT CAST(o_orderkey AS VARCHAR) AS task_id, CASE WHEN o_orderkey % 3 = 0 THEN 'new.md' ELSE 'o' || o_orderkey || '.epub' END AS filename, CASE WHEN o_orderkey % 3 = 0 THEN 'pending' ELSE {STATUS} END AS status, 0 AS progress_current FROM orders""")
def task_insert(spark, sf):
    """New tasks are taken where their id is new; columns that they lack have their defaults."""
    old = whole_tasks(spark, sf)
    new = old.select("task_id", F.lit("new.md").alias("filename"), F.lit("pending").alias("status"))
    return tasks.migrated(tasks.insert(old.filter("cast(task_id as long) % 3 <> 0"), new)).select("task_id", "filename", "status", "progress_current")


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS task_id, {STATUS} AS status FROM orders WHERE o_orderkey IN (SELECT user_id FROM events)")
def task_lookup(spark, sf):
    ids = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("task_id"))
    return tasks.by_id(whole_tasks(spark, sf), ids).select("task_id", "status")


@query(f"""WITH t AS (SELECT o_orderkey AS k, {STATUS} AS s, o_orderdate AS d FROM orders), c AS (SELECT *, k % 7 = 0 AND s IN ('pending', 'processing') AS gone, row_number() OVER (PARTITION BY s = 'pending' AND NOT (k % 7 = 0) ORDER BY d, CAST(k AS VARCHAR)) AS n FROM t)
SELECT CAST(k AS VARCHAR) AS task_id, CASE WHEN gone THEN 'cancelled' WHEN s = 'pending' AND n <= 5 THEN 'processing' WHEN s = 'processing' AND d < TIMESTAMP '1998-01-01' - INTERVAL 900 SECOND THEN 'pending' ELSE s END AS status,
CASE WHEN gone THEN '{tasks.CANCELLED}' WHEN s = 'pending' AND n <= 5 THEN NULL WHEN s = 'processing' AND d < TIMESTAMP '1998-01-01' - INTERVAL 900 SECOND THEN '{tasks.REQUEUED}' ELSE 'old' END AS error FROM c""")
def task_messages(spark, sf):
    """Cancelled, claimed and stale tasks tell why, in this order of changes; those claimed lose their error."""
    t = whole_tasks(spark, sf)
    t = tasks.cancel(t, t.filter("cast(task_id as long) % 7 = 0"), now()).drop("changed")
    t = tasks.claim(t, F.lit("1998-01-01 00:00:00").cast("timestamp"), 5)
    return tasks.requeue_stale(t, now()).select("task_id", "status", "error")


@query(f"""SELECT CAST(o_orderkey AS VARCHAR) AS task_id, {STATUS} AS status, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS created_at, 0.0::DOUBLE AS percentage, o_orderkey % 2 = 0 AS bilingual FROM orders""")
def task_records(spark, sf):
    return tasks.records(whole_tasks(spark, sf)).select("task_id", "task.status", "task.created_at", "task.progress.percentage", "task.bilingual")


@query(f"""SELECT o_orderkey AS task_id, CASE WHEN o_orderkey % 5 = 4 THEN 'format' WHEN {STATUS} <> 'completed' THEN 'unfinished' WHEN o_orderkey % 2 = 1 AND (o_orderkey % 3 = 0 OR o_orderkey % 5 = 1) THEN 'monolingual' END AS refusal,
'o' || o_orderkey || CASE WHEN o_orderkey % 5 = 1 THEN '.bilingual.html' WHEN o_orderkey % 5 = 2 THEN '.assets.zip' WHEN o_orderkey % 3 = 0 THEN '.bilingual.md' ELSE '.cn.md' END AS name FROM orders""")
def download_guards(spark, sf):
    k = F.col("task_id").cast("long")
    form = F.when(k % 5 == 4, "doc").when(k % 5 == 1, "html").when(k % 5 == 2, "zip").otherwise("md")
    variant = F.when(k % 3 == 0, "bilingual").otherwise("mono")
    t = whole_tasks(spark, sf)
    return t.select(k.alias("task_id"), sinks.download_refusal(F.col("status"), F.col("bilingual"), form, variant).alias("refusal"), sinks.result_name(F.col("filename"), form, variant).alias("name"))


@query("""SELECT page_id, CASE WHEN page_id % 10 = 0 THEN NULL ELSE sha256(html) END AS markdown, CASE WHEN page_id % 10 = 0 THEN 'broken' END AS error FROM pages WHERE page_id % 3 > 0""")
def converted_pages(spark, sf):
    """Pages as files of three types through a converter that fails on every tenth; Markdown files aren't converted."""
    page = F.col("page_id")
    files = table(spark, sf, "pages").select(F.concat(F.lit("in/"), page.cast("string"), F.when(page % 3 == 0, ".md").when(page % 3 == 1, ".epub").otherwise(".PDF")).alias("path"), F.encode("html", "UTF-8").alias("content"))

    def convert(path: str, content: bytes) -> str:
        if path.split("/")[1].split(".")[0].endswith("0"):
            raise ValueError("broken")
        return content.decode()

    out = scans.converted(files, convert)
    return out.select(F.regexp_extract("path", "([0-9]+)", 1).cast("long").alias("page_id"), F.sha2("markdown", 256).alias("markdown"), "error")


@query("""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'tmp/' || page_id || '/p' || page_id || '.md' ELSE 'tmp/' || page_id || '/a/b.md' END AS reuse FROM pages WHERE page_id % 3 = 1 AND (page_id % 2 = 0 OR page_id % 5 = 0)""")
def reusable_conversions(spark, sf):
    """What earlier conversions of EPUBs left: a file of the source's name, or the first other one; empty files don't count."""
    page, own = F.col("page_id"), F.col("page_id").cast("string")
    sources = table(spark, sf, "pages").select(page.alias("doc"), F.concat(F.lit("in/p"), own, F.when(page % 3 == 1, ".EPUB").otherwise(".pdf")).alias("path"), F.concat(F.lit("tmp/"), own).alias("folder"))
    left = F.array(F.struct(F.concat(F.lit("tmp/"), own, F.lit("/p"), own, F.lit(".md")).alias("path"), F.when(page % 2 == 0, 5).otherwise(0).alias("length")), F.struct(F.concat(F.lit("tmp/"), own, F.lit("/a/b.md")).alias("path"), F.when(page % 5 == 0, 7).otherwise(0).alias("length")), F.struct(F.concat(F.lit("tmp/"), own, F.lit("/z.md")).alias("path"), F.when(page % 5 == 0, 7).otherwise(0).alias("length")))
    files = table(spark, sf, "pages").select(F.inline(left))
    return scans.reusable(sources, files).withColumnRenamed("doc", "page_id")


@query("SELECT doc_id, lang AS summary, CASE WHEN doc_id % 2 = 0 THEN 'a,b,c,d' ELSE '' END AS style_notes, 'f' AS fallback FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, '', '', 'f' FROM documents WHERE doc_id % 3 = 0")
def profile_parse(spark, sf):
    notes = F.when(F.col("doc_id") % 2 == 0, '["a ", "", "b", "c", "d", "e"]').otherwise("[]")
    raw = F.when(F.col("doc_id") % 3 == 0, F.lit("no object")).otherwise(F.concat(F.lit('x {"summary": " '), "lang", F.lit(' ", "style_notes": '), notes, F.lit("} y")))
    p = table(spark, sf, "documents").select("doc_id", markdown.parse_profile(raw).alias("p"))
    return p.select("doc_id", "p.summary", F.array_join("p.style_notes", ",").alias("style_notes"), F.lit("f").alias("fallback"))


# --- prompts, runs and reports --------------------------------------------------------------------------------------


@query("""SELECT doc_id, CASE WHEN lang IS NULL OR doc_id % 3 = 0 THEN '无额外文档级分析。' ELSE '文档摘要: ' || lang || CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) || '风格约束:' || chr(10) || '- a' || chr(10) || '- b' ELSE '' END END AS profile FROM documents""")
def profile_prompt(spark, sf):
    given = F.col("lang").isNotNull() & (F.col("doc_id") % 3 != 0)
    none = F.array().cast("array<string>")
    notes = F.when(given & (F.col("doc_id") % 2 == 0), F.array(F.lit("a"), F.lit("b"))).otherwise(none)
    profile = F.struct(F.when(given, F.col("lang")).otherwise("").alias("summary"), notes.alias("style_notes"), none.alias("terminology_hints"), none.alias("section_overview"))
    return table(spark, sf, "documents").select("doc_id", prompts.profile_text(profile).alias("profile"))


@query("""SELECT conv_id, turn, sha256('S ' || coalesce(text, '') || ' T 译文：' || role || ' G ' || CASE WHEN turn % 2 = 0 THEN '（无术语表）' ELSE '- a: b' || chr(10) || '- c: d' END || ' {x}') AS prompt FROM conversations""")
def judge_prompts(spark, sf):
    pair = lambda a, b: F.struct(F.lit(a).alias("term"), F.lit(b).alias("rendering"))
    known = F.when(F.col("turn") % 2 == 0, F.array().cast("array<struct<term:string,rendering:string>>")).otherwise(F.array(pair("a", "b"), pair("c", "d")))
    asked = prompts.judge_prompt("S {source} T {translation} G {glossary} {x}", F.coalesce("text", F.lit("")), F.concat(F.lit("译文："), "role"), known)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.sha2(asked, 256).alias("prompt"))


@query("""SELECT conv_id, string_agg(title, '|' ORDER BY idx) AS sections FROM (SELECT conv_id, title, idx, row_number() OVER (PARTITION BY conv_id ORDER BY idx) AS n FROM (
SELECT conv_id, CASE WHEN turn % 4 = 0 THEN 'Document Root' ELSE role || ' > ' || turn % 3 END AS title, min(turn) AS idx FROM conversations GROUP BY 1, 2)) WHERE n <= 3 GROUP BY conv_id""")
def section_overview(spark, sf):
    path = F.when(F.col("turn") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.col("role"), (F.col("turn") % 3).cast("string")))
    chunks = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("idx"), path.alias("section_path"), X.section_title(path).alias("section_title"))
    return prompts.section_lists(chunks, "conv_id", 3).select("conv_id", F.array_join("sections", "|").alias("sections"))


@query("""SELECT l_orderkey AS task_id, count(*) AS chunks, count(*) FILTER (WHERE l_returnflag <> 'R') AS completed, count(*) FILTER (WHERE l_returnflag = 'R') AS failed,
count(*) FILTER (WHERE l_linestatus = 'F') AS repaired, count(*) FILTER (WHERE l_linenumber = 1) AS cached, round(count(*) * 60 / CAST(sum(l_linenumber) AS DOUBLE), 1) AS per_minute FROM lineitem GROUP BY l_orderkey""")
def run_summary(spark, sf):
    results = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("task_id"), (F.col("l_returnflag") != "R").alias("success"), (F.col("l_linestatus") == "F").alias("repaired"), (F.col("l_linenumber") == 1).alias("cached"), F.col("l_linenumber").cast("double").alias("duration"))
    return reporting.run_summary(results, "task_id")


@query("""SELECT event_type AS variant, user_id AS sample_id, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 3) AS latency_s, CAST(sum(CASE WHEN event_id % 2 = 0 THEN event_id ELSE user_id END) AS BIGINT) AS total_tokens, count(*) AS calls FROM events GROUP BY event_type, user_id""")
def variant_measures(spark, sf):
    ts = F.col("ts").cast("timestamp")
    calls = table(spark, sf, "events").select(F.col("event_type").alias("variant"), F.col("user_id").alias("sample_id"), ts.alias("began"), ts.alias("ended"), F.when(F.col("event_id") % 2 == 0, F.col("event_id")).alias("total"), F.col("user_id").alias("prompt_tokens"), F.lit(None).cast("long").alias("completion_tokens"))
    return reporting.measures(calls)


@query("""SELECT CAST(sum(t) AS BIGINT) AS total_tokens, CAST(sum(c) AS BIGINT) AS calls FROM (SELECT n_chars AS t, 1 AS c FROM documents UNION ALL SELECT 3, 2 FROM labels)""")
def evaluation_cost(spark, sf):
    return reporting.cost(table(spark, sf, "documents").select(F.col("n_chars").alias("total_tokens"), F.lit(1).alias("calls")), table(spark, sf, "labels").select(F.lit(3).alias("total_tokens"), F.lit(2).alias("calls")))


def _cell(x: str) -> str:
    """A mean to 3 places, rounded half up to 2."""
    n = f"(CAST(round(round({x}, 3) * 1000) AS BIGINT) + 5) // 10"
    return f"printf('%d.%02d', {n} // 100, {n} % 100)"


SCORES = ["quality * 4 + 1", "5 - toxic", "3.0::DOUBLE", "round((quality * 4 + 1 + 5 - toxic + 3.0::DOUBLE) / 3, 3)"]


@query(f"""SELECT '| ' || source || ' | ' || count(*) || ' | ' || {" || ' | ' || ".join(_cell(f"avg({x})") for x in SCORES)} || ' | ' || CAST(sum(n_chars) AS BIGINT) || ' | ' || {_cell("avg(n_chars / 8.0::DOUBLE)")} || ' |' AS line FROM documents JOIN labels USING (doc_id) GROUP BY source""")
def score_lines(spark, sf):
    """Lines of a score table."""
    return variant_aggregate(spark, sf).select(reporting.variant_line(F.col("variant")).alias("line"))


@query(f"""WITH {GRAMS_SQL}, o AS (SELECT phrase, occurrences, occurrences % 2 = 0 AS same FROM df)
SELECT CAST(row_number() OVER (ORDER BY occurrences DESC, phrase) - 1 AS INT) AS nth, '| ' || phrase || ' | ' || occurrences || ' | ' || CASE WHEN same THEN '✅' ELSE '❌' END || ' | ' || '—' || ' |' AS line
FROM o QUALIFY nth < 30""")
def consistency_report(spark, sf):
    phrases = ngram_df(spark, sf).withColumns({"consistent": F.col("occurrences") % 2 == 0, "signature": F.lit("")})
    return reporting.consistency_lines(phrases)


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'f' || event_id || '.md' WHEN 1 THEN 'translation.md' WHEN 2 THEN 'a.b.md' ELSE '.env.md' END AS name FROM events""")
def download_names(spark, sf):
    e = F.col("event_id")
    given = F.when(e % 4 == 0, F.concat(F.lit("x/f"), e.cast("string"), F.lit(".epub"))).when(e % 4 == 1, "  .pdf").when(e % 4 == 2, "a.b.pdf").otherwise(".env")
    return table(spark, sf, "events").select("event_id", sinks.download_name(given, ".md").alias("name"))


@query(f"""SELECT lang AS glossary_id, '{{' || chr(10) || string_agg('  ' || CAST(to_json(term) AS VARCHAR) || ': ' || CAST(to_json(rendering) AS VARCHAR), ',' || chr(10) ORDER BY pos) || chr(10) || '}}' AS json
FROM (SELECT DISTINCT lang, pos, term, rendering FROM documents, {TERMS_SQL} WHERE lang IS NOT NULL AND contains(lower(text), lower(term))) GROUP BY lang""")
def glossary_export(spark, sf):
    found = G.matches(table(spark, sf, "documents").filter("lang IS NOT NULL").select(F.col("lang").alias("glossary_id"), "text"), terms(spark)).drop("text").distinct()
    return sinks.glossary_json(found)


@query("SELECT p_brand AS glossary_id, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS INT) AS pos, p_name || ' ' || p_partkey AS term, p_type AS rendering FROM part")
def glossary_read_back(spark, sf):
    """A glossary of each brand's parts, written as JSON and read again, is the same in the same order."""
    parts = table(spark, sf, "part").select(F.col("p_brand").alias("glossary_id"), F.col("p_partkey").alias("pos"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("term"), F.col("p_type").alias("rendering"))
    return scans.glossary_terms(sinks.glossary_json(parts))


@query(f"""SELECT e.event_id FROM events e WHERE e.user_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 0 AND o_orderstatus IN ('P', 'O'))""")
def cancelled_suppressed(spark, sf):
    t = order_tasks(spark, sf)
    gone = tasks.cancel(t, t.filter("task_id % 7 = 0"), now())
    return tasks.without_cancelled(table(spark, sf, "events").select(F.col("user_id").alias("task_id"), "event_id"), gone).select("event_id")


@query(f"""SELECT count(*) AS total, count(*) FILTER (WHERE s IN ('completed', 'partial_success')) AS finished, count(*) FILTER (WHERE s = 'processing') AS processing FROM (SELECT {STATUS} AS s, o_orderkey AS k FROM orders) WHERE NOT (k % 5 = 0 AND s <> 'processing')""")
def task_removal(spark, sf):
    t = order_tasks(spark, sf)
    return tasks.counts(tasks.remove(t, t.filter("task_id % 5 = 0")))


@query("""SELECT o_orderkey AS task_id, CASE o_orderkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS terms FROM orders""")
def task_glossary(spark, sf):
    entries = F.from_json("json", "map<string,string>")
    known = spark.createDataFrame([("g0", '{"a": "b", "c": "d"}'), ("g1", '{"a": "b"}'), ("g2", "bad")], "glossary_id string, json string").select("glossary_id", entries.alias("entries"))
    t = order_tasks(spark, sf).withColumn("glossary_id", F.concat(F.lit("g"), F.pmod("task_id", F.lit(3)).cast("string")))
    return tasks.with_glossary(t, known).select("task_id", F.size("entries").alias("terms"))


COUNTED = "'# A' || chr(10) || '::: quote' || chr(10) || 'x[]{#a}' || chr(10) || ':::' || chr(10) || '```' || chr(10) || '```' || chr(10) || '::: {.toc}' || chr(10) || html"


@query("SELECT page_id, " + ", ".join(f"len(regexp_extract_all({COUNTED}, '{p}')){d} AS {n}" for n, p, d in [
    ("headers", "(?m)^#{1,6}[^#\\n]", ""), ("quotes", "(?m)^:::+ *\\{?\\.?(?:quote|blockquote|center|block)\\b", ""), ("contents", "(?m)^:::+ *\\{?\\.?(?:toc|tableofcontents)\\b", ""), ("emphasis", "\\*", ""),
    ("anchors", "\\[\\]\\{#[^}]+\\}", ""), ("comments", "<!--", ""), ("images", "!\\[[^\\]]*\\]\\([^)]+\\)", ""), ("code_blocks", "(?m)^[ \\t]*```", " // 2"),
]) + ", 1::BIGINT AS enhanced FROM pages")
def format_counts(spark, sf):
    raw = F.concat(F.lit("# A\n::: quote\nx[]{#a}\n:::\n```\n```\n::: {.toc}\n"), "html")
    return table(spark, sf, "pages").select("page_id", reporting.format_counts(raw).alias("c")).select("page_id", "c.*")


@query()
def translated_documents(spark, sf):
    """Every document planned, translated by the stub, checked, repaired and rendered."""
    out = document.translated_documents(table(spark, sf, "documents").select("doc_id", "text"), terms(spark), bilingual=True)
    return out.select("doc", F.char_length("markdown").alias("chars"), F.sha2("markdown", 256).alias("sha256"))


# --- rules of issues, prompts, calls and their cache ----------------------------------------------------------------

KINDS = {"untranslated": ("high", 2), "terminology": ("medium", 3), "markdown": ("high", 5), "repetition": ("low", 7)}
WEIGHT = " + ".join(f"CASE WHEN {{0}} % {n} = 0 THEN {dict(high=3, medium=2, low=1)[w]} ELSE 0 END" for w, n in KINDS.values())


@query(f"""SELECT doc_id, {WEIGHT.format('doc_id')} AS severity, doc_id % 2 = 0 OR doc_id % 3 = 0 OR doc_id % 5 = 0 AS repairs, {WEIGHT.format('doc_id')} <= {WEIGHT.format('(doc_id + 1)')} AS better FROM documents""")
def issue_severity(spark, sf):
    """Weights of issues, which of them ask for a repair, and whether a report is no worse than another."""
    found = lambda n: F.filter(F.array(*[X.issue(n % m == 0, kind, weight, F.lit("m")) for kind, (weight, m) in KINDS.items()]), lambda i: i.isNotNull())
    own, other = found(F.col("doc_id")), found(F.col("doc_id") + 1)
    return table(spark, sf, "documents").select("doc_id", X.severity_score(own).alias("severity"), X.should_repair(own).alias("repairs"), X.is_better(own, other).alias("better"))


@query(f"""SELECT conv_id, turn, sha256('{WORDS.translator}' || chr(10) || chr(10) || '[Profile]' || chr(10) || '文档摘要: ' || role || chr(10) || chr(10) || '[Glossary]' || chr(10) || '- x: y' || chr(10) || chr(10) || '[Section]' || chr(10) || 'A > ' || role || chr(10) || chr(10) || '[Context]' || chr(10) || text || chr(10) || chr(10) || '{prompts.numbered(WORDS.translation).replace(chr(10), "' || chr(10) || '")}') AS prompt FROM conversations""")
def translation_prompts(spark, sf):
    none = F.array().cast("array<string>")
    profile = F.struct(F.col("role").alias("summary"), none.alias("style_notes"), none.alias("terminology_hints"), none.alias("section_overview"))
    known = F.array(F.struct(F.lit("x").alias("term"), F.lit("y").alias("rendering")))
    asked = prompts.translation_prompt(WORDS, profile, known, X.breadcrumb(F.array(F.lit("A"), "role")), F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.sha2(asked, 256).alias("prompt"))


@query("""SELECT page_id, sha256(CASE WHEN page_id % 2 = 0 THEN html ELSE 'a' || chr(10) || html END) AS body FROM pages""")
def template_bodies(spark, sf):
    """A template's text is what follows its first line of three dashes."""
    raw = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("name: x\n---\n\n"), "html", F.lit("\n"))).otherwise(F.concat(F.lit(" a\n"), "html", F.lit(" \n\n")))
    return table(spark, sf, "pages").select("page_id", F.sha2(prompts.template_body(raw), 256).alias("body"))


@query("""SELECT doc_id, doc_id % 4 IN (1, 2) AS accepted, CASE WHEN doc_id % 4 IN (1, 2) THEN sha256(text) END AS body FROM documents""")
def submission_bodies(spark, sf):
    """Exactly one of a text and its base64 is taken."""
    kind = F.col("doc_id") % 4
    given = table(spark, sf, "documents").select("doc_id", F.when(kind % 2 == 1, F.col("text")).alias("text"), F.when(kind >= 2, F.base64(F.encode("text", "UTF-8"))).alias("content_base64"))
    return scans.submissions(given).select("doc_id", "accepted", F.sha2("body", 256).alias("body"))


@query("""SELECT conv_id, turn, sha256(array_to_string(list_transform(list_filter(string_split(text || chr(10) || '![a](p' || turn || '.png)' || chr(10) || chr(10) || '![b](q.png)', chr(10)), lambda x: NOT (turn % 2 = 0 AND x = '![a](p' || turn || '.png)')), lambda x: CASE WHEN trim(x) = '' THEN x ELSE '> ' || x END), chr(10)) || chr(10) || chr(10) ||
CASE WHEN turn % 2 = 0 THEN '译 ![z](p' || turn || '.png)' ELSE '译' END || chr(10) || chr(10) || '---') AS part FROM conversations""")
def streamed_parts(spark, sf):
    """Chunks as they are streamed: an image that the translation has is left out of the quoted source."""
    image = F.concat(F.lit("p"), F.col("turn").cast("string"), F.lit(".png"))
    source = F.concat("text", F.lit("\n![a]("), image, F.lit(")\n\n![b](q.png)"))
    told = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("译 ![z]("), image, F.lit(")"))).otherwise(F.lit("译"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.sha2(rendering.stream_format(source, told), 256).alias("part"))


class FlakyModel:
    """Fails on prompts of kind 2, and once on those of kind 1; tells its tokens. It remembers only what it still has to answer."""

    def __init__(self) -> None:
        self.failed: set[str] = set()

    def translate(self, prompt: str, text: str) -> tuple[str, int, int]:
        if prompt == "2":
            raise ValueError("down")
        if prompt == "1" and text not in self.failed:
            self.failed.add(text)
            raise ValueError("down")
        self.failed.discard(text)
        return text.upper(), 1, 2


@query("""SELECT event_id, CASE WHEN event_id % 3 = 2 THEN '[翻译失败: down]' ELSE upper(event_type) || event_id END AS answer, event_id % 3 <> 2 AS success, CAST(event_id % 3 AS INT) AS retry_count, CASE WHEN event_id % 3 <> 2 THEN 3 ELSE 0 END::BIGINT AS tokens FROM events""")
def model_calls(spark, sf):
    """Answers, failures, retries and tokens of a model that fails now and then, asked by several tasks at once."""
    rows = table(spark, sf, "events").select("event_id", (F.col("event_id") % 3).cast("string").alias("prompt"), F.concat("event_type", F.col("event_id").cast("string")).alias("text"))
    told = translate.call_model(rows, FlakyModel(), "translate", 2, 0.0, translate.Limits(10, None))
    return told.select("event_id", "answer", "success", "retry_count", F.coalesce("tokens", F.lit(0)).alias("tokens"))


TURN_TERMS = f"EXISTS (SELECT 1 FROM {TERMS_SQL} WHERE contains(lower(text), lower(term)) AND NOT contains('译文：' || text, rendering) AND NOT (trim(split_part(rendering, ' (', 1)) <> '' AND contains('译文：' || text, trim(split_part(rendering, ' (', 1)))))"


@query(f"""SELECT conv_id * 1000 + turn AS doc, sha256(CASE WHEN regexp_matches(text, '{SPAN}') OR {TURN_TERMS} THEN '修复后的译文' ELSE '译文：' || text END) AS translation, true AS cached FROM conversations""")
def cache_replay(spark, sf):
    """Every turn through the stub, its answers into an empty cache, then again: the second run takes all from the cache."""
    docs = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    none = spark.createDataFrame([], "cache_key string, cached_translation string")
    first = document.cache_updates(document.translated_chunks(docs, terms(spark), cache=none))
    again = document.translated_chunks(docs, terms(spark), cache=written(first, "cache"))
    return again.select("doc", F.sha2("translation", 256).alias("translation"), "cached")

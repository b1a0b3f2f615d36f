"""The corpus pipeline against a brute-force version of its stages."""

from pyspark.sql import functions as F

import corpus_pipeline
from lexweave.llm import pii

from ..conftest import SF
from .test_operators import brute_near


def test_run_matches_brute_force(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    kept = {i: t for i, t in rows.items() if t and any(c.isalpha() for c in t)}
    last = {}
    for i, t in sorted(kept.items()):
        last[t] = i
    kept = {i: t for t, i in last.items()}
    ids = sorted(kept)
    groups = brute_near([kept[i] for i in ids])
    kept = {ids[k]: kept[ids[k]] for k, c in enumerate(groups) if c == k}
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: len(tok.encode(pii.replace_text(t, pii.session_key(spark))[0], add_special_tokens=False).ids) + 1 for i, t in kept.items()}
    got = corpus_pipeline.run(spark, SF).toPandas()
    assert got.groupby("doc_id")["length"].sum().to_dict() == want
    assert (got.offset + got["length"]).max() <= 2048


def test_stages_keep_columns_and_take_edges(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(1, None, "en", "s", None), (2, "", None, "s", 0), (3, "the and of", "en", "s", 10), (3, "the and of", "en", "s", 10), (4, "12 34", "en", None, 5), (5, "Mail a@b.co", "en", "s", 11)], schema).withColumns({c: F.lit("own") for c in ("lang_pred", "score", "pii_kinds", "text_key", "kept")})
    out = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, SF)
        assert out.columns == docs.columns
    left = {r.doc_id: r for r in out.collect()}
    assert left[5].lang_pred == left[5].score == left[5].pii_kinds == left[5].kept == "own"
    assert sorted(left) == [3, 5] and "a@b.co" not in left[5].text and left[5].n_chars == len(left[5].text)
    assert corpus_pipeline.STAGES[-1][1](spark, out, SF).count() == 2
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_language_stage_fills_and_judges(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").filter("lang in ('en', 'fr')")
    hidden = docs.withColumn("lang", F.when(F.col("doc_id") % 5 != 0, F.col("lang")))
    told = dict(docs.select("doc_id", "lang").collect())
    got = dict(corpus_pipeline.identify(spark, hidden, SF).select("doc_id", "lang").collect())
    assert len(got) > 0.99 * len(told) and sum(told[i] == l for i, l in got.items()) > 0.97 * len(got) and None not in got.values()
    # Nothing to learn from: what has a letter stays.
    bare = spark.createDataFrame([(1, "words", None), (2, "12 34", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [r.doc_id for r in corpus_pipeline.identify(spark, bare, SF).collect()] == [1]

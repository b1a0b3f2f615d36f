"""What a limit once cut off, and extra columns of any name."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexweave.llm import exact_dedup, language_id, pii

from ..conftest import SF

KEY = b"k"


def left(text):
    new = pii.replace_text(text, KEY)[0]
    return [w for w in text.replace(".", " ").replace(",", " ").split() if w in new.replace(".", " ").replace(",", " ").split()]


def test_a_name_has_any_number_of_words():
    assert left("Mrs. Anna Maria Luisa Bellini came home") == ["Mrs", "came", "home"]
    long = " ".join(["Anna", "Berta", "Clara", "Dora", "Emma", "Flora", "Greta", "Hanna"])
    assert left(f"Frau {long} Weber ging") == ["Frau", "ging"]
    assert left("MRS. ANNA MARIA LUISA BELLINI AND OTHERS") == ["MRS", "AND", "OTHERS"]
    assert left("Herr Ludwig van der Berg spielt") == ["Herr", "van", "der", "spielt"]
    assert left("Mr. Smith of London") == ["Mr", "of", "London"] and left("Mr. Smith de facto") == ["Mr", "de", "facto"]
    assert left("Mr. Adam Stone Mrs. Eve Brook left") == ["Mr", "Mrs", "left"]


def test_more_languages_than_allowed_raise(spark):
    for n in (3, 4, 6, 12):
        rows = spark.createDataFrame([(f"l{i}", f"word{chr(97 + i)} " * 5) for i in range(n)] * 3, "lang string, text string")
        with pytest.raises(ValueError, match=f"{n} languages"):
            language_id.train(rows, bits=4, max_langs=2)
        assert len(language_id.train(rows, bits=4, max_langs=n).langs) == n


#: Names that stages use inside.
HELPERS = "predicted posterior kinds exceptions of_document gone_id gone_digest again gone_key __lang __score __pii_kinds __other __doc __id __digest __key id digest keep_id group_size kept text_key rep text_sha256 locator row file canon".split()


def test_extra_columns_of_any_name_stay_as_they_are(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    docs = docs.unionByName(docs.limit(5)).unionByName(docs.limit(5).withColumn("doc_id", F.col("doc_id") + 100_000)).withColumns({c: F.concat(F.lit(f"own {c} "), "doc_id") for c in HELPERS})
    docs = docs.withColumn("text", F.concat("text", F.lit(" Dr. Jane Smith, jane@smith.org; Ms. Jane Smith")))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert [c for c in docs.columns if c in HELPERS] == HELPERS
        bad = docs.filter(" OR ".join(f"NOT `{c}` <=> concat('own {c} ', doc_id)" for c in HELPERS))
        assert bad.count() == 0 and docs.count() > 40
    assert corpus_pipeline.pack(spark, docs, SF).count() >= docs.count()
    upper = docs.withColumnsRenamed({"gone_id": "GONE_ID", "gone_digest": "Gone_Digest"})
    assert exact_dedup.drop_copies(upper).columns == upper.columns

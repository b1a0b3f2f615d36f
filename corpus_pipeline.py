"""A corpus pipeline of five stages: language ID, exact dedup, SimHash near-dedup, PII surrogates, packing.

Part of the subpackage llm. Every stage works on all rows that its predecessor kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm import exact_dedup, language_id, near_text, packing, pii
from lexweave.llm.shared import Workspace, free_names


#: A document goes if even its likeliest language has a lower posterior than this.
CONFIDENCE = 0.5


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no known language go: null texts, those without a letter, and those whose likeliest language is less likely than not.

    The prediction fills a null lang. Without any labelled row there is nothing to judge by: all documents with a letter stay.
    Empty tables give no rows, repeated rows stay, columns of any name are kept as they are.
    """
    model = language_id.train(docs.select("lang", "text"))
    lang, score = free_names(docs.columns, "predicted", "posterior")
    judged = language_id.predict(docs, model, names=(lang, score))
    if not model.langs:
        return judged.filter(F.col("text").rlike("\\p{L}")).select(*docs.columns)
    kept = judged.filter((F.col(lang) != "und") & (F.col(score) >= CONFIDENCE))
    return kept.select(*[F.coalesce("lang", lang).alias("lang") if c == "lang" else F.col(c) for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null counts as empty) the row with the largest doc_id stays, null ids last; of repeated rows one."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts of a similarity of 0.8 or more (five-word shingles) the smallest doc_id stays.

    Rows with a null doc_id stay. Rows are told by doc_id and text, so of an id on several texts only the copies go.
    """
    gone_id, gone_key = free_names(docs.columns, "gone_id", "gone_key")
    gone = near_text.near_groups(docs.select("doc_id", "text")).filter("not kept").select(F.col("doc_id").alias(gone_id), F.col("text_key").alias(gone_key))
    return docs.join(gone, (F.col("doc_id") == F.col(gone_id)) & (F.xxhash64(F.col("text").cast("string")) == F.col(gone_key)), "left_anti")


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates; n_chars follows the text. Null texts stay null; other columns, of any name, stay as they are."""
    out = pii.replace_pii(docs, pii.session_key(spark), kinds_col=free_names(docs.columns, "kinds")[0])
    return out.select(*[F.char_length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies in sequences of 2048 tokens. A null text counts as empty; repeated rows are packed one by one."""
    return packing.pack_documents(docs.select("doc_id", "text"))


STAGES = [("language_id", identify), ("exact_dedup", drop_copies), ("simhash_near_dedup", drop_near_copies), ("pii_surrogates", replace_pii), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all documents. A stage's table goes as soon as the next one is written, so no text from before the surrogates stays."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, ws.save(stage(spark, docs, sf_dir), name)
        ws.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Classification, near copies, surrogates and packing aren't SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None

"""A corpus pipeline of five stages; each stage's rows are written and read again for the next.

``run(spark, sf_dir)`` applies ``STAGES`` to the documents of ``sf_dir``. All stages but the
last return the columns of documents, in their order, with whatever other columns a table has.

In every stage: an empty table gives an empty table; a null text counts as an empty one and stays null; texts of
any length are worked on whole; an id of any size, and a null id, stays what it is. Rows are rows: those that are equal in all columns
share their fate where a stage judges the text, and each that stays is returned.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, packing, quality, secrets, simhash
from tessera.llm.common import materialise, table
from tessera.session import import_path

#: Near duplicates share at least this part of their five-word shingles.
WORDS, SIMILARITY = 5, 0.8


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go. Without enough labels none does; a null source, language or length is a value of its own."""
    import_path(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays.

    Texts without words are alike. Rows that share the id that stays all stay, and so do rows without an id.
    """
    import_path(spark)
    return simhash.keep_first(docs, WORDS, SIMILARITY)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go, with all rows that share their id; rows without an id share one in this."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; ``n_chars`` follows (null for a null text). No row goes."""
    forest = secrets.train(secrets.labelled_findings(spark))
    clean = secrets.redact(docs, forest)
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their place in sequences of 2048 tokens; an empty text is its end token, and other columns are left out."""
    import_path(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_filter),
    ("simhash", near_dedup),
    ("decontamination", decontamination),
    ("secrets", secret_scan),
    ("packing", pack),
]

#: Trained models and Hamming components are not SQL: the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, f"stage-{name}")
    return docs

"""The queries of this subpackage, as the entry module registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import brown, decontaminate, packing, quality, secrets, simhash, suffixes, topk, toxicity, url_templates
from tessera.llm.common import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), of_ids=F.crc32("ids").alias("ids_crc32"))
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "class")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op3_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.evaluate(table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"), secrets.train(secrets.labelled_findings(spark)))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.group(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1.0).when(F.col("quality").isNotNull() & F.col("toxic").isNotNull(), 0.0)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), good.alias("good"))
    return url_templates.judge(table(spark, sf_dir, "pages"), labels)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_topk": op2_topk,
    "op3_brown": op3_brown,
    "op4_secrets": op4_secrets,
    "op5_decontaminate": op5_decontaminate,
    "op6_suffixes": op6_suffixes,
    "op7_simhash": op7_simhash,
    "op8_toxicity": op8_toxicity,
    "op9_quality": op9_quality,
    "op10_url_templates": op10_url_templates,
}

ORACLES: dict[str, str] = {
    "op2_topk": topk.ORACLE,
    "op5_decontaminate": decontaminate.ORACLE,
    "op10_url_templates": url_templates.oracle(),
}

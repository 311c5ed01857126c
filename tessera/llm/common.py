"""What several operators share: scratch tables, safe columns, shard counts."""

from __future__ import annotations

import functools
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import materialise

__all__ = ["ascii_lower", "crc_mod", "materialise", "real_ids", "shuffle_parts", "small", "table", "tokenizer", "unused", "with_ids"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_mod(c: Column, n: int) -> Column:
    """crc32 of a column's text, mod ``n``."""
    return F.crc32(c.cast("string").cast("binary")) % n


@functools.cache
def tokenizer(path: str):
    """A ``tokenizers.Tokenizer``, read once a Python process."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_ids(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id and no_id, neither of them null, and some columns as strings: pandas makes floats of integers beside a null, which changes large ones."""
    ids = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(ids, F.lit(0)).alias("doc_id"), ids.isNull().alias("no_id"), *(F.col(c).cast("string").alias(c) for c in columns))


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def real_ids(df: DataFrame) -> DataFrame:
    """``df`` with its ids as they were before ``with_ids``."""
    return df.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")


#: Rows that are broadcast at most.
BROADCAST = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """``df``, written before, to be broadcast if its rows are at most ``BROADCAST``; else joined by a shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST else df

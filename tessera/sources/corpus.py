"""Sources of documents and queries, and the text forms of the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schemas


#: A table up to this size in fewer files than there are cores is dealt over all cores; larger ones are read as they lie.
SMALL_BYTES = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """Small tables over all cores: one file may be one row group, which only one task can read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    files = df.inputFiles()
    if len(files) >= cores:
        return df
    size = df.sparkSession.read.format("binaryFile").load(files).agg(F.sum("length")).first()[0]
    return df.repartition(cores) if (size or 0) <= SMALL_BYTES else df


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """(doc_id, text) of a Parquet table."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))


def directory(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) of a folder of text files with integer names; another name fails the query."""
    files = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("name"), F.col("value").alias("text"))
    # Spark's sources give no row for an empty file
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(place)
    empty = [x.getPath().getName() for x in listed if x.isFile() and not x.getLen() and x.getPath().getName()[0] not in "._"]
    if empty:
        files = files.unionByName(spark.createDataFrame([(name, "") for name in empty], "name string, text string"))
    named = F.when(F.col("name").rlike("^[0-9]+$"), F.col("name").cast("long"))
    return files.select(F.coalesce(named, F.raise_error(F.concat(F.lit("not a document's number: "), "name")).cast("long")).alias("doc_id"), "text")


def queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, raw): a query each line of the file, numbered from 0."""
    whole = spark.read.text(path, wholetext=True)
    found = whole.select(F.posexplode(F.split(F.regexp_replace("value", r"(\r\n|\n|\r)\z", ""), "\r\n|\n|\r", -1)).alias("query_id", "raw"))
    return found.select(F.col("query_id").cast("long").alias("query_id"), "raw")


def inline(spark: SparkSession, lines: list[str]) -> DataFrame:
    """(query_id, raw) of a few given lines, as a literal relation."""
    if not lines:
        return spark.range(0).select(F.col("id").alias("query_id"), F.lit("").alias("raw"))
    rows = F.array(*(F.struct(F.lit(i).cast("long").alias("query_id"), F.lit(x).alias("raw")) for i, x in enumerate(lines)))
    return spark.range(1).select(F.explode(rows).alias("q")).select("q.query_id", "q.raw")


def csv_rows(df: DataFrame, key: str, values: str, *first: str) -> DataFrame:
    """One text row each: ``first``, the key and its list, joined by commas."""
    return df.select(F.concat_ws(",", *first, F.col(key), F.array_join(F.col(values).cast("array<string>"), ",")).alias("value"))


def write_table(df: DataFrame, path: str, name: str) -> DataFrame:
    """A Parquet table of the index, and the table read again.

    Tables with a bucket are partitioned by it. Rows are dealt by ranges of (bucket, term, doc_id), so a task
    writes few buckets, files hold ranges of terms, and a very frequent term still goes to several tasks.
    """
    if "bucket" in df.columns:
        keys = [c for c in ("bucket", "term", "doc_id") if c in df.columns]
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}")
    else:
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    return read_table(df.sparkSession, path, name)


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(getattr(schemas, name.upper())).parquet(f"{path}/{name}")

"""Search as a stream: lines of queries arrive, each micro-batch is searched against a fixed index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.plans.search import Index, search
from tessera.session import scratch


def query_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(query_id, raw) of Parquet files that arrive in a folder."""
    return spark.readStream.schema("query_id long, raw string").parquet(folder)


def text_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(query_id, raw) of the lines of text files that arrive in a folder; ids are hashes of the file's path and the line's number, so that equal lines are queries of their own."""
    files = spark.readStream.text(folder, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    lines = files.select("file", F.posexplode(F.split(F.regexp_replace("value", r"(\r\n|\n|\r)\z", ""), "\r\n|\n|\r", -1)).alias("line_no", "raw"))
    return lines.select(F.xxhash64("file", "line_no").alias("query_id"), "raw")


def serve(stream: DataFrame, idx: Index, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None, **options) -> StreamingQuery:
    """Searches each micro-batch and hands its results to ``sink``; no state is kept between them, and their scratch tables go.

    ``every``: goes on and looks for new files at this interval; without it, ends when what has arrived is answered.
    """

    def each(batch: DataFrame, number: int) -> None:
        with scratch(batch.sparkSession):
            sink(search(idx, batch, **options), number)

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()

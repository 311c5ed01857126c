"""Session helpers."""

from __future__ import annotations

import contextlib
import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Bytes of an Arrow batch at most: what a Python worker, and the executor's buffers beside it, hold at once.
BATCH_BYTES = 8 << 20


def import_path(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it (a cluster installs it, or ships it with --py-files).

    Arrow batches are bounded by bytes too, unless the session's bound is lower: long texts make 10,000 rows large.
    """
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    low = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(bound))
    if low > BATCH_BYTES:
        spark.conf.set(bound, str(BATCH_BYTES))
    here, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    if here not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), here) if x)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where that is unset and the master is local, a temporary folder takes its place.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        if kept.isDefined():
            return kept.get()
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(where)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return where


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it again.

    Cuts the lineage: a lost executor costs the tasks that ran on it, not the stages before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if open_ := getattr(_LOCAL, "open", None):
        open_[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


_LOCAL = threading.local()


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What ``materialise`` writes inside is deleted at the end: for work whose results are used up by then."""
    stack = _LOCAL.__dict__.setdefault("open", [])
    stack.append([])
    try:
        yield
    finally:
        for path in stack.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)

"""Folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir; a temporary one where none is set, on a local master only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go as soon as it has run, not when the driver next collects its garbage; the session's own setting comes back."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    own = spark.conf.getAll.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if own is None else spark.conf.set(name, own)


def drained(stream: DataFrame) -> DataFrame:
    """Run an append stream over all that is there into Parquet files of the shared folder, and read these."""
    spark = stream.sparkSession
    out, state = shared_dir(spark), shared_dir(spark)
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)

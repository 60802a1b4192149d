"""Incremental refresh: new files of raw rows are merged into stored tables, batch by batch."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import aggregates
from lectern.session import scratch_dir

BUCKETS = 16


def upsert_stream(spark: SparkSession, folder: str, schema, target: str, keys: list[str], order: list[str], files_per_batch: int = 8, checkpoint: str | None = None, buckets: int = BUCKETS) -> None:
    """Read what is new in ``folder`` and merge it into the table at ``target``, last row per key.

    The table lies in buckets by the hash of the key, each in versions: a batch reads and writes only the buckets that
    its keys fall in, as a new version named by its number. A batch that is run again after a failure writes the same.
    """
    checkpoint = checkpoint or os.path.join(scratch_dir(spark), f"stream-{uuid.uuid4().hex}")

    def merge(batch: DataFrame, number: int) -> None:
        placed = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        touched = sorted(r.bucket for r in placed.select("bucket").distinct().collect())  # at most ``buckets`` numbers
        if not touched:
            return
        before = current(batch.sparkSession, target, below=number, only=touched)
        rows = batch if before is None else before.select(*batch.columns).unionByName(batch)
        newest = aggregates.last_wins(rows, keys, order).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        newest.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/version={number:08d}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def current(spark: SparkSession, target: str, below: int | None = None, only: list[int] | None = None) -> DataFrame | None:
    """The newest whole version of each bucket, or None. Versions are listed through the file system of the path."""
    jvm, path = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    at = jvm.org.apache.hadoop.fs.Path
    names = lambda p, prefix: [n for n in (s.getPath().getName() for s in fs.listStatus(at(p))) if n.startswith(prefix)]
    newest: dict[int, str] = {}
    for version in sorted(names(target, "version=")):
        if fs.exists(at(f"{target}/{version}/_SUCCESS")) and (below is None or int(version.split("=")[1]) < below):
            newest |= {int(b.split("=")[1]): f"{target}/{version}/{b}" for b in names(f"{target}/{version}", "bucket=")}
    paths = [p for b, p in sorted(newest.items()) if only is None or b in only]
    return spark.read.parquet(*paths) if paths else None

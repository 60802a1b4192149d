"""What every operator needs from the session: tables, scratch tables, parallelism."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, so that they need no copy of it on their own path."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="lectern-code-")  # of the driver, which serves the file to the executors
    atexit.register(shutil.rmtree, folder, True)
    archive = Path(folder, f"lectern-{context.applicationId}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, Path(root.name) / file.relative_to(root))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table; Catalyst prunes its columns at the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register_views(spark: SparkSession, sf_dir: str) -> list[str]:
    """Temporary views of all tables of a folder, for SQL; their names are returned."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    names = sorted(f.getPath().getName().removesuffix(".parquet") for f in files if f.getPath().getName().endswith(".parquet"))
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return names


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset and all tasks run on this machine (tests)
    a temporary folder of this machine is used; a cluster without the setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    global _own_dir
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="lectern-")
        atexit.register(shutil.rmtree, _own_dir, True)
    return _own_dir


#: Shuffle files of a write go as soon as it has ended, not when the driver happens to collect its garbage.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, name: str = "step", lean: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lineage cut that survives the loss of executors.

    ``lean`` is for tables of texts: they are packed closer, and what the write shuffled is deleted at its end.
    """
    spark = df.sparkSession
    path = os.path.join(scratch_dir(spark), f"lectern-{name}-{uuid.uuid4().hex}")
    if lean:
        before = spark.conf.get(_TIDY, "false")
        spark.conf.set(_TIDY, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            spark.conf.set(_TIDY, before)
    else:
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``cut`` from which all that is wanted has been written on. No plan that is still to run may read them."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.written_to)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """Give a Python-heavy stage at least one task per core when the input is one small file.

    Inputs with enough splits stay as they are, so nothing is shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < max(2, cores // 2) else df

"""Places in an order: ordinals, shards, batches, dictionary numbers, first choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.session import cut


def ordinals(df: DataFrame, *order: str | Column, name: str = "ordinal") -> DataFrame:
    """Adds the place of each row, from 0, in a total order, without a single-task window.

    Rows are sorted by range; what reaches the driver is one count per partition, from which each partition's first
    place follows.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    laid = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    laid = cut(laid.withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id()), "ordinals")
    start, starts = 0, []
    for r in laid.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect():
        starts += [F.lit(r["_part"]), F.lit(start)]
        start += r["n"]
    offset = F.element_at(F.create_map(*starts), F.col("_part")) if starts else F.lit(0)
    place = F.col("_id") - F.shiftleft(F.col("_part").cast("bigint"), 33) + offset
    return laid.withColumn(name, place.cast("bigint")).drop("_part", "_id")


def shard_slots(df: DataFrame, ordinal: str = "ordinal", size: int = 200) -> DataFrame:
    """Adds ``shard`` and ``slot`` for shards of ``size`` rows."""
    return df.withColumn("shard", F.floor(F.col(ordinal) / size)).withColumn("slot", F.col(ordinal) % size)


def batches(df: DataFrame, size: int, value: str, ordinal: str = "ordinal") -> DataFrame:
    """Lists of ``size`` values in order: one row per batch."""
    listed = F.array_sort(F.collect_list(F.struct(ordinal, value)))
    return df.groupBy(F.floor(F.col(ordinal) / size).alias("batch")).agg(F.transform(listed, lambda x: x[value]).alias("items"))


def dictionary(df: DataFrame, value: str, *order: str, name: str = "number") -> DataFrame:
    """Numbers for distinct values by first appearance."""
    first = df.groupBy(value).agg(F.min(F.struct(*order)).alias("first"))
    return ordinals(first, "first", name=name).select(value, name)


def first_choice(df: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """The first row of each group; Spark limits groups in each task before they are shuffled."""
    own = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n")


def first_in_edition(df: DataFrame, edition: str = "toc_key", order: str = "row_idx") -> DataFrame:
    """First row per key within each edition; without a key, title and names stand for it. Copies in other editions stay."""
    names = F.array_join(F.col("authors.name"), ",")
    key = F.coalesce(F.nullif("dblp_key", F.lit("")), F.concat_ws("|", F.coalesce("title", F.lit("")), names))
    return first_choice(df.withColumn("_key", key), [edition, "_key"], order).drop("_key")

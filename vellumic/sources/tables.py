"""Tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Setting of a session whose owner knows that its files have few row groups, each of which one
#: task would read alone: rows are then dealt out over so many partitions. Unset, nothing moves.
PARTITIONS = "spark.vellumic.read.partitions"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    n = spark.conf.get(PARTITIONS, None)
    return rows.repartition(int(n)) if n else rows

"""Reader of Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Spark cuts a file in splits of no less than this (spark.sql.files.openCostInBytes), and a row group is never cut.
SPLIT = 4 << 20
PIECE = 1 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """folder/name.parquet. A table of less than a split for each core may lie in one row group and so in one task: such a small one
    is dealt to all cores. Larger ones are read as they lie, without a shuffle."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = spark.sparkContext.defaultParallelism
    wanted = min(cores, size // PIECE)
    return df.repartition(wanted) if wanted > 1 and size < cores * SPLIT else df

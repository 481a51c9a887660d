"""Tables in the folder that driver and executors share: where lineage is cut."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark then deletes what an execution has shuffled at its end, not when the driver happens to collect its garbage.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. On a local master, which has one machine, the warehouse
    will do where that is unset; a cluster without it is refused, as its executors would write to their own disks."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (at or f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared").rstrip("/")


@contextmanager
def _shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """While the block runs, executions of the session delete their shuffle files when they end; afterwards the setting is as before."""
    before = spark.conf.get(CLEANED, None)
    spark.conf.set(CLEANED, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANED) if before is None else spark.conf.set(CLEANED, before)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df once to the shared folder and read it back with its schema. What the write has shuffled is deleted
    with its end, as only the table is read from then on."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _shuffles_deleted(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Delete tables that saved() wrote, once nothing will read them again: what came of them has been written itself."""
    for df in tables:
        if (at := getattr(df, "_saved_at", None)) is not None:
            remove(df.sparkSession, at)


def remove(spark: SparkSession, at: str) -> None:
    """Delete a folder, in whatever store it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

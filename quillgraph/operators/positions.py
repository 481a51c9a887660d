"""Global positions: the place of every row in an order over all rows, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import forget, saved

_ROWS = 33  # bits of monotonically_increasing_id() that number the rows of a partition


def positioned(rows: DataFrame, *order: Column, name: str = "position", start: int = 1) -> tuple[DataFrame, DataFrame]:
    """rows with their place in the order (long, gapless from `start`), and the table to forget() once the result is written.

    Rows are dealt to range partitions and sorted there; each partition's rows are counted, and what is before a partition is the sum
    of the counts before it: one short row for each partition, broadcast. Ties have some order among themselves, so give an order that
    tells rows apart where that matters. An empty table stays empty. A lost executor's partitions are read again from the shared
    folder, in the order in which they were written."""
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    kept = saved(sorted_, f"{name}-order")
    part, at = F.shiftright("_at", _ROWS), F.col("_at").bitwiseAND((1 << _ROWS) - 1)
    sizes = dict(kept.groupBy(part.alias("part")).count().collect())  # a row for each partition
    before, total = [], 0
    for p in sorted(sizes):
        before.append((p, total + start))
        total += sizes[p]
    offsets = F.broadcast(rows.sparkSession.createDataFrame(before, "_part long, _before long"))
    placed = kept.withColumn("_part", part).join(offsets, "_part").withColumn(name, F.col("_before") + at)
    return placed.drop("_at", "_part", "_before"), kept


def settled(rows: DataFrame, *order: Column, name: str = "position", start: int = 1) -> DataFrame:
    """positioned(), written to the shared folder; the table in between goes."""
    placed, kept = positioned(rows, *order, name=name, start=start)
    out = saved(placed, name)
    forget(kept)
    return out

"""Helpers shared by the operators: tables in the shared folder, checked broadcasts, joins with hot keys, Arrow sub-batches."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import forget as forget
from ..sources.shared import saved as saved
from ..sources.shared import shared_dir as shared_dir
from ..sources.tables import table as table

#: A set of ids of at most this many rows may be broadcast (about 100 bytes a row in a hash table: 50 MB); beyond it the join shuffles.
BROADCAST_IDS = 500_000
#: A key with more than this share of the rows is hot; there are at most 1 / HOT of them.
HOT = 1 / 1000


def small(ids: DataFrame, most: int = BROADCAST_IDS) -> bool:
    """True if ids has at most `most` rows; counts no further than that."""
    return ids.limit(most + 1).count() <= most


def by_ids(df: DataFrame, ids: DataFrame, on: str, how: str) -> DataFrame:
    """left_semi or left_anti join on an id; the ids are broadcast only after a count has bounded them."""
    return df.join(F.broadcast(ids) if small(ids) else ids, on, how)


def with_class(rows: DataFrame, classes: DataFrame, on: list[str], total: int) -> DataFrame:
    """rows joined with classes, which has one row for each value of `on` and how many rows have it in `copies`.

    The classes that hold more than HOT of the total are broadcast (at most 1 / HOT of them), so that no task gets the rows of a hot
    key; for all others a shuffled join is even enough."""
    hot = F.col("copies") > total * HOT
    heavy, light = F.broadcast(classes.where(hot)), classes.where(~hot)
    return rows.join(heavy, on).unionByName(rows.join(heavy.select(*on), on, "left_anti").join(light, on))


@contextmanager
def batches_of(spark: SparkSession, most: int) -> Iterator[None]:
    """While the block runs, the session's limit on the bytes of an Arrow batch is at most `most`; afterwards it is as before. What a
    Python worker and its executor hold at a time then follows the bytes of texts, not their number. Jobs must end in the block."""
    conf, name = spark.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    before = conf.get(name)
    if (now := before.lower().removesuffix("b")).isdigit() and int(now) <= most:
        yield
        return
    conf.set(name, most)
    try:
        yield
    finally:
        conf.set(name, before)


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches whose texts together hold about `most` bytes (one row at least), with the UTF-8 texts.

    A null text counts as an empty one."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, n in enumerate([*sizes, most]):
            if i > start and (total + n > most or i == len(sizes)):
                part = batch.slice(start, i - start)
                yield part, [x or b"" for x in part.column(column).cast(pa.binary()).to_pylist()]
                start, total = i, 0
            total += n

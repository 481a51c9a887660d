"""Unique names at scale: rows whose names collide are numbered, until no number makes a name that exists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stems import LONG
from ..sources.shared import forget, saved
from .lookup import lookup
from .positions import positioned


def numbered(stem: Column, n: Column, limit: int = LONG) -> Column:
    """A stem with a number, within the limit."""
    mark = F.concat(F.lit(" - "), n.cast("string"))
    return F.concat(F.rtrim(F.left(stem, F.lit(limit) - F.length(mark)), F.lit(" .")), mark)


def _ranked(rows: DataFrame, key: str) -> tuple[DataFrame, list[DataFrame]]:
    """rows (stem, key) with `rank` in the stem's class by key, and `size` of the class. The order over all rows deals a class of any
    size to many tasks; a rank is the distance from where the class begins."""
    placed, order = positioned(rows, F.col("stem"), F.col(key))
    placed = saved(placed, "names-placed")
    begins = placed.groupBy("stem").agg(F.min("position").alias("first"), F.count("*").alias("size"))
    ranked = saved(lookup(placed, begins, "stem", how="inner").withColumn("rank", F.col("position") - F.col("first") + 1).drop("position", "first"), "names-ranked")
    return ranked, [order, placed]


def unique_names(rows: DataFrame, key: str, limit: int = LONG) -> DataFrame:
    """key, stem, name for rows (key, stem): no two rows have one name, whatever the order of the rows.

    A stem that one row has is its name. Where several have it, the first by key keeps it and the others add their rank in the class;
    if that name exists, they go on by the size of the class until one is free (of several rows that want one name, the first by key
    gets it). Only rows of colliding classes are sorted, and each round handles only rows that are not settled yet. A null stem counts
    as Untitled; keys must differ, null ones don't. An empty table gives no rows. The result lies in the shared folder."""
    rows = saved(rows.select(key, F.coalesce(F.nullif(F.col("stem"), F.lit("")), F.lit("Untitled")).alias("stem")), "names-stems")
    colliding = saved(rows.groupBy("stem").count().where("count > 1").select("stem"), "names-colliding")
    alone = lookup(rows, colliding, "stem", how="left_anti").select(key, "stem", F.col("stem").alias("name"))
    ranked, between = _ranked(lookup(rows, colliding, "stem", how="left_semi"), key)
    done = [saved(alone.unionByName(ranked.where("rank = 1").select(key, "stem", F.col("stem").alias("name"))), "names-0")]
    pending = saved(ranked.where("rank > 1").select(key, "stem", "size", F.col("rank").alias("n")), "names-pending")
    forget(*between, ranked, colliding, rows)
    while not pending.isEmpty():
        asked = pending.withColumn("name", numbered(F.col("stem"), F.col("n"), limit))
        taken = done[0]
        for more in done[1:]:
            taken = taken.unionByName(more)
        free = asked.join(taken.select("name"), "name", "left_anti").groupBy("name").agg(F.min_by(F.struct(key, "stem", "n"), key).alias("first"))
        won = saved(free.select(f"first.{key}", "first.stem", "name"), "names-won")
        rest = saved(pending.join(won.select(key), key, "left_anti").withColumn("n", F.col("n") + F.col("size")), "names-pending")
        forget(pending)
        done.append(won)
        pending = rest
    forget(pending)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out

"""Lookups that stay even when one key, or none, stands in a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT = 1 / 1000  # a key with more than this share of the rows is heavy: there are at most 1 / HOT of them
TRACKED = 20_000  # keys that the sketch follows: what it may miss a key by is a tenth of HOT


def heavy_keys(rows: DataFrame, key: str) -> DataFrame:
    """key, share: the keys with more than HOT of the rows, by a sketch: one pass, a row of bounded size for each task and a short
    list at the end. Nothing depends on it but which task does what."""
    told = rows.agg(F.expr(f"approx_top_k(cast(`{key}` as string), {int(1 / HOT)}, {TRACKED})").alias("top"), F.count("*").alias("n"))
    each = told.select("n", F.explode("top").alias("e")).where((F.col("e.count") > F.col("n") * HOT) & F.col("e.item").isNotNull())
    return each.select(F.col("e.item").alias(key), (F.col("e.count") / F.col("n")).alias("share"))


def lookup(rows: DataFrame, side: DataFrame, key: str, fanout: int | None = None, how: str = "left") -> DataFrame:
    """rows joined with side (one row for each value of `key`); `how` is left, inner, left_semi or left_anti.

    Rows without a key are dealt to `fanout` places (four times the shuffle's partitions), those with a heavy key to its share of
    them, by a hash of the whole row; the row of side with that key goes to all of these, others to one. So the join is one shuffle of
    rows in which no task gets a heavy key, side grows by some `fanout` rows in all, and results are those of a plain join. rows are
    read twice, once for the sketch: give a saved() table where they are costly to make. Rows that are equal in all columns can't be
    told apart and stay together."""
    spark = rows.sparkSession
    n = fanout or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    heavy = F.broadcast(heavy_keys(rows, key).select(F.col(key).alias("_heavy"), F.ceil(F.col("share") * n).alias("_fan")))

    def flagged(df: DataFrame) -> DataFrame:
        return df.join(heavy, F.col(key).cast("string") == F.col("_heavy"), "left").drop("_heavy")

    fan = F.when(F.col(key).isNull(), n).otherwise(F.coalesce("_fan", F.lit(1)))
    salted = flagged(rows).withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), fan).cast("int")).drop("_fan")
    copies = flagged(side).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_fan", F.lit(1)).cast("int") - 1))).drop("_fan")
    return salted.join(copies, [key, "_salt"], how).drop("_salt")

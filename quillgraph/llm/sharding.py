"""Sharding (operator 4): vector bin packing of groups of equal texts by bytes, tokens and rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table

SHARDS = 8
#: Light groups are packed in this many bundles; a group over total / BUNDLES in any measure is placed on its own.
BUNDLES = 4096
ROWS_OF_A_PIECE = 20_000
_KEY = ["key_a", "key_b", "size"]
_MEASURES = ["bytes", "tokens", "rows"]
#: Weights of the measures in the dot product: the law is about bytes, tokens and rows are balanced as far as it allows.
WEIGHTS = (4.0, 1.0, 1.0)


def measures(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    size = F.octet_length(text).cast("long") + 1
    tokens = (F.length(text) - F.length(F.replace(text, F.lit(" "))) + 1).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), tokens.alias("n_tokens"), F.xxhash64(text).alias("key_a"), F.hash(text).alias("key_b"))


def pack(items: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item (rows of non-negative measures, each a share of its total): largest first, to where the dot product
    of the weighted item with the residual capacity is highest; ties go to the lowest shard."""
    residual = np.full((shards, items.shape[1]), 1.0 / shards)
    out = np.zeros(len(items), dtype=np.int64)
    for i in np.lexsort((np.arange(len(items)), -items.max(axis=1))) if len(items) else []:
        out[i] = best = int(np.argmax(residual @ (items[i] * WEIGHTS)))
        residual[best] -= items[i]
    return out


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null) for every row of docs (doc_id, text).

    The law is `bytes`: sizes of shards are near equal, and tokens and rows are balanced with them. Groups of equal texts stay
    together, unless one holds more than a shard's fair share of a measure: it is then dealt in parts, row by row. What the driver
    packs is bounded: BUNDLES bundles and at most 3 * BUNDLES heavy groups, whatever the size of the input. A null text counts
    as an empty one (size 1); null doc_ids and repeated rows are placed like any other row; an empty table gives no rows."""
    spark = docs.sparkSession
    base = saved(measures(docs).withColumn("row", F.monotonically_increasing_id()), "measures")  # a row's number splits groups of equal ids
    groups = saved(base.groupBy(*_KEY).agg(F.sum("size").alias("bytes"), F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")), "groups")
    totals = groups.agg(*(F.sum(m).alias(m) for m in _MEASURES)).first()
    share = F.greatest(*(F.col(m) / F.lit(max(totals[m] or 1, 1)) for m in _MEASURES))
    heavy = groups.where(share > 1.0 / BUNDLES)
    light = groups.where(share <= 1.0 / BUNDLES).groupBy(F.pmod("key_a", F.lit(BUNDLES)).cast("long").alias("bundle")).agg(*(F.sum(m).alias(m) for m in _MEASURES)).collect()
    unit = np.array([max(totals[m] or 1, 1) for m in _MEASURES], dtype=float)
    bundles, items, whole = [r.bundle for r in light], [[r[m] for m in _MEASURES] for r in light], []
    following = BUNDLES
    for r in heavy.orderBy(*_KEY).collect():
        vector = np.array([r[m] for m in _MEASURES], dtype=float)
        most = float((vector / unit).max())
        parts = 1 if most <= 1.0 / shards else int(min(r.rows, np.ceil(most * shards * 8)))
        whole.append((*(r[k] for k in _KEY), following, parts))
        if parts == 1:
            bundles.append(following)
            items.append(vector)
        following += parts
    # both tables that follow have at most BUNDLES + 3 * BUNDLES + 8 * shards rows
    of_group = F.broadcast(spark.createDataFrame(whole, "key_a long, key_b int, size long, first long, parts int"))
    part = F.pmod(F.xxhash64("row", F.lit(1)), F.col("parts"))
    if any(g[-1] > 1 for g in whole):  # what each part of a dealt group holds
        dealt_parts = base.join(of_group.where("parts > 1"), _KEY).groupBy((F.col("first") + part).alias("bundle"))
        for r in dealt_parts.agg(F.sum("size").alias("bytes"), F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")).orderBy("bundle").collect():
            bundles.append(r.bundle)
            items.append([r[m] for m in _MEASURES])
    placed = pack(np.array(items, dtype=float).reshape(-1, 3) / unit, shards)
    of_bundle = F.broadcast(spark.createDataFrame([(int(b), int(s)) for b, s in zip(bundles, placed, strict=True)], "bundle long, shard int"))
    bundle = F.coalesce(F.col("first") + part, F.pmod("key_a", F.lit(BUNDLES)).cast("long"))
    dealt = base.join(of_group, _KEY, "left").withColumn("bundle", bundle).join(of_bundle, "bundle").select("doc_id", "size", "text_crc32", "row", "shard")
    pieces = max(1, -(-int(totals["rows"] or 0) // (shards * ROWS_OF_A_PIECE)))
    dealt = dealt.withColumn("piece", F.pmod(F.xxhash64("row"), F.lit(pieces)))
    before = dealt.groupBy("shard", "piece").agg(F.count("*").alias("n"))
    before = before.select("shard", "piece", (F.sum("n").over(Window.partitionBy("shard").orderBy("piece")) - F.col("n")).alias("offset"))
    order = Window.partitionBy("shard", "piece").orderBy("row")
    ranked = dealt.withColumn("rank", F.row_number().over(order)).join(before, ["shard", "piece"])
    return ranked.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))

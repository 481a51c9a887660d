"""MinHash near-dedup (operator 9): odd sketches pre-verify banded candidates, full shingle sets confirm them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, by_ids, forget, pieces, saved, small, table, with_class
from .components import components
from .kernels import constants, min_hashes, mix, shingle_sets

WIDTH = 5
PERCENT = 75
BANDS, ROWS = 60, 6  # a pair at 0.75 shares no band with probability (1 - 0.75**6)**60, about 8e-6; one at 0.3 shares one with 0.04
SAMPLE = 512  # smallest shingle hashes of a set (a bottom-k MinHash sample) that are folded into its odd sketch
BITS = 2048  # of the odd sketch
BLOCK = 2000  # members of a bucket that are compared with as many others in one task
PIECE = 1 << 20  # bytes of text at a time: working memory is some fifteen times as large, in each worker
FOLDED = 256  # sets folded at a time: 8 bytes for each of BITS
_KEY = ["n_shingles", "set_a", "set_b"]
_SKETCH = "doc_id long, text_hash long, n_shingles long, set_a long, set_b long, bands array<long>, odd array<long>"


def odd_sketches(sets: list[np.ndarray], bits: int = BITS) -> np.ndarray:
    """Fold the MinHash sample of each sorted set into a parity bitmap, as bits / 64 signed words.

    A sample is the SAMPLE smallest hashes of the set, hence the whole set if it is no larger."""
    out = np.empty((len(sets), bits // 64), dtype=np.int64)
    for at in range(0, len(sets), FOLDED):
        samples = [s[:SAMPLE] for s in sets[at : at + FOLDED]]
        owner = np.repeat(np.arange(len(samples)), [len(s) for s in samples])
        place = (mix(np.concatenate(samples) + np.uint64(53)) % np.uint64(bits)).astype(np.int64)
        odd = (np.bincount(owner * bits + place, minlength=len(samples) * bits) & 1).astype(np.uint8).reshape(len(samples), bits)
        out[at : at + FOLDED] = np.packbits(odd, axis=1).view(np.int64)
    return out


def plausible(n_a: Column, odd_a: Column, n_b: Column, odd_b: Column) -> Column:
    """False only for pairs below the threshold: by their sizes, or by the population count of the XOR of their odd sketches.

    Sets of n_a and n_b shingles at similarity J = PERCENT / 100 share J (n_a + n_b) / (1 + J) of them, of which the sparser
    sample holds its share; all else in the samples differs. The XOR has at most one bit for each sampled shingle that differs,
    so without sampling (sets up to SAMPLE) no similar pair is lost; with it, six standard deviations are allowed for."""
    k_a, k_b = (F.least(n, F.lit(SAMPLE)).cast("double") for n in (n_a, n_b))
    rate = F.least(k_a / n_a, k_b / n_b)
    shared = F.lit(PERCENT / (100.0 + PERCENT)) * (n_a + n_b)
    deviation = 2 * F.sqrt(shared * rate * (1 - rate) + 0.0)
    differ = reduce(lambda x, y: x + y, (F.bit_count(F.get(odd_a, F.lit(i)).bitwiseXOR(F.get(odd_b, F.lit(i)))) for i in range(BITS // 64)))
    return (100 * F.least(n_a, n_b) >= PERCENT * F.greatest(n_a, n_b)) & (differ <= k_a + k_b - 2 * shared * rate + 6 * deviation + 1e-6)


def _marks(sets: list[np.ndarray]) -> list[pa.Array]:
    """What tells a set from others: its size and a 128-bit sum over it."""
    sums = [np.array([mix(s + np.uint64(c)).sum(dtype=np.uint64) for s in sets], dtype=np.uint64).view(np.int64) for c in (7, 11)]
    return [pa.array([len(s) for s in sets], pa.int64()), *map(pa.array, sums)]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in pieces(batches, "text", PIECE):
        sets = shingle_sets(texts, WIDTH)
        sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
        full = np.flatnonzero(sizes)
        low = min_hashes([sets[i] for i in full], BANDS * ROWS)
        joint = (low.reshape(len(full), BANDS, ROWS) * constants(ROWS, 61)).sum(axis=2, dtype=np.uint64) + constants(BANDS, 67)
        bands, odd = [None] * len(sets), [None] * len(sets)
        for i, b, o in zip(full, mix(joint).view(np.int64), odd_sketches([sets[i] for i in full]), strict=True):
            bands[i], odd[i] = b, o
        columns = [part.column("doc_id"), part.column("text_hash"), *_marks(sets), pa.array(bands, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", *_KEY, "bands", "odd"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, texts in pieces(batches, "text", PIECE):
        sets = shingle_sets(texts, WIDTH)
        yield pa.RecordBatch.from_arrays([*_marks(sets), pa.array([s.tobytes() for s in sets], pa.binary())], [*_KEY, "shingles"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
            both = np.concatenate((x, y))
            both.sort()
            same = int((both[1:] == both[:-1]).sum())
            keep.append(100 * same >= PERCENT * (len(both) - same))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def sketches(docs: DataFrame) -> DataFrame:
    """One row per document: text hash, set size, a 128-bit sum over the set, band keys and the odd sketch (null for an empty set)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(_sketch, _SKETCH)
    with batches_of(docs.sparkSession, PIECE):
        return saved(rows, "sketches")


def _confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that are similar, by the full shingle sets of one document of each class.

    A class is found again by the marks of its set, as its smallest doc_id may stand before other texts too."""
    wanted = saved(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct().join(classes.select("id", "first_id", *_KEY), "id"), "wanted")
    texts = by_ids(docs.select(F.col("doc_id").cast("long").alias("first_id"), "text"), wanted.select("first_id").distinct(), "first_id", "left_semi").select("text")
    with batches_of(docs.sparkSession, PIECE):
        made = saved(texts.mapInArrow(_sets, "n_shingles long, set_a long, set_b long, shingles binary"), "sets")
    sets = made.join(wanted.select("id", *_KEY), _KEY).select("id", "shingles")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    with batches_of(docs.sparkSession, PIECE):
        links = saved(both.select("a", "b", "x", "y").mapInArrow(_confirm, "a long, b long").distinct(), "links")
    forget(made, wanted)
    return links


def _named(side: DataFrame, name: str) -> DataFrame:
    return side.select(F.col("id").alias(name), F.col("n_shingles").alias(f"n_shingles_{name}"), F.col("odd").alias(f"odd_{name}"))


def _sketch_columns(*names: str) -> list[Column]:
    return [F.col(f"{c}_{n}") for n in names for c in ("n_shingles", "odd")]


def _live(entries: DataFrame) -> DataFrame:
    """Buckets that still hold more than one component, with their size (copies), their smallest member, their largest component and
    how many members lie outside it."""
    parts = entries.groupBy("key", "comp").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    live = parts.groupBy("key").agg(F.min("low").alias("hub"), F.min_by("comp", "low").alias("hub_comp"), F.max_by("comp", F.struct("n", "comp")).alias("main"), F.sum("n").alias("copies"), (F.sum("n") - F.max("n")).alias("minor"))
    return saved(live.where("minor > 0"), "live")


def _in_blocks(seen: DataFrame, side: DataFrame) -> DataFrame:
    """Plausible pairs (a, b) of classes that share a bucket and no component, one of them outside the bucket's largest component.

    The members of a bucket are dealt in blocks of about BLOCK, and each block meets each block under a key of its own: a large
    bucket makes many equal tasks instead of one, and a pair becomes a row only if the sketches find it plausible."""
    blocks = F.greatest(F.ceil(F.col("copies") / BLOCK), F.lit(1))
    rows = seen.join(side, "id").select("key", "id", "comp", "main", "n_shingles", "odd", F.pmod(F.xxhash64("id"), blocks).alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other"))

    def named(df: DataFrame, n: str, at: list[str]) -> DataFrame:
        return df.select("key", *(F.col(c).alias(x) for c, x in zip(("own", "other"), at, strict=True)), *(F.col(c).alias(f"{c}_{n}") for c in ("id", "comp", "n_shingles", "odd")))

    met = named(rows.where("comp <> main"), "a", ["x", "y"]).join(named(rows, "b", ["y", "x"]), ["key", "x", "y"])
    found = met.where((F.col("comp_a") != F.col("comp_b")) & plausible(*_sketch_columns("a", "b")))
    return found.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept for every row of docs (doc_id long, text string; other columns are ignored).

    Rows with equal shingle sets form a class, which has a number of its own. Classes are banded. Up to three rounds look for links,
    each only between classes that are not yet in one component: (1) each member with the smallest hub of its buckets, (2) with the
    hub of every bucket, where round three would have more pairs to compare than there are entries, (3) in buckets that still hold
    several components, every member outside the largest one with all others, in blocks. Odd sketches are compared inside the joins,
    so only plausible pairs become rows: a group of copies or near copies costs rows in proportion to its size, and no link between
    components is skipped.

    A row is a document. component_id is the smallest doc_id of the rows that can be reached by links, kept says that it is the
    row's own. Rows that repeat a doc_id with the same text, or with other texts, are returned each with its own text's component.
    Null and empty texts and texts of white space have n_shingles 0 and link with nothing. Rows with a null doc_id link with
    nothing and have component_id null and kept true. An empty table gives an empty result."""
    sk = sketches(docs)
    full = sk.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = full.groupBy(*_KEY).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.any_value("bands").alias("bands"), F.any_value("odd").alias("odd"))
    classes = saved(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    entries = classes.select("id", F.explode("bands").alias("key"))
    side = classes.select("id", "n_shingles", "odd")
    shared = entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    entries = saved(entries.join(shared, "key"), "entries")
    total = entries.count()
    checked = found = comps = None
    step = 0
    while step < 3:
        now = entries.withColumn("comp", F.col("id")) if comps is None else saved(entries.join(comps, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component"), "now")
        live = _live(now)
        pairs_left = live.agg(F.sum(F.col("minor").cast("double") * F.col("copies"))).first()[0]
        if not pairs_left:  # all buckets lie inside one component each: nothing is left to be found
            break
        step += step == 1 and pairs_left <= total
        seen = with_class(now, live, ["key"], total)
        if step < 2:
            pairs = seen.where("comp <> hub_comp")
            pairs = pairs.groupBy(F.col("id").alias("b")).agg(F.min("hub").alias("a")) if step == 0 else pairs.select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
            pairs = pairs.join(_named(side, "a"), "a").join(_named(side, "b"), "b").where(plausible(*_sketch_columns("a", "b"))).select("a", "b")
        else:
            pairs = _in_blocks(seen, side)
        pairs = saved(pairs if checked is None else pairs.join(checked, ["a", "b"], "left_anti"), "pairs")
        forget(live, now if comps is not None else None)
        step += 1
        if pairs.isEmpty():
            continue
        checked = pairs if checked is None else checked.unionByName(pairs)
        new = _confirmed(pairs, docs, classes)
        found = new if found is None else found.unionByName(new)
        comps = components(found, "a", "b").select("id", "component")
    forget(entries)
    groups = classes.select(*_KEY, "copies", "id", "first_id")
    if comps is not None:
        low = comps.join(classes.select("id", "first_id"), "id").groupBy("component").agg(F.min("first_id").alias("low"))
        groups = groups.join(comps.join(low, "component").select("id", "low"), "id", "left").withColumn("first_id", F.coalesce("low", "first_id"))
    groups = saved(groups.select(*_KEY, "copies", F.col("first_id").alias("component_id")), "groups")
    rows = sk.select("doc_id", "text_hash", *_KEY)
    linked = F.col("n_shingles").eqNullSafe(0) | F.col("doc_id").isNull()
    alone = rows.where(linked).withColumn("component_id", F.col("doc_id"))
    out = with_class(rows.where(~linked), groups, _KEY, sk.count()).select(*alone.columns).unionByName(alone)
    return out.select("doc_id", "text_hash", "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that near_duplicates() keeps, one for each component.

    Where several rows of one component have its doc_id, the one with the smallest text hash stays, and of rows that repeat doc_id
    and text any one does. Rows without doc_id or words are in no group and all stay."""
    names = ["_of_id", "_of_text"]
    groups = saved(near_duplicates(docs).where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("component_id", "doc_id", "text_hash").agg(F.count("*").alias("n")), "groups")
    own = groups.where("doc_id = component_id")
    first = own.groupBy("component_id").agg(F.min("text_hash").alias("first"))
    gone = groups.where("doc_id <> component_id").select("doc_id", "text_hash")
    gone = saved(gone.unionByName(own.join(first, "component_id").where("text_hash <> first").select("doc_id", "text_hash")).toDF(*names), "gone")
    again = own.where("n > 1").select("doc_id", "text_hash").toDF(*names)

    def matched(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        same = (rows["doc_id"].cast("long") == keys[names[0]]) & (F.xxhash64(rows["text"]) == keys[names[1]])
        return rows.join(F.broadcast(keys) if small(keys) else keys, same, how)

    left = matched(docs, gone, "left_anti")
    if again.isEmpty():
        return left
    again = saved(again, "again")
    once = matched(left, again, "left_semi").withColumn(names[1], F.xxhash64("text")).dropDuplicates(["doc_id", names[1]]).drop(names[1])
    return matched(left, again, "left_anti").unionByName(once)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


SQL = r"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
each AS (SELECT r, len(s) AS n, unnest(s) AS shingle FROM sets WHERE doc_id IS NOT NULL),
pairs AS (SELECT a.r AS x, b.r AS y, count(*) AS c, any_value(a.n) AS n, any_value(b.n) AS m FROM each a JOIN each b ON a.shingle = b.shingle AND a.r <> b.r GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs WHERE 100 * c >= 75 * (n + m - c)),
reach AS (SELECT r AS x, r AS y FROM sets UNION SELECT p.x, l.y FROM reach p JOIN links l ON l.x = p.y),
low AS (SELECT p.x, min(s.doc_id) AS component_id FROM reach p JOIN sets s ON s.r = p.y GROUP BY p.x)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, l.component_id, coalesce(l.component_id = s.doc_id, true) AS kept FROM sets s JOIN low l ON l.x = s.r
"""

"""Embedding near-dedup (operator 5): cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified links."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.let import let
from .common import forget, saved, table, with_class
from .components import components
from .kernels import mix

COSINE = 0.9
BLOCK, SPREAD = 4096, 8  # rows on either side of one comparison; blocks that a side of fewer rows is cut in
FILL = 512  # vectors that a bucket should hold on average
_U = np.uint64


def plan(n: int, dim: int) -> tuple[int, int, int]:
    """Rotations a table, tables and probes for n distinct vectors. Measured on random pairs at cosine 0.9, one table finds a pair
    with probability 0.94, 0.70 or 0.50 in 64 dimensions (1, 2 or 3 rotations), and 0.79, 0.45 or 0.23 in 1536; more than 128
    dimensions thus take more tables, and all of them together miss a pair with a probability of about 0.001 or less."""
    k = max(1, math.ceil(math.log(max(n / FILL, 1)) / math.log(2 * max(dim, 2))))
    return k, math.ceil(2 ** (k + 1) * (1 if dim <= 128 else 1.75)), 4 if k == 1 else 3 * k


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, whose length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        pair = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]), axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    """A pseudo-random rotation: three rounds of random signs and a Hadamard transform."""
    signs = np.random.default_rng(seed).choice((-1.0, 1.0), size=(3, x.shape[1]))
    for s in signs:
        x = hadamard(x * s)
    return x


def codes(unit: np.ndarray, k: int, tables: int, probes: int) -> np.ndarray:
    """n x tables x probes bucket numbers, the base bucket first, the others by how little they lose against it."""
    n, d = unit.shape
    width = 1 << max(1, (d - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :d] = unit
    out = np.empty((n, tables, probes), dtype=_U)
    rows = np.arange(n)[:, None]
    few = min(probes, 2 * width)
    for t in range(tables):
        code, loss = np.zeros((n, 1), dtype=_U), np.zeros((n, 1))
        for j in range(k):
            turned = rotate(padded, 1000 * t + j)
            ends = np.hstack((turned, -turned))  # the vertices of the cross-polytope
            near = np.argsort(-ends, axis=1, kind="stable")[:, :few]
            value = ends[rows, near]
            code = (code[:, :, None] * _U(2 * width) + near.astype(_U)[:, None, :]).reshape(n, -1)
            loss = (loss[:, :, None] + (value[:, :1] - value)[:, None, :] ** 2).reshape(n, -1)
            best = np.argsort(loss, axis=1, kind="stable")[:, :probes]
            code, loss = code[rows, best], loss[rows, best]
        keyed = mix(code * _U(64) + _U(t % 64) + (_U(d) << _U(48)))
        out[:, t, :] = np.pad(keyed, ((0, 0), (0, probes - keyed.shape[1])), mode="edge")
    return out


def _matrix(column) -> np.ndarray:
    flat = np.array(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1)


def _hash(k: int, tables: int, probes: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        sizes = np.array(whole.column("embedding").value_lengths())
        for d in np.unique(sizes):
            same = whole.filter(pa.array(sizes == d))
            for at in range(0, len(same), 2048):
                batch = same.slice(at, 2048)
                found = codes(_matrix(batch.column("embedding")), k, tables, probes).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(list(found[:, :, 0]), pa.list_(pa.int64())), pa.array(list(found.reshape(len(batch), -1)), pa.list_(pa.int64()))], ["id", "bases", "probes"])


def forest(hit: np.ndarray) -> list[tuple[int, int]]:
    """Edges (row, column) of a spanning forest of the bipartite graph that the matrix holds."""
    edges, seen_row, seen_col = [], ~hit.any(axis=1), ~hit.any(axis=0)
    while not seen_row.all():
        rows = np.array([np.argmin(seen_row)])
        seen_row[rows] = True
        while len(rows):
            part = hit[rows]
            cols = np.flatnonzero(part.any(axis=0) & ~seen_col)
            edges += zip(rows[part[:, cols].argmax(axis=0)].tolist(), cols.tolist(), strict=True)
            seen_col[cols] = True
            part = hit[:, cols]
            more = np.flatnonzero(part.any(axis=1) & ~seen_row) if len(cols) else np.empty(0, dtype=int)
            edges += zip(more.tolist(), cols[part[more].argmax(axis=1)].tolist() if len(more) else [], strict=True)
            seen_row[more] = True
            rows = more
    return edges


def _link_block(q: dict, t: dict) -> list[tuple[int, int]]:
    """Links between queries and targets of different components, as a spanning forest."""
    hit = (q["v"] @ t["v"].T >= COSINE) & (q["comp"][:, None] != t["comp"][None, :])
    return [(int(q["id"][i]), int(t["id"][j])) for i, j in forest(hit)]


def _count_block(q: dict, t: dict) -> list[tuple[int, int]]:
    """For each query, how many vectors the targets linked to it stand for, itself aside."""
    hit = (q["v"] @ t["v"].T >= COSINE) & (q["id"][:, None] != t["id"][None, :])
    return list(zip(q["id"].tolist(), (hit @ t["copies"]).astype(int).tolist(), strict=True))


def _blocks(kernel: Callable, names: tuple[str, str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Apply kernel(queries, targets) to each run of rows with one group number; batches are sorted by it."""

    def done(table_: pa.Table) -> pa.RecordBatch:
        side = []
        for role in (1, 0):
            part = table_.filter(pc.equal(table_.column("role"), role))
            side.append({"v": _matrix(part.column("embedding").combine_chunks()) if len(part) else None} | {c: np.array(part.column(c)) for c in ("id", "comp", "copies")})
        rows = kernel(*side) if len(side[0]["id"]) and len(side[1]["id"]) else []
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], list(names))

    held: list[pa.RecordBatch] = []
    for batch in batches:
        group = np.array(batch.column("group"))
        cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(group)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                if held and held[-1].column("group")[-1].as_py() != group[a]:
                    yield done(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
    if held:
        yield done(pa.Table.from_batches(held))


def _dealt(rows: DataFrame, vectors: DataFrame, kernel: Callable, names: tuple[str, str]) -> DataFrame:
    """rows has key, role (1 query, 0 target), id, comp, n_q, n_t: both sides are cut in blocks of at most about BLOCK rows, and every
    block of queries meets every block of targets in one group of the shuffle. Sides of more than 2 * FILL rows are cut too, in SPREAD
    blocks at most, so that one large group is the work of many tasks."""
    n_q, n_t = (F.greatest(F.ceil(F.col(c) / BLOCK), F.when(F.col(c) > 2 * FILL, F.least(F.ceil(F.col(c) / 256), F.lit(SPREAD))), F.lit(1)) for c in ("n_q", "n_t"))
    own = F.when(F.col("role") == 1, F.pmod(F.xxhash64("id"), n_q)).otherwise(F.pmod(F.xxhash64("id"), n_t))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("role") == 1, n_t).otherwise(n_q) - 1))
    cut = rows.withColumn("own", own).withColumn("other", other)
    at = F.when(F.col("role") == 1, F.xxhash64("key", "own", "other")).otherwise(F.xxhash64("key", "other", "own"))
    wide = cut.select(at.alias("group"), "role", "id", "comp").join(vectors.select("id", "embedding", "copies"), "id")
    return wide.repartition("group").sortWithinPartitions("group").mapInArrow(partial(_blocks, kernel, names), ", ".join(f"{n} long" for n in names))


def _usable(v: Column) -> Column:
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)


def _unit_column(v: Column) -> Column:
    """The vector at length one. It is scaled by its largest component first, so that no square overflows or vanishes."""
    scaled = let(F.array_max(F.transform(v, F.abs)), lambda most: F.transform(v, lambda x: x / most))
    return let(scaled, lambda s: let(F.sqrt(F.aggregate(s, F.lit(0.0), lambda t, x: t + x * x)), lambda n: F.transform(s, lambda x: x / n)))


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose unit vectors have the cosine."""
    for batch in batches:
        x, y = batch.column("x"), batch.column("y")  # of one length in each row, but of several in a batch
        ends = np.cumsum(np.array(x.value_lengths()))
        total = np.add.reduceat(np.array(x.flatten()) * np.array(y.flatten()), np.concatenate(([0], ends[:-1]))) if len(batch) else np.empty(0)
        yield batch.select(["a", "b"]).filter(pa.array(total >= COSINE))


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding array<float or double>).

    Equal vectors form a class with a number of its own, compared once, at length one and in doubles. Each class is linked with the
    smallest class of each of its buckets first; only then do buckets that still hold several components compare them, outside the
    largest one with all, in blocks. Last, links are counted by comparing all members of each component in blocks, so that a link
    counts once, whatever buckets share it. A pair is missed only if no table brings its two components together (see plan()).

    A pair (vec_id, embedding) is a vector: rows that repeat both are one and are returned alike; rows that repeat a vec_id with
    another embedding are vectors of their own, which may link with each other. n_links counts other vectors, component_id is the
    smallest vec_id reachable. Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; so do
    vectors of different length. Rows with a null vec_id link with nothing: component_id null, kept true. An empty table gives no
    rows."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    usable = F.col("vec_id").isNotNull() & F.coalesce(_usable(F.col("embedding")), F.lit(False))
    good = rows.where(usable).distinct()
    classes = good.groupBy("embedding").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"))
    reps = saved(classes.withColumn("id", F.monotonically_increasing_id()).withColumn("unit", _unit_column(F.col("embedding"))), "reps")
    size = reps.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim"), F.sum("copies").alias("rows")).first()
    rotations, tables, probes = plan(size.n, size.dim or 1)
    vector = reps.select("id", "copies", F.col("unit").alias("embedding"))
    hashed = saved(vector.select("id", "embedding").mapInArrow(partial(_hash, rotations, tables, probes), "id long, bases array<long>, probes array<long>"), "hashed")
    base = hashed.select("id", F.explode("bases").alias("key"))
    hubs = base.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("copies")).where("copies > 1")
    pairs = with_class(base, hubs, ["key"], size.n * tables).where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    side = vector.select("id", "embedding")
    both = pairs.join(side.select(F.col("id").alias("a"), F.col("embedding").alias("x")), "a").join(side.select(F.col("id").alias("b"), F.col("embedding").alias("y")), "b")
    links = saved(both.where("size(x) = size(y)").select("a", "b", "x", "y").mapInArrow(_near, "a long, b long"), "hub-links")
    comps = components(links, "a", "b")
    named = reps.select("id").join(comps, "id", "left").select("id", F.coalesce("component", "id").alias("comp"))
    entry = hashed.select("id", F.explode("bases").alias("key"), F.lit(0).alias("role")).union(hashed.select("id", F.explode(F.array_distinct("probes")).alias("key"), F.lit(1).alias("role")))
    entry = saved(entry.join(named, "id"), "entries")
    parts = entry.groupBy("key", "comp").agg(F.sum(1 - F.col("role")).alias("t"), F.sum("role").alias("q"))
    live = parts.groupBy("key").agg(F.max_by("comp", F.struct(F.col("t") + F.col("q"), "comp")).alias("main"), F.max_by(F.struct("t", "q"), F.struct(F.col("t") + F.col("q"), "comp")).alias("top"), F.sum("t").alias("t"), F.sum("q").alias("q"), F.count("*").alias("comps")).where("comps > 1 AND t > 0 AND q > 0")
    seen = with_class(entry, live.withColumn("copies", F.col("t") + F.col("q")), ["key"], size.n * tables * (1 + probes)).withColumn("is_main", F.col("comp") == F.col("main"))
    rest = seen.where("role = 0 OR NOT is_main").select(F.xxhash64("key", F.lit(1)).alias("key"), "role", "id", "comp", (F.col("q") - F.col("top.q")).alias("n_q"), F.col("t").alias("n_t")).where("n_q > 0")
    large = seen.where("(role = 0 AND NOT is_main) OR (role = 1 AND is_main)").select(F.xxhash64("key", F.lit(2)).alias("key"), "role", "id", "comp", F.col("top.q").alias("n_q"), (F.col("t") - F.col("top.t")).alias("n_t")).where("n_q > 0 AND n_t > 0")
    more = saved(_dealt(rest.union(large), vector, _link_block, ("a", "b")).distinct(), "block-links")
    forget(entry)
    comps = saved(components(links.union(more), "a", "b"), "components")
    sized = with_class(comps, comps.groupBy("component").agg(F.count("*").alias("copies")), ["component"], size.n)
    asked = sized.select(F.col("component").alias("key"), F.explode(F.array(F.lit(0), F.lit(1))).alias("role"), "id", F.col("component").alias("comp"), F.col("copies").alias("n_q"), F.col("copies").alias("n_t"))
    counted = _dealt(asked, vector, _count_block, ("id", "linked")).groupBy("id").agg(F.sum("linked").alias("linked"))
    low = comps.join(reps.select("id", "first_id"), "id").groupBy("component").agg(F.min("first_id").alias("low"))
    found = saved(comps.join(counted, "id", "left").join(low, "component").select("id", "linked", "low"), "counted")
    per_class = reps.select("embedding", "id", "first_id", "copies").join(found, "id", "left").select("embedding", "copies", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("low", "first_id").alias("component_id"))
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = with_class(rows.where(usable), per_class, ["embedding"], size.rows or 0).select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE vectors AS (
  SELECT row_number() OVER () AS r, vec_id, e FROM (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
  WHERE vec_id IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.r AS x, b.r AS y FROM vectors a JOIN vectors b ON a.r <> b.r AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT r AS x, r AS y FROM vectors UNION SELECT p.x, l.y FROM reach p JOIN links l ON l.x = p.y),
low AS (SELECT p.x, min(v.vec_id) AS component_id FROM reach p JOIN vectors v ON v.r = p.y GROUP BY p.x),
degree AS (SELECT x, count(*) AS n FROM links GROUP BY x),
known AS (SELECT v.vec_id, v.e, coalesce(d.n, 0) AS n, l.component_id FROM vectors v JOIN low l ON l.x = v.r LEFT JOIN degree d ON d.x = v.r)
SELECT m.vec_id, coalesce(k.n, 0)::BIGINT AS n_links, coalesce(k.component_id, m.vec_id) AS component_id, coalesce(coalesce(k.component_id, m.vec_id) = m.vec_id, true) AS kept
FROM embeddings m LEFT JOIN known k ON k.vec_id = m.vec_id AND k.e = m.embedding::DOUBLE[]
"""

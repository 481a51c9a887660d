"""Quality classifier (operator 10): random Fourier features of document statistics, ridge by normal equations, isotonic scores."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, pieces, saved, small, table
from .kernels import words

FEATURES = 192  # random Fourier features
WIDTH = 3.0  # of the Gaussian kernel, in standard deviations of the statistics
RIDGE = 1e-3  # for each labelled row
BINS = 512  # of raw scores, for the isotonic fit
CALIBRATED = 4  # labelled rows whose crc32(doc_id as text) mod 5 is this calibrate the scores; the others fit the ridge
THRESHOLD = 0.3
PIECE = 1 << 20  # bytes of text at a time
ROWS = 1024  # rows whose random features are held at a time: some 8 kB each
_CLASS = np.zeros(256, dtype=np.int64)  # 0 control, 1 space, 2 digit, 3 upper, 4 lower, 5 beyond ASCII, 6 sentence marks, 7 symbols
for _i in range(33, 128):
    _CLASS[_i] = 7
for _chars, _kind in ((b" \t\n\r", 1), (b"0123456789", 2), (bytes(range(65, 91)), 3), (bytes(range(97, 123)), 4), (bytes(range(128, 256)), 5), (b".,;:!?'\"()-", 6)):
    _CLASS[list(_chars)] = _kind
STATISTICS = 18


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of STATISTICS numbers for each text; the text alone decides them. Zeros for an empty text, but for its size."""
    hashes, bounds = words(texts)
    out = np.zeros((len(texts), STATISTICS))
    for i, text in enumerate(texts):
        w = hashes[bounds[i] : bounds[i + 1]]
        n, m = len(text), len(w)
        out[i, 0], out[i, 1] = np.log1p(n), np.log1p(m)
        if not n or not m:
            continue
        of_byte = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
        out[i, 2:10] = np.bincount(_CLASS, weights=of_byte, minlength=8) / n
        _, number = np.unique(w, return_counts=True)
        lines = text.split(b"\n")
        out[i, 10] = (n - of_byte[32]) / m
        out[i, 11] = len(number) / m
        out[i, 12] = number.max() / m
        out[i, 13] = (w[1:] == w[:-1]).mean() if m > 1 else 0.0
        out[i, 14] = 1 - len(set(lines)) / len(lines)
        out[i, 15] = np.log1p(n / len(lines))
        out[i, 16] = of_byte[[46, 33, 63]].sum() / m
        out[i, 17] = of_byte[33] / n
    return out


@dataclass
class Model:
    """All that scoring needs; a few hundred kilobytes."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return expand((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.levels), 0.0, 1.0)


def expand(z: np.ndarray) -> np.ndarray:
    """Random Fourier features of standardised statistics (fixed seed), the statistics themselves, and a constant."""
    rng = np.random.default_rng(20240607)
    z = np.clip(z, -8.0, 8.0)
    waves = np.cos(z @ (rng.standard_normal((z.shape[1], FEATURES)) / WIDTH) + rng.uniform(0, 2 * np.pi, FEATURES)) * np.sqrt(2.0 / FEATURES)
    return np.hstack((waves, z * 0.1, np.ones((len(z), 1))))


def isotonic(x: np.ndarray, total: np.ndarray, positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins in order of x: centres and non-decreasing shares of positives."""
    blocks: list[list[float]] = []
    for centre, n, p in zip(x, total, positive, strict=True):
        blocks.append([centre * n, n, p])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[1] for b in blocks]), np.array([b[2] / b[1] for b in blocks])


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in pieces(batches, "text", PIECE):
        x = statistics(texts)
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "text_hash", "x"])


def features(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text and the statistics of the whole text, written to the shared folder."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    rows = rows.mapInArrow(_featurise, "doc_id long, text_hash long, x array<double>")
    with batches_of(docs.sparkSession, PIECE):
        return saved(rows, "features")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, at most ROWS at a time."""
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            yield batch.slice(at, ROWS)


def _sums(mean: np.ndarray, scale: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The partition's share of the normal equations, as numbered cells: the upper triangle of Z'Z, then Z'y."""
    left, right = 0, 0
    for batch in _parts(batches):
        z = expand((_matrix(batch) - mean) / scale)
        left, right = left + z.T @ z, right + z.T @ np.array(batch.column("quality"), dtype=float)
    if not np.isscalar(left):
        cells = np.concatenate((left[np.triu_indices(len(left))], right))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells), dtype=np.int32)), pa.array(cells)], ["cell", "value"])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.array(batch.column("x").flatten()).reshape(-1, STATISTICS)


def held_out(doc_id: str) -> F.Column:
    return F.coalesce(_rest(doc_id) == 0, F.lit(False))


def _raw(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _parts(batches):
        yield batch.drop_columns(["x"]).append_column("raw", pa.array(model.raw(_matrix(batch)), pa.float64()))


def _scored(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _parts(batches):
        yield batch.drop_columns(["x"]).append_column("score", pa.array(model.score(_matrix(batch)), pa.float64()))


def _rest(doc_id: str) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def _solved(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, n: int) -> np.ndarray:
    """Ridge weights. Partitions sum their rows where these lie, and a shuffle sums the cells, so that only one value for each cell
    (some 22,000) reaches the driver, however many partitions there are."""
    width = FEATURES + STATISTICS + 1
    cells = rows.mapInArrow(partial(_sums, mean, scale), "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    flat = np.zeros(width * (width + 1) // 2 + width)
    flat[[c.cell for c in cells]] = [c.value for c in cells]
    upper = np.zeros((width, width))
    upper[np.triu_indices(width)] = flat[:-width]
    return np.linalg.solve(upper + np.triu(upper, 1).T + RIDGE * n / 1000 * np.eye(width), flat[-width:])


def train(feats: DataFrame, labels: DataFrame) -> Model:
    """Fit on the labelled rows whose crc32(doc_id as text) mod 5 is not 0; rows without doc_id or quality teach nothing, and a doc_id
    that is labelled both good and bad counts as good.

    One fold of five (CALIBRATED) is kept from the ridge fit and calibrates its scores isotonically; where a fold has no rows of both
    labels, the other rows do both. Without any labelled row all scores are 0.5."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    taught = saved(feats.where(~held_out("doc_id")).join(known, "doc_id").select("x", "quality", (_rest("doc_id") == CALIBRATED).alias("later")), "taught")
    model = Model(np.zeros(STATISTICS), np.ones(STATISTICS), np.zeros(FEATURES + STATISTICS + 1), np.array([0.0]), np.array([0.5]))
    both = {r.later for r in taught.groupBy("later").agg(F.countDistinct("quality").alias("n")).collect() if r.n > 1}
    fit, calibrate = (taught.where("NOT later"), taught.where("later")) if both == {False, True} else (taught, taught)
    moments = fit.agg(F.count("*"), *(f(F.col("x")[i]) for i in range(STATISTICS) for f in (F.avg, F.stddev_pop))).first()
    if not moments[0]:
        return model
    model.mean, model.scale = np.array(moments[1::2]), np.maximum(np.array(moments[2::2]), 1e-9)
    model.weights = _solved(fit.select("x", "quality"), model.mean, model.scale, moments[0])
    raw = calibrate.select("x", "quality").mapInArrow(partial(_raw, model), "quality int, raw double")
    bins = raw.groupBy(F.floor(F.least(F.greatest("raw", F.lit(-1.0)), F.lit(2.0)) * (BINS // 3)).alias("bin")).agg(F.avg("raw").alias("x"), F.count("*").alias("n"), F.sum("quality").alias("p")).orderBy("bin").collect()
    model.knots, model.levels = isotonic(*(np.array([r[c] for r in bins], dtype=float) for c in "xnp"))
    return model


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text); labels has doc_id and quality (0 or 1).

    Only whole texts enter a score, as bytes, so that text which is no UTF-8 is scored too. Null and empty texts are scored as
    statistics of nothing; a null doc_id is not held out and gets a score; repeated rows are all returned. An empty table gives no
    rows."""
    feats = features(docs)
    model = train(feats, labels)
    scores = feats.mapInArrow(partial(_scored, model), "doc_id long, text_hash long, score double")
    return scores.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose text is predicted good.

    Texts are read once for their statistics; what returns to the rows are the rejected ones, by doc_id and text hash, broadcast if
    they are few and joined by a shuffle otherwise."""
    feats = features(docs)
    scores = feats.mapInArrow(partial(_scored, train(feats, labels)), "doc_id long, text_hash long, score double")
    bad = saved(scores.where(F.col("score") < THRESHOLD).select(F.col("doc_id").alias("_of_id"), F.col("text_hash").alias("_of_text")).distinct(), "rejected")
    same = docs["doc_id"].cast("long").eqNullSafe(bad["_of_id"]) & (F.xxhash64(docs["text"]) == bad["_of_text"])
    return docs.join(F.broadcast(bad) if small(bad) else bad, same, "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

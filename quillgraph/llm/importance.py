"""Target-distribution importance resampling (operator 11) over hashed n-grams found by an overlapped scan."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.positions import positioned
from .common import batches_of, forget, pieces, saved, table

PIECE = 4 << 20  # bytes of text at a time
LONGEST, BUCKETS = 1, 10_000  # features are runs of 1 to LONGEST words, hashed to so many buckets
LEAST_WORDS, PERCENT, SEED = 20, 10, 2024
NO_WORD = rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # of lower-cased texts
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))  # A-Z alone are folded
_GAPS = regex.compile(NO_WORD)


def scanner(n: int) -> regex.Pattern:
    """Runs of n words in a text whose words are parted by single spaces. Searched with overlapped=True, it finds each run once: only
    at the first letter of a word is there a boundary behind."""
    return regex.compile(rb"(?<![^ ])[^ ]++(?: [^ ]++){%d}(?![^ ])" % (n - 1))


def features(text: bytes, scanners: list[regex.Pattern], buckets: int = BUCKETS) -> tuple[np.ndarray, int]:
    """The bucket of every feature of a text (UTF-8), and how many words it has. Separators collapse to single spaces, and each span
    of a run of words is hashed out of that text as it stands."""
    flat = _GAPS.sub(b" ", text.translate(LOWER)).strip(b" ")
    crc = zlib.crc32
    found = [crc(m[0]) for scan in scanners for m in scan.finditer(flat, overlapped=True)]
    return np.array(found, dtype=np.uint32) % np.uint32(buckets), (flat.count(b" ") + 1 if flat else 0)


def _features(longest: int, buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanners = [scanner(n) for n in range(1, longest + 1)]
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32
    for part, texts in pieces(batches, "text", PIECE):
        found = [features(t, scanners, buckets) for t in texts]
        columns = [part.column("doc_id"), pa.array([n for _, n in found], pa.int64()), pa.array([len(x) for x, _ in found], pa.int64()), pa.array([x.astype(kind).tobytes() for x, _ in found], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "buckets"])


def hashed(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, buckets (binary: two or four bytes for each feature, in order) for rows of doc_id, text."""
    return texts.select("doc_id", "text").mapInArrow(partial(_features, longest, buckets), "doc_id long, n_words long, n_features long, buckets binary")


def _read(raw: bytes, buckets: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.uint16 if buckets <= 1 << 16 else np.uint32)


def _sums(buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(buckets, dtype=np.int64)
    for batch in batches:
        for raw in batch.column("buckets").to_pylist():
            total += np.bincount(_read(raw, buckets), minlength=buckets)
    held = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], ["bucket", "n"])


def bucket_counts(features_: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all rows each bucket holds: every task adds up its own, so that no more than `buckets` numbers of each
    task meet in the shuffle, and no more than `buckets` rows come to the driver."""
    rows = features_.select("buckets").mapInArrow(partial(_sums, buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(buckets, dtype=np.int64)
    for r in rows:
        total[r.bucket] = r.n
    return total


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(((t + 1)(S + B)) / ((s + 1)(T + B)))) of each of the B buckets, in doubles."""
    size, all_s, all_t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log(((t + 1) * (all_s + size)) / ((s + 1) * (all_t + size)))) for s, t in zip(source.astype(float).tolist(), target.astype(float).tolist(), strict=True)], dtype=np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """floor(-1000 * ln(-ln((h + 0.5) / 2**32))), h the first eight hexadecimal digits of sha256("seed:doc_id")."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _weigh(gain: np.ndarray, seed: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        weights = []
        for raw in batch.column("buckets").to_pylist():
            found = gain[_read(raw, len(gain))]
            weights.append(int(found.sum()) // len(found) if len(found) else 0)
        drawn = [noise(i, seed) for i in batch.column("doc_id").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), batch.column("n_features"), pa.array(weights, pa.int64()), pa.array([w + x for w, x in zip(weights, drawn, strict=True)], pa.int64())], ["doc_id", "n_words", "n_features", "weight", "score"])


def resample(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, percent: int = PERCENT, seed: int = SEED, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score, rank for every row of docs (doc_id, text): rank numbers the drawn ones, the best score first.

    target has the texts (column text) whose distribution is wanted. Of the documents with at least `least_words` words, `percent`
    in a hundred are drawn; ties go to smaller doc_ids, then to fewer features. Features lie in the shared folder for as long as they
    are counted and weighed: two bytes for each. Only ids and numbers are sorted, in range partitions, none of which sees all.

    Null and empty texts have no features, weight 0 and no rank. A null doc_id is drawn as an empty string and comes last among equal
    scores. Repeated rows are drawn one by one. An empty table gives no rows; an empty target gives every feature the gain of the
    smoothing alone. Bytes that are no UTF-8 are words like other bytes beyond ASCII. Other columns are ignored; no text is cut."""
    spark = docs.sparkSession
    with batches_of(spark, PIECE):
        ours = saved(hashed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), longest, buckets), "importance-features")
        wanted = bucket_counts(hashed(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), longest, buckets), buckets)
        gain = gains(bucket_counts(ours, buckets), wanted)
        kind = "doc_id long, n_words long, n_features long, weight long, score long"
        scored = saved(ours.select("doc_id", "n_words", "n_features", "buckets").mapInArrow(partial(_weigh, gain, seed), kind), "importance-scores")
    forget(ours)
    drawn = scored.where(F.col("n_words") >= least_words).count() * percent // 100
    fit = F.col("n_words") >= least_words
    placed, order = positioned(scored, F.desc(fit), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight"))
    out = saved(placed.select("doc_id", "n_features", "weight", "score", F.when(fit & (F.col("position") <= drawn), F.col("position")).alias("rank")), "importance")
    forget(scored, order)
    return out


def _sql() -> str:
    """The same in SQL. The table of CRC-32 follows from its polynomial; each distinct word is hashed once."""
    table_ = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        table_.append(i)
    words = r"list_filter(string_split_regex(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
    step = f"xor(c >> 8, ([{', '.join(map(str, table_))}])[(xor(c, b) & 255) + 1])"
    byte = "list_transform(range(0, strlen(w)), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT)"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words.format(x="coalesce(text, '')")} AS w FROM documents), b AS (SELECT {words.format(x="coalesce(text, '')")} AS w FROM benchmark),
dw AS (SELECT r, unnest(w) AS w FROM d), dn AS (SELECT r, w, count(*) AS n FROM dw GROUP BY r, w), sn AS (SELECT w, sum(n) AS n FROM dn GROUP BY w), tn AS (SELECT w, count(*) AS n FROM (SELECT unnest(w) AS w FROM b) GROUP BY w),
hashed AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, {byte}), lambda c, b: {step}), 4294967295) % 10000 AS k FROM (SELECT w FROM sn UNION SELECT w FROM tn)),
s AS (SELECT k, sum(n)::DOUBLE AS s FROM sn JOIN hashed USING (w) GROUP BY k), t AS (SELECT k, sum(n)::DOUBLE AS t FROM tn JOIN hashed USING (w) GROUP BY k),
gain AS (SELECT k, floor(1000 * ln(((coalesce(t, 0) + 1) * ((SELECT sum(s) FROM s) + 10000)) / ((coalesce(s, 0) + 1) * ((SELECT coalesce(sum(t), 0) FROM t) + 10000))))::BIGINT AS g FROM s LEFT JOIN t USING (k)),
summed AS (SELECT r, sum(n * g)::BIGINT AS g FROM dn JOIN hashed USING (w) JOIN gain USING (k) GROUP BY r),
scored AS (SELECT d.r, doc_id, len(w) AS n_features, coalesce(floor(g::DOUBLE / len(w))::BIGINT, 0) AS weight, floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS x FROM d LEFT JOIN summed USING (r)),
placed AS (SELECT *, weight + x AS score, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY weight + x DESC, doc_id NULLS LAST, n_features, weight) END AS p FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN p <= (SELECT count(*) * 10 // 100 FROM scored WHERE n_features >= 20) THEN p END AS rank FROM placed"""


SQL = _sql()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

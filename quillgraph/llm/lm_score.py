"""LM scoring (operator 2): stupid-backoff scores from n-gram counts partitioned by hash and joined to each chunk's n-grams.

A chunk is about 6 MB of text. Its words are counted first: each distinct word goes once to the partition of its hash, which sums the
counts over all chunks and numbers the words, frequent ones low; totals and numbers return to the chunks that asked. Then every
distinct n-gram of two words and more goes once, as word numbers, to the partition of its hash, and its total returns in the same
way. So the most frequent n-gram costs one entry per chunk, not one per document, and no partition holds more than its share of the
distinct n-grams. Word numbers are small and pack well, where hashes of n-grams do not. Words are told apart by 64-bit hashes,
n-grams by the numbers of their words, exactly."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, forget, pieces, saved, table
from .kernels import constants, mix, words

ORDER = 3
BACKOFF = 0.4
PIECE = 6 << 20
BUCKET = 1_500_000  # entries (distinct n-grams of chunks) that a partition of the count table should get
_U = np.uint64
_CHUNK = "chunk long, doc_ids array<long>, sizes array<long>, n_words long, tokens binary"
_ASKED = "k long, bucket long, chunk long, n long, words array<binary>, counts binary"
_ANSWER = "chunk long, k long, bucket long, n long, totals binary, numbers binary"


def _packed(x: np.ndarray) -> bytes:
    """Numbers as compressed planes of their first, second, ... bytes: small numbers cost little."""
    return pa.compress(np.ascontiguousarray(x[:, None].view(np.uint8).T).tobytes(), codec="zstd", asbytes=True)


def _unpacked(blob: bytes, n: int, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(blob, decompressed_size=width * n, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(width, n).T).view(kind).ravel()


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<binary>": pa.list_(pa.binary())}
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[t]) for i, (_, t) in enumerate(fields)], [n for n, _ in fields])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as places in a list of distinct word hashes, which ascends."""
    task, number = TaskContext.get().partitionId(), 0
    for part, texts in pieces(batches, "text", PIECE):
        hashes, bounds = words(texts)
        distinct, index, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        row = ((task << 24) | number, part.column("doc_id").to_pylist(), np.diff(bounds).tolist(), len(distinct), _packed(index.astype("<u4")))
        yield _batch([(*row, distinct.tobytes(), _packed(counts.astype("<u4")))], f"{_CHUNK}, hashes binary, counts binary")
        number += 1


def _runs(bucket: np.ndarray) -> list[tuple[int, int]]:
    """Where runs of equal numbers begin and end."""
    cut = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)] if len(bucket) else [0]
    return list(zip(cut[:-1], cut[1:], strict=True))


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)


def _ask_words(buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk, n, raw, counted in zip(*(batch.column(c).to_pylist() for c in ("chunk", "n_words", "hashes", "counts")), strict=True):
            hashes, counts = np.frombuffer(raw, dtype=_U), _unpacked(counted, n, "<u4")
            bucket = _bucket(hashes, buckets)  # hashes ascend, so a bucket is a run
            yield _batch([(0, int(bucket[a]), chunk, b - a, [_packed(np.diff(hashes[a:b], prepend=_U(0)))], _packed(counts[a:b])) for a, b in _runs(bucket)], _ASKED)


def _dense(column: np.ndarray) -> np.ndarray:
    """The numbers, or their ranks where they need more than 32 bits."""
    return column if not len(column) or int(column.max()) < 1 << 32 else np.unique(column, return_inverse=True)[1].astype(_U)


def _answer(buckets: int, group: pa.Table) -> pa.Table:
    """The totals of one partition of the count table, in the order in which each chunk asked for them; for words their numbers too."""
    sizes = group.column("n").to_pylist()
    counts = np.concatenate([_unpacked(x, n, "<u4") for x, n in zip(group.column("counts").to_pylist(), sizes, strict=True)])
    asked, k, bucket = group.column("words").to_pylist(), group.column("k")[0].as_py(), group.column("bucket")[0].as_py()
    key = None
    for i in range(len(asked[0])):
        column = [_unpacked(x[i], n, "<u8") for x, n in zip(asked, sizes, strict=True)]
        column = np.concatenate([np.cumsum(c, dtype=_U) for c in column] if i == 0 else column)
        key = column if key is None else np.unique(key << _U(32) | _dense(column), return_inverse=True)[1].astype(_U)
        key = _dense(key) if i + 1 < len(asked[0]) else key
    distinct, index = np.unique(key, return_inverse=True)
    totals = np.bincount(index, weights=counts, minlength=len(distinct)).astype("<u8")
    numbers = np.empty(len(distinct), dtype="<u8")
    if k == 0:
        numbers[np.lexsort((distinct, -totals.astype(np.int64)))] = np.arange(len(distinct), dtype=_U) * _U(buckets) + _U(bucket)
    ends = np.cumsum(sizes)[:-1]
    each = zip(group.column("chunk").to_pylist(), sizes, np.split(totals[index], ends), np.split(numbers[index], ends) if k == 0 else [None] * len(sizes), strict=True)
    return pa.Table.from_batches([_batch([(chunk, k, bucket, n, _packed(t), None if m is None else _packed(m)) for chunk, n, t, m in each], _ANSWER)])


def _by_bucket(answers: pa.Table, k: int, column: str, kind: str = "<u8") -> np.ndarray:
    rows = sorted(((r["bucket"], r[column], r["n"]) for r in answers.to_pylist() if r["k"] == k), key=lambda r: r[0])
    return np.concatenate([np.empty(0, dtype=kind), *(_unpacked(x, n, kind) for _, x, n in rows)])


def _numbered(chunk: pa.Table, answers: pa.Table) -> pa.Table:
    """The chunk with word numbers (ascending) and totals in place of hashes."""
    one = chunk.to_pylist()[0]
    numbers, totals = (_by_bucket(answers, 0, c) for c in ("numbers", "totals"))
    order = np.argsort(numbers)
    rank = np.empty(len(order), dtype="<u4")
    rank[order] = np.arange(len(order), dtype="<u4")
    tokens = rank[_unpacked(one["tokens"], sum(one["sizes"]), "<u4")]
    row = (one["chunk"], one["doc_ids"], one["sizes"], one["n_words"], _packed(tokens), _packed(np.diff(numbers[order], prepend=_U(0))), _packed(totals[order]))
    return pa.Table.from_batches([_batch([row], f"{_CHUNK}, numbers binary, totals binary")])


class Grams:
    """The n-grams of a chunk, for each order k + 1 from the first: the place of each n-gram in the list of distinct ones (index, -1
    where none ends), and of each distinct one its last word and the place of its context in the list before (last, context)."""

    def __init__(self, sizes: list[int], tokens: bytes, n_words: int, order: int):
        self.sizes = np.array(sizes, dtype=np.int64)
        n = int(self.sizes.sum())
        self.owner = np.repeat(np.arange(len(sizes), dtype=np.int32), self.sizes)
        place = np.arange(n) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        token = _unpacked(tokens, n, "<u4").astype(np.int64)
        self.index, self.last, self.context = [token], [np.arange(n_words)], [None]
        for k in range(1, order):
            there = np.flatnonzero(place >= k)
            distinct, inverse = np.unique(self.index[-1][there - 1] << 32 | token[there], return_inverse=True)
            at = np.full(n, -1, dtype=np.int64)
            at[there] = inverse
            self.index.append(at)
            self.last.append(distinct & 0xFFFFFFFF)
            self.context.append(distinct >> 32)

    def dealt(self, numbers: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each order from two words on: k, the buckets of its distinct n-grams, and these in order of their buckets."""
        hashes = mix(numbers)
        for k in range(1, len(self.last)):
            hashes = mix(hashes[self.context[k]] * constants(1, 71)[0] + mix(numbers[self.last[k]]) * constants(1, 73)[0] + _U(k))
            bucket = _bucket(hashes, buckets)
            order = np.argsort(bucket, kind="stable")
            yield k, bucket[order], order

    def columns(self, k: int, which: np.ndarray) -> list[np.ndarray]:
        """The words of some n-grams, by position."""
        out = []
        for j in range(k, 0, -1):
            out.append(self.last[j][which])
            which = self.context[j][which]
        return [which, *reversed(out)]


def _ask(order: int, buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for one in batch.to_pylist():
            numbers = np.cumsum(_unpacked(one["numbers"], one["n_words"], "<u8"), dtype=_U)
            grams = Grams(one["sizes"], one["tokens"], one["n_words"], order)
            for k, bucket, which in grams.dealt(numbers, buckets):
                counts = np.bincount(grams.index[k][grams.index[k] >= 0], minlength=len(which)).astype("<u4")[which]
                by_position = [numbers[c] for c in grams.columns(k, which)]
                rows = []
                for a, b in _runs(bucket):
                    first, *rest = (c[a:b] for c in by_position)
                    rows.append((k, int(bucket[a]), one["chunk"], b - a, [_packed(np.diff(first, prepend=_U(0))), *map(_packed, rest)], _packed(counts[a:b])))
                yield _batch(rows, _ASKED)


def _score(order: int, buckets: int, total: int, chunk: pa.Table, answers: pa.Table) -> pa.Table:
    one = chunk.to_pylist()[0]
    numbers = np.cumsum(_unpacked(one["numbers"], one["n_words"], "<u8"), dtype=_U)
    grams = Grams(one["sizes"], one["tokens"], one["n_words"], order)
    everywhere = [_unpacked(one["totals"], one["n_words"], "<u8").astype(np.int64)]
    for k, _, which in grams.dealt(numbers, buckets):
        everywhere.append(np.empty(len(which), dtype=np.int64))
        everywhere[k][which] = _by_bucket(answers, k, "totals")
    others = []  # for each order and place: how often the n-gram ending there occurs in other documents
    for k in range(order):
        at, there = grams.index[k], np.flatnonzero(grams.index[k] >= 0)
        _, index, number = np.unique(grams.owner[there].astype(np.int64) << 32 | at[there], return_inverse=True, return_counts=True)
        left = np.zeros(len(at), dtype=np.int64)
        left[there] = everywhere[k][at[there]] - number[index]
        others.append(left)
    rest = (total - grams.sizes)[grams.owner]  # words of other documents
    score = np.log(np.where(others[0] > 0, others[0], 1)) - np.log(np.where(others[0] > 0, rest, rest + 1))
    backed_off = np.zeros(len(score), dtype=bool)
    for k in range(1, order):
        context = np.concatenate((np.zeros(1, dtype=np.int64), others[k - 1][:-1])) if len(score) else others[0]
        known, inside = others[k] > 0, grams.index[k] >= 0
        backed_off = inside & ~known
        direct = np.log(np.where(known, others[k], 1)) - np.log(np.where(known, np.maximum(context, 1), 1))
        score = np.where(known, direct, np.where(inside, score + np.log(BACKOFF), score))
    documents = len(grams.sizes)
    sums = np.bincount(grams.owner, weights=score, minlength=documents)
    missed = np.bincount(grams.owner[backed_off], minlength=documents)
    return pa.Table.from_arrays([pa.array(one["doc_ids"], pa.int64()), pa.array(grams.sizes), pa.array(missed), pa.array(sums)], names=["doc_id", "n_tokens", "n_backed_off", "log_score"])


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, n_tokens, n_backed_off, log_score for every row of docs (doc_id, text).

    Words are runs without ASCII white space, A-Z lower-cased. log_score sums the natural logarithm of each word's score given the
    order - 1 words before it in its document: count of the n-gram over count of its context where the n-gram occurs, else
    BACKOFF times the score of the shorter n-gram; a single word scores its count over all words, or 1 over all words plus 1 where
    it does not occur. Counts cover all rows of docs but the row itself (leave-one-out: a document doesn't vouch for itself).
    n_backed_off counts the places with order - 1 words before them whose n-gram of `order` words occurs in no other row.

    Null, empty and white texts have no words: 0, 0 and 0.0. Null doc_ids stay null; repeated rows count and score as separate
    documents; an empty table gives no rows. Other columns are ignored."""
    if order < 1:
        raise ValueError("order must be at least 1")
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_chunks, f"{_CHUNK}, hashes binary, counts binary")
    with batches_of(docs.sparkSession, PIECE):
        chunks = saved(read, "lm-chunks")
    totals = chunks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x)).alias("words"), F.sum("n_words").alias("distinct")).first()
    total = int(totals.words or 0)
    word_buckets, buckets = (max(8, -(-n // BUCKET)) for n in (int(totals.distinct or 0), (order - 1) * total))
    asked = chunks.select("chunk", "n_words", "hashes", "counts").mapInArrow(partial(_ask_words, word_buckets), _ASKED)
    answers = asked.groupBy("k", "bucket").applyInArrow(lambda group: _answer(word_buckets, group), _ANSWER)
    texts = chunks.drop("hashes", "counts")
    numbered = saved(texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lambda key, chunk, found: _numbered(chunk, found), f"{_CHUNK}, numbers binary, totals binary"), "lm-numbered")
    forget(chunks)
    asked = numbered.mapInArrow(partial(_ask, order, buckets), _ASKED)
    answers = asked.groupBy("k", "bucket").applyInArrow(lambda group: _answer(buckets, group), _ANSWER)
    joined = numbered.groupBy("chunk").cogroup(answers.groupBy("chunk"))
    return joined.applyInArrow(lambda key, chunk, found: _score(order, buckets, total, chunk, found), "doc_id long, n_tokens long, n_backed_off long, log_score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(table(spark, sf_dir, "documents"))
    mean = F.round(F.col("log_score") / F.when(F.col("n_tokens") > 0, F.col("n_tokens")), 6)
    return scored.select("doc_id", "n_tokens", "n_backed_off", mean.alias("mean_log_score"))


SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS w
  FROM documents),
tokens AS (SELECT doc_id, unnest(w) AS v, generate_subscripts(w, 1) AS i FROM words),
grams AS (SELECT doc_id, i, v, lag(v) OVER d AS u, lag(v, 2) OVER d AS t FROM tokens WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
total AS (SELECT count(*) AS n FROM tokens),
size AS (SELECT doc_id, count(*) AS n FROM tokens GROUP BY doc_id),
counted AS (
  SELECT *, count(*) OVER (PARTITION BY v) - count(*) OVER (PARTITION BY doc_id, v) AS c_v,
    count(*) OVER (PARTITION BY u, v) - count(*) OVER (PARTITION BY doc_id, u, v) AS c_uv,
    count(*) OVER (PARTITION BY t, u, v) - count(*) OVER (PARTITION BY doc_id, t, u, v) AS c_tuv FROM grams),
both_ AS (SELECT c.*, lag(c_v) OVER d AS c_u, lag(c_uv) OVER d AS c_tu, total.n - size.n AS rest FROM counted c JOIN size USING (doc_id) CROSS JOIN total WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
one AS (SELECT *, CASE WHEN c_v > 0 THEN ln(c_v) - ln(rest) ELSE -ln(rest + 1) END AS s1 FROM both_),
two AS (SELECT *, CASE WHEN u IS NULL THEN s1 WHEN c_uv > 0 THEN ln(c_uv) - ln(c_u) ELSE s1 + ln(0.4) END AS s2 FROM one),
scored AS (
  SELECT doc_id, count(*) AS n_tokens, count(*) FILTER (WHERE t IS NOT NULL AND c_tuv = 0) AS n_backed_off,
    sum(CASE WHEN t IS NULL THEN s2 WHEN c_tuv > 0 THEN ln(c_tuv) - ln(c_tu) ELSE s2 + ln(0.4) END) AS s
  FROM two GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_tokens, 0)::BIGINT AS n_tokens, coalesce(n_backed_off, 0)::BIGINT AS n_backed_off, round(s / n_tokens, 6) AS mean_log_score
FROM documents d LEFT JOIN scored USING (doc_id)
"""

"""Helpers, and text that is no UTF-8."""

import hashlib
import time
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import functions as F

from quillgraph.llm import bpe, common, near_dup, quality
from quillgraph.sources import shared

CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_hot_classes_meet_all_their_rows(spark):
    rows = spark.range(6000).select(F.col("id").alias("r"), F.when(F.col("id") < 3000, F.lit(1)).otherwise(F.col("id")).alias("k"))
    classes = rows.groupBy("k").agg(F.count("*").alias("copies"), F.min("r").alias("low"))
    got = {(r.r, r.k, r.low) for r in common.with_class(rows, classes, ["k"], 6000).collect()}
    assert got == {(i, 1, 0) if i < 3000 else (i, i, i) for i in range(6000)}


def test_batch_limit_is_put_back(spark):
    before = spark.conf.get(CONF)
    with common.batches_of(spark, 1000):
        assert spark.conf.get(CONF) == "1000"
        with common.batches_of(spark, 5000):
            assert spark.conf.get(CONF) == "1000"
    assert spark.conf.get(CONF) == before


def test_forget_deletes_what_was_saved(spark):
    df = common.saved(spark.range(3), "t")
    common.forget(df, None, spark.range(1))
    path = spark._jvm.org.apache.hadoop.fs.Path(df._saved_at)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def test_saved_leaves_no_shuffle_files(spark):
    """The first phase's shuffles of op2 would lie beside the second's until the driver collects its garbage."""
    local = Path(spark.conf.get("spark.local.dir"))
    files = lambda: set(local.rglob("shuffle_*"))
    counted = spark.range(1000).groupBy((F.col("id") % 50).alias("k")).agg(F.count("*").alias("n"))
    shuffled, cleaned = files(), spark.conf.get(shared.CLEANED, None)
    df = common.saved(counted, "t")
    until = time.monotonic() + 20
    while files() - shuffled and time.monotonic() < until:
        time.sleep(0.1)
    assert not files() - shuffled and spark.conf.get(shared.CLEANED, None) == cleaned
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, counted.collect())) == [(k, 20) for k in range(50)]


def test_text_that_is_no_utf8(spark):
    docs = spark.sql("SELECT CAST(1 AS LONG) AS doc_id, CAST(X'61FF62206320642065' AS STRING) AS text UNION ALL SELECT CAST(2 AS LONG), CAST(X'FFFE' AS STRING)")
    raw, pattern = bpe.default_vocabulary()
    reference = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.vocabulary(raw, pattern).ranks, special_tokens={})
    want = []
    for i, b in ((1, b"a\xffb c d e"), (2, b"\xff\xfe")):
        text = b.decode(errors="replace")
        ids = reference.encode_ordinary(text)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, bpe.digests(docs, raw, pattern).collect())) == want
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert quality.classify(docs, labels).count() == 2 and quality.good(docs, labels).count() <= 2
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs).collect()} == {(1, 1, 1), (2, 1, 2)}


def traced_peak(made):
    """MB of Python and numpy memory that using up an iterator takes at a time, beyond what was there, and its rows."""
    tracemalloc.start()
    before = tracemalloc.get_traced_memory()[0]
    rows = sum(len(b) for b in made)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return (peak - before) / 1e6, rows


def test_workers_hold_little_at_a_time():
    """However many texts a batch has, what a worker holds stays far below an executor's share of memory for its workers."""
    word = np.random.default_rng(5).integers(0, 3000, 700_000)
    texts = [" ".join(f"w{x}" for x in part) for part in np.array_split(word, 1500)]  # some 4 MB
    n = pa.array(range(len(texts)), pa.int64())
    batch = pa.RecordBatch.from_arrays([n, n, pa.array(texts)], ["doc_id", "text_hash", "text"])
    raw, pattern = bpe.default_vocabulary()
    bpe.vocabulary(raw, pattern)  # stays in the worker
    model = quality.Model(np.zeros(quality.STATISTICS), np.ones(quality.STATISTICS), np.zeros(quality.FEATURES + quality.STATISTICS + 1), np.array([0.0]), np.array([0.5]))
    x = pa.RecordBatch.from_arrays([pa.array(range(10_000)), pa.array(list(np.ones((10_000, quality.STATISTICS))), pa.list_(pa.float64()))], ["doc_id", "x"])
    peaks = {}
    for name, made, rows in [("sketch", near_dup._sketch([batch]), 1500), ("sets", near_dup._sets([batch]), 1500), ("featurise", quality._featurise([batch]), 1500), ("score", quality._scored(model, [x]), 10_000), ("encode", bpe._encode(raw, pattern, True, [batch]), 1500)]:
        peaks[name], seen = traced_peak(made)
        assert seen == rows
    assert max(peaks.values()) < 40, peaks

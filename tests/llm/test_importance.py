"""Importance resampling against a plain version."""

import hashlib
import math
import re
import zlib

import pytest

from quillgraph.llm import importance

SPLIT = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def words(text):
    return re.findall(SPLIT, (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def plain(docs, target, longest, buckets, percent, least):
    def features(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    source, wanted = [0] * buckets, [0] * buckets
    found = [features(t) for _, t in docs]
    for f in found:
        for b in f:
            source[b] += 1
    for t in target:
        for b in features(t):
            wanted[b] += 1
    s, t = sum(source), sum(wanted)
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (s + buckets) / ((source[b] + 1) * (t + buckets)))) for b in range(buckets)]
    rows = []
    for (i, text), f in zip(docs, found, strict=True):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words(text))])
    fit = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(fit[: len(fit) * percent // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in rows), key=str)


@pytest.mark.parametrize(("longest", "buckets", "percent"), [(1, 10_000, 10), (3, 500, 40), (2, 70_000, 100)])
def test_as_the_plain_version(spark, sf, longest, buckets, percent):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs += [(900, None), (901, ""), (902, " .,;"), (None, "no id " * 9), (903, "same words here " * 8), (903, "same words here " * 8), (904, "ÀÉ word joined ǅ " * 8), (905, "x" * 50_000 + " y" * 30), (906, "a" + "." * 3_000 + "b")]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()] + [None, "", "one"]
    df = spark.createDataFrame([(*d, "clash", 5) for d in docs], "doc_id long, text string, bucket string, score int").repartition(5)
    goal = spark.createDataFrame([(t, 1) for t in target], "text string, n int")
    got = importance.resample(df, goal, longest, buckets, percent)
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs, target, longest, buckets, percent, 20)


def test_empty_tables(spark):
    docs, goal = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "text string")
    assert importance.resample(docs, goal).count() == 0
    some = spark.createDataFrame([(i, "a b " * 10) for i in range(10)], "doc_id long, text string")
    got = importance.resample(some, goal).collect()
    assert {r.n_features for r in got} == {20} and sorted(r.rank for r in got if r.rank) == [1]


def test_every_run_is_found_once():
    found = [m[0] for m in importance.scanner(2).finditer(b"aa b aa b aa", overlapped=True)]
    assert found == [b"aa b", b"b aa", b"aa b", b"b aa"]
    assert [m[0] for m in importance.scanner(1).finditer(b"aaa", overlapped=True)] == [b"aaa"] and not importance.scanner(2).findall(b"one", overlapped=True)

"""Unique names and lookups against plain versions."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import stems
from quillgraph.operators.lookup import heavy_keys, lookup
from quillgraph.operators.naming import unique_names
from quillgraph.operators.positions import settled


def plain_names(rows, limit):
    stem = {k: s or "Untitled" for k, s in rows}
    classes = {}
    for k in sorted(stem):
        classes.setdefault(stem[k], []).append(k)
    name, pending = {}, {}
    for s, keys in classes.items():
        name[keys[0]] = s
        pending |= {k: (s, i, len(keys)) for i, k in enumerate(keys[1:], 2)}
    while pending:
        wants = {}
        for k, (s, n, _) in pending.items():
            mark = f" - {n}"
            wants.setdefault(s[: limit - len(mark)].rstrip(" .") + mark, []).append(k)
        taken = set(name.values())
        for want, keys in wants.items():
            if want not in taken:
                name[min(keys)] = want
                del pending[min(keys)]
        pending = {k: (s, n + size, size) for k, (s, n, size) in pending.items()}
    return name


@pytest.mark.parametrize("seed", [1, 2])
def test_unique_names(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", "a", "a", "b", "b - 2", "a - 2", "a - 3", "a - 2 - 2", None, "", "long name", "long nam. x", f"own {i}"])) for i in range(300)]
    want = plain_names(rows, 9)
    for _ in range(2):
        rng.shuffle(rows)
        got = unique_names(spark.createDataFrame(rows, "id int, stem string").repartition(5), "id", 9)
        assert {r.id: r.name for r in got.collect()} == want and len(set(want.values())) == 300
    assert unique_names(spark.createDataFrame([], "id int, stem string"), "id").count() == 0


def test_stems(spark):
    df = spark.createDataFrame([("12", "support/12-how-to.md", "How to", "web", "a/b c.ts"), (None, "ref/guide-x.md", "A (b)", "r", "x.py"), ("", "top-page.md", "Top Page", "r", "x.py")], "n string, p string, t string, r string, f string")
    got = df.select(stems.support(F.col("n"), F.col("p"), F.col("t")), stems.wiki(F.col("p"), F.col("t")), stems.repo(F.col("r")), stems.capability(F.col("t")), stems.code_reference(F.col("r"), F.col("f"))).collect()
    assert [r[0] for r in got] == ["Support - 12 - How to", "Support Reference - guide - A b", "Support Reference - top - Top Page"]
    assert [r[1][:-9] for r in got] == ["Wiki - support - How to - 12 how to -", "Wiki - ref - A b - guide x -", "Wiki - Root - Top Page -"]
    assert [r[2:] for r in got] == [("Repo - web", "Capability - How to", "Code Ref - web - a -- b c.ts"), ("Repo - r", "Capability - A b", "Code Ref - r - x.py"), ("Repo - r", "Capability - Top Page", "Code Ref - r - x.py")]


def test_lookup_spreads_heavy_keys(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        rows = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, None).otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"))
        side = spark.createDataFrame([("hot", 1), ("k2", 2), ("other", 3), (None, 4)], "k string, v int")
        assert [r.k for r in heavy_keys(rows, "k").collect()] == ["hot"]
        for how in ("left", "inner", "left_semi", "left_anti"):
            got = lookup(rows, side, "k", fanout=8, how=how)
            want = rows.join(side, "k", how)
            assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
        dealt = lookup(rows, side, "k", fanout=64).select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
        assert max(r["count"] for r in dealt) < 6000 * 0.35 and len(dealt) == 4  # of four partitions; in a plain join two hold two thirds
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_positions(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(50), i) for i in range(1000)]
    got = settled(spark.createDataFrame(rows, "a int, b int").repartition(7), F.desc("a"), F.col("b")).collect()
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.position)] == sorted(rows, key=lambda x: (-x[0], x[1]))
    assert sorted(r.position for r in got) == list(range(1, 1001)) and Counter(r.a for r in got) == Counter(a for a, _ in rows)
    assert settled(spark.createDataFrame([], "a int"), F.col("a")).count() == 0

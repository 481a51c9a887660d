"""The sink of note files: what is written, left alone, pruned, and what a failure leaves."""

import hashlib
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillgraph.sources import files, note_files


def tree(root):
    return {str(p.relative_to(root)): p.read_text() for p in Path(root).rglob("*.md")}


def notes(spark, rows):
    return spark.createDataFrame(rows, "section string, name string, body string").repartition(3)


def test_writes_changes_and_prunes(spark, tmp_path):
    root = str(tmp_path / "vault")
    first = [("a", "one", "1"), ("a", "two", "2  \n\n"), ("b/c", "Grüße + 100%", "ä\r\nö"), (None, "top", None), ("a", "dup", "x"), ("a", "dup", "y")]
    assert note_files.write_tree(notes(spark, first), root) == {"written": 5, "unchanged": 0, "pruned": 0}
    have = tree(root)
    assert {k: v for k, v in have.items() if "dup" not in k} == {"a/one.md": "1\n", "a/two.md": "2\n", "b/c/Gre  100.md": "ä\nö\n", "top.md": "\n"}
    assert have["a/dup.md"] == min(("x\n", "y\n"), key=lambda s: hashlib.md5(s.encode()).hexdigest())
    kept = os.stat(f"{root}/a/one.md").st_mtime_ns
    second = [("a", "one", "1"), ("a", "two", "new"), ("d", "four", "4")]
    assert note_files.write_tree(notes(spark, second), root) == {"written": 2, "unchanged": 1, "pruned": 3}
    assert tree(root) == {"a/one.md": "1\n", "a/two.md": "new\n", "d/four.md": "4\n"} and os.stat(f"{root}/a/one.md").st_mtime_ns == kept
    assert {tuple(r) for r in files.notes(spark, root).collect()} == {("a/one.md", "1\n"), ("a/two.md", "new\n"), ("d/four.md", "4\n")}
    assert note_files.write_tree(notes(spark, second), root) == {"written": 0, "unchanged": 3, "pruned": 0}
    assert note_files.write_tree(notes(spark, []), root, prune=False)["pruned"] == 0 and len(tree(root)) == 3
    assert note_files.write_tree(notes(spark, []), root) == {"written": 0, "unchanged": 0, "pruned": 3} and not tree(root)


def test_a_failing_task_leaves_the_old_tree(spark, tmp_path):
    root = str(tmp_path / "vault")
    note_files.write_tree(notes(spark, [("a", f"n{i}", "old") for i in range(20)]), root)
    before = tree(root)
    spark.dataSource.register(note_files.NoteFiles)
    rows = spark.range(40).repartition(4).select(F.concat(F.lit("a/n"), "id", F.lit(".md")).alias("path"), F.when(F.col("id") == 33, F.raise_error(F.lit("lost"))).otherwise("new").alias("body"))
    with pytest.raises(Exception, match="lost"):
        rows.write.format(note_files.FORMAT).option("path", root).option("run", "r1").mode("append").save()
    assert tree(root) == before and not os.path.exists(f"{root}/.staged/r1")


def test_an_interrupted_run_is_carried_on(spark, tmp_path):
    root = str(tmp_path / "vault")
    note_files.write_tree(notes(spark, [("a", "n1", "old")]), root)
    rows = spark.createDataFrame([("a/n1.md", "new\n"), ("b/n2.md", "two\n")], "path string, body string").repartition(2)
    rows.write.format(note_files.FORMAT).option("path", root).option("run", "r2").mode("append").save()
    (Path(root) / ".staged" / "r3" / "x").mkdir(parents=True)  # a run that never was committed
    assert {k: v for k, v in tree(root).items() if not k.startswith(".")} == {"a/n1.md": "old\n"}
    assert [r.path for r in files.notes(spark, root).collect()] == ["a/n1.md"]  # staged files are no notes
    assert note_files.recover(spark, root) == ["r2"]
    assert tree(root) == {"a/n1.md": "new\n", "b/n2.md": "two\n"} and not os.listdir(f"{root}/.staged")

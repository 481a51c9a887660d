"""A tree of notes as files, one file per row, kept equal to a table.

The rows that changed are staged by a Spark data source, below the tree in a folder that readers don't see; when all tasks are done
its commit lists the attempts that count, and only then are files renamed into place and orphans removed, by Spark jobs as well. Until
that list exists the old tree is whole; once it exists, a run that was interrupted is carried on by the next one."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import chain

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..functions import text as T
from .shared import remove, saved
from .sinks import tidy

FORMAT, STAGED, LISTED = "note_files", ".staged", "_committed.json"
LISTED_AT_ONCE, READ_AT_ONCE = 1000, 4 << 20  # files in a batch, and characters


def _store(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if root.startswith("file:/") and not root.startswith("file://"):
        root = "file://" + root.removeprefix("file:")
    return fs.FileSystem.from_uri(root)


def _put(store: fs.FileSystem, path: str, content: bytes) -> None:
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(path) as f:
        f.write(content)


@dataclass
class Attempt(WriterCommitMessage):
    """A task that is done: its folder, and how many files it staged."""

    folder: str
    files: int


class StagingWriter(DataSourceArrowWriter):
    def __init__(self, root: str, run: str):
        self.root, self.run = root, run

    def _base(self) -> tuple[fs.FileSystem, str]:
        store, at = _store(self.root)
        return store, f"{at}/{STAGED}/{self.run}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Attempt:
        store, base = self._base()
        attempt, n = uuid.uuid4().hex, 0
        for batch in iterator:
            for path, body in zip(batch.column("path").to_pylist(), batch.column("body").to_pylist(), strict=True):
                _put(store, f"{base}/{attempt}/{path}", body.encode())
                n += 1
        return Attempt(attempt, n)

    def commit(self, messages: list[Attempt | None]) -> None:
        """Write the list of attempts (a short name for each task) in one step: what is not in it never counts."""
        store, base = self._base()
        done = [m.folder for m in messages if m is not None and m.files]
        _put(store, f"{base}/{LISTED}.tmp", json.dumps(done).encode())
        store.move(f"{base}/{LISTED}.tmp", f"{base}/{LISTED}")

    def abort(self, messages: list[Attempt | None]) -> None:
        store, base = self._base()
        if store.get_file_info(base).type != fs.FileType.NotFound:
            store.delete_dir(base)


class NoteFiles(DataSource):
    """Write-only: rows of path and body become staged files below the option `path`; the option `run` names the run."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, body string"

    def writer(self, schema: Ty.StructType, overwrite: bool) -> StagingWriter:
        return StagingWriter(self.options["path"], self.options["run"])


def _exists(spark: SparkSession, root: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path)


def _list(root: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path, folder of what is in folders; hidden names are left out."""
    store, at = _store(root)
    for batch in batches:
        for folder in batch.column("path").to_pylist():
            found = store.get_file_info(fs.FileSelector(f"{at}/{folder}".rstrip("/"), allow_not_found=True))
            kept = [(f"{folder}/{x.base_name}".lstrip("/"), x.type == fs.FileType.Directory) for x in found if not x.base_name.startswith((".", "_"))]
            for i in range(0, len(kept), LISTED_AT_ONCE):
                part = kept[i : i + LISTED_AT_ONCE]
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in part], pa.string()), pa.array([d for _, d in part], pa.bool_())], ["path", "folder"])


def listed(spark: SparkSession, root: str) -> DataFrame:
    """path of every file below root, in the shared folder: folders are listed by tasks, level by level, so that the driver never holds
    the names of files."""
    folders, found = spark.createDataFrame([("",)], "path string"), None
    while True:
        level = saved(folders.mapInArrow(partial(_list, root), "path string, folder boolean"), "tree-level")
        here = level.where("NOT folder").select("path")
        found = here if found is None else found.unionByName(here)
        folders = level.where("folder").select("path")
        if folders.isEmpty():
            return found
        folders = folders.repartition("path")


def _read(root: str, digest: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    store, at = _store(root)
    rows, held = [], 0
    for path in chain.from_iterable(batch.column("path").to_pylist() for batch in batches):
        with store.open_input_stream(f"{at}/{path}") as f:
            content = f.read()
        rows.append((path, hashlib.md5(content).hexdigest() if digest else content.decode(errors="replace")))
        held += len(rows[-1][1])
        if held >= READ_AT_ONCE or len(rows) >= LISTED_AT_ONCE:
            yield _batch(rows)
            rows, held = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ["relative_path", "value"])


def _contents(spark: SparkSession, root: str, suffix: str, digest: bool) -> DataFrame:
    names = listed(spark, root).where(F.endswith("path", F.lit(suffix)))
    dealt = names.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return dealt.mapInArrow(partial(_read, root, digest), "relative_path string, value string")


def texts(spark: SparkSession, root: str, suffix: str = ".md") -> DataFrame:
    """relative_path, text like files.texts(), for trees of very many small files: tasks list them, and each reads its share."""
    return _contents(spark, root, suffix, False).withColumnRenamed("value", "text")


def present(spark: SparkSession, root: str, suffix: str = ".md") -> DataFrame:
    """path, md5 of the files below root; no rows where there is no tree yet."""
    if not _exists(spark, root):
        return spark.createDataFrame([], "path string, md5 string")
    return _contents(spark, root, suffix, True).toDF("path", "md5")


def _moves(root: str, run: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rename the files of attempts into place. Doing it again is harmless: what has moved is no longer there."""
    store, at = _store(root)
    for batch in batches:
        n = 0
        for attempt in batch.column("attempt").to_pylist():
            base = f"{at}/{STAGED}/{run}/{attempt}"
            for info in store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)):
                if info.type == fs.FileType.File:
                    to = f"{at}/{info.path[len(base) + 1 :]}"
                    store.create_dir(to.rsplit("/", 1)[0], recursive=True)
                    store.move(info.path, to)
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])


def _drops(root: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    store, at = _store(root)
    for batch in batches:
        n = 0
        for path in batch.column("path").to_pylist():
            if store.get_file_info(f"{at}/{path}").type == fs.FileType.File:
                store.delete_file(f"{at}/{path}")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])


def publish(spark: SparkSession, root: str, run: str) -> int:
    """Rename what a committed run has staged, and clear its folder; the number of files that moved."""
    store, at = _store(root)
    with store.open_input_file(f"{at}/{STAGED}/{run}/{LISTED}") as f:
        attempts = json.loads(f.read())  # a name for each task
    moved = 0
    if attempts:
        rows = spark.createDataFrame([(a,) for a in attempts], "attempt string").repartition(len(attempts))
        moved = rows.mapInArrow(partial(_moves, root, run), "n long").agg(F.sum("n")).first()[0]
    remove(spark, f"{root}/{STAGED}/{run}")
    return moved or 0


def recover(spark: SparkSession, root: str) -> list[str]:
    """Carry on runs that were committed and not published, and clear those that were not committed; the names of the former."""
    if not _exists(spark, f"{root}/{STAGED}"):
        return []
    base = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{STAGED}")
    found = base.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatus(base)
    runs = [s.getPath().getName() for s in found]
    done = [r for r in runs if _exists(spark, f"{root}/{STAGED}/{r}/{LISTED}")]
    for run in runs:
        if run in done:
            publish(spark, root, run)
        else:
            remove(spark, f"{root}/{STAGED}/{run}")
    return done


def wanted(notes: DataFrame) -> DataFrame:
    """path, body, md5 of notes (section, name, body): `<section>/<safe name>.md` with a tidied body."""
    name = F.concat(F.concat_ws("/", F.nullif("section", F.lit("")), T.safe_filename(F.col("name"))), F.lit(".md"))
    rows = notes.select(name.alias("path"), tidy(F.coalesce("body", F.lit(""))).alias("body"))
    return rows.withColumn("md5", F.md5(F.encode("body", "UTF-8")))


def write_tree(notes: DataFrame, root: str, prune: bool = True) -> dict[str, int]:
    """Make the tree below root equal to notes (section, name, body): written, unchanged and pruned files.

    Files whose checksum is right are left alone; only the others are staged and renamed into place. With `prune`, files that no row
    names are removed, after all others are in place. What has changed is found by names and checksums alone; bodies are read twice, for
    checksums and for the files that change (give a saved() table where they are costly to make). Of rows that name one file, the body with the smallest checksum stays; a
    null body is an empty note, a null section the root; names are those of safe_filename(), and unique if the caller made them so
    (operators.naming). An empty table leaves an empty tree. One writer at a time may use a tree."""
    spark = notes.sparkSession
    spark.dataSource.register(NoteFiles)
    recover(spark, root)
    rows = wanted(notes)
    there = saved(present(spark, root), "tree-present")
    named = saved(rows.groupBy("path").agg(F.min("md5").alias("md5")), "tree-wanted")
    change = saved(named.join(there, ["path", "md5"], "left_anti"), "tree-changes")
    n_all, n_change = named.count(), change.count()
    written = 0
    if n_change:
        run = uuid.uuid4().hex
        rows.join(change, ["path", "md5"], "left_semi").select("path", "body").write.format(FORMAT).option("path", root).option("run", run).mode("append").save()
        publish(spark, root, run)
        written = n_change
    pruned = 0
    if prune:
        pruned = there.join(named, "path", "left_anti").select("path").mapInArrow(partial(_drops, root), "n long").agg(F.sum("n")).first()[0] or 0
    for df in (there, named, change):
        remove(spark, df._saved_at)
    return {"written": written, "unchanged": n_all - n_change, "pruned": pruned}

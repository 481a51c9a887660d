"""Fill-in-middle transformation (operator 13) over seekable compressed frames."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, forget, pieces, saved, table

PIECE = 4 << 20  # bytes of text at a time
FRAME = 64 << 10  # bytes of text in a frame: what one cut decompresses
SEED = 1
PLAIN_FROM, SPM_BELOW = 90, 20  # percentages: documents left as they are, and the others that put the suffix first
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
STORE = "doc_id long, n long, marked boolean, frames array<struct<units:long,chars:long,inside:boolean,data:binary>>"
DIGESTS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_STARTS = np.ones(256, dtype=bool)  # bytes that begin a code point
_STARTS[0x80:0xC0] = False


def unit_starts(text: bytes, inside: bool) -> np.ndarray:
    """A mask of the bytes at which units begin: runs of A-Z and a-z, and all other code points one by one. `inside`: the text goes
    on from a letter, so that a run at its front is no new unit."""
    raw = np.frombuffer(text, dtype=np.uint8)
    letter = _LETTER[raw]
    before = np.concatenate(([inside], letter[:-1])) if len(raw) else letter
    return np.where(letter, ~before, _STARTS[raw])


def frames_of(text: bytes, compress) -> Iterator[dict]:
    """Independent zstandard frames of about FRAME bytes, cut between code points, each with the units and characters before it."""
    at = units = chars = 0
    inside = False
    while at < len(text):
        end = min(at + FRAME, len(text))
        while end < len(text) and not _STARTS[text[end]]:
            end += 1
        part = text[at:end]
        yield {"units": units, "chars": chars, "inside": inside, "data": compress(part)}
        units += int(unit_starts(part, inside).sum())
        chars += int(_STARTS[np.frombuffer(part, dtype=np.uint8)].sum())
        inside, at = bool(_LETTER[part[-1]]), end
    yield {"units": units, "chars": chars, "inside": inside, "data": b""}  # the end: totals, and no text


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    compress = zstandard.ZstdCompressor(level=3).compress
    kind = pa.list_(pa.struct([("units", pa.int64()), ("chars", pa.int64()), ("inside", pa.bool_()), ("data", pa.binary())]))
    for part, texts in pieces(batches, "text", PIECE):
        texts = [t.decode(errors="replace").encode() for t in texts]
        cut = [list(frames_of(t, compress)) for t in texts]
        marked = [any(m in t for m in (PREFIX, SUFFIX, MIDDLE)) for t in texts]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([f[-1]["units"] for f in cut], pa.int64()), pa.array(marked, pa.bool_()), pa.array(cut, kind)], ["doc_id", "n", "marked", "frames"])


def store(docs: DataFrame) -> DataFrame:
    """The texts of docs (doc_id, text) as a table of frames: doc_id, n (units), marked (the text holds a marker), frames.

    A frame has the units and characters before it, whether it goes on within a run of letters, and its text as a zstandard frame of
    its own; the last one is empty and carries the totals. A null text counts as an empty one; bytes that are no UTF-8 are read as
    U+FFFD; null doc_ids and repeated rows are stored like any other; an empty table gives no rows. Other columns are ignored."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_store, STORE)


class Frames:
    """Reads the text of one document out of its frames; `opened` counts the frames that were decompressed."""

    def __init__(self, frames: list[dict]):
        self.frames, self.opened = frames, 0
        self._decompress = zstandard.ZstdDecompressor().decompress

    def text(self, i: int) -> bytes:
        self.opened += 1
        return self._decompress(self.frames[i]["data"])

    def seek(self, unit: int) -> tuple[int, int, int]:
        """The frame and byte at which a unit begins, and the characters before it: only that frame is decompressed."""
        last = len(self.frames) - 1
        i, high = 0, last
        while i < high:  # the last frame with no more than `unit` units before it
            middle = (i + high + 1) // 2
            i, high = (middle, high) if self.frames[middle]["units"] <= unit else (i, middle - 1)
        if i == last:
            return last, 0, self.frames[last]["chars"]
        text = self.text(i)
        at = int(np.flatnonzero(unit_starts(text, self.frames[i]["inside"]))[unit - self.frames[i]["units"]])
        return i, at, self.frames[i]["chars"] + int(_STARTS[np.frombuffer(text[:at], dtype=np.uint8)].sum())

    def read(self, start: tuple[int, int], end: tuple[int, int]) -> Iterator[bytes]:
        """The text from one place to another, frame after frame."""
        for i in range(start[0], min(end[0] + 1, len(self.frames) - 1)):
            if i < end[0] or end[1]:
                yield self.text(i)[start[1] if i == start[0] else 0 : end[1] if i == end[0] else None]


def draws(doc_id: int | None, seed: int = SEED) -> tuple[int, int, int, int]:
    """h1 to h4: the first four groups of eight hexadecimal digits of sha256("seed:doc_id"); a null doc_id is an empty string."""
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digits[i : i + 8], 16) for i in (0, 8, 16, 24))


def plan(doc_id: int | None, n: int, marked: bool, seed: int = SEED) -> tuple[str, int, int]:
    """The form of a document, and the units before its middle and before its suffix."""
    h1, h2, h3, h4 = draws(doc_id, seed)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if n == 0 or marked or h3 % 100 >= PLAIN_FROM:
        return "plain", 0, 0
    return ("spm" if h4 % 100 < SPM_BELOW else "psm"), a, b


def output(frames: Frames, form: str, first: tuple[int, int], second: tuple[int, int]) -> Iterator[bytes]:
    """The transformed text, piece by piece."""
    begin, end = (0, 0), (len(frames.frames) - 1, 0)
    if form == "plain":
        yield from frames.read(begin, end)
        return
    prefix, suffix = (PREFIX, begin, first), (SUFFIX, second, end)
    for marker, start, stop in ([suffix, prefix] if form == "spm" else [prefix, suffix]) + [(MIDDLE, first, second)]:
        yield marker
        yield from frames.read(start, stop)


def parts(stream: Iterable[bytes], form: str) -> Iterator[tuple[bytes, bytes]]:
    """(marker, text) pieces of a transformed text, told apart by its markers alone; a marker may lie across two pieces."""
    if form == "plain":
        yield from ((b"", x) for x in stream)
        return
    order = [SUFFIX, PREFIX, MIDDLE] if form == "spm" else [PREFIX, SUFFIX, MIDDLE]
    now, rest = b"", b""
    for x in stream:
        rest += x
        while order and (at := rest.find(order[0])) >= 0:
            yield now, rest[:at]
            now, rest = order[0], rest[at + len(order[0]) :]
            order = order[1:]
        keep = 2 if order else 0
        yield now, rest[: len(rest) - keep]
        rest = rest[len(rest) - keep :]
    yield now, rest


def restored(outputs, form: str) -> Iterator[bytes]:
    """The original text from a transformed one. `outputs` starts the stream of the transformed text: the suffix stands before the
    middle there, so the stream is read twice and nothing is held."""
    for passed, wanted in ((0, (b"", PREFIX, MIDDLE)), (1, (SUFFIX,))):
        if passed and form == "plain":
            return
        yield from (text for marker, text in parts(outputs(), form) if marker in wanted)


def _digest(stream: Iterable[bytes]) -> str:
    h = hashlib.sha256()
    for x in stream:
        h.update(x)
    return h.hexdigest()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, int, bool, Frames]]:
    for batch in batches:
        for i in range(batch.num_rows):  # one document's frames at a time become Python objects
            row = batch.slice(i, 1).to_pylist()[0]
            yield row["doc_id"], row["n"], row["marked"], Frames(row["frames"])


def _transform(with_text: bool, seed: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in DIGESTS.split(", ")] + ["output"] * with_text
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.string()] * with_text
    rows, held = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for doc_id, n, marked, frames in _rows(batches):
        form, a, b = plan(doc_id, n, marked, seed)
        (i, x, before), (j, y, until) = (frames.seek(a), frames.seek(b)) if form != "plain" else ((0, 0, None), (0, 0, None))
        stream = partial(output, frames, form, (i, x), (j, y))
        row = [doc_id, n, form, before, until - before if form != "plain" else None, _digest(stream()), _digest(restored(stream, form))]
        if with_text:
            row.append(b"".join(stream()).decode())
            held += len(row[-1])
        rows.append(row)
        if len(rows) >= 10_000 or held >= PIECE:
            yield batch()
            rows, held = [], 0
    if rows:
        yield batch()


def transform(frames: DataFrame, text: bool = False, seed: int = SEED) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256, and with `text` the output itself, for every row
    of a store() of frames. No shuffle: a lost executor's tasks run again elsewhere."""
    return frames.mapInArrow(partial(_transform, text, seed), DIGESTS + ", output string" * text)


def _restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            raw = row["output"].encode()
            text = b"".join(restored(lambda raw=raw: iter([raw]), row["form"])).decode()
            yield pa.RecordBatch.from_arrays([pa.array([row["doc_id"]], pa.int64()), pa.array([text], pa.string())], ["doc_id", "text"])


def restore(outputs: DataFrame) -> DataFrame:
    """doc_id, text: the texts from which rows of doc_id, form, output were made."""
    return outputs.select("doc_id", "form", "output").mapInArrow(_restore, "doc_id long, text string")


def digests(docs: DataFrame) -> DataFrame:
    """What transform() tells of docs, by way of a store of frames in the shared folder, which goes when the digests are written.

    Every row of docs gives one row. Null texts count as empty ones: plain, with n 0. Ties and repeated rows have equal results; an
    empty table gives none. No text is cut: a task holds a batch of about 4 MB, or one text where that is longer."""
    with batches_of(docs.sparkSession, PIECE):
        frames = saved(store(docs), "fim-frames")
        out = saved(transform(frames), "fim")
    forget(frames)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))

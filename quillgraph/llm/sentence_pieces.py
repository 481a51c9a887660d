"""SentencePiece encoding and decoding (operator 12) that keeps the place of every piece in the original bytes."""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator, Sequence
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, pieces, saved, table

PIECE = 2 << 20  # bytes of text at a time: working memory is some thirty times as large
KNOWN = 400_000  # stretches whose pieces a worker remembers; the memory is emptied when it is full (some 250 bytes each)
LONG = 48  # symbols from which a heap, not a scan, finds the next merge
SPACE = "▁"
_NONE = float("inf")  # the worth of a pair that makes no piece
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # fixed values: kinds of pieces in a model file


def fields(raw: bytes) -> Iterator[tuple[int, int | float | bytes]]:
    """The (number, value) fields of a serialised protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = number() if kind == 2 else {1: 8, 5: 4}[kind]
        value, at = raw[at : at + size], at + size
        yield key >> 3, struct.unpack("<f", value)[0] if kind == 5 else value


class CharacterMap:
    """A compiled character map: a double-array trie from source bytes to places in a blob of zero-ended replacements."""

    def __init__(self, compiled: bytes):
        size = struct.unpack_from("<I", compiled)[0] if compiled else 0
        self.units = np.frombuffer(compiled, dtype="<u4", count=size // 4, offset=4).tolist() if size else []
        self.blob = compiled[4 + size :]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """The longest rule that matches at a place: how many bytes it takes, and what it puts there."""
        if not self.units:
            return None
        node, found = self._offset(self.units[0]), None
        for i in range(at, len(raw)):
            node ^= raw[i]
            unit = self.units[node]
            if unit & 0x800000FF != raw[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = i + 1 - at, self.units[node] & 0x7FFFFFFF
        return found and (found[0], self.blob[found[1] : self.blob.index(0, found[1])])

    def first_bytes(self) -> list[int]:
        """The bytes with which some rule begins."""
        if not self.units:
            return []
        root = self._offset(self.units[0])
        return [b for b in range(1, 256) if root ^ b < len(self.units) and self.units[root ^ b] & 0x800000FF == b]


class Model:
    """A BPE model file: its pieces, its normalisation, and how texts become ids and ids texts."""

    def __init__(self, raw: bytes):
        self.pieces, self.scores, self.kinds = [], [], []
        trainer, normalizer = {}, {}
        for number, value in fields(raw):
            if number == 1:
                piece = dict(fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(piece.get(2, 0.0))
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normalizer = dict(fields(value))
        if trainer.get(3, 1) != 2:
            raise ValueError("the model is no BPE model")
        if trainer.get(24, 0):
            raise ValueError("white space as a suffix is not supported")
        self.byte_fallback = bool(trainer.get(35, 0))
        self.unknown_shown = trainer.get(44, " ⁇ ".encode()).decode()
        self.prefixed, self.squeezed, self.escaped = (bool(normalizer.get(i, 1)) for i in (3, 4, 5))
        self.map = CharacterMap(normalizer.get(2, b""))
        self.ids, self.reserved = {}, {}
        for i, (piece, kind) in enumerate(zip(self.pieces, self.kinds, strict=True)):
            (self.ids if kind in (NORMAL, USER, UNUSED) else self.reserved).setdefault(piece, i)
        self.worth = {piece: -self.scores[i] for piece, i in self.ids.items()}  # the smallest is merged first
        self.unknown = self.kinds.index(UNKNOWN)
        self.end = self.pieces.index("</s>")
        self.bytes = [self.reserved.get(f"<0x{b:02X}>", self.unknown) for b in range(256)]
        users = sorted((p for p, k in zip(self.pieces, self.kinds, strict=True) if k == USER), key=len, reverse=True)
        self.users = re.compile("|".join(map(re.escape, users))) if users else None
        self.unused = UNUSED in self.kinds
        self.space = SPACE if self.escaped else " "
        # no merge crosses two characters that no piece holds next to each other: texts are cut there, and equal stretches merged once
        pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        letters = sorted({c for p in pairs for c in p})
        self.letter = np.zeros(0x110000, dtype=np.int32)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.joined = np.zeros((len(letters) + 1, len(letters) + 1), dtype=bool)
        for a, b in pairs:
            self.joined[self.letter[ord(a)], self.letter[ord(b)]] = True
        firsts = bytes(self.map.first_bytes()) + (bytes({p.encode()[0] for p in users}) if users else b"")
        # bytes at which a rule may apply; all others are copied in runs
        self.ruled = re.compile(b"[" + re.escape(firsts) + b"]") if firsts else None
        self.known: dict[str, tuple[int, ...]] = _Known(self.stretch_ids)
        self.size = np.array([len(p) for p in self.pieces])
        self.size[[i for i, kind in enumerate(self.kinds) if kind == BYTE]] = 0
        self.goes_on = np.zeros(len(self.pieces) + 1, dtype=bool)  # bytes within a character
        self.goes_on[self.bytes[0x80:0xC0]] = True
        self.is_byte = np.array([kind == BYTE for kind in self.kinds])
        self.controls = {i for i, kind in enumerate(self.kinds) if kind == CONTROL}
        self.shown = [self._shown(i) for i in range(len(self.pieces))]

    # normalisation

    def _prefix(self, raw: bytes, text_at: int) -> tuple[int, bytes]:
        """What stands at a place: the bytes that it takes, and what becomes of them."""
        if self.users and (user := self.users.match(raw[text_at:].decode(errors="ignore"))):
            return len(user.group().encode()), user.group().encode()
        if (rule := self.map.longest(raw, text_at)) is not None:
            return rule
        end = text_at + 1
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end += 1
        return end - text_at, raw[text_at:end]

    def normalize(self, raw: bytes) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its characters (and its end) the byte of `raw` (UTF-8) that it came from."""
        if not raw:
            return "", np.zeros(1, dtype=np.int64)
        at = 0
        if self.squeezed:
            while at < len(raw) and (found := self._prefix(raw, at))[1] == b" ":
                at += found[0]
            if at == len(raw):
                return "", np.full(1, at, dtype=np.int64)
        shown, places = [], []

        def put(text: str, source: np.ndarray | int) -> None:
            shown.append(text)
            places.append(np.broadcast_to(np.asarray(source, dtype=np.int64), (len(text),)))

        if self.prefixed:
            put(self.space, at)
        spaced = self.squeezed
        while at < len(raw):
            hit = self.ruled.search(raw, at) if self.ruled else None
            until = len(raw) if hit is None else hit.start()
            if self.squeezed:
                blank = raw.find(b" ", at)
                until = min(until, blank if blank >= 0 else until)
            if until > at:  # a run that no rule touches: its characters keep their places
                run = raw[at:until]
                begins = np.flatnonzero(np.frombuffer(run, dtype=np.uint8) & 0xC0 != 0x80)
                text = run.decode()
                put(text.replace(" ", self.space), at + begins)
                spaced, at = self.squeezed and text.endswith(" "), until
                continue
            size, new = self._prefix(raw, at)
            text = new.decode()
            if spaced:
                text = text.lstrip(" ")
            if text:
                put(text.replace(" ", self.space), at)
                spaced = text.endswith(" ")
            at += size
            spaced = spaced and self.squeezed
        text, source = "".join(shown), np.concatenate([*places, [at]])
        if self.squeezed:
            kept = len(text.rstrip(self.space))
            text, source = text[:kept], source[: kept + 1]
        return text, source

    # merging

    def _symbols(self, text: str) -> tuple[list[str], list[bool]]:
        if not self.users:
            return list(text), [False] * len(text)
        out, frozen, at = [], [], 0
        while at < len(text):
            user = self.users.match(text, at)
            out.append(user.group() if user else text[at])
            frozen.append(bool(user))
            at += len(out[-1])
        return out, frozen

    def _merged(self, text: str) -> list[str]:
        """The symbols of a stretch after all merges: the best score first, of equal ones the leftmost."""
        parts, frozen = self._symbols(text)
        worth, no = self.worth, _NONE
        made: dict[str, tuple[str, str]] = {}

        def score(left: str, right: str) -> float:
            found = worth.get(left + right, no)
            if found != no and self.unused and self.kinds[self.ids[left + right]] == UNUSED:
                made[left + right] = left, right
            return found

        if len(parts) <= LONG and not any(frozen):
            of = score if self.unused else lambda left, right: worth.get(left + right, no)
            pairs = list(map(of, parts[:-1], parts[1:]))
            while pairs and (best := min(pairs)) != no:
                at = pairs.index(best)
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                del pairs[at]
                if at > 0:
                    pairs[at - 1] = of(parts[at - 1], parts[at])
                if at < len(pairs):
                    pairs[at] = of(parts[at], parts[at + 1])
        else:
            parts = self._merged_long(parts, frozen, score)
        return [x for p in parts for x in self._apart(p, made)] if made else parts

    @staticmethod
    def _merged_long(parts: list[str], frozen: list[bool], score) -> list[str]:
        """The same by a heap over a linked list, for long stretches."""
        after, before = [*range(1, len(parts)), -1], list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, int, int]] = []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right >= 0 and not frozen[left] and not frozen[right] and (w := score(parts[left], parts[right])) != _NONE:
                heapq.heappush(heap, (w, left, right, len(parts[left]) + len(parts[right])))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, left, right, size = heapq.heappop(heap)
            if not parts[left] or not parts[right] or len(parts[left]) + len(parts[right]) != size:
                continue  # stale: one side has changed
            parts[left] += parts[right]
            parts[right] = ""
            after[left] = after[right]
            if after[right] >= 0:
                before[after[right]] = left
            offer(before[left], left)
            offer(left, after[left])
        return [p for p in parts if p]

    def _apart(self, piece: str, made: dict[str, tuple[str, str]]) -> list[str]:
        """An unused piece goes back to the pieces that it was made of."""
        found = self.ids.get(piece)
        if found is None or self.kinds[found] != UNUSED or piece not in made:
            return [piece]
        return [x for side in made[piece] for x in self._apart(side, made)]

    def _id(self, piece: str) -> int:
        return self.reserved.get(piece, self.ids.get(piece, self.unknown))

    def stretches(self, text: str) -> list[str]:
        """The text in pieces across which nothing can merge."""
        if len(text) < 2:
            return [text] if text else []
        letters = self.letter[np.frombuffer(text.encode("utf-32-le"), dtype="<u4")]
        cuts = [0, *(np.flatnonzero(~self.joined[letters[:-1], letters[1:]]) + 1).tolist(), len(text)]
        return [text[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def stretch_ids(self, text: str) -> tuple[int, ...]:
        """The ids of a stretch; characters without a piece become bytes where the model has them."""
        ids = []
        for piece in self._merged(text):
            i = self._id(piece)
            ids += [self.bytes[b] for b in piece.encode()] if i == self.unknown and self.byte_fallback else [i]
        return tuple(ids)

    def _sizes(self, ids: np.ndarray) -> np.ndarray:
        """How many characters each piece takes: of a character that became bytes, the last byte takes it."""
        last = self.is_byte[ids] & ~self.goes_on[np.append(ids[1:], len(self.pieces))]
        return self.size[ids] + last

    def _without_bytes(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes where unknown characters have no bytes: neighbouring unknown ones are one piece."""
        ids, sizes = [], []
        for piece in chain.from_iterable(map(self._merged, stretches)):
            if (i := self._id(piece)) == self.unknown and ids and ids[-1] == i:
                sizes[-1] += len(piece)
            else:
                ids.append(i)
                sizes.append(len(piece))
        return np.array(ids, dtype=np.int64), np.array(sizes, dtype=np.int64)

    def encode(self, raw: bytes, end: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a text (UTF-8), and the places in `raw`: piece i covers the bytes from places[i] to places[i + 1]. The end id covers
        nothing."""
        text, source = self.normalize(raw)
        stretches = self.stretches(text)
        if self.byte_fallback:
            ids = np.fromiter(chain.from_iterable(map(self.known.__getitem__, stretches)), dtype=np.int64)
            sizes = self._sizes(ids)
        else:
            ids, sizes = self._without_bytes(stretches)
        if end:
            ids, sizes = np.append(ids, self.end), np.append(sizes, 0)
        return ids, source[np.concatenate(([0], np.cumsum(sizes)))]

    # decoding

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ids: control pieces say nothing, byte pieces are read together as UTF-8 (U+FFFD for each byte that is none),
        unknown ones show the model's mark, and white space at the front goes as it came."""
        ids = list(ids)
        for at, i in enumerate(ids):  # up to the first piece that says anything
            kind, shown = self.kinds[i], self.shown[i]
            if kind in (CONTROL, UNKNOWN, BYTE) or not (self.prefixed or self.squeezed) or not shown.startswith(b" "):
                front = shown
            else:
                front = shown[1:]
                if not self.squeezed:
                    return self._text(front, ids[at + 1 :])
            if front:
                return self._text(front, ids[at + 1 :])
        return ""

    def _text(self, front: bytes, ids: list[int]) -> str:
        if self.controls.isdisjoint(ids[:-1]):
            return _utf8(front + b"".join(map(self.shown.__getitem__, ids)))
        out = [front]
        for i in ids:  # bytes on either side of a control piece are no one character
            if i in self.controls:
                out.append(b"")
            else:
                out[-1] += self.shown[i]
        return "".join(map(_utf8, out))

    def _shown(self, i: int) -> bytes:
        """The bytes that a piece stands for behind the first one of a text."""
        kind = self.kinds[i]
        if kind == CONTROL:
            return b""
        if kind == BYTE:
            return bytes([int(self.pieces[i][3:5], 16)])
        return self.unknown_shown.encode() if kind == UNKNOWN else self.pieces[i].replace(SPACE, " ").encode()


class _Known(dict):
    """Results by stretch; long stretches are not kept, and a full memory is emptied."""

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, stretch: str):
        found = self.of(stretch)
        if len(stretch) <= LONG:
            if len(self) >= KNOWN:
                self.clear()
            self[stretch] = found
        return found


def _utf8(raw: bytes) -> str:
    """Bytes as text; every byte that is no part of a character becomes U+FFFD by itself."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            size = 1 + sum(raw[at] >= x for x in (0xC0, 0xE0, 0xF0))
            try:
                out.append(raw[at : at + size].decode())
                at += size
            except UnicodeDecodeError:
                out.append("�")
                at += 1
        return "".join(out)


@lru_cache(maxsize=2)
def model(raw: bytes) -> Model:
    return Model(raw)


def default_model() -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def _read(part: bytes) -> bytes:
    """UTF-8, with U+FFFD for what is none."""
    try:
        part.decode()
        return part
    except UnicodeDecodeError:
        return part.decode(errors="replace").encode()


def _encode(raw: bytes, end: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    m = model(raw)
    for part, texts in pieces(batches, "text", PIECE):
        done = [m.encode(_read(t), end) for t in texts]
        ids = [i.astype(np.int32) for i, _ in done]
        begins, ends = [p[:-1] for _, p in done], [p[1:] for _, p in done]
        columns = [part.column("doc_id"), pa.array([len(i) for i in ids], pa.int64()), *(pa.array(x, k) for x, k in ((ids, pa.list_(pa.int32())), (begins, pa.list_(pa.int64())), (ends, pa.list_(pa.int64()))))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "begins", "ends"])


def encode(docs: DataFrame, raw: bytes, end: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids, begins, ends (arrays): the pieces of each text and the bytes of the original text that each covers.

    docs has doc_id and text; other columns are ignored. raw is a model file's content. Every row gives one row, repeated rows too;
    a null text counts as an empty one (the end id alone, if asked for); a null doc_id stays null; an empty table gives no rows.
    Bytes that are no UTF-8 are read as U+FFFD, as Python decodes them with errors="replace". Texts are taken whole, about 2 MB at
    a time. No shuffle: a lost executor's tasks run again elsewhere."""
    schema = "doc_id long, n_tokens long, ids array<int>, begins array<long>, ends array<long>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(_encode, raw, end), schema)


def _decode(raw: bytes, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    m = model(raw)
    for batch in batches:
        ids = batch.column("ids")
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = [m.decode(i or []) for i in ids.slice(at, 256).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "decoded"])


def decode(encoded: DataFrame, raw: bytes) -> DataFrame:
    """doc_id, decoded for rows of doc_id, ids; null ids decode to an empty text."""
    return encoded.select("doc_id", "ids").mapInArrow(partial(_decode, raw), "doc_id long, decoded string")


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, covered long"


def _digests(raw: bytes, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    m = model(raw)
    named = list(map(str, range(len(m.pieces))))
    hexed = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for part, texts in pieces(batches, "text", PIECE):
        rows = []
        for text in texts:
            ids, places = m.encode(_read(text))
            ids = ids.tolist()
            rows.append((len(ids), hexed(" ".join(map(named.__getitem__, ids))), hexed(m.decode(ids)), int(places[-1] - places[0])))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True))], DIGESTS.replace(" long", "").replace(" string", "").split(", "))


def digests(docs: DataFrame, raw: bytes) -> DataFrame:
    """doc_id, n_tokens and SHA-256 digests of the decimal ids and of the decoded text; covered: the bytes that the pieces' spans
    cover. Written to the shared folder (some 100 bytes a row); rows as in encode()."""
    done = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(_digests, raw), DIGESTS)
    with batches_of(docs.sparkSession, PIECE):
        return saved(done, "piece-digests")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), default_model())

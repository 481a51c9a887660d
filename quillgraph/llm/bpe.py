"""Byte-level BPE encoding and decoding (operator 7) with a hierarchical-bitmap rank queue."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, pieces, saved, table

PIECE = 1 << 20  # bytes of text at a time: working memory is some twenty times as large
_SHIFT = 20
_NONE = (1 << _SHIFT) - 1  # the token of a list's end; no vocabulary has so many tokens


class RankQueue:
    """Buckets of list positions, one for each merge rank; three levels of 64-bit words say which buckets hold any."""

    def __init__(self, ranks: int):
        self.buckets: dict[int, list[np.ndarray]] = {}
        self.low = [0] * ((ranks >> 6) + 1)
        self.middle = [0] * ((ranks >> 12) + 1)
        self.top = 0

    def add(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        first = np.flatnonzero(np.concatenate(([True], ranks[1:] != ranks[:-1])))
        ends = [*first[1:].tolist(), len(ranks)]
        for rank, a, b in zip(ranks[first].tolist(), first.tolist(), ends, strict=True):
            if rank in self.buckets:
                self.buckets[rank].append(positions[a:b])
                continue
            self.buckets[rank] = [positions[a:b]]
            word = rank >> 6
            if not self.low[word]:
                group = word >> 6
                self.middle[group] |= 1 << (word & 63)
                self.top |= 1 << group
            self.low[word] |= 1 << (rank & 63)

    def pop(self) -> tuple[int, np.ndarray] | None:
        """The smallest rank that has positions, and all of these in order: find-first-set on each level."""
        if not self.top:
            return None
        group = (self.top & -self.top).bit_length() - 1
        word = (group << 6) + (self.middle[group] & -self.middle[group]).bit_length() - 1
        rank = (word << 6) + (self.low[word] & -self.low[word]).bit_length() - 1
        self.low[word] &= self.low[word] - 1
        if not self.low[word]:
            self.middle[group] &= self.middle[group] - 1
            if not self.middle[group]:
                self.top &= self.top - 1
        found = self.buckets.pop(rank)
        return rank, np.sort(np.concatenate(found)) if len(found) > 1 else np.sort(found[0])


class Bpe:
    """A vocabulary of byte strings by rank, with the pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern)
        self.size = max(ranks.values()) + 1
        self.tokens = [b""] * self.size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left << _SHIFT | right] = rank
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()] or [0], dtype=np.int32)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the token that each pair makes, -1 if none."""
        key = left.astype(np.int64) << _SHIFT | right
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        return np.where(self.keys[at] == key, self.merged[at], -1) if len(self.keys) else np.full(len(key), -1)

    def _merge(self, words: list[bytes], singly: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Merge many pre-tokens at once as separate linked lists over one array of bytes.

        All valid positions of the lowest rank merge together, as one by one from the left they would, unless a pair of lower
        rank comes up in between: such pre-tokens are reported, to be merged again singly (one merge of each at a time).
        Returns the ids, their number in each pre-token, and the indexes of reported pre-tokens."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        n = int(sizes.sum())
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        token = np.append(self.of_byte[np.frombuffer(b"".join(words), dtype=np.uint8)], np.int32(_NONE))
        after = np.arange(1, n + 2, dtype=np.int32)
        after[ends - 1] = n
        before = np.arange(-1, n, dtype=np.int32)
        before[ends - sizes] = n
        rank_at = np.append(self.pair_ranks(token[:n], token[after[:n]]), -1).astype(np.int32)
        queue, suspects = RankQueue(self.size), []
        start = np.flatnonzero(rank_at >= 0).astype(np.int32)
        if len(start):
            queue.add(rank_at[start], start)
        while (item := queue.pop()) is not None:
            rank, at = item
            at = at[rank_at[at] == rank]  # stale entries are skipped
            if not len(at):
                continue
            if len(at) > 1:
                if singly:
                    first = np.concatenate(([True], owner[at[1:]] != owner[at[:-1]]))
                    if not first.all():
                        queue.add(np.full((~first).sum(), rank), at[~first])
                    at = at[first]
                else:
                    chained = np.concatenate(([False], after[at[:-1]] == at[1:]))
                    if chained.any():  # of overlapping pairs, every second one is taken, from the left
                        index = np.arange(len(at))
                        at = at[(index - np.maximum.accumulate(np.where(chained, 0, index))) % 2 == 0]
                    touching = np.flatnonzero(after[after[at[:-1]]] == at[1:])
                    if len(touching):
                        between = self.pair_ranks(np.full(len(touching), rank), token[at[touching + 1]])
                        suspects.append(owner[at[touching[(between >= 0) & (between < rank)]]])
            gone = after[at]
            rest = after[gone]
            token[at] = rank
            token[gone] = -1
            rank_at[gone] = -1
            after[at] = rest
            before[rest] = at
            left = before[at]
            other = left != n
            other[1:] &= left[1:] != at[:-1]
            fresh = np.concatenate((at, left[other]))
            ranks = self.pair_ranks(token[fresh], token[after[fresh]])
            rank_at[fresh] = ranks
            if not singly and len(at) > 1 and (lower := (ranks >= 0) & (ranks < rank)).any():
                suspects.append(owner[fresh[lower]])
            if (made := ranks >= 0).any():
                queue.add(ranks[made], fresh[made])
        alive = token[:n] >= 0
        counts = np.bincount(owner[alive], minlength=len(words))
        return token[:n][alive], counts, np.unique(np.concatenate(suspects)) if suspects else np.empty(0, dtype=np.int32)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens, one after another, and how many each has."""
        whole = [self.ranks.get(w, -1) for w in words]
        parts = [i for i, r in enumerate(whole) if r < 0]
        counts = np.ones(len(words), dtype=np.int64)
        if not parts:
            return np.array(whole, dtype=np.int32), counts
        ids, number, again = self._merge([words[i] for i in parts], singly=False)
        if len(again):
            exact, exact_n, _ = self._merge([words[parts[i]] for i in again], singly=True)
            pieces_, redo = np.split(ids, np.cumsum(number)[:-1]), np.split(exact, np.cumsum(exact_n)[:-1])
            for i, new in zip(again.tolist(), redo, strict=True):
                pieces_[i] = new
            ids, number = np.concatenate(pieces_), np.fromiter(map(len, pieces_), dtype=np.int64, count=len(pieces_))
        counts[parts] = number
        out = np.empty(int(counts.sum()), dtype=np.int32)
        single = np.array(whole, dtype=np.int32)
        is_single = np.repeat(single >= 0, counts)
        out[is_single] = single[single >= 0]
        out[~is_single] = ids
        return out, counts

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. Equal pre-tokens of the call are merged once."""

        class Index(dict):
            def __missing__(self, key):
                self[key] = n = len(self)
                return n

        index = Index()
        used = [np.fromiter(map(index.__getitem__, self.split.findall(t)), dtype=np.int32) for t in texts]
        if not index:
            return [np.empty(0, dtype=np.uint32) for _ in texts]
        ids, counts = self.encode_words([w.encode() for w in index])
        start = np.cumsum(counts) - counts
        out = []
        for words in used:
            n = counts[words]
            place = np.repeat(start[words] - (np.cumsum(n) - n), n)
            out.append(ids[place + np.arange(len(place))].astype("<u4"))
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def vocabulary(raw: bytes, pattern: str) -> Bpe:
    """From the lines of a rank file: a base64 token, a space, its rank."""
    return Bpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}, pattern)


def _encode(raw: bytes, pattern: str, with_text: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bpe = vocabulary(raw, pattern)
    for part, texts in pieces(batches, "text", PIECE):
        ids = bpe.encode([t.decode(errors="replace") for t in texts])
        columns = [part.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())]
        if with_text:
            columns.append(pa.array([bpe.decode(x) for x in ids], pa.binary()))
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "decoded"][: len(columns)])


def _decode(raw: bytes, pattern: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bpe = vocabulary(raw, pattern)
    for part, ids in pieces(batches, "ids", PIECE):
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([bpe.decode(np.frombuffer(x, dtype="<u4")) for x in ids], pa.binary())], ["doc_id", "decoded"])


def default_vocabulary() -> tuple[bytes, str]:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def encode(docs: DataFrame, raw: bytes, pattern: str, decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (binary: little-endian unsigned 32-bit), and with `decoded` the bytes that these ids stand for.

    docs has doc_id and text; other columns are ignored. raw is a rank file's content. Every row of docs gives one row, repeated
    rows too; a null text counts as an empty one (no tokens); a null doc_id stays null; an empty table gives no rows. Bytes of a text
    that are no UTF-8 are read as U+FFFD, as Python decodes them with errors="replace", and decode to it. Each task takes about 1 MB
    of text at a time and no text is cut. No shuffle: a lost executor's tasks run again elsewhere."""
    schema = "doc_id long, n_tokens long, ids binary" + ", decoded binary" * decoded
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(_encode, raw, pattern, decoded), schema)


def decode(encoded: DataFrame, raw: bytes, pattern: str) -> DataFrame:
    """doc_id, decoded (binary) for rows of doc_id, ids; null ids decode to no bytes."""
    return encoded.select("doc_id", "ids").mapInArrow(partial(_decode, raw, pattern), "doc_id long, decoded binary")


def digests(docs: DataFrame, raw: bytes, pattern: str) -> DataFrame:
    """doc_id, n_tokens and SHA-256 digests of the ids and of the decoded bytes, written to the shared folder (some 100 bytes a row)."""
    done = encode(docs, raw, pattern, decoded=True)
    with batches_of(docs.sparkSession, PIECE):
        return saved(done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")), "digests")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), *default_vocabulary())

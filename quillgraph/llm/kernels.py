"""Vectorised hashing of words, shingles and n-grams over the bytes of many texts at once (numpy, inside tasks)."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)  # odd, so that its powers have inverses modulo 2**64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BLOCK = 1 << 18  # bytes of text hashed at a time: working arrays are some fifty times as large


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit over the output."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers."""
    return mix(np.arange(1, n + 1, dtype=_U) * _BASE + _U(seed)) | _U(1)


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, dtype=_U)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def _block_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    ends_of_texts = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
    inside = ~_SPACE[raw]
    edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.cumsum((_LOWER[raw].astype(_U) + _U(1)) * _powers(int(_BASE), len(raw)))
    before = np.where(first > 0, total[first - 1], _U(0))
    hashes = mix((total[last - 1] - before) * _powers(pow(int(_BASE), -1, 1 << 64), len(raw))[first] ^ (last - first).astype(_U))
    return hashes, np.searchsorted(first, ends_of_texts)


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs without ASCII white space, A-Z lower-cased) of the texts, and where each text's words begin.

    Returns (hashes, bounds): text i has hashes[bounds[i]:bounds[i + 1]]. Texts are hashed in blocks of about _BLOCK bytes."""
    hashes, bounds, start, size, n = [np.empty(0, dtype=_U)], [np.zeros(1, dtype=np.int64)], 0, 0, 0
    for i, text in enumerate(texts):
        size += len(text) + 1
        if size >= _BLOCK or i == len(texts) - 1:
            h, b = _block_words(texts[start : i + 1])
            hashes.append(h)
            bounds.append(b + n)
            n, start, size = n + len(h), i + 1, 0
    return np.concatenate(hashes), np.concatenate(bounds)


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash for each run of `width` consecutive words; the last width - 1 places have none."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, dtype=_U)
    out = np.zeros(n, dtype=_U)
    for j, c in enumerate(constants(width, 17)):
        out += hashes[j : j + n] * c
    return mix(out)


def shingle_sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text. With fewer words than width, the whole sequence is the one shingle."""
    hashes, bounds = words(texts)
    runs, out = windows(hashes, width), []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(runs[a : b - width + 1]))
        else:
            short = hashes[a:b]
            out.append(mix((short * constants(width, 29)[: b - a]).sum(keepdims=True, dtype=_U) + _U(b - a)) if b > a else short)
    return out


def min_hashes(sets: list[np.ndarray], k: int) -> np.ndarray:
    """len(sets) x k smallest values under k multiplicative permutations; sets must not be empty."""
    factor, shift = constants(k, 41)[:, None], constants(k, 43)[:, None]
    out = np.empty((len(sets), k), dtype=_U)
    for i, s in enumerate(sets):
        low = None
        for at in range(0, len(s), 512):  # so that the products stay in a core's cache
            part = ((s[at : at + 512] ^ shift) * factor).min(axis=1)
            low = part if low is None else np.minimum(low, part)
        out[i] = low
    return out

"""Keyword matching by an Aho-Corasick automaton: one pass over a text, however many keywords a profile has.

The keywords of a profile are configuration (its size is the profile's, not the data's): they travel with the task, and each Python
worker builds the automaton once. Texts reach it in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

LINES_PER_FILE = 3


@lru_cache(maxsize=8)
def automaton(words: tuple[str, ...]) -> ahocorasick.Automaton | None:
    """Of distinct words, each with its place in the list; empty words are left out. None if there are none."""
    built = ahocorasick.Automaton()
    for i, word in enumerate(words):
        if word:
            built.add_word(word, i)
    if not len(built):
        return None
    built.make_automaton()
    return built


def index(keyed: Iterable[tuple[str, Sequence[str]]]) -> tuple[tuple[str, ...], tuple[tuple[int, ...], ...]]:
    """(key, words) pairs as the distinct words, and for each word the places of the keys that list it (once for each listing)."""
    owners: dict[str, list[int]] = {}
    for place, (_, words) in enumerate(keyed):
        for word in words:
            owners.setdefault(word, []).append(place)
    return tuple(owners), tuple(map(tuple, owners.values()))


@lru_cache(maxsize=1)
def _folding() -> tuple[re.Pattern[str], dict[int, str]]:
    """Characters that lower() does not fold one to one to what stands for all cases of a letter, and what each character folds to."""
    table, odd = {}, "\u03a3"  # a capital sigma is lowered by what follows it
    for i in range(0x1E944):  # beyond the last letter with two cases
        c = chr(i)
        one = next((f for f in (c.casefold(), c.lower()) if len(f) == 1), c)
        if one != c:
            table[i] = one
        if one != c.lower():
            odd += c
    return re.compile(f"[{odd}]"), table


def folded(text: str) -> str:
    """The text with one case for every letter, character by character, as a regular expression without case compares them."""
    if text.isascii():
        return text.lower()
    odd, table = _folding()
    return text.translate(table) if odd.search(text) else text.lower()


def _scores(keys: tuple[str, ...], words: tuple[str, ...], owners: tuple[tuple[int, ...], ...], heads: pa.Array, texts: pa.Array) -> pa.Array:
    found, everywhere = automaton(words), [owners[i] for i, w in enumerate(words) if not w]
    out = []
    for head, text in zip(heads.to_pylist(), texts.to_pylist(), strict=True):
        points: dict[int, int] = {}
        if found is not None:
            points.update((i, 1) for _, i in found.iter(text or ""))
            points.update((i, 3) for _, i in found.iter(head or ""))
        totals: dict[int, int] = {}
        for i, n in points.items():
            for owner in owners[i]:
                totals[owner] = totals.get(owner, 0) + n
        for all_ in everywhere:  # an empty keyword is in every title
            for owner in all_:
                totals[owner] = totals.get(owner, 0) + (1 if head is None else 3)
        out.append([{"minus": -n, "key": keys[owner]} for owner, n in sorted(totals.items())])
    return pa.array(out, pa.list_(pa.struct([("minus", pa.int32()), ("key", pa.string())])))


def scores(head: Column, text: Column, keyed: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """array<struct<minus, key>>: for each key with a hit, minus the sum over its words of 3 if the head holds the word, else 1 if the
    text does. Words are compared as they are: lower both sides before. A null head or text holds nothing."""
    words, owners = index(keyed)
    keys = tuple(k for k, _ in keyed)

    def found(heads: pa.Array, texts: pa.Array) -> pa.Array:
        return _scores(keys, words, owners, heads, texts)

    return F.arrow_udf(found, "array<struct<minus:int,key:string>>")(head, text)


def _lines(places: dict[str, frozenset[int]], keys: tuple[str, ...], words: tuple[str, ...], owners: tuple[tuple[int, ...], ...], limit: int, groups: pa.Array, texts: pa.Array) -> pa.Array:
    found, out = automaton(words), []
    for group, text in zip(groups.to_pylist(), texts.to_pylist(), strict=True):
        wanted, hits = places.get(group, frozenset()), {}
        if found is not None and wanted and text:
            flat = text.replace("\r\n", "\n")
            low = folded(flat)  # as long as flat
            begin, end, number = 0, low.find("\n"), 1
            full = 0
            for last, i in found.iter(low):
                while 0 <= end < last:
                    begin, end, number = end + 1, low.find("\n", end + 1), number + 1
                for owner in owners[i]:
                    if owner in wanted:
                        of = hits.setdefault(owner, [])
                        if len(of) < limit and (not of or of[-1] != number):
                            if not of:
                                hits[owner, "line"] = flat[begin : end if end >= 0 else None]
                            of.append(number)
                            full += len(of) == limit
                if full == len(wanted):
                    break
        out.append([{"topic": keys[o], "score": len(n), "line_number": n[0], "line": hits[o, "line"]} for o, n in sorted((o, n) for o, n in hits.items() if isinstance(o, int))])
    return pa.array(out, pa.list_(pa.struct([("topic", pa.string()), ("score", pa.int32()), ("line_number", pa.int32()), ("line", pa.string())])))


def lines(group: Column, text: Column, keyed: Sequence[tuple[str, Sequence[str], Sequence[str]]], limit: int = LINES_PER_FILE) -> Column:
    """array<struct<topic, score, line_number, line>>: for each (key, words, groups) whose groups hold the row's group and of whose
    words the text has any (letters in either case): how many lines have one (`limit` at most, where reading stops), and the first of
    them."""
    lowered = [(k, [folded(w) for w in words]) for k, words, _ in keyed]
    words, owners = index(lowered)
    places: dict[str, set[int]] = {}
    for place, (_, _, groups) in enumerate(keyed):
        for g in groups:
            places.setdefault(g, set()).add(place)
    fixed = {g: frozenset(p) for g, p in places.items()}
    keys = tuple(k for k, *_ in keyed)

    def found(groups: pa.Array, texts: pa.Array) -> pa.Array:
        return _lines(fixed, keys, words, owners, limit, groups, texts)

    return F.arrow_udf(found, "array<struct<topic:string,score:int,line_number:int,line:string>>")(group, text)

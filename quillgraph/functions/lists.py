"""Lists of lines: order-preserving dedup and the signals of a note."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T
from .let import let
from .urls import URL, strip_trailing


def unique_lines(x: Column, limit: int) -> Column:
    """The first line of each dedupe key (lines without one are left out), normalised, at most `limit`; one pass over the lines, which
    keys no further line once the limit is reached."""
    none = F.struct(F.array().cast("array<string>").alias("keys"), F.array().cast("array<string>").alias("lines"))

    def add(s: Column, line: Column) -> Column:
        new = lambda key: F.when((key != "") & ~F.array_contains(s["keys"], key), F.struct(F.array_append(s["keys"], key).alias("keys"), F.array_append(s["lines"], T.normalize(line)).alias("lines"))).otherwise(s)
        return F.when(F.size(s["keys"]) < limit, let(T.dedupe_key(line), new)).otherwise(s)

    return F.aggregate(x, none, add)["lines"]


def headings(x: Column) -> Column:
    return unique_lines(F.regexp_extract_all(x, F.lit(T.HEADING), F.lit(1)), 12)


def _body(x: Column) -> Column:
    flat = F.transform(T.lines(x), T.normalize)
    return F.filter(flat, lambda s: ~T.is_noise(s) & (s != "---") & ~F.startswith(s, F.lit("#")))


def _bullets(body: Column) -> Column:
    found = F.transform(F.filter(body, lambda s: F.startswith(s, F.lit("- "))), lambda s: T.normalize(F.substring(s, 3, 1 << 30)))
    return unique_lines(F.filter(found, lambda s: F.length(s) > 8), 12)


def _paragraphs(body: Column) -> Column:
    return unique_lines(F.filter(body, lambda s: ~F.startswith(s, F.lit("- ")) & (F.length(s) > 30)), 8)


def bullets(x: Column) -> Column:
    return _bullets(_body(x))


def paragraphs(x: Column) -> Column:
    return _paragraphs(_body(x))


def signals(x: Column) -> Column:
    """struct(headings, bullets, paragraphs, urls, article_refs) of a note's text; its lines are cut and judged once."""
    said = let(_body(x), lambda body: F.struct(_bullets(body).alias("bullets"), _paragraphs(body).alias("paragraphs")))
    return let(said, lambda s: F.struct(headings(x).alias("headings"), s["bullets"].alias("bullets"), s["paragraphs"].alias("paragraphs"), urls(x).alias("urls"), article_refs(x).alias("article_refs")))


def urls(x: Column, limit: int = 15) -> Column:
    found = F.transform(F.regexp_extract_all(x, F.lit(URL), F.lit(0)), strip_trailing)
    return F.slice(F.array_sort(F.array_distinct(found)), 1, limit)


def article_refs(x: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(x, F.lit(T.ARTICLE), F.lit(1))))


def search_keywords(title: Column, heads: Column, points: Column, paras: Column, topics: Column) -> Column:
    """What to search code for: the title, then headings, bullets, paragraph starts and topic words, 16 at most."""
    phrases = F.concat(F.array(title), F.slice(heads, 1, 6), F.slice(points, 1, 4), F.transform(F.slice(paras, 1, 2), lambda p: F.left(p, F.lit(80))), topics)
    return unique_lines(F.filter(phrases, lambda p: F.length(T.normalize(p)) > 2), 16)

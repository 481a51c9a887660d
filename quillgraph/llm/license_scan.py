"""License scans (operator 6): a positional index of rare licence words. Native: DataFrame and SQL functions only."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.let import let
from .common import saved, table
from .license_texts import TEMPLATES

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RARE = 8  # of a file's words that a template holds, so many of highest IDF are looked up
SUPPORT = 0.6  # share of these, by IDF, that must stand at one relative position
REST = 0.5  # what is looked up counts as no less than this share of the template's own rarest words, so that few words prove nothing
SLACK = 8  # the relative position may vary by one word in so many of the template: names and years stand between
# Phrases and labels of the contract.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def templates() -> list[tuple[str, list[str]]]:
    """Label and words of every template."""
    return [(label, [w for w in re.split(SEPARATORS, text.lower()) if w]) for label, (texts, _) in TEMPLATES.items() for text in texts]


def width(words: list[str]) -> int:
    return 1 + len(words) // SLACK


def weights(counts: dict[str, int], total: int) -> dict[str, float]:
    """The IDF of every word of the templates among `total` texts that mention no licence, of which counts[word] hold it."""
    return {w: math.log((total + 2) / (counts.get(w, 0) + 1)) for _, words in templates() for w in words}


def ranked(idf: dict[str, float]) -> list[list[str]]:
    """The distinct words of each template, rarest first: by IDF, then by the number of templates that hold them, then by letters."""
    shared = Counter(w for _, words in templates() for w in set(words))
    return [sorted(set(words), key=lambda w: (-idf[w], shared[w], w)) for _, words in templates()]


def _phrase(phrase: str) -> str:
    return r"(?:^|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])" + SEPARATORS.join(phrase.split()) + r"(?:$|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])"


def _starts(phrase: str, words: Column, found: Column) -> Column:
    first, *rest = phrase.split()

    def whole(h: Column) -> Column:
        ok = h["word"] == first
        for i, w in enumerate(rest, 1):
            ok = ok & (F.get(words, h["at"] + i) == w)
        return ok

    return F.transform(F.filter(found, whole), lambda h: F.struct(h["at"].alias("at"), F.lit(BASE[phrase]).alias("label")))


def _split(docs: DataFrame) -> DataFrame:
    """doc_id, text, words: lower() folds all letters, but what it makes of letters beyond ASCII is no licence word, once the Kelvin
    sign is out of the way, which it makes a k; so in all that follows only A-Z count as folded."""
    text = F.lower(F.replace(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("\u212a"), F.lit("\ufffd")))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.split(text, SEPARATORS).alias("words"))


def _said(phrases: Iterable[str]) -> Column:
    """Whether one of the phrases stands in `text`; texts without its longest word are not searched."""
    return reduce(or_, (F.contains("text", F.lit(max(p.split(), key=len))) & F.col("text").rlike(_phrase(p)) for p in phrases))


def findings(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """One pass over the texts: words counted, base places, labels whose key phrase occurs (proven); of rows with one, the places of all
    licence words (found) and which these are (held), of other rows only which they hold."""
    words, lead = F.col("words"), (F.col("words")[0] == "").cast("int")
    n = F.greatest(F.size(words) - lead - (F.element_at(words, -1) == "").cast("int"), F.lit(0))
    proven = F.array_compact(F.array(*(F.when(_said(keys), F.lit(label)) for label, (_, keys) in TEMPLATES.items())))
    told = _split(docs).select("doc_id", "words", n.cast("long").alias("n_words"), lead.alias("lead"), proven.alias("proven"), _said(BASE).alias("based"))

    def places(of: list[str]) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get(F.col("words"), i).isin(of))
        return F.transform(at, lambda i: F.struct(i.alias("at"), F.get(F.col("words"), i).alias("word")))

    starts = places(sorted({p.split()[0] for p in BASE}))
    base = F.when(F.col("based"), let(starts, lambda found: F.concat(*(_starts(p, F.col("words"), found) for p in BASE))))
    held = F.array_distinct(F.filter("words", lambda w: w.isin(vocabulary)))
    return told.select("doc_id", "n_words", "lead", "proven", base.alias("base"), held.alias("held"), F.when(F.size("proven") > 0, places(vocabulary)).alias("found"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of docs (doc_id, text).

    base_labels come from places where the words of a phrase of BASE stand consecutively. The method adds a label of TEMPLATES where
    a mandatory key phrase occurs and the file's own words fit a template of the label: of the template's words that the file holds,
    the RARE of highest IDF are looked up in the template's postings, and at least SUPPORT of them (by IDF) must stand at one relative
    position, within a word in SLACK of the template. IDF counts all rows that mention no licence, so that a label depends neither on
    what else the file holds nor on how many licences the corpus has. score: 1 with a base place, else the best share.

    A null text counts as an empty one: no words, no labels (empty strings), null first_word and last_word, score 0. Rows with
    null doc_ids and repeated rows are returned like any other, ties among labels are all kept. An empty table gives no rows. Columns
    other than doc_id and text are ignored. No text is cut."""
    spark = docs.sparkSession
    vocabulary = sorted({w for _, words in templates() for w in words})
    rows = saved(findings(docs, vocabulary).withColumn("row", F.monotonically_increasing_id()), "licence-words")
    others = rows.where(F.size("proven") == 0)
    counts = dict(others.select(F.explode("held").alias("word")).groupBy("word").count().collect())  # a row for each word of the templates
    idf = weights(counts, others.count())
    rarest = ranked(idf)
    of_word = F.create_map(*(F.lit(v) for kv in idf.items() for v in kv))
    most = [sum(idf[w] for w in words[:RARE]) for words in rarest]

    def own(t: int, words: list[str]) -> Column:
        looked_up = F.slice(F.array_intersect(F.array(*map(F.lit, words)), F.col("held")), 1, RARE)
        return F.struct(F.lit(t).alias("template"), looked_up.alias("words"))

    asked = F.array_compact(F.array(*(F.when(F.array_contains("proven", label), own(t, rarest[t])) for t, (label, _) in enumerate(templates()))))
    each = rows.where(F.size("proven") > 0).select("row", "found", F.explode(asked).alias("asked")).select("row", "found", "asked.template", "asked.words")
    whole = F.aggregate("words", F.lit(0.0), lambda total, w: total + F.element_at(of_word, w))
    places = each.select("row", "template", whole.alias("whole"), F.explode(F.filter("found", lambda h: F.array_contains(F.col("words"), h["word"]))).alias("hit")).select("row", "template", "whole", "hit.at", "hit.word")
    index = [(t, w, i, idf[w], REST * most[t], width(words), label) for t, (label, words) in enumerate(templates()) for i, w in enumerate(words)]
    index = F.broadcast(spark.createDataFrame(index, "template int, word string, place int, idf double, least double, width int, label string"))  # fixed size
    offset, w = F.col("at") - F.col("place"), F.col("width")
    grids = F.explode(F.array(F.floor(offset / w) * 2, F.floor((offset + F.floor(w / 2)) / w) * 2 + 1))  # two grids, so that no border parts what is near
    aligned = places.join(index, ["template", "word"]).select("row", "label", "template", F.greatest("whole", "least").alias("whole"), "word", "idf", grids.alias("offset")).distinct()
    best = aligned.groupBy("row", "label", "template", "offset").agg((F.sum("idf") / F.first("whole")).alias("share")).where(F.col("share") >= SUPPORT - 1e-9)
    method = best.groupBy("row").agg(F.collect_set("label").alias("added"), F.max("share").alias("share"))
    all_rows = rows.select("row", "doc_id", "n_words", "lead", F.coalesce("base", F.expr("cast(array() as array<struct<at:int,label:string>>)")).alias("base")).join(method, "row", "left")
    labels = F.array_distinct(F.col("base.label"))
    added = F.coalesce("added", F.expr("cast(array() as array<string>)"))
    first, last = (F.when(F.size("base") > 0, (f("base.at") - F.col("lead")).cast("long")) for f in (F.array_min, F.array_max))
    score = F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.least(F.coalesce("share", F.lit(0.0)), F.lit(1.0)))
    return all_rows.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), first.alias("first_word"), last.alias("last_word"), F.array_join(F.array_sort(labels), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(labels, added)), ",").alias("labels"), score.alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))

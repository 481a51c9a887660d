"""Notes and topics of a keyword profile: scores, top topics, rollups, related notes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keywords
from ..functions.let import let

DEFAULT = "platform-core"
KEPT = 3
RELATED = 16


@dataclass(frozen=True)
class Topic:
    key: str
    title: str
    keywords: tuple[str, ...]
    repos: tuple[str, ...] = field(default=())


def scores(title: Column, text: Column, hints: Column, profile: list[Topic]) -> Column:
    """array<struct<minus, key>> of topics with a score: 3 for a keyword in the title, else 1 for one in title, text or hints.

    The keywords of all topics are one automaton, so a text is read once, whatever the size of the profile."""
    keyed = [(t.key, [w.lower() for w in t.keywords]) for t in profile]
    return keywords.scores(F.lower(title), F.lower(F.concat_ws("\n", title, text, hints)), keyed)


def classify(notes: DataFrame, profile: list[Topic]) -> DataFrame:
    """notes (note_id, title, body, path) with `topics`: the three best by score, then key; DEFAULT if none scores."""
    found = F.slice(F.array_sort(scores(F.col("title"), F.col("body"), F.col("path"), profile)), 1, KEPT)["key"]
    return notes.withColumn("topics", let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(F.array(F.lit(DEFAULT)))))


def repos_of(topics: Column, profile: list[Topic]) -> Column:
    """The repositories of a list of topics, in order, each once, 20 at most; a topic that the profile lacks has none."""
    by_key = F.create_map(*(v for t in profile for v in (F.lit(t.key), F.array(*map(F.lit, t.repos)).cast("array<string>"))))
    return F.slice(F.array_distinct(F.flatten(F.transform(topics, lambda k: F.coalesce(F.try_element_at(by_key, k), F.array().cast("array<string>"))))), 1, 20)


def by_topic(notes: DataFrame, *keep: str) -> DataFrame:
    """topic and some columns of notes, a row for each of a note's topics. An inner explode() would have Catalyst filter on the size of
    the list below, and so read every text twice."""
    return notes.select(*keep, F.explode_outer("topics").alias("topic")).where("topic IS NOT NULL")


def rollup(notes: DataFrame, kind: str = "kind") -> DataFrame:
    """Notes per topic, by kind of note."""
    return by_topic(notes, kind).groupBy("topic", kind).agg(F.count("*").alias("n_notes"))


def rollup_lists(notes: DataFrame, limit: int = 25) -> DataFrame:
    """topic, kind, n_notes, more, first: notes of each topic by kind, how many beyond the limit, and the first stems in order.

    notes (note_id, stem, topics, kind). Stems are ranked with the limit below the shuffle before any are gathered."""
    each = by_topic(notes, "kind", "stem", "note_id")
    first = each.withColumn("rank", F.row_number().over(Window.partitionBy("topic", "kind").orderBy("stem", "note_id"))).where(F.col("rank") <= limit)
    first = first.groupBy("topic", "kind").agg(F.array_sort(F.collect_list(F.struct("rank", "stem")))["stem"].alias("first"))
    counted = each.groupBy("topic", "kind").agg(F.count("*").alias("n_notes"))
    return counted.join(first, ["topic", "kind"]).select("topic", "kind", "n_notes", F.greatest(F.col("n_notes") - limit, F.lit(0)).alias("more"), "first")


def topic_links(notes: DataFrame, records: DataFrame) -> DataFrame:
    """topic, status, n: links of the notes of each topic, by the status of the inventory. notes (topics, urls), records (url, status).

    A URL counts once for each note and topic; pairs are counted by (topic, url) before they meet the inventory."""
    each = by_topic(notes, "note_id", "urls").select("topic", F.explode("urls").alias("url"))
    counted = each.groupBy("topic", "url").agg(F.count("*").alias("n"))
    return counted.join(records.select("url", "status"), "url").groupBy("topic", "status").agg(F.sum("n").alias("n"))


def of_topics(notes: DataFrame, lists: DataFrame, names: list[str]) -> DataFrame:
    """notes (topics: KEPT at most) with the lists of their topics, one after another. lists (topic, and arrays named in `names`) has
    a row for each topic of the profile at most, so it is broadcast: no note is shuffled."""
    out, kinds = notes, {f.name: f.dataType for f in lists.schema}
    for i in range(KEPT):
        side = lists.select(F.col("topic").alias(f"_topic{i}"), *(F.col(n).alias(f"_{n}{i}") for n in names))
        out = out.join(F.broadcast(side), F.get(F.col("topics"), F.lit(i)) == F.col(f"_topic{i}"), "left")
    whole = [F.concat(*(F.coalesce(f"_{n}{i}", F.array().cast(kinds[n])) for i in range(KEPT))).alias(n) for n in names]
    return out.select(*(c for c in notes.columns if c not in names), *whole)


def related(notes: DataFrame, refs: DataFrame | None = None, kinds: tuple[str, ...] = ("support", "wiki"), limit: int = RELATED) -> DataFrame:
    """note_id, kind and related_<kind> for each kind: the first `limit` other notes of that kind on the note's topics, best topic
    first, each once; notes of its own kind that it refers to (refs: note_id, refs as an array of ids) come before.

    Each topic offers its first limit + 1 notes of a kind, which is enough for any note: these are ranked with the limit below the
    shuffle, gathered into one list per topic and broadcast, so that no pair of notes is ever a row."""
    each = by_topic(notes, "note_id", "kind")
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("topic", "kind").orderBy("note_id"))).where(F.col("rank") <= limit + 1)
    offered = ranked.groupBy("topic").agg(*(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("note_id")))).alias(k) for k in kinds))
    asked = notes.select("note_id", F.col("kind").alias("own_kind"), "topics")
    asked = asked.withColumn("refs", F.array().cast("array<long>")) if refs is None else asked.join(refs, "note_id", "left")
    found = of_topics(asked, offered, list(kinds))
    none = F.array().cast("array<long>")
    lists = {k: F.concat(F.when(F.col("own_kind") == k, F.coalesce("refs", none)).otherwise(none), F.col(k)) for k in kinds}
    shown = [F.slice(F.filter(F.array_distinct(x), lambda o: o != F.col("note_id")), 1, limit).alias(f"related_{k}") for k, x in lists.items()]
    return found.select("note_id", F.col("own_kind").alias("kind"), *shown)

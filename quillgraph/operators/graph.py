"""The graph of notes: resolved wikilinks, degrees, orphans, duplicate stems, missing fields, saved views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import frontmatter
from ..functions import text as T
from .lookup import lookup

WIKILINK = r"\[\[([^\]|#]+)(?:#[^\]|]+)?(?:\|[^\]]+)?\]\]"
# What the frontmatter of each type of note must hold.
REQUIRED = {
    "intelligence-summary": ["type", "entity", "category", "status", "last_updated"],
    "node": ["type", "node_type", "title"],
    "playbook": ["type", "entity", "date"],
    **{t: ["type", "area", "status"] for t in ("area", "problem", "initiative", "decision", "experiment", "metric", "insight")},
}


def edges(notes: DataFrame) -> DataFrame:
    """src (a path), target: every wikilink of notes (path, body)."""
    return notes.select(F.col("path").alias("src"), F.explode(F.regexp_extract_all("body", F.lit(WIKILINK), F.lit(1))).alias("raw")).select("src", T.link_target(F.col("raw")).alias("target"))


def nodes(notes: DataFrame) -> DataFrame:
    """path, rel (without .md), stem, type ('' if missing), fields (name -> values)."""
    fields = frontmatter.parse(F.col("body"))
    named = notes.select("path", F.regexp_replace("path", r"\.md$", "").alias("rel"), fields.alias("fields"))
    return named.select("path", "rel", F.element_at(F.split("rel", "/"), -1).alias("stem"), field("type").alias("type"), "fields")


def resolve(links: DataFrame, known: DataFrame) -> DataFrame:
    """links with `dst`: the note at that relative path, else the note of that stem if only one has it, else null. Targets that many
    notes link to are spread (see lookup(), which reads links twice)."""
    by_path = known.select(F.col("rel").alias("target"), F.col("path").alias("at_path"))
    by_stem = known.groupBy("stem").agg(F.count("*").alias("n"), F.min("path").alias("at_stem")).where("n = 1").select(F.col("stem").alias("target"), "at_stem")
    return lookup(links, by_path.join(by_stem, "target", "full"), "target").select("src", "target", F.coalesce("at_path", "at_stem").alias("dst"))


def degrees(known: DataFrame, resolved: DataFrame) -> DataFrame:
    """path, n_in (resolved links to it), n_out (all links from it)."""
    into = resolved.where("dst IS NOT NULL").groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("n_in"))
    out = resolved.groupBy(F.col("src").alias("path")).agg(F.count("*").alias("n_out"))
    zero = F.lit(0).cast("long")
    return known.select("path").join(into, "path", "left").join(out, "path", "left").select("path", F.coalesce("n_in", zero).alias("n_in"), F.coalesce("n_out", zero).alias("n_out"))


def orphans(degree: DataFrame) -> DataFrame:
    return degree.where("n_in = 0 AND n_out = 0").select("path")


def duplicate_stems(known: DataFrame) -> DataFrame:
    return known.groupBy("stem").agg(F.count("*").alias("n")).where("n > 1")


def missing_fields(known: DataFrame, templates: str = "Templates/") -> DataFrame:
    """path, type, missing: required fields that are absent or empty; notes below the templates folder are exempt."""

    def lacking(names: list[str]) -> Column:
        return F.filter(F.array(*map(F.lit, names)), lambda f: field(f) == "")

    chain = None
    for kind, names in REQUIRED.items():
        of = F.col("type") == kind
        chain = F.when(of, lacking(names)) if chain is None else chain.when(of, lacking(names))
    return known.where(~F.startswith("path", F.lit(templates))).select("path", "type", chain.alias("missing")).where("size(missing) > 0")


def field(name: str | Column) -> Column:
    """A frontmatter field of nodes() as one line, '' if it is missing or has no values."""
    return F.coalesce(F.array_join(F.try_element_at(F.col("fields"), F.lit(name) if isinstance(name, str) else name), ", "), F.lit(""))


def view(known: DataFrame, kind: str, statuses: list[str] | None = None, without: list[str] | None = None, columns: tuple[str, ...] = ("status", "area")) -> DataFrame:
    """A saved view: notes of a type, with or without some statuses, and some of their fields."""
    rows = known.where(F.col("type") == kind)
    rows = rows.where(field("status").isin(statuses)) if statuses else rows
    rows = rows.where(~field("status").isin(without)) if without else rows
    return rows.select("path", "stem", *(field(c).alias(c) for c in columns))


def tagged(known: DataFrame, tag: str) -> DataFrame:
    """Notes whose tags (a list, or words in one line) hold the tag."""
    return known.where(F.array_contains(tags(), tag))


def tags() -> Column:
    """The tags of a note, in lower case, each once."""
    return F.array_remove(F.array_distinct(F.split(F.lower(F.regexp_replace(field("tags"), r"[\[\]#,]+", " ")), r"\s+")), "")


def below(known: DataFrame, prefix: str) -> DataFrame:
    """Notes in a folder or under it."""
    return known.where(F.startswith("path", F.lit(prefix.rstrip("/") + "/")))


#: Saved views: name -> (type, fields that are shown); the inbox goes by tag.
SAVED = {
    "Areas": ("area", ("status", "metric", "confidence")),
    "Experiments": ("experiment", ("area", "status", "metric")),
    "Metrics": ("metric", ("area", "status")),
    "Research Signals": ("insight", ("area", "confidence")),
    "Entities": ("intelligence-summary", ("entity", "category", "status", "last_updated")),
    "Hub Nodes": ("node", ("node_type", "title", "entity_count")),
}


def saved_views(known: DataFrame) -> DataFrame:
    """view, path, shown: the rows of all views of SAVED and of the inbox, each with its fields in order, in one pass over the notes."""
    own = F.array(*(F.when(F.col("type") == kind, F.struct(F.lit(name).alias("view"), F.array(*map(field, columns)).alias("shown"))) for name, (kind, columns) in SAVED.items()))
    typed = known.select("path", F.explode(F.array_compact(own)).alias("v")).select("v.view", "path", "v.shown")
    return typed.unionByName(tagged(known, "inbox").select(F.lit("Inbox").alias("view"), "path", F.array("type", field("status")).alias("shown")))

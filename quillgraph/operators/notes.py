"""Notes: conflicts, rewritten links, names seen in author contexts, section listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lists, privacy, urls
from ..functions import text as T
from ..functions.let import let
from ..sources import sinks
from ..sources.shared import saved
from .lookup import lookup

LINK = r"\[[^\]]+\]\([^)]+\)|(?i:\bArticle\s+\d{4,6}\b)"
# Capitalised phrases that are no names, and words that tell of an author.
NOT_NAMES = [
    "Full Article Content", "Full Wiki Content", "Platform Core", "Feature Overview", "Frequently Asked Questions", "How It Works", "Welcome Email", "Challenge Digest",
    "Best Practices", "Notify Product", "Community Components", "Open Signup", "Challenge Notification Email", "Inactive Members Email", "Authentication Flow", "First Name",
    "Last Name", "Privacy Policy", "Setup Instructions", "Click Save", "Message Notification Email", "Forgot Password Email", "Advocacy Insights", "Support To Code Map",
]
AUTHOR_TERMS = "posted|comments|author"
NAME_LINE = r"^\s*(?:- |## )([A-Z][a-z]+(?: [A-Z][a-z]+){1,2})\s*$"
NAME_START = r"(?:^|\n)[^\S\n]*(?:- |## )[A-Z][a-z]+ [A-Z][a-z]"  # every text with such a line has this; others are not cut into lines


def conflicts(text: Column, n_stale: Column, n_blocked: Column, n_drive: Column, n_repos: Column, n_hits: Column) -> Column:
    """Kinds of conflict of a note, in order: stale links, links that can't be captured, repositories without a code hit, and a
    mention of a legacy host where no stale link says so already."""
    return F.array_compact(F.array(
        F.when(n_stale > 0, F.lit("documentation-drift")),
        F.when((n_blocked > 0) | (n_drive > 0), F.lit("restricted-source")),
        F.when((n_repos > 0) & (n_hits == 0), F.lit("code-traceability-gap")),
        F.when(F.contains(F.lower(text), F.lit("gitlab")) & (n_stale == 0), F.lit("documentation-drift")),
    ))


def link_counts(links: DataFrame, records: DataFrame) -> DataFrame:
    """note_id, n_links, n_stale, n_blocked, n_drive: links (note_id, url) of each note by their status in the inventory (url, status).
    A URL that many notes cite is spread (see lookup(), which reads links twice)."""
    found = lookup(links.distinct(), records.select("url", "status"), "url", how="inner")
    by = {"n_stale": "stale-doc-reference", "n_blocked": "blocked", "n_drive": "needs-google-drive"}
    return found.groupBy("note_id").agg(F.count("*").alias("n_links"), *(F.count_if(F.col("status") == status).alias(n) for n, status in by.items()))


def with_conflicts(notes: DataFrame, links: DataFrame, records: DataFrame, hits: DataFrame) -> DataFrame:
    """notes (note_id, body, repos) with n_links, n_stale, n_hits and conflicts, from the inventory and from the code hits (note_id)."""
    counted = hits.groupBy("note_id").agg(F.count("*").alias("n_hits"))
    full = notes.join(link_counts(links, records), "note_id", "left").join(counted, "note_id", "left").na.fill(0, ["n_links", "n_stale", "n_blocked", "n_drive", "n_hits"])
    kinds = conflicts(F.col("body"), F.col("n_stale"), F.col("n_blocked"), F.col("n_drive"), F.size("repos"), F.col("n_hits"))
    return full.select("note_id", "n_links", "n_stale", "n_hits", kinds.alias("conflicts"))


def rendered(notes: DataFrame, near: DataFrame, hits: DataFrame, found: DataFrame) -> DataFrame:
    """note_id, body: whole notes from structured rows.

    notes (note_id, kind, section, title, body, topics), near (note_id, related_support, related_wiki: arrays of ids), hits (note_id,
    repo, path, place; few a note), found (note_id, conflicts). All meet by note_id; each note is one row expression."""
    code = hits.groupBy("note_id").agg(F.array_sort(F.collect_list(F.struct("place", F.concat_ws(":", "repo", "path").alias("at"))))["at"].alias("code"))
    full = notes.withColumn("said", lists.signals(F.col("body"))).join(near.drop("kind"), "note_id", "left").join(code, "note_id", "left").join(found.select("note_id", "conflicts"), "note_id", "left")
    linked = lambda ids: F.transform(ids, lambda i: F.concat(F.lit("[[note-"), i.cast("string"), F.lit("]]")))
    none = F.array().cast("array<string>")
    sections = [
        ("Summary", F.slice("said.paragraphs", 1, 1), "Nothing is said."), ("Key sections", F.slice("said.headings", 1, 8), "None."), ("Key evidence", F.slice("said.bullets", 1, 10), "None."),
        ("Related support notes", linked(F.col("related_support")), "None."), ("Related wiki notes", linked(F.col("related_wiki")), "None."), ("Topics", F.col("topics"), "None."),
        ("Source code", F.coalesce("code", none), "No code was found."), ("Conflicts", F.coalesce("conflicts", none), "None."),
    ]
    fields = {"type": F.lit("concept"), "source": F.col("kind"), "section": F.col("section"), "topics": F.array_join("topics", " ")}
    whole = sinks.render_note(T.display_title(F.col("title")), fields, sections, T.imported_markdown(F.col("body")))
    return full.select("note_id", whole.alias("body"))


def _author_names(x: Column) -> Column:
    """Of a text: two or three capitalised words alone on a list or heading line, with an author term within three lines."""

    def of(lines: Column) -> Column:
        near = lambda at: F.lower(F.array_join(F.slice(lines, F.greatest(at - 2, F.lit(1)), F.least(at + 4, F.lit(7))), " "))
        return F.transform(lines, lambda line, at: F.when(line.rlike(NAME_LINE) & near(at).rlike(AUTHOR_TERMS), F.regexp_extract(line, NAME_LINE, 1)))

    return F.when(x.rlike(NAME_START), F.array_compact(let(T.lines(x), of)))


def _counted(names: DataFrame, least: int) -> DataFrame:
    """names (names: a list for each text) to name, n."""
    # explode would have Catalyst filter on the size of the list below it, and so search every text twice
    each = names.select(F.explode_outer("names").alias("name")).where("name IS NOT NULL").where(~F.col("name").isin(NOT_NAMES))
    return each.groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def person_names(texts: DataFrame, least: int = 2) -> DataFrame:
    """name, n: two or three capitalised words alone on a list or heading line, with an author term within three lines, seen
    `least` times or more. The neighbourhood is a slice of the row's own lines: no shuffle but the final count."""
    return _counted(texts.select(_author_names(F.col("text")).alias("names")), least)


def redacted(texts: DataFrame, least: int = 2) -> DataFrame:
    """texts (…, text) with credentials, addresses and the names of person_names() removed, however many names there are.

    Each text is read once: what it masks to, its capitalised phrases and its author lines lie in the shared folder. The phrases meet
    the names in a join; what returns to a text, by its MD5, are the few that it holds."""
    masked = texts.withColumn("_people", _author_names(F.col("text"))).withColumn("text", privacy.redact(F.col("text")))
    masked = saved(masked.withColumn("_key", F.md5("text")).withColumn("_said", privacy.phrases(F.col("text"))), "masked-texts")
    names = _counted(masked.select(F.col("_people").alias("names")), least)
    said = masked.select("_key", F.explode("_said").alias("name"))
    held = said.join(names.select("name"), "name").groupBy("_key").agg(F.collect_set("name").alias("_names"))
    both = masked.drop("_people", "_said").join(held.hint("merge"), "_key", "left")  # in the order of keys, whatever the size
    text = F.when(F.col("_names").isNull(), F.col("text")).otherwise(privacy.redact_names(F.col("text"), F.col("_names")))
    return both.withColumn("text", text).select(*texts.columns)


def wikified(notes: DataFrame, articles: DataFrame, pages: DataFrame) -> DataFrame:
    """notes (note_id, path, body) with markdown links and article mentions turned into wikilinks where the target is known.

    articles: article_id, stem; pages: path, stem. Matches are exploded, looked up by two equi-joins (article first, then page) and
    put back in place. Matches lie in the shared folder while they are looked up; popular targets, and matches that name none, are
    spread over all tasks. Notes meet their matches by note, and keep their text once."""
    body = T.imported_markdown(F.col("body"))
    cut = notes.select("note_id", "path", F.split(body, LINK).alias("gaps"), F.regexp_extract_all(body, F.lit(LINK), F.lit(0)).alias("found"))
    # posexplode would have Catalyst filter on the size of the list below it, and so read every text twice
    each = cut.select("note_id", "path", F.posexplode_outer("found").alias("at", "match")).where("match IS NOT NULL")
    label = T.normalize(F.regexp_extract("match", r"^\[([^\]]+)\]", 1))
    target = F.trim(F.regexp_extract("match", r"\]\(([^)]+)\)$", 1))
    each = each.select("note_id", "at", "match", label.alias("label"), F.coalesce(urls.article_id(target), F.nullif(F.regexp_extract("match", T.ARTICLE, 1), F.lit(""))).alias("article_id"), T.wiki_target(target, F.col("path")).alias("page"))
    each = saved(each, "wikilinks")
    by_article = articles.select("article_id", F.col("stem").alias("article_stem"))
    by_page = pages.select(F.col("path").alias("page"), F.col("stem").alias("page_stem"))
    known = lookup(lookup(each, by_article, "article_id"), by_page, "page")
    stem = F.coalesce("article_stem", "page_stem")
    name = F.coalesce(F.nullif(F.col("label"), F.lit("")), F.concat(F.lit("Article "), F.col("article_id")), F.col("page_stem"))
    shown = known.select("note_id", "at", F.when(stem.isNotNull(), F.concat(F.lit("[["), stem, F.lit("|"), name, F.lit("]]"))).otherwise(F.col("match")).alias("shown"))
    put = shown.groupBy("note_id").agg(F.array_sort(F.collect_list(F.struct("at", "shown")))["shown"].alias("shown"))
    whole = F.array_join(F.transform(F.arrays_zip("gaps", F.coalesce("shown", F.array().cast("array<string>")).alias("shown")), lambda e: F.concat(e["gaps"], F.coalesce(e["shown"], F.lit("")))), "")
    return cut.select("note_id", "gaps").join(put, "note_id", "left").select("note_id", whole.alias("body"))


def listing(notes: DataFrame, by: str, limit: int) -> DataFrame:
    """by, n, more, first: how many notes a section has, how many beyond the limit, and the first titles in order."""
    ranked = notes.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy("title", "note_id"))).where(F.col("rank") <= limit)
    first = ranked.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("rank", "title")))["title"].alias("first"))
    return notes.groupBy(by).agg(F.count("*").alias("n")).join(first, by).select(by, "n", F.greatest(F.col("n") - limit, F.lit(0)).alias("more"), "first")

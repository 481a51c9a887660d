"""Notes of articles, wiki pages, code files and repositories: whole pages out of structured rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import code as C
from ..functions import lists
from ..functions import stems as St
from ..functions import text as T
from ..functions import urls as U
from ..sources import sinks
from . import code_search as Cs
from .lookup import lookup

GAP = "\n\n"


def bullets(title: str, lines: Column, otherwise: str | None = None) -> Column:
    """A heading and a list; where that is empty the sentence `otherwise`, or nothing at all (null)."""
    shown = F.concat(F.lit(f"## {title}{GAP}- "), F.array_join(lines, "\n- "))
    return F.when(F.size(lines) > 0, shown).otherwise(None if otherwise is None else f"## {title}{GAP}- {otherwise}")


def ticked(names: Column, otherwise: str = "(none found)") -> Column:
    """Names in back quotes, in one line."""
    return F.when(F.size(names) > 0, F.concat(F.lit("`"), F.array_join(names, "`, `"), F.lit("`"))).otherwise(otherwise)


def linked(names: Column, prefix: str = "") -> Column:
    return F.transform(names, lambda n: F.concat(F.lit(f"[[{prefix}"), n.cast("string"), F.lit("]]")))


def page(fields: dict[str, Column], tags: list[Column], title: Column, blocks: list[Column], related: list[str]) -> Column:
    """A note: frontmatter with a list of tags, the title, blocks (those that are null are left out), and where to go on."""
    listed = F.concat_ws("\n", *(F.concat(F.lit("  - "), sinks.scalar(t)) for t in tags))
    head = F.concat(F.regexp_replace(sinks.frontmatter(**fields), r"\n---$", ""), F.lit("\ntags:\n"), listed, F.lit("\n---"))
    onward = [F.lit(f"## Related notes{GAP}" + "\n".join(f"- [[{r}]]" for r in related))] if related else []
    return F.concat_ws(GAP, head, F.concat(F.lit("# "), title), *blocks, *onward)


def code_notes(refs: DataFrame, files: DataFrame, stale_hosts: list[str], limit: int = 30) -> DataFrame:
    """repo, path, body: a note for every file that is referred to.

    refs is code_search.registry() (a few rows for each topic, so it is broadcast), files has file_id, repo, path, body; of several
    files with one path the first by file_id is described. Only the files that are referred to are analysed and shuffled."""
    wanted = files.join(F.broadcast(refs.select("repo", "path")), ["repo", "path"], "left_semi").groupBy("repo", "path").agg(F.min_by("body", "file_id").alias("text"))
    full = wanted.join(F.broadcast(refs), ["repo", "path"]).withColumn("a", C.analysis(F.col("text"), F.col("path"), F.col("sample"), stale_hosts))
    a = F.col("a")
    names = [F.when(F.size(a[k]) > 0, F.concat(F.lit(f"- {label}: "), ticked(a[k]))) for k, label in (("classes", "Classes"), ("functions", "Functions"), ("types", "Types"))]
    some = F.size(a["classes"]) + F.size(a["functions"]) + F.size(a["types"]) > 0
    summary = F.concat_ws("\n", F.concat(F.lit("## Summary\n\n- Language: `"), a["language"], F.lit("`")), F.concat(F.lit("- Kind: "), a["artifact_kind"]), *names, F.when(~some, "- Nothing is named."))
    facts = F.concat(F.lit("- Repository: [["), St.repo(F.col("repo")), F.lit("]]\n- Path: `"), "path", F.lit("`\n- First line: `"), F.coalesce(F.col("line_number").cast("string"), F.lit("n/a")), F.lit("`"))
    relevance = F.concat(F.lit("## Relevance\n\n- Support notes: `"), F.col("n_support").cast("string"), F.lit("`\n- Wiki notes: `"), F.col("n_wiki").cast("string"), F.lit("`\n- Topics: `"), F.col("n_topic").cast("string"), F.lit("`"))
    match = F.when(F.coalesce("sample", F.lit("")) != "", F.concat(F.lit("## Representative match\n\n`"), "sample", F.lit("`")))
    blocks = [
        facts, summary, bullets("Intentions", a["intentions"]), match, relevance, bullets("Implementation", a["implementation"]), bullets("Risks", a["risks"], "None was seen."), bullets("Conflicts", a["conflicts"], "None was seen."),
        bullets("Topics", linked(F.slice("topics", 1, 20))), bullets("Support notes", linked(F.slice("support", 1, limit), "note-")), bullets("Wiki notes", linked(F.slice("wiki", 1, limit), "note-")),
    ]
    fields = {"type": F.lit("concept"), "source": F.lit("code-search"), "repo": F.col("repo"), "language": a["language"], "risk_count": F.size(a["risks"]), "conflict_count": F.size(a["conflicts"])}
    body = page(fields, [F.lit("code-reference"), F.col("repo")], F.concat_ws("/", "repo", "path"), blocks, ["Code Reference Index", "Code Intelligence Hub"])
    return full.select("repo", "path", body.alias("body"))


def repo_notes(snapshots: DataFrame, files: DataFrame, topics: DataFrame) -> DataFrame:
    """repo, body: a note for every repository. snapshots is files.repo_snapshot(), files has repo, path; topics has repo, topic (the
    topics that name a repository). Representative files are ranked with the limit below the shuffle."""
    shown = Cs.representative(files.select("repo", "path").distinct()).groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("place", "path")))["path"].alias("shown"))
    named = topics.groupBy("repo").agg(F.array_sort(F.collect_set("topic")).alias("topics"))
    none = F.array().cast("array<string>")
    full = snapshots.join(shown, "repo", "left").join(named, "repo", "left")
    tick = lambda xs, n: F.transform(F.slice(xs, 1, n), lambda x: F.concat(F.lit("`"), x, F.lit("`")))
    structure = F.concat(F.lit("## Structure\n\n- Top-level directories: "), ticked(F.slice("top_dirs", 1, 12)), F.lit("\n- Key files: "), ticked(F.col("key_files")))
    blocks = [
        structure, bullets("Apps", tick(F.col("monorepo_apps"), 20)), bullets("Services", tick(F.col("monorepo_services"), 25)), bullets("Representative files", tick(F.coalesce("shown", none), 14)),
        bullets("Topics", F.when(F.size(F.coalesce("topics", none)) > 0, linked(F.col("topics"), "Capability - ")).otherwise(F.array(F.lit("[[Product Capability Map]]")))),
    ]
    fields = {"type": F.lit("concept"), "source": F.lit("repository-scan"), "repo": F.col("repo")}
    return full.select("repo", page(fields, [F.lit("repo")], F.col("repo"), blocks, ["Repo Catalog", "Code Intelligence Hub"]).alias("body"))


def uncaptured_line(record: Column) -> Column:
    """What a note says of a link whose page could not be kept: status, link, and HTTP status and error where there are any."""
    tick = lambda label, x: F.when(x.isNotNull(), F.concat(F.lit(f"{label} `"), F.left(T.normalize(x.cast("string")), F.lit(160)), F.lit("`")))
    details = F.concat_ws("; ", tick("http", record["http_status"]), tick("error", record["error"]))
    return F.concat(F.lit("["), record["status"], F.lit("] ["), record["url"], F.lit("]("), record["url"], F.lit(")"), F.when(details != "", F.concat(F.lit(" | "), details)).otherwise(""))


def link_facts(links: DataFrame, records: DataFrame) -> DataFrame:
    """note_id, found: the records (url, status, domain, http_status, error) of the links of each note (note_id, url), by URL. A note has
    few links of its own (lists.urls() gives 15 at most); a URL that many notes cite is spread in the lookup."""
    each = lookup(links.distinct(), records.select("url", "status", "domain", "http_status", "error"), "url", how="inner")
    return each.groupBy("note_id").agg(F.array_sort(F.collect_list(F.struct("url", "status", "domain", "http_status", "error"))).alias("found"))


def _most_common(names: Column, limit: int) -> Column:
    """- name: `count` of the most frequent names, ties by name."""
    counted = F.transform(F.array_distinct(names), lambda n: F.struct((-F.size(F.filter(names, lambda x: x == n))).alias("minus"), n.alias("name")))
    return F.transform(F.slice(F.array_sort(counted), 1, limit), lambda c: F.concat(c["name"], F.lit(": `"), (-c["minus"]).cast("string"), F.lit("`")))


def source_notes(notes: DataFrame, contents: DataFrame, near: DataFrame, hits: DataFrame, conflicts: DataFrame, links: DataFrame) -> DataFrame:
    """note_id, body: the page of every article and wiki page.

    notes: note_id, kind (support or wiki), section, path, title, body, topics and repos (titles and names, arrays); contents: note_id,
    body (with wikilinks); near: note_id, related_support, related_wiki; hits: note_id, repo, path, place (few a note); conflicts:
    note_id, conflicts; links: link_facts(). All meet by note_id; each page is one row expression over bounded lists and whole texts."""
    none = F.array().cast("array<string>")
    code = hits.groupBy("note_id").agg(F.array_sort(F.collect_list(F.struct("place", St.code_reference(F.col("repo"), F.col("path")).alias("stem"))))["stem"].alias("code"))
    told = notes.withColumn("said", lists.signals(F.col("body"))).drop("body")
    full = told.join(contents.select("note_id", F.col("body").alias("content")), "note_id", "left").join(near.drop("kind"), "note_id", "left").join(code, "note_id", "left").join(conflicts.select("note_id", "conflicts"), "note_id", "left").join(links, "note_id", "left")
    wiki = F.col("kind") == "wiki"
    found = F.coalesce("found", F.expr("cast(array() as array<struct<url:string,status:string,domain:string,http_status:int,error:string>>)"))
    statuses = F.array_join(F.array_sort(_most_common(found["status"], 10)), ", ")
    shut = F.transform(F.filter(found, lambda r: r["status"].isin(U.UNCAPTURED)), uncaptured_line)
    kept = F.transform(F.slice(F.filter(found, lambda r: r["status"] == "mirrored"), 1, 15), lambda r: F.concat(F.lit("["), r["url"], F.lit("]("), r["url"], F.lit(")")))
    facts = F.concat(F.lit("- Path: `"), "path", F.lit("`\n- Linked page statuses: "), F.when(statuses == "", "none").otherwise(statuses))
    content = F.when(F.coalesce("content", F.lit("")) != "", F.concat(F.when(wiki, "## Full Wiki Content\n\n").otherwise("## Full Article Content\n\n"), "content"))
    blocks = [
        facts, F.concat(F.lit(f"## Summary{GAP}"), F.coalesce(F.get("said.paragraphs", F.lit(0)), F.lit("Nothing is said."))), bullets("Key sections", F.slice("said.headings", 1, F.when(wiki, 10).otherwise(8))), bullets("Key evidence", F.slice("said.bullets", 1, 10)),
        bullets("Linked domains", _most_common(found["domain"], 6)), bullets("Related support notes", linked(F.coalesce("related_support", F.array().cast("array<long>")), "note-")), bullets("Related wiki notes", linked(F.coalesce("related_wiki", F.array().cast("array<long>")), "note-")),
        bullets("Related capabilities", linked(F.col("topics"), "Capability - ")), bullets("Source code references", linked(F.coalesce("code", none)), "No code was found."), bullets("Repositories", linked(F.col("repos"), "Repo - ")),
        bullets("Conflicts and mismatches", F.coalesce("conflicts", none), "None was seen."), bullets("Uncaptured evidence", shut), bullets("Linked resources", kept), content,
    ]
    fields = {"type": F.lit("concept"), "source": F.when(wiki, "engineering-wiki").otherwise("support-export"), "section": F.col("section"), "source_path": F.col("path")}
    goes_on = F.when(wiki, "## Related notes\n\n- [[Engineering Wiki Index]]\n- [[Wiki Pages Hub]]").otherwise("## Related notes\n\n- [[Support Article Index]]\n- [[Support Articles Hub]]")
    return full.select("note_id", page(fields, [F.when(wiki, "wiki").otherwise("support")], T.display_title(F.col("title")), [*blocks, goes_on], []).alias("body"))

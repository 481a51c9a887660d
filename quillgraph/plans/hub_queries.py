"""Hub, map, log and index notes of a vault: facts from notes, links and code, and what each note shows of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stems as St
from ..functions import text as T
from ..functions import urls as U
from ..operators import hubs as H
from ..operators.hubs import Block, Hub, Part
from ..operators.lookup import lookup
from ..sources import files
from ..sources.shared import saved
from . import code_queries as C
from . import sqltext as S
from .profile import PROFILE
from .views import derive, with_views

_BLANK = Part("text")
_SECTION = (Part("text", "## {section}"), _BLANK)


def _topic(*parts: Part) -> Block:
    return Block((*_SECTION, Part("text", "- Capability note: [[Capability - {section}]]"), *parts, _BLANK), over="topic")


_COUNTED = (Part("total", "- Support notes: `{n}`", "support"), Part("total", "- Wiki notes: `{n}`", "wiki_topic"), Part("total", "- Code hits: `{n}`", "code"), Part("inline", "- Repositories: {lines}", "topic_repo", limit=20))

#: What each note of the second stage shows, and of the first one's indices.
HUBS = [
    Hub("Support Articles Hub", (Block((*_SECTION, Part("text", "- Capability note: [[Capability - {section}]]"), Part("list", fact="support", limit=40, more="- ... `{n}` more notes in this capability"), _BLANK), over="support"),), ("support", "hub"), related=("Support Article Index", "Product Capability Map", "Intelligence Home")),
    Hub("Wiki Pages Hub", (Block((*_SECTION, Part("list", fact="wiki", limit=200, more="- ... `{n}` more pages"), _BLANK), over="wiki"),), ("wiki", "hub"), related=("Engineering Wiki Index", "Product Capability Map", "Intelligence Home")),
    Hub("Code Intelligence Hub", (Block((Part("text", "## Repository notes"), _BLANK, Part("list", fact="repo", limit=200, more="- ... `{n}` more"), _BLANK, Part("text", "## Capability notes"), _BLANK, Part("list", fact="topic"), _BLANK)),), ("code", "hub"), related=("Code Reference Index", "Repo Catalog", "Conflict Log")),
    Hub("Product Capability Map", (_topic(*_COUNTED),), ("product", "capabilities"), related=("Support Articles Hub", "Wiki Pages Hub", "Code Intelligence Hub")),
    Hub("Support Article Index", (Block((Part("total", "- Support article notes: `{n}`", "article"), _BLANK, Part("text", "## Coverage by capability"), _BLANK, Part("counts", "- [[Capability - {one}]]: `{n}` support notes", "support"), _BLANK)),), ("sources", "support-index"), related=("Support Articles Hub", "Corpus Overview")),
    Hub("Engineering Wiki Index", (Block((Part("total", "- Total wiki note count: `{n}`", "wiki"), _BLANK)), Block((*_SECTION, Part("total", "- Count: `{n}`", "wiki"), Part("list", fact="wiki", limit=25, more="- ... `{n}` more pages"), _BLANK), over="wiki")), ("wiki-index",), related=("Wiki Pages Hub", "Intelligence Home")),
    Hub("Repo Catalog", (Block((Part("total", "- Repository notes: `{n}`", "repo"), _BLANK, Part("list", fact="repo", limit=200, more="- ... `{n}` more"), _BLANK)),), ("engineering", "repo-catalog"), related=("Code Intelligence Hub", "Intelligence Home")),
    Hub("Code Reference Index", (Block((*_SECTION, Part("list", fact="code_ref", limit=80, more="- ... `{n}` more code reference notes"), _BLANK), over="code_ref"),), ("engineering", "code-reference-index"), related=("Code Intelligence Hub", "Repo Catalog")),
    Hub("Support-to-Code Map", (_topic(*_COUNTED),), ("engineering", "traceability"), related=("Product Capability Map", "Conflict Log")),
    Hub("Research Hub", (Block(tuple(Part("text", f"- [[{n}]]") for n in ("Support Articles Hub", "Wiki Pages Hub", "Code Intelligence Hub", "Corpus Overview", "Linked Pages Registry"))),), ("research", "hub")),
    Hub("Source Of Truth", (Block((Part("total", "- Declared repositories: `{n}`", "repo"), Part("total", "- Stale references: `{n}`", "link", "stale-doc-reference"), _BLANK, Part("text", "## Repositories"), _BLANK, Part("list", fact="repo", limit=200), _BLANK, Part("text", "## Notes with most stale references"), _BLANK, Part("counts", "- `{one}`: `{n}` stale references", "stale", limit=12, top=True), _BLANK)),), ("engineering", "source-of-truth"), related=("Repo Catalog", "Blocked Access Registry")),
    Hub("Conflict Log", (Block((Part("text", "## Coverage summary"), _BLANK, *(Part("total", f"- {k}: `{{n}}`", "conflict", k) for k in ("documentation-drift", "restricted-source", "code-traceability-gap")), _BLANK)), Block((*_SECTION, Part("list", fact="conflict", limit=200, more="- ... `{n}` more"), _BLANK), over="conflict")), ("engineering", "conflicts"), kind="knowledge", related=("Source Of Truth", "Blocked Access Registry")),
    Hub("Intelligence Home", (Block((Part("text", "## Coverage snapshot"), _BLANK, Part("total", "- Support notes: `{n}`", "article"), Part("total", "- Wiki notes: `{n}`", "wiki"), Part("total", "- Capability hubs: `{n}`", "topic"), Part("total", "- Repository notes: `{n}`", "repo"), Part("total", "- Stale references: `{n}`", "link", "stale-doc-reference"), _BLANK)),), ("home",), related=("Product Capability Map", "Support Articles Hub", "Wiki Pages Hub", "Conflict Log")),
    Hub("Corpus Overview", (Block((Part("total", "- Articles indexed: `{n}`", "article"), Part("total", "- Wiki pages indexed: `{n}`", "wiki"), Part("total", "- Links discovered: `{n}`", "link"), _BLANK)),), ("corpus",), kind="review", folder="Sources", related=("Support Article Index", "Linked Pages Registry")),
    Hub("Support Article Index", (Block((Part("total", "- Support markdown files: `{n}`", "article"), _BLANK, Part("text", "## Inventory"), _BLANK, Part("list", fact="article", limit=120, more="- ... `{n}` more"), _BLANK)),), ("sources", "support-index"), folder="Sources"),
    Hub("Engineering Wiki Index", (Block((Part("total", "- Total wiki pages indexed: `{n}`", "wiki_page"), _BLANK)), Block((*_SECTION, Part("list", fact="wiki_page", limit=200, more="- ... `{n}` more pages"), _BLANK), over="wiki_page")), ("wiki-index",), folder="Sources"),
    Hub("Linked Pages Registry", (Block((Part("total", "- Unique links: `{n}`", "link"), _BLANK, Part("text", "## Status counts"), _BLANK, Part("counts", "- {one}: `{n}`", "link"), _BLANK, Part("text", "## Top domains"), _BLANK, Part("counts", "- {one}: `{n}`", "domain", limit=30, top=True), _BLANK, Part("text", "## Mirrored samples"), _BLANK, Part("list", fact="link", section="mirrored", limit=80), _BLANK)),), ("links", "traversal"), folder="Sources", related=("Source Of Truth", "Blocked Access Registry")),
    Hub("Blocked Access Registry", (Block((*(x for k in ("auth-gated", "blocked", "likely-auth-gated", "needs-google-drive", "stale-doc-reference") for x in (Part("text", f"## {k}"), _BLANK, Part("total", "- Links: `{n}`", "link", k), Part("list", fact="link", section=k, limit=80, more="- ... `{n}` more"), _BLANK)),)),), ("blockers", "access"), folder="Engineering", related=("Linked Pages Registry",)),
    Hub("Repo Catalog", (Block((Part("total", "- Repositories indexed: `{n}`", "repo"), _BLANK)), Block((*_SECTION, Part("list", fact="snapshot", limit=10), _BLANK), over="snapshot")), ("engineering", "repo-catalog"), folder="Engineering"),
]


#: Notes of topics: hubs whose parts show the topic's own section of a fact.
CAPABILITIES = [
    Hub(t.title, (Block((
        Part("text", "## Coverage snapshot"), _BLANK, Part("total", "- Support notes: `{n}`", "support", t.title), Part("total", "- Wiki notes: `{n}`", "wiki_topic", t.title), Part("total", "- Repo notes: `{n}`", "topic_repo", t.title),
        Part("total", "- Code hits: `{n}`", "code", t.title), Part("counts", "- Links, {one}: `{n}`", f"links of {t.title}"), _BLANK, Part("text", "## Linked domains"), _BLANK, Part("counts", "- {one}: `{n}`", f"domains of {t.title}", limit=8, top=True), _BLANK,
        Part("text", "## Primary repositories"), _BLANK, Part("list", fact="topic_repo", section=t.title), _BLANK, Part("text", "## Representative code paths"), _BLANK, Part("list", fact="code", section=t.title, limit=20), _BLANK,
        Part("text", "## Representative support notes"), _BLANK, Part("list", fact="support", section=t.title, limit=20), _BLANK, Part("text", "## Representative wiki notes"), _BLANK, Part("list", fact="wiki_topic", section=t.title, limit=20), _BLANK,
    )),), ("capability", t.key), kind="area", folder="Capabilities", related=("Product Capability Map", "Support-to-Code Map"))
    for t in PROFILE
]


def _fact(rows: DataFrame, fact: Column | str, section: Column | str, order: Column, line: Column) -> DataFrame:
    return rows.select((F.lit(fact) if isinstance(fact, str) else fact).alias("fact"), (F.lit(section) if isinstance(section, str) else section).alias("section"), order.cast("string").alias("ord"), line.alias("line"))


def facts(spark, sf_dir) -> DataFrame:
    """What the hubs show, as rows; what several facts come from lies in the shared folder."""
    title = T.display_title(F.col("title"))
    stem = F.when(F.col("kind") == "wiki", St.wiki(F.col("path"), title)).otherwise(St.support(F.col("note_id").cast("string"), F.col("path"), title))
    rows, _, links, inventory, found = C.gathered(spark, sf_dir)
    notes = saved(rows.select("note_id", "kind", "section", "path", "topics", title.alias("title"), F.concat(F.lit("[["), stem, F.lit("]]")).alias("link")), "hub-notes")
    inventory = inventory.select("url", "status")
    kept = saved(C.kept(spark, sf_dir).select("topic", "repo", "path"), "hub-code")
    repos = saved(files.repo_snapshot(derive(spark, sf_dir, "files").select("repo", "path")), "hub-repos")
    kinds = found.select("note_id", F.explode("conflicts").alias("kind"))
    titles = F.create_map(*(F.lit(x) for t in PROFILE for x in (t.key, t.title)))
    named = lambda key: F.coalesce(F.try_element_at(titles, key), key)
    number = F.lpad(F.col("note_id").cast("string"), 20, "0")
    by_title = F.concat(F.lower("title"), F.lit(" "), number)
    article, wiki = notes.where("kind = 'support'"), notes.where("kind = 'wiki'")
    shown = F.concat(F.lit("`"), "path", F.lit("`: "), "title")
    topics = spark.createDataFrame([(t.title, f"{i:03}", f"`{r}`") for t in PROFILE for i, r in enumerate(t.repos)], "title string, at string, repo string")
    listed = lambda name, n: F.array_join(F.transform(F.slice(name, 1, n), lambda x: F.concat(F.lit("`"), x, F.lit("`"))), ", ")
    of_topic = lookup(links, inventory, "url", how="inner").join(notes.select("note_id", F.explode("topics").alias("topic")), "note_id")
    every = [
        _fact(article.withColumn("topic", F.explode("topics")), "support", named(F.col("topic")), number, F.col("link")), _fact(article, "article", "", by_title, shown),
        _fact(wiki, "wiki", F.col("section"), by_title, F.col("link")), _fact(wiki, "wiki_page", F.col("section"), by_title, shown), _fact(wiki.withColumn("topic", F.explode("topics")), "wiki_topic", named(F.col("topic")), number, F.col("link")),
        _fact(spark.createDataFrame([(t.title,) for t in PROFILE], "title string"), "topic", F.col("title"), F.col("title"), F.concat(F.lit("[[Capability - "), "title", F.lit("]]"))), _fact(topics, "topic_repo", F.col("title"), F.col("at"), F.col("repo")),
        _fact(repos, "repo", "", F.col("repo"), F.concat(F.lit("[["), St.repo(F.col("repo")), F.lit("]]"))), _fact(repos, "snapshot", F.col("repo"), F.lit("1"), F.concat(F.lit("Key files: "), listed("key_files", 6))), _fact(repos, "snapshot", F.col("repo"), F.lit("2"), F.concat(F.lit("Top-level dirs: "), listed("top_dirs", 12))),
        _fact(kept, "code", named(F.col("topic")), F.col("path"), F.col("path")), _fact(kept.select("repo", "path").distinct(), "code_ref", F.col("repo"), F.col("path"), F.concat(F.lit("[["), St.code_reference(F.col("repo"), F.col("path")), F.lit("]]"))),
        _fact(kinds.join(notes.select("note_id", "link"), "note_id"), "conflict", F.col("kind"), number, F.col("link")),
        _fact(inventory, "link", F.col("status"), F.col("url"), F.col("url")), _fact(inventory, "domain", U.host(F.col("url")), F.col("url"), F.col("url")),
        _fact(links.join(inventory.where("status = 'stale-doc-reference'"), "url"), "stale", F.concat(F.lit("note-"), F.col("note_id").cast("string")), F.col("url"), F.col("url")),
        _fact(of_topic, F.concat(F.lit("links of "), named(F.col("topic"))), F.col("status"), F.col("url"), F.col("url")), _fact(of_topic, F.concat(F.lit("domains of "), named(F.col("topic"))), U.host(F.col("url")), F.col("url"), F.col("url")),
    ]
    whole = every[0]
    for rows in every[1:]:
        whole = whole.unionByName(rows)
    return whole


def _digest(done: DataFrame) -> DataFrame:
    return done.select("hub", F.length("body").cast("long").alias("n_chars"), F.md5("body").alias("body_md5"))


def hub_notes(spark, sf_dir):
    """All hubs, maps, logs and indices of the vault, rendered."""
    return _digest(H.render(facts(spark, sf_dir), HUBS))


def capability_notes(spark, sf_dir):
    """A note for each topic: its articles, pages, repositories, code and links."""
    return _digest(H.render(facts(spark, sf_dir), CAPABILITIES))


QUERIES = {"hub_notes": hub_notes, "capability_notes": capability_notes}


# The same in SQL: one SELECT for each part of each hub, glued together by string_agg.
_TITLES = "CASE topic WHEN 'delivery' THEN 'Delivery' WHEN 'billing' THEN 'Billing' WHEN 'access' THEN 'Access' WHEN 'search' THEN 'Search' WHEN 'platform' THEN 'Platform' WHEN 'legacy' THEN 'Legacy' ELSE topic END"
_SAFE = "coalesce(nullif(rtrim(left(trim(regexp_replace({x}, '[^A-Za-z0-9 ._-]+', '', 'g')), {n}), ' .'), ''), 'Untitled')"
_FILE = "regexp_replace(list_last(string_split(path, '/')), '\\.md$', '')"
_HINT = _SAFE.format(x=f"replace({_FILE}, '-', ' ')", n=48)
_WIKI = f"CASE WHEN {S.key(_HINT)} <> {S.key('d')} THEN concat('Wiki - ', split_part(path, '/', 1), ' - ', d, ' - ', {_HINT}, ' - ', left(sha1(path), 8)) ELSE concat('Wiki - ', split_part(path, '/', 1), ' - ', d, ' - ', left(sha1(path), 8)) END"
_NUMBER = "lpad(note_id::VARCHAR, 20, '0')"
_TICKED = "array_to_string(list_transform({l}, lambda x: concat('`', x, '`')), ', ')"
_FACTS = f"""shown AS (SELECT note_id, kind, section, path, d, concat('[[', CASE WHEN kind = 'wiki' THEN {_SAFE.format(x=_WIKI, n=180)} ELSE {_SAFE.format(x="concat('Support - ', note_id, ' - ', d)", n=120)} END, ']]') AS link FROM (SELECT *, {S.display_title('title')} AS d FROM notes)),
by_topic AS (SELECT s.*, {_TITLES} AS t FROM shown s JOIN top USING (note_id)),
snap AS (SELECT repo, list(DISTINCT path ORDER BY path) FILTER (WHERE path IN ('README.md', 'package.json', 'Gemfile', 'Podfile', 'DockerFile', 'docker-compose.yml')) AS k, list(DISTINCT split_part(path, '/', 1) ORDER BY split_part(path, '/', 1)) FILTER (WHERE contains(path, '/') AND NOT starts_with(path, '.')) AS t FROM files GROUP BY repo),
facts AS (SELECT 'support' AS fact, t AS section, {_NUMBER} AS ord, link AS line FROM by_topic WHERE kind = 'support' UNION ALL SELECT 'wiki_topic', t, {_NUMBER}, link FROM by_topic WHERE kind = 'wiki'
UNION ALL SELECT 'article', '', concat(lower(d), ' ', {_NUMBER}), concat('`', path, '`: ', d) FROM shown WHERE kind = 'support' UNION ALL SELECT 'wiki', section, concat(lower(d), ' ', {_NUMBER}), link FROM shown WHERE kind = 'wiki'
UNION ALL SELECT 'wiki_page', section, concat(lower(d), ' ', {_NUMBER}), concat('`', path, '`: ', d) FROM shown WHERE kind = 'wiki'
UNION ALL SELECT 'topic', n, n, concat('[[Capability - ', n, ']]') FROM (VALUES ('Delivery'), ('Billing'), ('Access'), ('Search'), ('Platform'), ('Legacy')) v(n)
UNION ALL SELECT 'topic_repo', {_TITLES}, lpad(ord::VARCHAR, 3, '0'), concat('`', repo, '`') FROM repos
UNION ALL SELECT 'repo', '', repo, concat('[[Repo - ', repo, ']]') FROM snap UNION ALL SELECT 'snapshot', repo, '1', concat('Key files: ', coalesce({_TICKED.format(l="k[1:6]")}, '')) FROM snap UNION ALL SELECT 'snapshot', repo, '2', concat('Top-level dirs: ', coalesce({_TICKED.format(l="t[1:12]")}, '')) FROM snap
UNION ALL SELECT 'code', {_TITLES}, path, path FROM kept UNION ALL SELECT DISTINCT 'code_ref', repo, path, concat('[[', {_SAFE.format(x="concat('Code Ref - ', repo, ' - ', replace(path, '/', ' -- '))", n=180)}, ']]') FROM kept
UNION ALL SELECT 'conflict', c.kind, {_NUMBER}, link FROM (SELECT note_id, unnest(kinds) AS kind FROM con) c JOIN shown USING (note_id)
UNION ALL SELECT 'link', status, url, url FROM rec UNION ALL SELECT 'domain', {S.host('url')}, url, url FROM rec
UNION ALL SELECT 'stale', concat('note-', note_id), url, url FROM said JOIN rec USING (url) WHERE status = 'stale-doc-reference'
UNION ALL SELECT concat('links of ', t), status, url, url FROM by_topic JOIN said USING (note_id) JOIN rec USING (url) UNION ALL SELECT concat('domains of ', t), {S.host('url')}, url, url FROM by_topic JOIN said USING (note_id) JOIN rec USING (url)),
per_section AS (SELECT fact, section, count(*) AS n FROM facts GROUP BY fact, section), per_fact AS (SELECT fact, count(*) AS n FROM facts GROUP BY fact),
in_section AS (SELECT *, row_number() OVER (PARTITION BY fact, section ORDER BY ord, line) AS k FROM facts), in_fact AS (SELECT *, row_number() OVER (PARTITION BY fact ORDER BY ord, line) AS k FROM facts)"""


def _part_sql(hub: str, b: int, p: int, over: str, most: int, part: Part) -> str:
    """hub, block, section, part, step, line of one part, by the rules of its kind."""
    text, more = S.q(part.text), S.q(part.more)
    if over:
        at, source = "o.section", f"(SELECT section FROM per_section WHERE fact = '{over}' ORDER BY section LIMIT {most}) o"
    else:
        at, source = "''", "(SELECT 1) o"
    head = f"SELECT {S.q(hub)} AS hub, {b} AS b, {at} AS place, {p} AS p"
    own = S.q(part.section) if part.section else ("o.section" if over else None)
    filled = f"replace({text}, '{{section}}', {at})"
    n = f"(SELECT coalesce(max(n), 0) FROM per_section WHERE fact = '{part.fact}' AND section = {own})" if own else f"(SELECT coalesce(max(n), 0) FROM per_fact WHERE fact = '{part.fact}')"
    lines = f"in_section l ON l.fact = '{part.fact}' AND l.section = {own}" if own else f"in_fact l ON l.fact = '{part.fact}'"
    if part.kind == "rest":
        sections = f"(SELECT count(*) FROM per_section WHERE fact = '{part.fact}')"
        return f"SELECT {S.q(hub)} AS hub, {b} AS b, chr(1114111) AS place, {p} AS p, 0 AS step, replace({text}, '{{n}}', ({sections} - {part.limit})::VARCHAR) AS line WHERE {sections} > {part.limit}"
    if part.kind == "text":
        return f"{head}, 0 AS step, {filled} AS line FROM {source}"
    if part.kind == "total":
        return f"{head}, 0, replace({filled}, '{{n}}', {n}::VARCHAR) FROM {source}"
    if part.kind == "inline":
        return f"{head}, 0, replace({filled}, '{{lines}}', o.joined) FROM (SELECT o.section, string_agg(l.line, ', ' ORDER BY l.k) AS joined FROM {source} JOIN {lines} WHERE l.k <= {part.limit} GROUP BY o.section) o"
    if part.kind == "counts":
        order = "n DESC, section" if part.top else "section"
        return f"{head}, k, replace(replace({filled}, '{{n}}', n::VARCHAR), '{{one}}', c.section) FROM {source} JOIN (SELECT *, row_number() OVER (ORDER BY {order}) AS k FROM per_section WHERE fact = '{part.fact}') c ON k <= {part.limit}"
    listed = f"{head}, l.k, concat('- ', l.line) FROM {source} JOIN {lines} WHERE l.k <= {part.limit}"
    return listed + (f" UNION ALL {head}, {part.limit + 1}, replace({more}, '{{n}}', ({n} - {part.limit})::VARCHAR) FROM {source} WHERE {n} > {part.limit}" if part.more else "")


def _sql(hubs: list[Hub]) -> str:
    parts = [_part_sql(hub, b, p, over, most, Part(kind, text, fact, section, lim, more, top)) for hub, b, p, over, most, kind, text, fact, section, lim, more, top in H.specification(hubs)]
    return f"WITH {C.CONFLICT}, {_FACTS}, lines AS ({' UNION ALL '.join(parts)}), body AS (SELECT hub, string_agg(line, chr(10) ORDER BY b, place, p, step) AS body FROM lines GROUP BY hub) SELECT hub, length(body) AS n_chars, md5(body) AS body_md5 FROM body"


ORACLE_SQL = {name: with_views(_sql(hubs), "files", "notes", "known", "note_pages") for name, hubs in (("hub_notes", HUBS), ("capability_notes", CAPABILITIES))}

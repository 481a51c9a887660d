"""Queries over notes: titles, signals, topics, names, links between notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lists as Li
from ..functions import privacy as P
from ..functions import text as T
from ..functions import urls as U
from ..operators import graph as G
from ..operators import links as L
from ..operators import notes as N
from ..operators import topics as To
from ..sources.shared import saved
from ..sources.tables import table
from . import manifest as M
from . import sqltext as S
from .profile import PROFILE
from .views import derive, with_views

STALE_HOSTS = ["wiki.legacy.test.org"]


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, "notes")


def _joined(x, mark="|"):
    return F.array_join(x, mark)


def title_from_text(spark, sf_dir):
    rows = _notes(spark, sf_dir)
    return rows.select("note_id", T.page_title(F.col("body"), F.col("path")).alias("page_title"), T.note_title(F.col("body"), F.col("path")).alias("note_title"))


def display_titles(spark, sf_dir):
    """Titles of file names such as 12-note-en, and of first lines."""
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "")
    return _notes(spark, sf_dir).select("note_id", T.display_title(name).alias("of_name"), T.display_title(F.split_part("body", F.lit("\n"), F.lit(1))).alias("of_line"))


def dedupe_key_groups(spark, sf_dir):
    """Documents whose texts have one dedupe key (ASCII letters and digits only)."""
    keyed = table(spark, sf_dir, "documents").select("doc_id", F.md5(T.dedupe_key(F.col("text"))).alias("key"))
    return keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


def token_set_size(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("n_tokens"))


def token_overlap(spark, sf_dir):
    """For each document and topic, how many of the topic's keywords are tokens of the document."""
    words = sorted({w for t in PROFILE for w in t.keywords})
    shared = F.array_intersect(T.tokens(F.col("text")), F.array(*map(F.lit, words)))
    return table(spark, sf_dir, "documents").select("doc_id", _joined(F.array_sort(shared), ",").alias("shared"), F.size(shared).cast("long").alias("n_shared"))


def imported_markdown(spark, sf_dir):
    return _notes(spark, sf_dir).select("note_id", F.md5(T.imported_markdown(F.col("body"))).alias("body_md5"))


def unique_lines_dedup(spark, sf_dir):
    found = Li.unique_lines(T.lines(F.col("text")), 12)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(found).cast("long").alias("n_lines"), F.md5(_joined(found, "\n")).alias("lines_md5"))


def extract_signals(spark, sf_dir):
    found = _notes(spark, sf_dir).select("note_id", Li.signals(F.col("body")).alias("s")).select("note_id", "s.*")
    return found.select("note_id", *(_joined(F.col(c)).alias(c) for c in ("headings", "bullets")), F.md5(_joined(F.col("paragraphs"))).alias("paragraphs_md5"), *(_joined(F.col(c)).alias(c) for c in ("urls", "article_refs")))


def wiki_targets(spark, sf_dir):
    """Relative links resolved against the folder of the note."""
    rows = _notes(spark, sf_dir).select("note_id", "path", F.concat("note_id", F.lit("-next.md?raw=1#top")).alias("target"))
    return rows.select("note_id", T.wiki_target(F.col("target"), F.col("path")).alias("resolved"), T.link_target(F.concat("path", F.lit("/ "))).alias("link"))


def section_index(spark, sf_dir):
    return N.listing(_notes(spark, sf_dir), "section", 25).select("section", F.col("n").alias("n_notes"), F.col("more").cast("long").alias("more"), F.md5(_joined(F.col("first"))).alias("first_md5"))


def redact_pii(spark, sf_dir):
    return _notes(spark, sf_dir).select("note_id", F.md5(P.redact(F.col("body"))).alias("body_md5"))


def redact_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(P.redact(F.col("text"))).alias("text_md5"), (P.redact(F.col("text")) != F.col("text")).alias("changed"))


def person_names(spark, sf_dir):
    return N.person_names(_notes(spark, sf_dir).select(F.col("body").alias("text")))


def redact_people(spark, sf_dir):
    done = N.redacted(_notes(spark, sf_dir).select("note_id", F.col("body").alias("text")))
    return done.select("note_id", F.md5("text").alias("text_md5"))


def classified(spark, sf_dir):
    return To.classify(_notes(spark, sf_dir), PROFILE)


def capability_scores(spark, sf_dir):
    found = F.explode(To.scores(F.col("title"), F.col("body"), F.col("path"), PROFILE))
    return _notes(spark, sf_dir).select("note_id", found.alias("e")).select("note_id", F.col("e.key").alias("topic"), (-F.col("e.minus")).cast("long").alias("score"))


def capability_top3(spark, sf_dir):
    return classified(spark, sf_dir).select("note_id", F.posexplode_outer("topics").alias("at", "topic")).select("note_id", "topic", (F.col("at") + 1).cast("long").alias("place"))


def capability_rollup_counts(spark, sf_dir):
    return To.rollup(classified(spark, sf_dir))


def note_repos(spark, sf_dir):
    return classified(spark, sf_dir).select("note_id", _joined(To.repos_of(F.col("topics"), PROFILE), ",").alias("repos"))


def repo_topics(spark, sf_dir):
    """Repositories by the notes whose topics name them."""
    each = classified(spark, sf_dir).select("note_id", F.explode_outer(To.repos_of(F.col("topics"), PROFILE)).alias("repo")).where("repo IS NOT NULL")
    return each.groupBy("repo").agg(F.count("*").alias("n_notes"))


def refs(rows: DataFrame) -> DataFrame:
    """note_id, refs: the support notes that support notes mention as articles, in order of the mentions."""
    support = rows.where("kind = 'support'")
    said = support.select("note_id", F.posexplode(F.slice(Li.article_refs(F.col("body")), 1, 20)).alias("at", "article_id"))
    known = support.select((F.col("note_id") + 1000).cast("string").alias("article_id"), F.col("note_id").alias("other_id"))
    return said.join(known, "article_id").groupBy("note_id").agg(F.array_sort(F.collect_list(F.struct("at", "other_id")))["other_id"].alias("refs"))


def related(spark, sf_dir):
    rows = classified(spark, sf_dir)
    return To.related(rows.select("note_id", "kind", "topics"), refs(_notes(spark, sf_dir)))


def related_notes(spark, sf_dir):
    found = related(spark, sf_dir)
    return found.select("note_id", "kind", _joined(F.col("related_support"), ",").alias("related_support"), _joined(F.col("related_wiki"), ",").alias("related_wiki"))


def capability_rollup(spark, sf_dir):
    """The notes of each topic by kind: how many, and the first stems."""
    rows = classified(spark, sf_dir).withColumn("stem", T.display_title(F.col("title")))
    return To.rollup_lists(rows).select("topic", "kind", "n_notes", F.col("more").cast("long").alias("more"), F.md5(_joined(F.col("first"))).alias("first_md5"))


def link_records(spark, sf_dir):
    """(note_id, url) of all notes, and the inventory of these URLs."""
    each = _notes(spark, sf_dir).select("note_id", F.explode(Li.urls(F.col("body"))).alias("url"))
    links = saved(each.withColumn("url", U.clean_url(F.col("url"))).where("url IS NOT NULL").distinct(), "note-links")
    listed = links.select("url", F.col("note_id").cast("string").alias("ref"))
    return links, L.inventory(listed, derive(spark, sf_dir, "known"), derive(spark, sf_dir, "note_pages"), STALE_HOSTS)


def capability_links(spark, sf_dir):
    """Links of the notes of each topic by what became of them."""
    _, records = link_records(spark, sf_dir)
    rows = classified(spark, sf_dir)
    cleaned = F.array_distinct(F.array_compact(F.transform(Li.urls(F.col("body")), U.clean_url)))
    return To.topic_links(rows.select("note_id", "topics", cleaned.alias("urls")), records)


def search_keywords(spark, sf_dir):
    found = _notes(spark, sf_dir).select("note_id", "title", Li.signals(F.col("body")).alias("s"))
    words = Li.search_keywords(F.col("title"), F.col("s.headings"), F.col("s.bullets"), F.col("s.paragraphs"), F.array(F.lit("Delivery"), F.lit("api")))
    kept = found.select("note_id", words.alias("words"))
    return kept.select("note_id", F.md5(_joined(F.col("words"))).alias("keywords_md5"), F.size("words").cast("long").alias("n_keywords"))


def note_stems(spark, sf_dir):
    """Names of notes: of articles by number, of wiki pages by section and a hash of the path."""
    rows = _notes(spark, sf_dir)
    article = T.safe_filename(F.concat(F.lit("Support - "), F.col("note_id").cast("string"), F.lit(" - "), T.display_title(F.col("title"))))
    wiki = T.safe_filename(F.concat(F.lit("Wiki - "), F.split_part("path", F.lit("/"), F.lit(1)), F.lit(" - "), T.display_title(F.col("title")), F.lit(" - "), F.left(F.sha1("path"), F.lit(8))), 180)
    return rows.select("note_id", F.when(F.col("kind") == "wiki", wiki).otherwise(article).alias("stem"))


def contents(rows: DataFrame) -> DataFrame:
    """note_id, body: links to articles and pages as wikilinks: support notes are articles, by number, and wiki notes are pages, by path."""
    articles = rows.where("kind = 'support'").select((F.col("note_id") + 1000).cast("string").alias("article_id"), F.concat(F.lit("Support - "), F.col("note_id") + 1000).alias("stem"))
    pages = rows.where("kind = 'wiki'").select("path", F.concat(F.lit("Wiki - "), "note_id").alias("stem"))
    return N.wikified(rows, articles, pages)


def wikified(spark, sf_dir):
    """The contents of all notes with wikilinks."""
    return contents(_notes(spark, sf_dir)).select("note_id", F.md5("body").alias("body_md5"))


def _graph(spark, sf_dir):
    rows = derive(spark, sf_dir, "graph_notes")
    known = G.nodes(rows).select("path", "rel", "stem").distinct()
    return rows, known, G.resolve(saved(G.edges(rows), "wikilink-edges"), known)


def graph_links(spark, sf_dir):
    _, _, resolved = _graph(spark, sf_dir)
    return resolved.groupBy("src", "target", "dst").agg(F.count("*").alias("n"))


def graph_degrees(spark, sf_dir):
    _, known, resolved = _graph(spark, sf_dir)
    return G.degrees(known, resolved)


def graph_orphans(spark, sf_dir):
    return G.orphans(graph_degrees(spark, sf_dir))


def graph_missing_links(spark, sf_dir):
    _, _, resolved = _graph(spark, sf_dir)
    return resolved.where("dst IS NULL").groupBy("target").agg(F.count("*").alias("n"), F.min("src").alias("first_src"))


def duplicate_stems(spark, sf_dir):
    return G.duplicate_stems(_graph(spark, sf_dir)[1])


def missing_fields(spark, sf_dir):
    known = G.nodes(derive(spark, sf_dir, "graph_notes"))
    return G.missing_fields(known).groupBy("type", _joined(F.col("missing"), ",").alias("missing")).agg(F.count("*").alias("n"))


def note_types(spark, sf_dir):
    return L.counts(G.nodes(derive(spark, sf_dir, "graph_notes")), "type")


def open_problems_view(spark, sf_dir):
    return G.view(G.nodes(derive(spark, sf_dir, "graph_notes")), "problem", without=["resolved"])


def active_bets_view(spark, sf_dir):
    return G.view(G.nodes(derive(spark, sf_dir, "graph_notes")), "initiative", statuses=["active", "proposed"])


def recent_decisions_view(spark, sf_dir):
    return G.view(G.nodes(derive(spark, sf_dir, "graph_notes")), "decision")


def saved_views(spark, sf_dir):
    return G.saved_views(G.nodes(derive(spark, sf_dir, "graph_notes"))).withColumn("shown", _joined(F.col("shown")))


def notes_below(spark, sf_dir):
    """Notes in one folder, by type."""
    return L.counts(G.below(G.nodes(derive(spark, sf_dir, "graph_notes")), "src1"), "type")


def readiness_counts(spark, sf_dir):
    """Readiness of areas, by the statuses of their notes: active is done, proposed is partial, anything else is missing."""
    status = G.field("status")
    said = F.when(status == "active", "done").when(status == "proposed", "partial")
    known = G.nodes(derive(spark, sf_dir, "graph_notes")).select(G.field("area").alias("area"), said.alias("status"))
    return M.readiness(known, "area")


QUERIES = {f.__name__: f for f in (
    title_from_text, display_titles, dedupe_key_groups, token_set_size, token_overlap, imported_markdown, unique_lines_dedup, extract_signals, wiki_targets, section_index, redact_pii,
    redact_documents, person_names, redact_people, capability_scores, capability_top3, capability_rollup_counts, note_repos, repo_topics, related_notes, search_keywords, note_stems, wikified,
    graph_links, graph_degrees, graph_orphans, graph_missing_links, duplicate_stems, missing_fields, note_types, open_problems_view, active_bets_view,
    recent_decisions_view, readiness_counts, capability_rollup, capability_links, saved_views, notes_below,
)}

_H = r"(?m)^[ \t]{0,3}#{1,6}[ \t]+([^\n]*[^\s])[ \t]*$"
_FIRST = f"list_filter(list_transform({S.lines('body')}, lambda v: {S.norm('v')}), lambda v: v <> '')[1]"
_FLAT = f"list_transform({S.lines('body')}, lambda v: {S.norm('v')})"
_BODY = f"list_filter({_FLAT}, lambda s: NOT {S.noise('s')} AND s <> '---' AND NOT starts_with(s, '#'))"
HEADINGS = S.unique(f"regexp_extract_all(body, '{_H}', 1)", 12)
BULLETS = S.unique(f"list_filter(list_transform(list_filter({_BODY}, lambda s: starts_with(s, '- ')), lambda s: {S.norm('substr(s, 3)')}), lambda s: length(s) > 8)", 12)
PARAS = S.unique(f"list_filter({_BODY}, lambda s: NOT starts_with(s, '- ') AND length(s) > 30)", 8)
_URLS = f"list_sort(list_distinct(list_transform(regexp_extract_all(body, 'https?://[^\\s)>\\]\"'']+'), lambda u: {S.strip('u')})))[1:15]"
_LINK = S.q(N.LINK)
_LABEL = "regexp_extract(m, '^\\[([^\\]]+)\\]', 1)"
_TARGET = "trim(regexp_extract(m, '\\]\\(([^)]+)\\)$', 1))"
_BARE = f"string_split(string_split({_TARGET}, '#')[1], '?')[1]"
_REFS = "list_sort(list_distinct(regexp_extract_all(body, '(?i)\\bArticle\\s+(\\d{4,6})\\b', 1)))"
_REDACT = "regexp_replace(regexp_replace(regexp_replace({x}, '(https?://)([^/\\s@]+)@', '\\1[REDACTED_CREDENTIALS]@', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}', '[REDACTED_EMAIL]', 'g'), '\\b(?:10(?:\\.\\d{{1,3}}){{3}}|172\\.(?:1[6-9]|2\\d|3[0-1])(?:\\.\\d{{1,3}}){{2}}|192\\.168(?:\\.\\d{{1,3}}){{2}})\\b', '[REDACTED_PRIVATE_IP]', 'g')"
_NAMES = "name_lines AS (SELECT note_id, regexp_extract(l[i], '^\\s*(?:- |## )([A-Z][a-z]+(?: [A-Z][a-z]+){1,2})\\s*$', 1) AS name, lower(array_to_string(l[greatest(i - 3, 1):i + 3], ' ')) AS near FROM (SELECT note_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT note_id, %s AS l FROM notes))), found AS (SELECT name, count(*) AS n FROM name_lines WHERE name <> '' AND regexp_matches(near, 'posted|comments|author') AND name NOT IN (%s) GROUP BY name HAVING count(*) >= 2)" % (S.lines("body"), ", ".join(S.q(n) for n in N.NOT_NAMES))


def _score(topic: To.Topic) -> str:
    parts = [f"CASE WHEN contains(lower(title), {S.q(w.lower())}) THEN 3 WHEN contains(lower(concat_ws(chr(10), title, body, path)), {S.q(w.lower())}) THEN 1 ELSE 0 END" for w in topic.keywords]
    return f"SELECT note_id, kind, '{topic.key}' AS topic, {' + '.join(parts)} AS score FROM notes"


SCORED = "scored AS (SELECT * FROM (" + " UNION ALL ".join(_score(t) for t in PROFILE) + ") WHERE score > 0)"
TOP = f"{SCORED}, best AS (SELECT note_id, kind, topic, row_number() OVER (PARTITION BY note_id ORDER BY score DESC, topic) AS place FROM scored), top AS (SELECT * FROM best WHERE place <= 3 UNION ALL SELECT note_id, kind, 'platform-core', 1 FROM notes WHERE note_id NOT IN (SELECT note_id FROM scored))"
REPOS = "repos AS (SELECT * FROM (VALUES " + ", ".join(f"('{t.key}', '{r}', {i})" for t in PROFILE for i, r in enumerate(t.repos)) + ") v(topic, repo, ord))"
def _field(name: str) -> str:
    return f"trim(regexp_extract(block, '(?m)^{name}:(.*)$', 1))"


_NODES = r"""fm AS (SELECT path, regexp_replace(path, '\.md$', '') AS rel, regexp_extract(body, '^---\n((?s).*?)\n---\n?', 1) AS block FROM graph_notes),
nodes AS (SELECT path, rel, list_last(string_split(rel, '/')) AS stem, trim(regexp_extract(block, '(?m)^type:(.*)$', 1)) AS type, trim(regexp_extract(block, '(?m)^status:(.*)$', 1)) AS status, trim(regexp_extract(block, '(?m)^area:(.*)$', 1)) AS area, trim(regexp_extract(block, '(?m)^title:(.*)$', 1)) AS title, block FROM fm),
single AS (SELECT DISTINCT path, rel, stem FROM nodes),
raw AS (SELECT path AS src, regexp_replace(rtrim(trim(unnest(regexp_extract_all(body, '\[\[([^\]|#]+)(?:#[^\]|]+)?(?:\|[^\]]+)?\]\]', 1))), '/'), '\.md$', '') AS target FROM graph_notes),
stems AS (SELECT stem, min(path) AS at FROM single GROUP BY stem HAVING count(*) = 1),
edges AS (SELECT r.src, r.target, coalesce(p.path, s.at) AS dst FROM raw r LEFT JOIN single p ON p.rel = r.target LEFT JOIN stems s ON s.stem = r.target)"""
_DEGREES = f"{_NODES}, degrees AS (SELECT n.path, coalesce(i.n, 0) AS n_in, coalesce(o.n, 0) AS n_out FROM single n LEFT JOIN (SELECT dst, count(*) AS n FROM edges WHERE dst IS NOT NULL GROUP BY dst) i ON i.dst = n.path LEFT JOIN (SELECT src, count(*) AS n FROM edges GROUP BY src) o ON o.src = n.path)"
RECORDS = f"""said AS (SELECT DISTINCT note_id, url FROM (SELECT note_id, {S.clean_url('url')} AS url FROM (SELECT note_id, unnest({_URLS}) AS url FROM notes)) WHERE url IS NOT NULL),
ours AS (SELECT DISTINCT {S.known_article('url')} AS k FROM known),
rec AS (SELECT u.url, CASE WHEN {S.known_article('u.url')} IN (SELECT k FROM ours) THEN 'local-support-evidence' WHEN {S.special('u.url')} IN ('needs-google-drive', 'stale-doc-reference') THEN {S.special('u.url')}
  WHEN f.url IS NULL THEN 'blocked' WHEN f.http_status IN (401, 403) THEN 'auth-gated' WHEN f.http_status >= 400 OR f.error IS NOT NULL THEN 'blocked'
  WHEN coalesce(f.body, '') = '' THEN 'binary-or-empty' ELSE 'mirrored' END AS status FROM (SELECT DISTINCT url FROM said) u LEFT JOIN note_pages f ON f.url = u.url)"""


def _lacking(names: tuple[str, ...]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {_field(c)} = '' THEN '{c}' END" for c in names) + "], lambda v: v IS NOT NULL)"


RELATED = f"first_notes AS (SELECT topic, kind, note_id, row_number() OVER (PARTITION BY topic, kind ORDER BY note_id) AS k FROM top), mentions AS (SELECT note_id, unnest({_REFS}[1:20]) AS a, unnest(range(1, len({_REFS}[1:20]) + 1)) AS i FROM notes WHERE kind = 'support'), offers AS (SELECT n.note_id, r.kind AS other_kind, r.note_id AS other, n.place, r.k FROM top n JOIN first_notes r ON r.topic = n.topic AND r.k <= 17 UNION ALL SELECT m.note_id, 'support', o.note_id, 0, m.i FROM mentions m JOIN notes o ON o.kind = 'support' AND (o.note_id + 1000)::VARCHAR = m.a), offered AS (SELECT note_id, other_kind, other, min((place, k)) AS o FROM offers WHERE other <> note_id GROUP BY ALL), placed AS (SELECT *, row_number() OVER (PARTITION BY note_id, other_kind ORDER BY o) AS p FROM offered), lists AS (SELECT note_id, other_kind, string_agg(other::VARCHAR, ',' ORDER BY p) AS l FROM placed WHERE p <= 16 GROUP BY ALL), related AS (SELECT n.note_id, n.kind, coalesce(s.l, '') AS related_support, coalesce(w.l, '') AS related_wiki FROM notes n LEFT JOIN lists s ON s.note_id = n.note_id AND s.other_kind = 'support' LEFT JOIN lists w ON w.note_id = n.note_id AND w.other_kind = 'wiki')"
_LACKS = _lacking(("type", "area", "status"))

WIKIFIED = f"b AS (SELECT note_id, path, {S.imported('body')} AS t FROM notes), c AS (SELECT note_id, regexp_split_to_array(t, {_LINK}) AS g, regexp_extract_all(t, {_LINK}) AS m, path FROM b), e AS (SELECT note_id, path, unnest(m) AS m, unnest(range(1, len(m) + 1)) AS i FROM c), k AS (SELECT note_id, i, m, {S.norm(_LABEL)} AS label, coalesce({S.article_id(_TARGET)}, nullif(regexp_extract(m, '(?i)\\bArticle\\s+(\\d{{4,6}})\\b', 1), '')) AS a, CASE WHEN NOT contains({_TARGET}, '://') AND ends_with({_BARE}, '.md') THEN concat(regexp_extract(path, '^(.*)/[^/]*$', 1), '/', {_BARE}) END AS p FROM e), s AS (SELECT k.note_id, k.i, CASE WHEN coalesce(an.note_id, pn.note_id) IS NULL THEN m ELSE concat('[[', CASE WHEN an.note_id IS NOT NULL THEN concat('Support - ', a) ELSE concat('Wiki - ', pn.note_id) END, '|', coalesce(nullif(label, ''), 'Article ' || a, concat('Wiki - ', pn.note_id)), ']]') END AS shown FROM k LEFT JOIN notes an ON an.kind = 'support' AND (an.note_id + 1000)::VARCHAR = a LEFT JOIN notes pn ON pn.kind = 'wiki' AND pn.path = p), l AS (SELECT note_id, list(shown ORDER BY i) AS s FROM s GROUP BY note_id), wikified AS (SELECT c.note_id, array_to_string(list_transform(range(1, len(g) + 1), lambda j: g[j] || coalesce(l.s[j], '')), '') AS body FROM c LEFT JOIN l USING (note_id))"

ORACLE_SQL = {
    "title_from_text": with_views(f"SELECT note_id, coalesce(nullif({S.norm('''regexp_extract(body, '(?m)^[ \\t]*#[ \\t]+([^\\n]*[^\\s])[ \\t]*$', 1)''')}, ''), left({_FIRST}, 160), path) AS page_title, {S.display_title(f'''coalesce(nullif(regexp_extract(body, '{_H}', 1), ''), {_FIRST}, path)''')} AS note_title FROM notes", "notes"),
    "display_titles": with_views(f"SELECT note_id, {S.display_title('''regexp_replace(list_last(string_split(path, '/')), '\\.md$', '')''')} AS of_name, {S.display_title('split_part(body, chr(10), 1)')} AS of_line FROM notes", "notes"),
    "dedupe_key_groups": f"SELECT md5({S.key('text')}) AS key, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "token_set_size": f"SELECT doc_id, len({S.tokens('text')}) AS n_tokens FROM documents",
    "token_overlap": f"WITH s AS (SELECT doc_id, list_sort(list_intersect({S.tokens('text')}, [{', '.join(S.q(w) for w in sorted({w for t in PROFILE for w in t.keywords}))}])) AS s FROM documents) SELECT doc_id, array_to_string(s, ',') AS shared, len(s) AS n_shared FROM s",
    "imported_markdown": with_views(f"SELECT note_id, md5({S.imported('body')}) AS body_md5 FROM notes", "notes"),
    "unique_lines_dedup": f"WITH u AS (SELECT doc_id, {S.unique(S.lines('text'), 12)} AS u FROM documents) SELECT doc_id, len(u) AS n_lines, md5(array_to_string(u, chr(10))) AS lines_md5 FROM u",
    "extract_signals": with_views(f"SELECT note_id, array_to_string({HEADINGS}, '|') AS headings, array_to_string({BULLETS}, '|') AS bullets, md5(array_to_string({PARAS}, '|')) AS paragraphs_md5, array_to_string({_URLS}, '|') AS urls, array_to_string({_REFS}, '|') AS article_refs FROM notes", "notes"),
    "wiki_targets": with_views("SELECT note_id, concat(regexp_extract(path, '^(.*)/[^/]*$', 1), '/', note_id, '-next.md') AS resolved, regexp_replace(path, '\\.md$', '') AS link FROM notes", "notes"),
    "section_index": with_views("WITH r AS (SELECT section, title, row_number() OVER (PARTITION BY section ORDER BY title, note_id) AS k, count(*) OVER (PARTITION BY section) AS n FROM notes) SELECT section, max(n) AS n_notes, greatest(max(n) - 25, 0) AS more, md5(array_to_string(list(title ORDER BY k) FILTER (WHERE k <= 25), '|')) AS first_md5 FROM r GROUP BY section", "notes"),
    "redact_pii": with_views(f"SELECT note_id, md5({_REDACT.format(x='body')}) AS body_md5 FROM notes", "notes"),
    "redact_documents": f"SELECT doc_id, md5({_REDACT.format(x='text')}) AS text_md5, {_REDACT.format(x='text')} <> text AS changed FROM documents",
    "person_names": with_views(f"WITH {_NAMES} SELECT name, n FROM found", "notes"),
    "redact_people": with_views(f"SELECT note_id, md5(regexp_replace({_REDACT.format(x='body')}, '\\b(Grace Brewster Hopper|Alan Turing Prize|Ada Lovelace|Alan Turing)\\b', '[REDACTED_PERSON]', 'g')) AS text_md5 FROM notes", "notes"),
    "capability_scores": with_views(f"WITH {SCORED} SELECT note_id, topic, score::BIGINT AS score FROM scored", "notes"),
    "capability_top3": with_views(f"WITH {TOP} SELECT note_id, topic, place::BIGINT AS place FROM top", "notes"),
    "capability_rollup_counts": with_views(f"WITH {TOP} SELECT topic, kind, count(*) AS n_notes FROM top GROUP BY topic, kind", "notes"),
    "note_repos": with_views(f"WITH {TOP}, {REPOS} SELECT n.note_id, coalesce(array_to_string(x.r, ','), '') AS repos FROM notes n LEFT JOIN (SELECT note_id, list(repo ORDER BY place, ord) AS r FROM top JOIN repos USING (topic) GROUP BY note_id) x USING (note_id)", "notes"),
    "repo_topics": with_views(f"WITH {TOP}, {REPOS} SELECT repo, count(DISTINCT note_id) AS n_notes FROM top JOIN repos USING (topic) GROUP BY repo", "notes"),
    "related_notes": with_views(f"WITH {TOP}, {RELATED} SELECT note_id, kind, related_support, related_wiki FROM related", "notes"),
    "capability_rollup": with_views(f"WITH {TOP}, r AS (SELECT t.topic, t.kind, {S.display_title('title')} AS stem, row_number() OVER (PARTITION BY t.topic, t.kind ORDER BY {S.display_title('title')}, t.note_id) AS k FROM top t JOIN notes USING (note_id)) SELECT topic, kind, count(*) AS n_notes, greatest(count(*) - 25, 0) AS more, md5(string_agg(stem, '|' ORDER BY k) FILTER (WHERE k <= 25)) AS first_md5 FROM r GROUP BY topic, kind", "notes"),
    "capability_links": with_views(f"WITH {TOP}, {RECORDS} SELECT topic, status, count(*) AS n FROM top JOIN said USING (note_id) JOIN rec USING (url) GROUP BY topic, status", "notes", "known", "note_pages"),
    "search_keywords": with_views(f"WITH s AS (SELECT note_id, title, {HEADINGS} AS h, {BULLETS} AS b, {PARAS} AS p FROM notes), c AS (SELECT note_id, list_filter(list_concat([title], h[1:6], b[1:4], list_transform(p[1:2], lambda v: left(v, 80)), ['Delivery', 'api']), lambda v: length({S.norm('v')}) > 2) AS l FROM s), u AS (SELECT note_id, {S.unique('l', 16)} AS u FROM c) SELECT note_id, md5(array_to_string(u, '|')) AS keywords_md5, len(u) AS n_keywords FROM u", "notes"),
    "note_stems": with_views(f"WITH t AS (SELECT note_id, kind, path, {S.display_title('title')} AS d FROM notes), s AS (SELECT note_id, CASE WHEN kind = 'wiki' THEN 180 ELSE 120 END AS n, CASE WHEN kind = 'wiki' THEN concat('Wiki - ', split_part(path, '/', 1), ' - ', d, ' - ', left(sha1(path), 8)) ELSE concat('Support - ', note_id, ' - ', d) END AS s FROM t) SELECT note_id, coalesce(nullif(rtrim(left(trim(regexp_replace(s, '[^A-Za-z0-9 ._-]+', '', 'g')), n::INT), ' .'), ''), 'Untitled') AS stem FROM s", "notes"),
    "wikified": with_views(f"WITH {WIKIFIED} SELECT note_id, md5(body) AS body_md5 FROM wikified", "notes"),
    "graph_links": with_views(f"WITH {_NODES} SELECT src, target, dst, count(*) AS n FROM edges GROUP BY src, target, dst", "graph_notes"),
    "graph_degrees": with_views(f"WITH {_DEGREES} SELECT * FROM degrees", "graph_notes"),
    "graph_orphans": with_views(f"WITH {_DEGREES} SELECT path FROM degrees WHERE n_in = 0 AND n_out = 0", "graph_notes"),
    "graph_missing_links": with_views(f"WITH {_NODES} SELECT target, count(*) AS n, min(src) AS first_src FROM edges WHERE dst IS NULL GROUP BY target", "graph_notes"),
    "duplicate_stems": with_views(f"WITH {_NODES} SELECT stem, count(*) AS n FROM single GROUP BY stem HAVING count(*) > 1", "graph_notes"),
    "missing_fields": with_views(f"WITH {_NODES}, m AS (SELECT type, CASE WHEN type IN ('area', 'problem', 'initiative', 'decision', 'experiment', 'metric', 'insight') THEN {_LACKS} {' '.join(f"WHEN type = '{kind}' THEN {_lacking(names)}" for kind, names in (('node', ('node_type', 'title')), ('playbook', ('entity', 'date')), ('intelligence-summary', ('entity', 'category', 'status', 'last_updated'))))} ELSE [] END AS l FROM nodes WHERE NOT starts_with(path, 'Templates/')) SELECT type, array_to_string(l, ',') AS missing, count(*) AS n FROM m WHERE len(l) > 0 GROUP BY 1, 2", "graph_notes"),
    "note_types": with_views(f"WITH {_NODES} SELECT type, count(*) AS n FROM nodes GROUP BY type", "graph_notes"),
    "open_problems_view": with_views(f"WITH {_NODES} SELECT path, stem, status, area FROM nodes WHERE type = 'problem' AND status <> 'resolved'", "graph_notes"),
    "active_bets_view": with_views(f"WITH {_NODES} SELECT path, stem, status, area FROM nodes WHERE type = 'initiative' AND status IN ('active', 'proposed')", "graph_notes"),
    "recent_decisions_view": with_views(f"WITH {_NODES} SELECT path, stem, status, area FROM nodes WHERE type = 'decision'", "graph_notes"),
    "readiness_counts": with_views(f"WITH {_NODES} SELECT area, CASE status WHEN 'active' THEN 'done' WHEN 'proposed' THEN 'partial' ELSE 'missing' END AS status, count(*) AS n FROM nodes GROUP BY 1, 2", "graph_notes"),
    "saved_views": with_views(f"WITH {_NODES}, f AS (SELECT *, {', '.join(f'{_field(c)} AS {c}' for c in ('metric', 'confidence', 'entity', 'category', 'last_updated', 'node_type', 'entity_count', 'tags'))} FROM nodes) " + " UNION ALL ".join([*(f"SELECT '{name}' AS \"view\", path, concat_ws('|', {', '.join(columns)}) AS shown FROM f WHERE type = '{kind}'" for name, kind, columns in (
        ("Areas", "area", ("status", "metric", "confidence")), ("Experiments", "experiment", ("area", "status", "metric")), ("Metrics", "metric", ("area", "status")), ("Research Signals", "insight", ("area", "confidence")),
        ("Entities", "intelligence-summary", ("entity", "category", "status", "last_updated")), ("Hub Nodes", "node", ("node_type", "title", "entity_count")),
    )), "SELECT 'Inbox' AS \"view\", path, concat_ws('|', type, status) AS shown FROM f WHERE contains(tags, 'inbox')"]), "graph_notes"),
    "notes_below": with_views(f"WITH {_NODES} SELECT type, count(*) AS n FROM nodes WHERE starts_with(path, 'src1/') GROUP BY type", "graph_notes"),
}

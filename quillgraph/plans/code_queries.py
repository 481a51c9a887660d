"""Queries over code files: static analysis, search, ranking, registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import code as C
from ..functions import text as T
from ..operators import code_search as Cs
from ..operators import links as L
from ..operators import note_pages as Np
from ..operators import notes as N
from ..operators import topics as To
from ..sources import files
from ..sources.shared import saved
from . import note_queries as Q
from . import sqltext as S
from .profile import PROFILE
from .views import derive, with_views

STALE_HOSTS = ["wiki.legacy.test.org"]

def _files(spark, sf_dir):
    return derive(spark, sf_dir, "files")


def language_classify(spark, sf_dir):
    return L.counts(_files(spark, sf_dir).withColumn("language", C.language(F.col("path"))), "language")


def artifact_kind(spark, sf_dir):
    return _files(spark, sf_dir).select("file_id", C.artifact_kind(F.col("path"), F.col("body")).alias("kind"), C.is_code(F.col("path")).alias("is_code"), C.is_ignored(F.col("path")).alias("is_ignored"))


def code_symbols(spark, sf_dir):
    body = F.col("body")
    return _files(spark, sf_dir).select("file_id", *(F.array_join(C.symbols(body, k), ",").alias(k) for k in C.SYMBOLS))


def code_comments(spark, sf_dir):
    return _files(spark, sf_dir).select("file_id", F.array_join(C.leading_comments(F.col("body")), "|").alias("comments"))


def code_risks(spark, sf_dir):
    return _files(spark, sf_dir).select("file_id", F.array_join(C.risks(F.col("body"), F.col("path")), ",").alias("risks"), F.array_join(C.conflicts(F.col("body"), F.col("path"), STALE_HOSTS), ",").alias("conflicts"))


def implementation_signals(spark, sf_dir):
    body = F.col("body")
    return _files(spark, sf_dir).select("file_id", F.array_join(C.signals(body, F.col("path")), ",").alias("signals"), F.array_join(C.systems(body, F.col("path")), ",").alias("systems"), F.array_join(C.path_focus(F.col("path")), ",").alias("focus"))


def identifier_words(spark, sf_dir):
    return _files(spark, sf_dir).select("file_id", T.identifier_words(F.col("path")).alias("words"))


def _hits(spark, sf_dir):
    return Cs.hits(_files(spark, sf_dir), PROFILE)


def code_search(spark, sf_dir):
    return _hits(spark, sf_dir).select("topic", "repo", "path", F.col("score").cast("long").alias("score"), F.col("line_number").cast("long").alias("line_number"), "sample")


def code_hit_top_files(spark, sf_dir):
    return Cs.top(_hits(spark, sf_dir)).select("topic", "repo", "path", F.col("score").cast("long").alias("score"), F.col("rank").cast("long").alias("rank"))


def kept(spark, sf_dir):
    return Cs.prune(Cs.top(_hits(spark, sf_dir), 60))


def code_hit_prune(spark, sf_dir):
    return kept(spark, sf_dir).select("topic", "repo", "path", F.col("place").cast("long").alias("place"))


def note_hits(spark, sf_dir):
    """The code found for each note, by its topics."""
    notes = Q.classified(spark, sf_dir).select("note_id", "kind", "topics", F.array("title", "section").alias("keywords"))
    return Cs.for_notes(notes, kept(spark, sf_dir))


def code_hit_rerank(spark, sf_dir):
    return note_hits(spark, sf_dir).select("note_id", "repo", "path", F.col("points").cast("long").alias("points"), F.col("place").cast("long").alias("place"))


def registry(spark, sf_dir):
    """Files that notes and topics use."""
    return Cs.registry(note_hits(spark, sf_dir), kept(spark, sf_dir))


def code_reference_registry(spark, sf_dir):
    rows = registry(spark, sf_dir)
    return rows.select("repo", "path", F.col("line_number").cast("long").alias("line_number"), "sample", "n_support", "n_wiki", "n_topic", *(F.array_join(c, ",").alias(c) for c in ("support", "wiki", "topics")))


def code_refs_per_repo(spark, sf_dir):
    return L.counts(registry(spark, sf_dir), "repo")


def code_analysis(spark, sf_dir):
    """What there is to say of each file, with the sample line of the files that topics keep."""
    samples = kept(spark, sf_dir).groupBy("repo", "path").agg(F.min_by("sample", F.struct("topic", "place")).alias("sample"))  # KEPT files a topic at most
    files = _files(spark, sf_dir).join(F.broadcast(samples), ["repo", "path"], "left")
    told = files.select("file_id", C.analysis(F.col("body"), F.col("path"), F.col("sample"), STALE_HOSTS).alias("a")).select("file_id", "a.*")
    lists = ("classes", "functions", "types", "comments", "implementation", "intentions", "risks", "conflicts")
    return told.select("file_id", "language", "artifact_kind", *(F.array_join(c, "|").alias(c) for c in lists))


def conflicts(spark, sf_dir):
    rows = Q.classified(spark, sf_dir).select("note_id", "body", To.repos_of(F.col("topics"), PROFILE).alias("repos"))
    return N.with_conflicts(rows, *Q.link_records(spark, sf_dir), note_hits(spark, sf_dir))


def note_conflicts(spark, sf_dir):
    """Conflicts of each note, from the inventory of its links and the code found for it."""
    return conflicts(spark, sf_dir).withColumn("conflicts", F.array_join("conflicts", ","))


def conflict_counts(spark, sf_dir):
    return L.counts(conflicts(spark, sf_dir).select(F.explode("conflicts").alias("kind")), "kind")


def _digests(rows, *keys):
    return rows.select(*keys, F.length("body").cast("long").alias("n_chars"), F.md5("body").alias("body_md5"))


def code_notes(spark, sf_dir):
    """A note for each file that notes and topics refer to."""
    refs = saved(registry(spark, sf_dir), "code-registry")
    return _digests(Np.code_notes(refs, _files(spark, sf_dir), STALE_HOSTS), "repo", "path")


def repo_notes(spark, sf_dir):
    """A note for each repository."""
    listed = saved(_files(spark, sf_dir).select("repo", "path").distinct(), "repo-files")
    topics = spark.createDataFrame([(r, t.title) for t in PROFILE for r in t.repos], "repo string, topic string")
    return _digests(Np.repo_notes(files.repo_snapshot(listed), listed, topics), "repo")


def source_notes(spark, sf_dir):
    """The page of every article and wiki page: what is known of it, and its own text with wikilinks."""
    rows, hits, links, inventory, found = gathered(spark, sf_dir)
    near = To.related(rows.select("note_id", "kind", "topics"), Q.refs(rows))
    records = inventory.withColumn("error", F.lit(None).cast("string"))
    shown = rows.drop("topics").withColumnRenamed("titles", "topics")
    return _digests(Np.source_notes(shown, Q.contents(rows), near, hits, found, Np.link_facts(links, records)), "note_id")


def representative_files(spark, sf_dir):
    return Cs.representative(_files(spark, sf_dir).select("repo", "path").distinct()).select("repo", "path", F.col("place").cast("long").alias("place"))


def file_owner(spark, sf_dir):
    """Files by the first declared root above them."""
    roots = [("web", "src/components"), ("api", "services"), ("legacy", "legacy"), ("all", "lib")]
    return Cs.owner(_files(spark, sf_dir).select("file_id", "path"), roots).groupBy("repo").agg(F.count("*").alias("n_files"))


def gathered(spark, sf_dir):
    """What pages of notes are made of, each computed once and kept in the shared folder while it is joined: the notes with their
    topics, the code found for them, their links, the inventory, and their conflicts."""
    titles = F.create_map(*(F.lit(x) for t in PROFILE for x in (t.key, t.title)))
    named = F.transform("topics", lambda k: F.coalesce(F.try_element_at(titles, k), k)).alias("titles")
    rows = saved(Q.classified(spark, sf_dir).select("note_id", "kind", "section", "path", "title", "body", "topics", named, To.repos_of(F.col("topics"), PROFILE).alias("repos")), "notes-classified")
    asked = rows.select("note_id", "kind", "topics", F.array("title", "section").alias("keywords"))
    hits = saved(Cs.for_notes(asked, kept(spark, sf_dir)).select("note_id", "repo", "path", "place"), "notes-hits")
    links, inventory = Q.link_records(spark, sf_dir)
    inventory = saved(inventory, "notes-inventory")
    return rows, hits, links, inventory, N.with_conflicts(rows, links, inventory, hits)


def rendered_notes(spark, sf_dir):
    """Every note as a whole: what is known of it, and its own text."""
    rows, hits, _, _, found = gathered(spark, sf_dir)
    near = To.related(rows.select("note_id", "kind", "topics"), Q.refs(rows))
    return _digests(N.rendered(rows, near, hits, found), "note_id")


QUERIES = {f.__name__: f for f in (language_classify, artifact_kind, code_symbols, code_comments, code_risks, implementation_signals, identifier_words, code_search, code_hit_top_files, code_hit_prune, code_hit_rerank, code_reference_registry, code_refs_per_repo, code_analysis, note_conflicts, conflict_counts, rendered_notes, representative_files, file_owner, code_notes, repo_notes, source_notes)}

_NAME = "list_last(string_split(path, '/'))"
_SUFFIX = f"lower(regexp_extract({_NAME}, '^.+(\\.[^.]+)$', 1))"
_LANG = "CASE " + " ".join(f"WHEN {_SUFFIX} = '{k}' THEN '{v}'" for k, v in C.LANGUAGES.items()) + " ELSE 'Code' END"
_LANGUAGE = f"CASE WHEN {_NAME} = 'Dockerfile' THEN 'Dockerfile' WHEN {_NAME} IN ('Gemfile', 'Podfile', 'Fastfile', 'Rakefile') THEN 'Ruby DSL' ELSE {_LANG} END"
_CODE = f"({_NAME} IN ('Dockerfile', 'Gemfile', 'Podfile', 'Fastfile', 'Rakefile') OR {_SUFFIX} IN ({', '.join(S.q(k) for k in C.LANGUAGES)}))"
_IGNORED = "list_has_any(string_split(path, '/'), ['.git', 'node_modules', 'Pods', 'vendor', 'dist', 'build', '__pycache__'])"
_B = "body"
_P = "lower(path)"


def _has(x: str, parts: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {S.q(p)})" for p in parts) + ")"


_UI = S.q(C.UI)
_LOCK = _has(_P, ["package-lock.json", "yarn.lock", "pnpm-lock"])
_KIND = f"""CASE WHEN {_NAME} = 'Dockerfile' THEN 'Container build definition' WHEN contains({_P}, 'docker-compose') THEN 'Container orchestration config'
 WHEN {_has(_P, ['.gitlab-ci', '.github/workflows/'])} THEN 'CI/CD pipeline config' WHEN regexp_matches({_P}, '(\\.(test|spec)\\.(js|jsx|ts|tsx)|_test\\.go|_spec\\.rb)$') THEN 'Automated test suite'
 WHEN {_LOCK} THEN 'Dependency lockfile' WHEN {_SUFFIX} = '.sql' THEN 'SQL script' WHEN {_SUFFIX} IN ('.yml', '.yaml') THEN 'YAML configuration' WHEN {_SUFFIX} = '.json' THEN 'JSON configuration or schema'
 WHEN {_SUFFIX} IN ('.jsx', '.tsx') THEN 'Frontend component module'
 WHEN {_SUFFIX} IN ('.js', '.ts') THEN CASE WHEN {_has(_P, ['component', 'view', 'container', 'page'])} OR regexp_matches({_B}, {_UI}) THEN 'Frontend or UI module' WHEN {_has(_P, ['service', 'api', 'integration', 'connector', 'gateway', 'auth'])} THEN 'Service or integration module' ELSE 'Application module' END
 WHEN {_SUFFIX} = '.go' THEN 'Go package or service' WHEN {_SUFFIX} = '.rb' THEN 'Ruby class or service' WHEN {_SUFFIX} = '.swift' THEN 'iOS source file' WHEN {_SUFFIX} IN ('.m', '.mm', '.h') THEN 'Objective-C source file'
 WHEN {_SUFFIX} = '.sh' THEN 'Shell automation script' WHEN {_SUFFIX} = '.py' THEN 'Python module' ELSE 'Code artifact' END"""


def _fired(tests: dict[str, str]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {t} THEN '{n}' END" for n, t in tests.items()) + "], lambda v: v IS NOT NULL), ',')"


def _symbols(kind: str) -> str:
    limit, patterns = C.SYMBOLS[kind]
    return f"array_to_string({S.unique('list_concat(' + ', '.join(f'regexp_extract_all({_B}, {S.q(p)}, 1)' for p in patterns) + ')', limit)}, ',')"


_RISKS = {n: f"regexp_matches({_B}, {S.q(p)})" for n, p in C.RISKS.items()}
_RISKS = dict([*list(_RISKS.items())[:3], ("legacy-path", f"contains({_P}, 'gitlab')"), *list(_RISKS.items())[3:]])
_SIGNALS = {n: f"regexp_matches({_B}, {S.q(p)})" + (f" OR {_SUFFIX} = '.sql'" if n == "sql" else "") for n, p in C.SIGNALS.items()}
_SYSTEMS = ["salesforce", "marketo", "hubspot", "eloqua", "tango", "oauth", "sso", "captcha", "redis", "postgres", "mysql", "metabase", "looker", "docker", "kubernetes", "fastlane", "referral"]
_GENERIC = [
    "src", "lib", "internal", "app", "apps", "services", "service", "components", "component", "modules", "module", "shared", "common", "utils", "devops", "domain", "api", "client", "server", "web",
    "mobile", "ios", "android", "config", "configs", "scripts", "test", "tests", "spec", "specs",
]


def _words(x: str) -> str:
    spaced = f"regexp_replace(translate({x}, '_-', '  '), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')"
    return f"lower({S.norm(spaced)})"


def _line(label: str, names: str, n: int) -> str:
    return f"CASE WHEN len({names}) > 0 THEN concat('{label}: ', array_to_string({names}[1:{n}], ', ')) END"


def _list(items: list[str]) -> str:
    return f"list_filter([{', '.join(items)}], lambda v: v IS NOT NULL)"


_NO_SUFFIX = r"regexp_replace(p, '^(.+)\.[^.]+$', '\1')"
_FOCUS_LIST = S.unique(f"list_transform(list_filter(string_split(path, '/'), lambda p: {S.key('p')} <> '' AND {S.key('p')} NOT IN ({', '.join(map(S.q, _GENERIC))})), lambda p: {_words(_NO_SUFFIX)})", 5)
_SYSTEM_LIST = _list([f"CASE WHEN contains(lower(concat(path, chr(10), body)), '{x}') THEN '{x.title()}' END" for x in _SYSTEMS]) + "[1:6]"
_FOCUS = f"array_to_string({_FOCUS_LIST}, ',')"
# the files derived here start with line comments only, so the SQL needs no state of block comments
_SAID = S.norm("CASE WHEN starts_with(v, '//') OR starts_with(v, '--') THEN substr(v, 3) ELSE substr(v, 2) END")
_COMMENTS = rf"""l AS (SELECT file_id, list_transform({S.lines('body')}[1:80], lambda v: regexp_replace(v, '^\s+|\s+$', '', 'g')) AS l FROM files),
c AS (SELECT file_id, l[1:coalesce(list_position(list_transform(l, lambda v: regexp_matches(v, '^(//|#|--|;)')), false), 81) - 1] AS c FROM l),
t AS (SELECT file_id, list_filter(list_transform(c, lambda v: {_SAID}), lambda v: v <> '')[1:4] AS t FROM c)"""
_PATTERNS = {
    "delivery": ("ion|loaditem", ["src1", "src2"]), "billing": ("eau|ent|accounts_", ["src0", "src3", "src4"]), "access": ("password|sch|innerhtml", ["src5"]),
    "search": ("ción|ado|class model", ["src6", "src7"]), "legacy": ("gitlab|old pages", ["src99"]),
}
_MATCHED = " UNION ALL ".join(f"SELECT '{t}' AS topic, file_id, repo, path, n, line FROM split WHERE repo IN ({', '.join(map(S.q, repos))}) AND regexp_matches(line, '(?i){p}')" for t, (p, repos) in _PATTERNS.items())
_HITS = f"""wanted AS (SELECT file_id, repo, path, {S.lines('body')} AS l FROM files WHERE {_CODE} AND NOT {_IGNORED}),
split AS (SELECT file_id, repo, path, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS n FROM wanted), matched AS ({_MATCHED}),
hits AS (SELECT topic, repo, path, file_id, least(count(*), 3) AS score, min(n) AS line_number, left({S.norm('arg_min(line, n)')}, 180) AS sample FROM matched GROUP BY topic, repo, path, file_id)"""
_LOW = _has("lower(concat_ws(' ', repo, path, sample))", [".gitlab-ci", "package-lock.json", "yarn.lock", "pnpm-lock", "jquery", "bootstrap", "react-16", "test-data", "fake-cards", "graphiql/rails"])
_RANKED = f"{_HITS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, repo, path, line_number, sample) AS rank FROM hits)"
_KEPT = f"""{_RANKED}, once AS (SELECT *, {_LOW} AS low, row_number() OVER (PARTITION BY topic, repo, path ORDER BY {_LOW}, rank) AS nth FROM ranked WHERE rank <= 60),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY low, rank) AS place FROM once WHERE nth = 1) WHERE place <= 24)"""
_FILE_TOKENS = S.tokens("concat_ws(' ', path, sample, repo)")
_PICKED = f"""{_KEPT}, {Q.TOP},
asked AS (SELECT note_id, n.kind, list_concat({S.tokens('title')}, {S.tokens('section')}) AS words, t.topic, t.place AS topic_no FROM top t JOIN notes n USING (note_id)),
both_ AS (SELECT a.note_id, a.kind, a.words, k.*, row_number() OVER (PARTITION BY a.note_id, k.repo, k.path ORDER BY a.topic_no, k.place) AS nth2 FROM asked a JOIN kept k ON k.topic = a.topic),
pts AS (SELECT *, score + len(list_intersect(words, {_FILE_TOKENS})) - CASE WHEN low THEN 4 ELSE 0 END AS points FROM both_ WHERE nth2 = 1),
picked AS (SELECT * FROM (SELECT note_id, kind, repo, path, line_number, sample, points, row_number() OVER (PARTITION BY note_id ORDER BY low, points DESC, path, repo) AS pos FROM pts) WHERE pos <= 8)"""
_REGISTRY = f"""{_PICKED},
users AS (SELECT repo, path, line_number, sample, CASE kind WHEN 'support' THEN 0 ELSE 1 END AS k, note_id AS who, NULL AS topic, pos FROM picked UNION ALL SELECT repo, path, line_number, sample, 2, NULL, topic, place FROM kept),
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY k, who, topic, pos) AS o FROM users) WHERE o = 1),
of_topics AS (SELECT DISTINCT repo, path, topic FROM (SELECT repo, path, topic FROM kept UNION ALL SELECT p.repo, p.path, t.topic FROM picked p JOIN top t USING (note_id))),
by_notes AS (SELECT repo, path, list(DISTINCT who ORDER BY who) FILTER (WHERE k = 0) AS s, list(DISTINCT who ORDER BY who) FILTER (WHERE k = 1) AS w FROM users GROUP BY repo, path),
by_topics AS (SELECT repo, path, list(topic ORDER BY topic) AS t FROM of_topics GROUP BY repo, path),
reg AS (SELECT f.repo, f.path, f.line_number, f.sample, coalesce(len(s), 0) AS n_support, coalesce(len(w), 0) AS n_wiki, len(t) AS n_topic,
  coalesce(array_to_string(s[1:60], ','), '') AS support, coalesce(array_to_string(w[1:60], ','), '') AS wiki, array_to_string(t[1:40], ',') AS topics FROM first f JOIN by_notes USING (repo, path) JOIN by_topics USING (repo, path))"""
_KINDS = _list(["CASE WHEN n_stale > 0 THEN 'documentation-drift' END", "CASE WHEN n_shut > 0 THEN 'restricted-source' END", "CASE WHEN r.note_id IS NOT NULL AND n_hits IS NULL THEN 'code-traceability-gap' END", "CASE WHEN contains(lower(body), 'gitlab') AND coalesce(n_stale, 0) = 0 THEN 'documentation-drift' END"])
CONFLICT = f"""{_PICKED}, {Q.REPOS}, {Q.RECORDS},
per AS (SELECT note_id, count(*) AS n_links, count(*) FILTER (WHERE status = 'stale-doc-reference') AS n_stale, count(*) FILTER (WHERE status IN ('blocked', 'needs-google-drive')) AS n_shut FROM said JOIN rec USING (url) GROUP BY note_id),
found AS (SELECT note_id, count(*) AS n_hits FROM picked GROUP BY note_id), roots AS (SELECT DISTINCT note_id FROM top JOIN repos USING (topic)),
con AS (SELECT n.note_id, coalesce(n_links, 0) AS n_links, coalesce(n_stale, 0) AS n_stale, coalesce(n_hits, 0) AS n_hits, {_KINDS} AS kinds
  FROM notes n LEFT JOIN per ON per.note_id = n.note_id LEFT JOIN found ON found.note_id = n.note_id LEFT JOIN roots r ON r.note_id = n.note_id)"""
_RISK_LIST, _SHOWN = _fired(_RISKS), _fired(_SIGNALS)
_CONFLICT_LIST = _fired({"legacy-path": f"contains({_P}, 'gitlab')", "stale-host": f"contains(lower({_B}), 'wiki.legacy.test.org')", "lockfile": f"({_KIND}) = 'Dependency lockfile'"})
_SYMBOL_LISTS = {k: S.unique("list_concat(" + ", ".join(f"regexp_extract_all(body, {S.q(p)}, 1)" for p in patterns) + ")", limit) for k, (limit, patterns) in C.SYMBOLS.items()}
_MADE = f"list_filter(list_concat([concat('kind: ', kind), {_line('classes', 'classes', 5)}, {_line('functions', 'functions', 6)}, {_line('types', 'types', 5)}], list_transform(shown, lambda v: concat('shows: ', v)), [{_line('systems', 'systems', 6)}]), lambda v: v IS NOT NULL)[1:10]"
_NAMES = S.unique(f"list_transform(list_concat(classes, functions, types), lambda v: {_words('v')})", 5)
_MEANT = f"list_filter(list_concat(t[1:2], [{_line('path', 'focus', 5)}, {_line('symbols', 'named', 5)}, CASE WHEN coalesce(sample, '') <> '' THEN concat('matches: ', left({S.norm('sample')}, 180)) END]), lambda v: v IS NOT NULL)"
_TOLD = S.unique("CASE WHEN len(meant) > 0 THEN meant ELSE [concat('found by search: ', lower(kind))] END", 6)
_ANALYSED = f"""samples AS (SELECT repo AS r, path AS of_path, arg_min(sample, (topic, place)) AS sample FROM kept GROUP BY repo, path),
whole AS (SELECT files.*, {S.unique('t', 4)} AS t, sample FROM files JOIN t USING (file_id) LEFT JOIN samples ON r = repo AND of_path = path),
each AS (SELECT *, {_LANGUAGE} AS language, {_KIND} AS kind, {', '.join(f'{x} AS {k}' for k, x in _SYMBOL_LISTS.items())}, string_split(nullif({_SHOWN}, ''), ',') AS shown, {_SYSTEM_LIST} AS systems, {_FOCUS_LIST} AS focus, {_RISK_LIST} AS risks, {_CONFLICT_LIST} AS conflicts FROM whole),
named AS (SELECT *, {_NAMES} AS named FROM each), meant AS (SELECT *, {_MEANT} AS meant FROM named)"""
_ANALYSIS = f"""WITH {_COMMENTS}, {_KEPT}, {_ANALYSED}
SELECT file_id, language, kind AS artifact_kind, {', '.join(f"array_to_string({k}, '|') AS {k}" for k in _SYMBOL_LISTS)}, array_to_string(t, '|') AS comments, array_to_string({_MADE}, '|') AS implementation,
  array_to_string({_TOLD}, '|') AS intentions, replace(risks, ',', '|') AS risks, replace(conflicts, ',', '|') AS conflicts FROM meant"""

def _part(title: str, lines: str, otherwise: str) -> str:
    return f"concat('## {title}', chr(10), chr(10), CASE WHEN len({lines}) > 0 THEN array_to_string(list_transform({lines}, lambda v: concat('- ', v)), chr(10)) ELSE '{otherwise}' END)"


def _ids(x: str) -> str:
    return f"list_transform(string_split(nullif({x}, ''), ','), lambda v: concat('[[note-', v, ']]'))"


_GAP = "concat(chr(10), chr(10))"
_RENDERED = f"""WITH {CONFLICT}, {Q.RELATED},
code AS (SELECT note_id, list(concat(repo, ':', path) ORDER BY pos) AS code FROM picked GROUP BY note_id), topics AS (SELECT note_id, list(topic ORDER BY place) AS topics FROM top GROUP BY note_id),
facts AS (SELECT n.*, {Q.HEADINGS} AS h, {Q.BULLETS} AS b, {Q.PARAS} AS p, code, topics, kinds, related_support, related_wiki, {S.display_title('title')} AS shown, {S.imported('body')} AS content
  FROM notes n LEFT JOIN code USING (note_id) LEFT JOIN topics USING (note_id) LEFT JOIN con USING (note_id) LEFT JOIN related USING (note_id)),
whole AS (SELECT note_id, concat_ws({_GAP}, concat('---', chr(10), 'type: "concept"', chr(10), 'source: "', kind, '"', chr(10), 'section: "', section, '"', chr(10), 'topics: "', array_to_string(topics, ' '), '"', chr(10), '---'), concat('# ', shown),
  {_part('Summary', 'p[1:1]', 'Nothing is said.')}, {_part('Key sections', 'h[1:8]', 'None.')}, {_part('Key evidence', 'b[1:10]', 'None.')}, {_part('Related support notes', _ids('related_support'), 'None.')}, {_part('Related wiki notes', _ids('related_wiki'), 'None.')},
  {_part('Topics', 'topics', 'None.')}, {_part('Source code', 'code', 'No code was found.')}, {_part('Conflicts', 'kinds', 'None.')}, '## Content', content) AS body FROM facts)
SELECT note_id, length(body) AS n_chars, md5(body) AS body_md5 FROM whole"""

def _block(title: str, lines: str, otherwise: str = "NULL") -> str:
    return f"CASE WHEN len({lines}) > 0 THEN concat('## {title}', {_GAP}, array_to_string(list_transform({lines}, lambda v: concat('- ', v)), chr(10))) ELSE {otherwise} END"


def _none(title: str) -> str:
    return f"concat('## {title}', {_GAP}, '- None was seen.')"


def _tick(lines: str) -> str:
    return f"CASE WHEN len({lines}) > 0 THEN array_to_string(list_transform({lines}, lambda v: concat('`', v, '`')), ', ') ELSE '(none found)' END"


def _wiki(lines: str, prefix: str = "") -> str:
    return f"list_transform({lines}, lambda v: concat('[[{prefix}', v, ']]'))"


_PIPED = "string_split(nullif({x}, ''), ',')"
_CODE_NOTES = f"""WITH {_COMMENTS}, {_REGISTRY}, {_ANALYSED}, made AS (SELECT *, {_MADE} AS made, {_TOLD} AS told FROM meant),
one AS (SELECT m.*, r.line_number, r.sample AS said, r.n_support, r.n_wiki, r.n_topic, {_PIPED.format(x="r.support")} AS s, {_PIPED.format(x="r.wiki")} AS w, {_PIPED.format(x="r.topics")} AS tt, row_number() OVER (PARTITION BY m.repo, m.path ORDER BY file_id) AS nth FROM made m JOIN reg r USING (repo, path)),
note AS (SELECT repo, path, concat_ws({_GAP}, concat('---', chr(10), 'type: "concept"', chr(10), 'source: "code-search"', chr(10), 'repo: "', repo, '"', chr(10), 'language: "', language, '"', chr(10), 'risk_count: ', coalesce(len(string_split(nullif(risks, ''), ',')), 0), chr(10), 'conflict_count: ', coalesce(len(string_split(nullif(conflicts, ''), ',')), 0), chr(10), 'tags:', chr(10), '  - "code-reference"', chr(10), '  - "', repo, '"', chr(10), '---'),
  concat('# ', repo, '/', path), concat('- Repository: [[Repo - ', repo, ']]', chr(10), '- Path: `', path, '`', chr(10), '- First line: `', line_number, '`'),
  concat_ws(chr(10), concat('## Summary', {_GAP}, '- Language: `', language, '`'), concat('- Kind: ', kind), CASE WHEN len(classes) > 0 THEN concat('- Classes: ', {_tick('classes')}) END, CASE WHEN len(functions) > 0 THEN concat('- Functions: ', {_tick('functions')}) END, CASE WHEN len(types) > 0 THEN concat('- Types: ', {_tick('types')}) END, CASE WHEN len(classes) + len(functions) + len(types) = 0 THEN '- Nothing is named.' END),
  {_block('Intentions', 'told')}, CASE WHEN coalesce(said, '') <> '' THEN concat('## Representative match', {_GAP}, '`', said, '`') END, concat('## Relevance', {_GAP}, '- Support notes: `', n_support, '`', chr(10), '- Wiki notes: `', n_wiki, '`', chr(10), '- Topics: `', n_topic, '`'),
  {_block('Implementation', 'made')}, {_block('Risks', "string_split(nullif(risks, ''), ',')", _none('Risks'))}, {_block('Conflicts', "string_split(nullif(conflicts, ''), ',')", _none('Conflicts'))}, {_block('Topics', _wiki('tt[1:20]'))}, {_block('Support notes', _wiki('s[1:30]', 'note-'))}, {_block('Wiki notes', _wiki('w[1:30]', 'note-'))},
  concat('## Related notes', {_GAP}, '- [[Code Reference Index]]', chr(10), '- [[Code Intelligence Hub]]')) AS body FROM one WHERE nth = 1)
SELECT repo, path, length(body) AS n_chars, md5(body) AS body_md5 FROM note"""
_REPO_TOPICS = "(VALUES ('src0', ['Billing']), ('src1', ['Delivery']), ('src2', ['Delivery']), ('src3', ['Billing']), ('src4', ['Billing']), ('src5', ['Access']), ('src6', ['Search']), ('src7', ['Search']), ('src99', ['Legacy'])) v(repo, topics)"
_REPO_NOTES = f"""WITH listed AS (SELECT DISTINCT repo, path FROM files), ranked AS (SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY CASE WHEN path = 'Dockerfile' THEN 3 ELSE 10 END, path) AS k FROM listed WHERE len(string_split(path, '/')) <= 4 AND {_CODE} AND NOT {_IGNORED}),
snap AS (SELECT repo, coalesce(list(DISTINCT path ORDER BY path) FILTER (WHERE path IN ('README.md', 'package.json', 'Gemfile', 'Podfile', 'DockerFile', 'docker-compose.yml')), []) AS keys, list(DISTINCT split_part(path, '/', 1) ORDER BY split_part(path, '/', 1)) FILTER (WHERE contains(path, '/') AND NOT starts_with(path, '.')) AS dirs,
  coalesce(list(DISTINCT split_part(path, '/', 2) ORDER BY split_part(path, '/', 2)) FILTER (WHERE regexp_matches(path, '^apps/[^/]+/')), []) AS apps, coalesce(list(DISTINCT split_part(path, '/', 2) ORDER BY split_part(path, '/', 2)) FILTER (WHERE regexp_matches(path, '^services/[^/]+/')), []) AS services FROM listed GROUP BY repo),
best AS (SELECT repo, list(concat('`', path, '`') ORDER BY k) AS shown FROM ranked WHERE k <= 14 GROUP BY repo),
note AS (SELECT s.repo, concat_ws({_GAP}, concat('---', chr(10), 'type: "concept"', chr(10), 'source: "repository-scan"', chr(10), 'repo: "', s.repo, '"', chr(10), 'tags:', chr(10), '  - "repo"', chr(10), '---'), concat('# ', s.repo),
  concat('## Structure', {_GAP}, '- Top-level directories: ', {_tick('dirs[1:12]')}, chr(10), '- Key files: ', {_tick('keys')}), {_block('Apps', "list_transform(apps[1:20], lambda v: concat('`', v, '`'))")}, {_block('Services', "list_transform(services[1:25], lambda v: concat('`', v, '`'))")},
  {_block('Representative files', 'shown')}, {_block('Topics', _wiki('topics', 'Capability - '), "concat('## Topics', chr(10), chr(10), '- [[Product Capability Map]]')")}, concat('## Related notes', {_GAP}, '- [[Repo Catalog]]', chr(10), '- [[Code Intelligence Hub]]')) AS body FROM snap s LEFT JOIN best USING (repo) LEFT JOIN {_REPO_TOPICS} USING (repo))
SELECT repo, length(body) AS n_chars, md5(body) AS body_md5 FROM note"""

_TITLE_OF = "CASE topic WHEN 'delivery' THEN 'Delivery' WHEN 'billing' THEN 'Billing' WHEN 'access' THEN 'Access' WHEN 'search' THEN 'Search' WHEN 'platform' THEN 'Platform' WHEN 'legacy' THEN 'Legacy' ELSE topic END"
_STEM_OF = "coalesce(nullif(rtrim(left(trim(regexp_replace(concat('Code Ref - ', repo, ' - ', replace(path, '/', ' -- ')), '[^A-Za-z0-9 ._-]+', '', 'g')), 180), ' .'), ''), 'Untitled')"
_SHUT = "status IN ('blocked', 'auth-gated', 'likely-auth-gated', 'needs-google-drive', 'binary-or-empty')"
_FETCHED = f"CASE WHEN status IN ('local-support-evidence', 'needs-google-drive', 'stale-doc-reference') THEN NULL ELSE p.http_status END"
_SOURCE_NOTES = f"""WITH {CONFLICT}, {Q.RELATED}, {Q.WIKIFIED},
of_note AS (SELECT s.note_id, s.url, status, {S.host('s.url')} AS domain, {_FETCHED} AS http_status FROM said s JOIN rec USING (url) LEFT JOIN note_pages p ON p.url = s.url),
statuses AS (SELECT note_id, string_agg(concat(status, ': `', n, '`'), ', ' ORDER BY concat(status, ': `', n, '`')) AS st FROM (SELECT note_id, status, count(*) AS n FROM of_note GROUP BY 1, 2) GROUP BY note_id),
domains AS (SELECT note_id, list(concat(domain, ': `', n, '`') ORDER BY n DESC, domain)[1:6] AS dm FROM (SELECT note_id, domain, count(*) AS n FROM of_note GROUP BY 1, 2) GROUP BY note_id),
linked AS (SELECT note_id, list(concat('[', status, '] [', url, '](', url, ')', CASE WHEN http_status IS NULL THEN '' ELSE concat(' | http `', http_status, '`') END) ORDER BY url) FILTER (WHERE {_SHUT}) AS shut, (list(concat('[', url, '](', url, ')') ORDER BY url) FILTER (WHERE status = 'mirrored'))[1:15] AS kept FROM of_note GROUP BY note_id),
code AS (SELECT note_id, list({_STEM_OF} ORDER BY pos) AS code FROM picked GROUP BY note_id), topics AS (SELECT note_id, list({_TITLE_OF} ORDER BY place) AS topics FROM top GROUP BY note_id),
named_repos AS (SELECT note_id, list(repo ORDER BY place, ord) AS r FROM top JOIN repos USING (topic) GROUP BY note_id),
facts AS (SELECT n.note_id, n.kind, n.section, n.path, {S.display_title('title')} AS shown, {Q.HEADINGS} AS h, {Q.BULLETS} AS b, {Q.PARAS} AS p FROM notes n),
whole AS (SELECT f.note_id, concat_ws({_GAP}, concat('---', chr(10), 'type: "concept"', chr(10), 'source: "', CASE WHEN kind = 'wiki' THEN 'engineering-wiki' ELSE 'support-export' END, '"', chr(10), 'section: "', section, '"', chr(10), 'source_path: "', path, '"', chr(10), 'tags:', chr(10), '  - "', kind, '"', chr(10), '---'), concat('# ', shown),
  concat('- Path: `', path, '`', chr(10), '- Linked page statuses: ', coalesce(st, 'none')), concat('## Summary', {_GAP}, coalesce(p[1], 'Nothing is said.')), {_block('Key sections', "h[1:CASE WHEN kind = 'wiki' THEN 10 ELSE 8 END]")}, {_block('Key evidence', 'b[1:10]')}, {_block('Linked domains', 'dm')},
  {_block('Related support notes', _ids('related_support'))}, {_block('Related wiki notes', _ids('related_wiki'))}, {_block('Related capabilities', _wiki('topics', 'Capability - '))}, {_block('Source code references', _wiki('code'), "concat('## Source code references', chr(10), chr(10), '- No code was found.')")}, {_block('Repositories', _wiki('r[1:20]', 'Repo - '))},
  {_block('Conflicts and mismatches', 'kinds', _none('Conflicts and mismatches'))}, {_block('Uncaptured evidence', 'shut')}, {_block('Linked resources', 'kept')}, CASE WHEN coalesce(w.body, '') <> '' THEN concat('## Full ', CASE WHEN kind = 'wiki' THEN 'Wiki' ELSE 'Article' END, ' Content', {_GAP}, w.body) END,
  CASE WHEN kind = 'wiki' THEN concat('## Related notes', {_GAP}, '- [[Engineering Wiki Index]]', chr(10), '- [[Wiki Pages Hub]]') ELSE concat('## Related notes', {_GAP}, '- [[Support Article Index]]', chr(10), '- [[Support Articles Hub]]') END) AS body
  FROM facts f LEFT JOIN statuses USING (note_id) LEFT JOIN domains USING (note_id) LEFT JOIN linked USING (note_id) LEFT JOIN code USING (note_id) LEFT JOIN topics USING (note_id) LEFT JOIN named_repos USING (note_id) LEFT JOIN con USING (note_id) LEFT JOIN (SELECT note_id, related_support, related_wiki FROM related) USING (note_id) LEFT JOIN wikified w USING (note_id))
SELECT note_id, length(body) AS n_chars, md5(body) AS body_md5 FROM whole"""

ORACLE_SQL = {
    "source_notes": with_views(_SOURCE_NOTES, "files", "notes", "known", "note_pages"),
    "code_notes": with_views(_CODE_NOTES, "files", "notes"),
    "repo_notes": with_views(_REPO_NOTES, "files"),
    "rendered_notes": with_views(_RENDERED, "files", "notes", "known", "note_pages"),
    "language_classify": with_views(f"SELECT {_LANGUAGE} AS language, count(*) AS n FROM files GROUP BY 1", "files"),
    "artifact_kind": with_views(f"SELECT file_id, {_KIND} AS kind, {_CODE} AS is_code, {_IGNORED} AS is_ignored FROM files", "files"),
    "code_symbols": with_views(f"SELECT file_id, {', '.join(f'{_symbols(k)} AS {k}' for k in C.SYMBOLS)} FROM files", "files"),
    "code_comments": with_views(f"WITH {_COMMENTS} SELECT file_id, array_to_string({S.unique('t', 4)}, '|') AS comments FROM t", "files"),
    "code_risks": with_views(f"SELECT file_id, {_RISK_LIST} AS risks, {_CONFLICT_LIST} AS conflicts FROM files", "files"),
    "implementation_signals": with_views(f"SELECT file_id, {_SHOWN} AS signals, array_to_string({_SYSTEM_LIST}, ',') AS systems, {_FOCUS} AS focus FROM files", "files"),
    "code_analysis": with_views(_ANALYSIS, "files"),
    "note_conflicts": with_views(f"WITH {CONFLICT} SELECT note_id, n_links, n_stale, n_hits, array_to_string(kinds, ',') AS conflicts FROM con", "files", "notes", "known", "note_pages"),
    "conflict_counts": with_views(f"WITH {CONFLICT} SELECT kind, count(*) AS n FROM (SELECT unnest(kinds) AS kind FROM con) GROUP BY kind", "files", "notes", "known", "note_pages"),
    "identifier_words": with_views(f"SELECT file_id, lower({S.norm('''regexp_replace(translate(path, '_-', '  '), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')''')}) AS words FROM files", "files"),
    "code_search": with_views(f"WITH {_HITS} SELECT topic, repo, path, score, line_number, sample FROM hits", "files"),
    "code_hit_top_files": with_views(f"WITH {_RANKED} SELECT topic, repo, path, score, rank FROM ranked WHERE rank <= 40", "files"),
    "code_hit_prune": with_views(f"WITH {_KEPT} SELECT topic, repo, path, place FROM kept", "files"),
    "code_hit_rerank": with_views(f"WITH {_PICKED} SELECT note_id, repo, path, points, pos AS place FROM picked", "files", "notes"),
    "code_reference_registry": with_views(f"WITH {_REGISTRY} SELECT * FROM reg", "files", "notes"),
    "code_refs_per_repo": with_views(f"WITH {_REGISTRY} SELECT repo, count(*) AS n FROM reg GROUP BY repo", "files", "notes"),
    "representative_files": with_views(f"SELECT repo, path, place FROM (SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY CASE WHEN path = 'Dockerfile' THEN 3 ELSE 10 END, path) AS place FROM (SELECT DISTINCT repo, path FROM files) WHERE len(string_split(path, '/')) <= 4 AND {_CODE} AND NOT {_IGNORED}) WHERE place <= 14", "files"),
    "file_owner": with_views("SELECT CASE WHEN starts_with(path, 'src/components/') THEN 'web' WHEN starts_with(path, 'services/') THEN 'api' WHEN starts_with(path, 'legacy/') THEN 'legacy' WHEN starts_with(path, 'lib/') THEN 'all' END AS repo, count(*) AS n_files FROM files GROUP BY 1", "files"),
}

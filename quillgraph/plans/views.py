"""Views derived from the tables by SQL that Spark and DuckDB both understand.

The documents hold no headings, links or code, so notes, files and fetches are derived from their columns; every row of the
table gives a row (or more) of the view, with its whole text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table

NL = "chr(10)"

VIEWS = {
    "notes": (
        ["documents"],
        f"""SELECT doc_id AS note_id, source AS section, CASE WHEN doc_id % 3 = 0 THEN 'wiki' ELSE 'support' END AS kind,
  concat(source, '/', lang, '/', doc_id, '-note-', lang, '.md') AS path,
  concat('Guide to ', split_part(text, ' ', 1), ' ', split_part(text, ' ', 3)) AS title,
  concat(CASE WHEN doc_id % 4 = 0 THEN concat('# Article ', doc_id, {NL}, '*Source:* https://kb.example.org/', doc_id, {NL}, '---', {NL}) ELSE '' END,
    '# Guide to ', split_part(text, ' ', 1), ' ', split_part(text, ' ', 3), {NL}, {NL}, '## Setup ', split_part(text, ' ', 2), {NL},
    '- see [the article](https://kb.', source, '.test.org/article/', 1000 + doc_id % 300, ') and Article ', 1000 + doc_id % 400, {NL},
    '- also [[', CASE WHEN doc_id % 5 = 0 THEN concat('src', doc_id % 7, '/en/', doc_id % 211, '-note-en') ELSE concat(doc_id % 500, '-note-', lang) END, '|other]]', {NL},
    CASE WHEN doc_id % 6 = 0 THEN concat('Posted', {NL}, '- ', CASE doc_id % 24 WHEN 6 THEN 'Grace Brewster Hopper' WHEN 12 THEN 'Alan Turing' WHEN 18 THEN 'Alan Turing Prize' ELSE 'Ada Lovelace' END, {NL}, 'Comments', {NL}) ELSE '' END,
    CASE WHEN doc_id % 5 = 1 THEN concat('With thanks to Alan Turing Prize Winner Grace Hopper and Dear Grace Brewster Hopper.', {NL}) ELSE '' END,
    CASE WHEN doc_id % 9 = 0 THEN 'Old pages live on gitlab and http://wiki.legacy.test.org/start.' ELSE '' END,
    'Mail ops', doc_id % 5, '@mail.test.org or http://bot:pw', doc_id, '@host.test.org/x at 10.1.', doc_id % 250, '.7.', {NL}, '---', {NL}, text) AS body
FROM documents""",
    ),
    "files": (
        ["documents"],
        f"""SELECT doc_id AS file_id, source AS repo,
  concat(CASE doc_id % 9 WHEN 0 THEN 'src/components/' WHEN 1 THEN 'services/api/' WHEN 2 THEN 'vendor/lib/' WHEN 3 THEN '.github/workflows/' WHEN 4 THEN 'legacy/gitlab/' WHEN 5 THEN 'test-data/' ELSE 'lib/billingCore/' END,
    CASE doc_id % 12 WHEN 0 THEN 'Dockerfile' WHEN 1 THEN concat('mod', doc_id, '.test.js') WHEN 2 THEN concat('mod', doc_id, '.py') WHEN 3 THEN concat('mod', doc_id, '.tsx') WHEN 4 THEN concat('mod', doc_id, '.sql')
      WHEN 5 THEN concat('mod', doc_id, '.ts') WHEN 6 THEN concat('mod', doc_id, '.go') WHEN 7 THEN 'package-lock.json' WHEN 8 THEN concat('conf', doc_id, '.yml') WHEN 9 THEN concat('mod', doc_id, '.js') WHEN 10 THEN concat('mod', doc_id, '.rb') ELSE concat('note', doc_id, '.txt') END) AS path,
  concat(CASE WHEN doc_id % 4 = 1 THEN concat(chr(9), ' ') ELSE '' END, '// handles ', split_part(text, ' ', 2), {NL}, CASE WHEN doc_id % 2 = 0 THEN concat('// TODO: split ', split_part(text, ' ', 1), {NL}) ELSE '' END,
    'class Model', doc_id % 40, ' {{', {NL}, 'export async function loadItem', doc_id % 30, '(a) {{ try {{ await fetch(u); }} catch (e) {{ return null; }} }}', {NL},
    CASE WHEN doc_id % 3 = 0 THEN concat('const pick', doc_id % 8, ' = (x) => x;', {NL}, 'console.log(process.env.HOME);', {NL}) ELSE '' END,
    CASE WHEN doc_id % 7 = 0 THEN concat('el.innerHTML = eval(q); // http://wiki.legacy.test.org', {NL}) ELSE '' END,
    CASE WHEN doc_id % 5 = 0 THEN concat('CREATE TABLE accounts_', doc_id % 20, ' (id int);', {NL}, 'select 1 from redis_cache;', {NL}) ELSE '' END, text) AS body
FROM documents""",
    ),
    "links": (
        ["pages"],
        """SELECT url, concat('note-', page_id % 97) AS ref, page_id FROM pages
UNION ALL SELECT concat('https://', CASE page_id % 6 WHEN 0 THEN 'docs.google.com' WHEN 1 THEN 'wiki.legacy.test.org' WHEN 2 THEN 'team.zendesk.com' WHEN 3 THEN 'kb.test.org' ELSE 'app.test.org' END,
  '/x/article/', 1000 + page_id % 900, CASE WHEN page_id % 2 = 0 THEN '#top).' ELSE '?a=1' END) AS url, concat('wiki/', page_id % 31) AS ref, page_id FROM pages
UNION ALL SELECT url, concat('wiki/', page_id % 13) AS ref, page_id FROM pages""",
    ),
    "known": (["pages"], "SELECT concat('https://kb.test.org/article/', 1000 + page_id % 900, '#a') AS url FROM pages WHERE page_id % 4 < 3"),
    "fetched": (
        ["pages"],
        """SELECT url, CASE page_id % 11 WHEN 0 THEN 404 WHEN 1 THEN 401 WHEN 2 THEN 503 ELSE 200 END AS http_status, CASE WHEN page_id % 13 = 5 THEN 'timeout' END AS error,
  CASE page_id % 17 WHEN 3 THEN '' WHEN 4 THEN concat('Please Log In first. ', html) ELSE html END AS body FROM pages WHERE page_id % 19 <> 7""",
    ),
    "answers": (
        ["pages"],
        """SELECT url, CASE page_id % 11 WHEN 0 THEN 404 WHEN 1 THEN 401 WHEN 2 THEN 503 ELSE 200 END AS http_status, CASE WHEN page_id % 13 = 5 THEN 'timeout' END AS error,
  CASE page_id % 17 WHEN 3 THEN '' WHEN 4 THEN concat('Please Log In first. ', html) ELSE html END AS body,
  CASE page_id % 5 WHEN 0 THEN concat('https://moved.test.org/to/', page_id, '?from=1') WHEN 1 THEN 'https://Home.test.org' ELSE url END AS final_url,
  CASE page_id % 7 WHEN 0 THEN 'text/plain' WHEN 1 THEN '' ELSE 'text/html; charset=utf-8' END AS content_type FROM pages WHERE page_id % 19 <> 7""",
    ),
    "note_pages": (
        ["documents"],
        """SELECT url, CASE k % 5 WHEN 0 THEN 404 WHEN 1 THEN 403 ELSE 200 END AS http_status, CAST(NULL AS STRING) AS error, CASE WHEN k % 7 = 0 THEN '' ELSE 'a page' END AS body
FROM (SELECT concat('https://kb.', source, '.test.org/article/', 1000 + doc_id % 300) AS url, min(doc_id) AS k FROM documents GROUP BY 1) WHERE k % 3 > 0
UNION ALL SELECT concat('http://bot:pw', doc_id, '@host.test.org/x') AS url, 200 AS http_status, CAST(NULL AS STRING) AS error, 'a page' AS body FROM documents WHERE doc_id % 4 > 0""",
    ),
    "vault_notes": (
        ["documents"],
        f"""SELECT doc_id AS note_id, concat(source, '/n', doc_id, '.md') AS path,
  concat('---', {NL}, '# written by hand', {NL}, 'type: ', CASE doc_id % 3 WHEN 0 THEN 'problem' WHEN 1 THEN '"insight"' ELSE concat(chr(39), 'capture', chr(39), '  # odd') END, {NL},
    CASE doc_id % 5 WHEN 0 THEN concat('tags:', {NL}, '  - inbox', {NL}, '  - ', lang, {NL}, '  - "', source, ', raw"', {NL}) WHEN 1 THEN concat('tags: [inbox, ', lang, ', "a, b"]', {NL})
      WHEN 2 THEN concat('tags:', {NL}, '- ', source, {NL}, '- ', chr(39), 'it', chr(39), chr(39), 's ', lang, chr(39), {NL}) WHEN 3 THEN concat('tags: []', {NL}) ELSE concat('tags: ', lang, {NL}) END,
    'title: "say ', doc_id, ': ', chr(92), '"', lang, chr(92), '""', {NL}, CASE WHEN doc_id % 2 = 0 THEN concat('summary: >', {NL}, '  first ', lang, {NL}, '  then ', source, {NL}) ELSE concat('summary: one ', source, {NL}, '  and ', lang, {NL}) END,
    'empty:', {NL}, 'at: 10:', doc_id % 60, {NL}, '---', {NL}, text) AS body
FROM documents""",
    ),
    "manifests": (
        ["documents"],
        """SELECT concat('p', doc_id) AS manifest, CASE WHEN doc_id % 31 = 0 THEN '{"product": ' ELSE concat('{"product": {"name": "P ', lang, '", "slug": ', CASE WHEN doc_id % 7 = 0 THEN '""' ELSE concat('"p', doc_id, '"') END,
  ', "mode": "product", "vault_path": "vaults/', doc_id % 50, '", "workspace_path": ', CASE WHEN doc_id % 9 = 5 THEN 'null' ELSE '"."' END, '}, ',
  CASE WHEN doc_id % 5 = 1 THEN '' ELSE '"sources": {"corpus_path": "c", "mirror_path": "m", "auth_cache_path": "a"}, ' END, '"profile": ', CASE WHEN doc_id % 11 = 2 THEN '3' ELSE '{"intelligence_path": "i.yaml"}' END,
  ', "repositories": {"local_clone_root": "r", "safe_mirror_root": "m", "items": [', CASE WHEN doc_id % 4 = 0 THEN '' ELSE concat('{"owner": "o", "name": "', source, '", "role": "web", "default_branch": "main", "local_path": "x', doc_id % 3, '", "url": "u"}, {"owner": "o", "name": "',
    CASE WHEN doc_id % 6 = 1 THEN source ELSE 'other' END, '", "role": "api", "default_branch": "main", "local_path": "x1"', CASE WHEN doc_id % 8 = 3 THEN '' ELSE ', "url": "u"' END, '}', CASE WHEN doc_id % 13 = 4 THEN ', 5' ELSE '' END) END,
  ']}, "automation_pack": {', CASE WHEN doc_id % 10 = 3 THEN '' ELSE '"daily": {"automation_id": "d", "status": "on"}' END, '}, "engineering_readiness": {"categories": [',
    CASE WHEN doc_id % 12 = 7 THEN '' ELSE concat('{"key": "tests", "status": "done"}, {"key": "docs"', CASE doc_id % 3 WHEN 0 THEN ', "status": "partial"' WHEN 1 THEN ', "status": "odd"' ELSE '' END, '}') END, ']}}') END AS text
FROM documents""",
    ),
    "paths": (
        ["documents"],
        """SELECT concat('vaults/', doc_id % 40) AS path FROM documents UNION ALL SELECT concat('vaults/', doc_id % 30, '/audit.md') FROM documents
UNION ALL SELECT concat('vaults/', doc_id % 45, '/readiness.md') FROM documents UNION ALL SELECT concat('x', doc_id % 2) FROM documents UNION ALL SELECT 'c' AS path FROM documents""",
    ),
    "graph_notes": (
        ["documents"],
        f"""SELECT concat(CASE WHEN doc_id % 50 = 1 THEN 'Templates/' ELSE '' END, source, '/', CASE WHEN doc_id % 10 = 0 THEN concat('shared', doc_id % 70 * 10) ELSE concat('n', doc_id) END, '.md') AS path,
  concat('---', {NL}, 'type: ', CASE doc_id % 13 WHEN 0 THEN 'problem' WHEN 1 THEN 'initiative' WHEN 2 THEN 'node' WHEN 3 THEN 'playbook' WHEN 4 THEN 'decision' WHEN 5 THEN 'intelligence-summary' WHEN 6 THEN 'area' WHEN 7 THEN 'experiment' WHEN 8 THEN 'metric' WHEN 9 THEN 'insight' WHEN 10 THEN 'capture' ELSE 'note' END, {NL}, CASE WHEN doc_id % 5 = 3 THEN concat('tags: raw, inbox', {NL}) ELSE '' END,
    CASE WHEN doc_id % 2 = 0 THEN concat('metric: m', doc_id % 9, {NL}, 'confidence: high', {NL}, 'date: 2024-01-0', doc_id % 9 + 1, {NL}) ELSE '' END, CASE WHEN doc_id % 3 = 1 THEN concat('entity: e', doc_id % 11, {NL}, 'category: c', {NL}, 'node_type: hub', {NL}, 'entity_count: ', doc_id % 5, {NL}) ELSE '' END,
    CASE WHEN doc_id % 3 <> 0 THEN concat('status: ', CASE doc_id % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'proposed' WHEN 2 THEN 'resolved' ELSE 'open' END, {NL}) ELSE '' END,
    CASE WHEN doc_id % 4 <> 1 THEN concat('area: ', source, {NL}) ELSE concat('area:', {NL}) END, 'title: n', doc_id, {NL}, '---', {NL},
    CASE WHEN doc_id % 8 < 5 THEN concat('see [[n', doc_id % 97 + 1, '#part|label]] and [[', source, '/n', doc_id + 1, '.md]] or [[shared', doc_id % 30 * 10, '/]]', {NL}) ELSE '' END, text) AS body
FROM documents""",
    ),
}


def derive(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables, sql = VIEWS[name]
    return spark.sql(_spark_sql(sql, tables[0]), t=table(spark, sf_dir, tables[0]))


def _spark_sql(sql: str, table: str) -> str:
    """Braces of the text are kept; the table becomes a parameter."""
    return sql.replace("{", "{{").replace("}", "}}").replace(f"FROM {table}", "FROM {t}")


def with_views(sql: str, *names: str) -> str:
    """The SQL of a check with the views that it reads as common table expressions."""
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in names)
    rest = sql.strip()
    if not names:
        return rest
    return f"WITH {ctes},\n{rest[5:]}" if rest.upper().startswith("WITH ") else f"WITH {ctes}\n{rest}"

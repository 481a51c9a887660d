"""Complete records of links, their order, and counts that are seen while a table is written."""

from pyspark.sql import functions as F

from quillgraph.operators import links as L
from quillgraph.sources import files, sinks


def test_records_in_order(spark):
    links = spark.createDataFrame([("https://n.org/a/b?x", "r2"), ("https://n.org/a/b?x", "r1"), ("https://n.org/t", "r1"), ("https://kb.org/article/1234#x", "r1"), ("https://docs.google.com/d", "r3"), ("https://gone.org/", "r4"), ("https://in.org/", "r5")], "url string, ref string")
    known = spark.createDataFrame([("https://kb.org/article/1234",)], "url string")
    answers = spark.createDataFrame([
        ("https://n.org/a/b?x", 200, None, "<html><title> A &amp; B </title>text</html>", "https://M.org/x/y?z#w", "text/html; charset=utf-8"), ("https://n.org/t", 200, None, "plain", "https://m.org", "text/plain"),
        ("https://docs.google.com/d", 200, None, "body", "https://docs.google.com/d", "text/html"), ("https://gone.org/", 404, None, None, "https://gone.org/", ""), ("https://in.org/", 200, None, "please sign in", "https://in.org/", "text/html"),
    ], "url string, http_status int, error string, body string, final_url string, content_type string")
    listed = L.inventory(links, known, answers.select("url", "http_status", "error", "body"), [])
    got = {r.position: r for r in L.in_order(L.records(listed, L.listed(links, 3), answers)).collect()}
    assert [(got[i].status, got[i].url) for i in sorted(got)] == [
        ("auth-gated", "https://in.org/"), ("blocked", "https://gone.org/"), ("local-support-evidence", "https://kb.org/article/1234#x"), ("mirrored", "https://n.org/a/b?x"), ("mirrored", "https://n.org/t"), ("needs-google-drive", "https://docs.google.com/d"),
    ]
    assert (got[4].title, got[4].final_domain, got[4].mirror_path, got[4].refs, got[4].n_refs) == ("A & B", "m.org", "m.org/x-y.md", ["r1", "r2"], 2)
    assert (got[5].title, got[5].mirror_path) == ("https://n.org/t", "m.org/m-org.md") and got[2].title is None and got[2].final_url == "https://gone.org/"
    assert got[6].final_url is None and got[3].http_status is None and got[1].title == "https://in.org/" and got[1].mirror_path is None


def test_a_record_for_each_fetch(spark):
    """A URL fetched twice: each record says what its own fetch came to."""
    links = spark.createDataFrame([("https://n.org/a", "r1")], "url string, ref string")
    known = spark.createDataFrame([], "url string")
    answers = spark.createDataFrame([("https://n.org/a", 200, None, "<title>one&amp</title>", "https://n.org/a", "text/html"), ("https://n.org/a", 404, None, "gone", "https://n.org/b", "text/html")], "url string, http_status int, error string, body string, final_url string, content_type string")
    listed = L.inventory(links, known, answers.select("url", "http_status", "error", "body"), [])
    got = sorted((r.status, r.http_status, r.final_url, r.title) for r in L.records(listed, L.listed(links, 3), answers, ended=True).collect())
    assert got == [(s, *a) for s in ("blocked", "mirrored") for a in ((200, "https://n.org/a", "one&amp"), (404, "https://n.org/b", None))]
    ordered = sorted((r.position, r.status, r.http_status) for r in L.in_order(L.records(listed, L.listed(links, 3), answers)).collect())
    assert ordered == [(1, "blocked", 200), (2, "blocked", 404), (3, "mirrored", 200), (4, "mirrored", 404)]


def test_counts_are_seen_while_writing(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    rows = spark.range(1000).mapInPandas(counted, "id long")
    counts = sinks.write_inventories({"wiki_pages": rows.select(F.col("id").cast("string").alias("title")), "empty": rows.where("id < 0")}, str(tmp_path / "out"))
    assert counts == {"wiki_pages": 1000, "empty": 0} and read.value == 2000  # each table was read once
    assert files.inventory(spark, str(tmp_path / "out" / "wiki_pages"), "wiki_pages", lines=True).count() == 1000


def test_code_and_repo_notes(spark):
    """A note lists symbols, the leading comment, counts and risks of its file."""
    from quillgraph.operators import note_pages as Np

    body = "// loads accounts\nclass Loader {\nfunction loadAll() { try { x(); } catch (e) { } }\n// TODO: split\nconsole.log(1);\n"
    code = spark.createDataFrame([(2, "web", "src/load.js", "other"), (1, "web", "src/load.js", body), (3, "web", "b.js", "x"), (4, "api", "README.md", "r")], "file_id int, repo string, path string, body string")
    refs = spark.createDataFrame([("web", "src/load.js", 3, "function loadAll", 2, 0, 1, ["7", "9"], [], ["billing"])], "repo string, path string, line_number int, sample string, n_support long, n_wiki long, n_topic long, support array<string>, wiki array<string>, topics array<string>")
    (note,) = Np.code_notes(refs, code, []).collect()
    for part in ('language: "JavaScript"', "# web/src/load.js", "- Classes: `Loader`", "- Functions: `loadAll`", "loads accounts", "- First line: `3`", "- Support notes: `2`", "- [[note-7]]\n- [[note-9]]", "- [[billing]]", "## Risks\n\n- "):
        assert part in note.body, (part, note.body)
    assert "## Wiki notes" not in note.body
    listed = code.select("repo", "path")
    got = {r.repo: r.body for r in Np.repo_notes(files.repo_snapshot(listed), listed, spark.createDataFrame([("web", "Billing")], "repo string, topic string")).collect()}
    assert "- Top-level directories: `src`" in got["web"] and "- [[Capability - Billing]]" in got["web"] and "- `b.js`\n- `src/load.js`" in got["web"]
    assert "- Key files: `README.md`" in got["api"] and "- [[Product Capability Map]]" in got["api"] and "(none found)" in got["api"]

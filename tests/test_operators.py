"""Operators on small fixtures; readers, writers, configuration and refresh."""

import zipfile

from pyspark.sql import functions as F

from quillgraph.operators import code_search as Cs
from quillgraph.operators import graph as G
from quillgraph.operators import links as L
from quillgraph.operators import notes as N
from quillgraph.operators import topics as To
from quillgraph.plans import manifest as M
from quillgraph.sources import files, sinks
from quillgraph.streaming import refresh


def test_inventory(spark):
    links = spark.createDataFrame([("https://kb.org/article/1234#x", "a"), ("https://docs.google.com/d", "a"), ("https://old.org/", "b"), ("https://n.org/", "b"), ("https://team.zendesk.com/x", "c"), ("https://n.org/", "c")], "url string, ref string")
    known = spark.createDataFrame([("https://kb.org/article/1234?y",)], "url string")
    fetched = spark.createDataFrame([("https://n.org/", 200, None, "body"), ("https://team.zendesk.com/x", 403, None, None)], "url string, http_status int, error string, body string")
    got = {r.url: (r.status, r.n_refs) for r in L.inventory(links, known, fetched, ["old.org"]).collect()}
    assert got == {"https://kb.org/article/1234#x": ("local-support-evidence", 1), "https://docs.google.com/d": ("needs-google-drive", 1), "https://old.org/": ("stale-doc-reference", 1), "https://n.org/": ("mirrored", 2), "https://team.zendesk.com/x": ("auth-gated", 1)}


def test_topics_and_related(spark):
    profile = [To.Topic("a", "A", ("alpha", "beta"), ("r1", "r2")), To.Topic("b", "B", ("gamma",), ("r2", "r3"))]
    notes = spark.createDataFrame([(i, "Alpha" if i % 2 else "x", "gamma" if i < 20 else "none", "p", "wiki" if i % 5 == 0 else "support") for i in range(40)], "note_id long, title string, body string, path string, kind string")
    done = To.classify(notes, profile).select("note_id", "kind", "topics", To.repos_of(F.col("topics"), profile).alias("repos"))
    got = {r.note_id: (r.topics, r.repos) for r in done.collect()}
    assert got[1] == (["a", "b"], ["r1", "r2", "r3"]) and got[0] == (["b"], ["r2", "r3"]) and got[22] == (["platform-core"], [])
    refs = spark.createDataFrame([(2, [17, 2, 1]), (10, [15])], "note_id long, refs array<long>")
    near = {r.note_id: (r.related_support, r.related_wiki) for r in To.related(done, refs, limit=3).collect()}
    # note 2 is on b alone, whose support notes are 1, 2, 3, 4, ... and whose wiki notes are 0, 5, 10, 15; it refers to 17 and 1
    assert near[2] == ([17, 1, 3], [0, 5, 10]) and near[0] == ([1, 2, 3], [5, 10, 15]) and near[10] == ([1, 2, 3], [15, 0, 5])
    # note 1 is on a (odd notes) before b (all below 20)
    assert near[1] == ([3, 7, 9], [5, 15, 25]) and near[22] == ([24, 26, 28], [20, 30])
    # topics are gathered up to the limit and no further
    few = spark.createDataFrame([(1, "support", ["x", "y"]), (2, "support", ["x"]), (3, "support", ["y"]), (4, "support", ["y", "x"])], "note_id long, kind string, topics array<string>")
    assert {r.note_id: r.related_support for r in To.related(few).collect()} == {1: [2, 4, 3], 2: [1, 4], 3: [1, 4], 4: [1, 3, 2]}


def test_rollups(spark):
    notes = spark.createDataFrame([(i, f"n{i:02}", ["a", "b"] if i % 2 else ["a"], "wiki", [f"u{i % 3}"]) for i in range(30)], "note_id long, stem string, topics array<string>, kind string, urls array<string>")
    got = {r.topic: (r.n_notes, r.more, r["first"]) for r in To.rollup_lists(notes, 4).collect()}
    assert got == {"a": (30, 26, ["n00", "n01", "n02", "n03"]), "b": (15, 11, ["n01", "n03", "n05", "n07"])}
    records = spark.createDataFrame([("u0", "blocked"), ("u1", "mirrored"), ("u2", "blocked")], "url string, status string")
    assert {tuple(r) for r in To.topic_links(notes, records).collect()} == {("a", "blocked", 20), ("a", "mirrored", 10), ("b", "blocked", 10), ("b", "mirrored", 5)}


def test_code_search(spark):
    profile = [To.Topic("t", "T", ("load", "ci"), ("r",)), To.Topic("u", "U", ("load",), ())]
    table = spark.createDataFrame([("other", "z.py", "load"), ("r", "a.py", "x\nload a\nLOAD b\nload\nload"), ("r", "package-lock.json", "load\nload"), ("r", "vendor/x.py", "load"), ("r", "b.py", "ci"), ("r", "c.py", "load")], "repo string, path string, body string")
    found = Cs.hits(table, profile)
    assert {(r.path, r.score, r.line_number) for r in found.collect()} == {("a.py", 3, 2), ("package-lock.json", 2, 1), ("c.py", 1, 1)}
    kept = Cs.prune(Cs.top(found))
    assert [r.path for r in kept.orderBy("place").collect()] == ["a.py", "c.py", "package-lock.json"]
    notes = spark.createDataFrame([(1, "wiki", ["t"], ["about c.py load py"])], "note_id long, kind string, topics array<string>, keywords array<string>")
    picked = Cs.for_notes(notes, kept)
    assert [(r.path, r.points) for r in picked.orderBy("place").collect()] == [("a.py", 4), ("c.py", 2), ("package-lock.json", -1)]
    assert Cs.hits(table, profile[1:]).count() == 0
    many = picked.unionByName(picked.withColumns({"note_id": F.lit(12).cast("long"), "kind": F.lit("support")})).unionByName(picked.withColumn("note_id", F.lit(9).cast("long")))
    row = Cs.registry(many, kept, (60, 1, 40)).where("path = 'a.py'").first()
    assert (row.n_support, row.n_wiki, row.n_topic, row.support, row.wiki, row.topics, row.line_number) == (1, 2, 1, ["12"], ["1"], ["t"], 2)
    assert Cs.registry(picked.limit(0), kept).count() == 3


def test_names_in_a_long_run_of_capitals(spark):
    """Java's stack held some 1,500 words of such a run."""
    run = "Setup " + "Word " * 20_000
    rows = [("Posted\n- Ada Byron\nx",), ("Posted\n- Ada Byron\nx",), (run + "Ada Byron",), (run + "Ada Byron9",), (run + "End",)]
    got = sorted(r.text for r in N.redacted(spark.createDataFrame(rows, "text string").repartition(2)).collect())
    assert got == sorted(["Posted\n- [REDACTED_PERSON]\nx"] * 2 + [run + "[REDACTED_PERSON]", run + "Ada Byron9", run + "End"])


def test_names_and_wikilinks(spark):
    texts = spark.createDataFrame([("Posted\n- Ada Byron\nx",), ("x\n## Ada Byron\ny\nz\nAuthor",), ("- Best Practices\nPosted",), ("- Jo Doe\n1\n2\n3\n4\nposted",)], "text string")
    assert [tuple(r) for r in N.person_names(texts).collect()] == [("Ada Byron", 2)]
    assert "[REDACTED_PERSON]" in N.redacted(texts).first().text
    people = [f"{a} {b}" for a in ("Ada", "Bea", "Cleo", "Dora") for b in ("Byron", "Moss", "Noether Klein", "Stone")]
    rows = [(f"Posted\n- {p}\nx",) for p in people for _ in range(2)] + [("Dear Ada Byron Moss and Bea Noether Klein, Ada Nobody, Adax Byron, Cleo Noether",), (None,)]
    text = N.redacted(spark.createDataFrame(rows, "text string")).where("text LIKE 'Dear%' OR text IS NULL").orderBy("text").collect()
    assert text[0].text is None and text[1].text == "Dear [REDACTED_PERSON] Moss and [REDACTED_PERSON], Ada Nobody, Adax Byron, Cleo Noether"
    notes = spark.createDataFrame([(1, "a/b.md", "See [here](https://kb.org/article/1234) and [w](c.md#x), [no](d.md); Article 1234, article 9999."), (2, "z.md", "nothing")], "note_id long, path string, body string")
    articles = spark.createDataFrame([("1234", "S")], "article_id string, stem string")
    pages = spark.createDataFrame([("a/c.md", "W")], "path string, stem string")
    got = {r.note_id: r.body for r in N.wikified(notes, articles, pages).collect()}
    assert got == {1: "See [[S|here]] and [[W|w]], [no](d.md); [[S|Article 1234]], article 9999.", 2: "nothing"}


def test_graph(spark):
    notes = spark.createDataFrame([("a/n1.md", "---\ntype: problem\nstatus: open\nstatus: resolved\n---\n[[n2|x]] [[b/n3#h]] [[n9]]"), ("a/n2.md", ""), ("b/n3.md", "[[same]]"), ("c/same.md", ""), ("d/same.md", "")], "path string, body string")
    known = G.nodes(notes)
    resolved = G.resolve(G.edges(notes), known)
    assert {(r.target, r.dst) for r in resolved.collect()} == {("n2", "a/n2.md"), ("b/n3", "b/n3.md"), ("n9", None), ("same", None)}
    degree = G.degrees(known, resolved)
    assert {r.path for r in G.orphans(degree).collect()} == {"c/same.md", "d/same.md"}
    assert [tuple(r) for r in G.duplicate_stems(known).collect()] == [("same", 2)]
    assert [(r.path, r.missing) for r in G.missing_fields(known).collect()] == [("a/n1.md", ["area"])]
    assert G.view(known, "problem", without=["resolved"]).count() == 0


def test_conflicts(spark):
    row = spark.createDataFrame([("on GitLab", 0, 1, 0, 2, 0), ("on gitlab", 2, 0, 0, 0, 0), ("x", 0, 0, 0, 1, 3)], "t string, s int, b int, d int, r int, h int")
    got = [r[0] for r in row.select(N.conflicts(*(F.col(c) for c in "tsbdrh"))).collect()]
    assert got == [["restricted-source", "code-traceability-gap", "documentation-drift"], ["documentation-drift"], []]


def test_conflicts_from_links_and_hits(spark):
    notes = spark.createDataFrame([(1, "on GitLab", ["r"]), (2, "x", []), (3, "y", ["r"]), (4, "z", ["r"])], "note_id long, body string, repos array<string>")
    links = spark.createDataFrame([(1, "u"), (1, "u"), (2, "v"), (2, "w"), (3, "d")], "note_id long, url string")
    records = spark.createDataFrame([("u", "stale-doc-reference"), ("v", "blocked"), ("w", "mirrored"), ("d", "needs-google-drive")], "url string, status string")
    hits = spark.createDataFrame([(1,), (4,), (4,)], "note_id long")
    got = {r.note_id: (r.n_links, r.n_stale, r.n_hits, r.conflicts) for r in N.with_conflicts(notes, links, records, hits).collect()}
    assert got == {1: (1, 1, 1, ["documentation-drift"]), 2: (2, 0, 0, ["restricted-source"]), 3: (1, 0, 0, ["restricted-source", "code-traceability-gap"]), 4: (0, 0, 2, [])}


def test_saved_views(spark):
    notes = spark.createDataFrame([("a/x.md", "---\ntype: metric\narea: a\nstatus: s\n---\n"), ("a/y.md", "---\ntype: node\ntags: [raw, Inbox]\n---\n"), ("b/z.md", "---\ntype: other\ntags: inboxes\n---\n")], "path string, body string")
    known = G.nodes(notes)
    assert {(r["view"], r.path, tuple(r.shown)) for r in G.saved_views(known).collect()} == {("Metrics", "a/x.md", ("a", "s")), ("Hub Nodes", "a/y.md", ("", "", "")), ("Inbox", "a/y.md", ("node", ""))}
    assert {r.path for r in G.below(known, "a").collect()} == {"a/x.md", "a/y.md"} and G.below(known, "a/x").count() == 0


def test_sources(spark, tmp_path):
    root = tmp_path / "my corpus"
    (root / "sub").mkdir(parents=True)
    (root / "12345-how-to.md").write_text("# How to\n\nsee https://a.test.org/x. and\nmore")
    (root / "sub" / "page+1.md").write_text("plain")
    got = {r.relative_path: r for r in files.support_articles(spark, str(root), "https://kb/{article_id}").collect()}
    assert got["12345-how-to.md"].source_url == "https://kb/12345" and got["12345-how-to.md"].link_count == 1 and got["12345-how-to.md"].text.endswith("more")
    assert got["sub/page+1.md"].category == "reference-doc" and got["sub/page+1.md"].title == "plain"
    assert {(r.relative_path, r.section) for r in files.wiki_pages(spark, str(root)).collect()} == {("12345-how-to.md", "root"), ("sub/page+1.md", "sub")}
    assert files.wiki_pages(spark, None).count() == 0
    assert [tuple(r) for r in files.refs(files.texts(spark, str(root)), "wiki/").collect()] == [("https://a.test.org/x", "wiki/12345-how-to.md")]
    body = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Hi</w:t></w:r></w:p><w:p><w:r><w:t>you</w:t></w:r></w:p></w:body></w:document>'
    with zipfile.ZipFile(root / "a.docx", "w") as z:
        z.writestr("word/document.xml", body)
    (root / "bad.docx").write_bytes(b"no zip")
    docs = {r.relative_path: r for r in files.docx(spark, str(root)).collect()}
    assert docs["a.docx"].text == "Hi\nyou" and docs["bad.docx"].error.startswith("BadZipFile")


def test_snapshot(spark):
    table = spark.createDataFrame([("r", p) for p in ("README.md", "src/a.py", "apps/web/x.js", "apps/ios/y.m", "services/pay/z.go", ".git/x", "package.json")], "repo string, path string")
    row = files.repo_snapshot(table).first()
    assert row.top_dirs == ["apps", "services", "src"] and row.key_files == ["README.md", "package.json"] and row.monorepo_apps == ["ios", "web"] and row.monorepo_services == ["pay"]


def test_sinks(spark, tmp_path):
    notes = spark.createDataFrame([("s", "A?b", "x  \ny\n\n")], "section string, name string, body string")
    sinks.write_notes(notes, str(tmp_path / "n"))
    sinks.write_notes(notes.limit(0), str(tmp_path / "n"), overwrite=False)
    row = spark.read.parquet(str(tmp_path / "n")).first()
    assert (row["name"], row["body"], row["section"]) == ("Ab", "x\ny\n", "s")
    rendered = notes.select(sinks.render_note(F.col("name"), {"type": F.lit("note")}, [("Links", F.array(F.lit("l")), "None."), ("Gaps", F.array().cast("array<string>"), "None.")], F.col("body"))).first()[0]
    assert rendered.startswith('---\ntype: "note"\n---\n\n# A?b\n\n## Links\n\n- l\n\n## Gaps\n\nNone.')


def test_manifest(spark):
    good = M.defaults("My Product")
    assert {r.field for r in M.violations(spark, good).where("level = 'error'").collect()} == {"repositories.items"} and len(good["engineering_readiness"]["categories"]) >= 8
    whole = {"owner": "o", "name": "a", "role": "x", "default_branch": "main", "local_path": "/a", "url": "u"}
    good["repositories"]["items"] = [whole]
    assert M.violations(spark, good).where("level = 'error'").count() == 0
    assert {r.field for r in M.violations(spark, good, lambda at: at != "/a").where("level = 'warning'").collect()} == {"automation_pack", "repositories.items[0].local_path"}
    bad = {k: v for k, v in good.items() if k != "profile"} | {"product": [], "repositories": good["repositories"] | {"items": [whole, {"name": "a", "role": "y"}, "odd"]}}
    fields = {r.field for r in M.violations(spark, bad).where("level = 'error'").collect()}
    assert {"profile", "profile.intelligence_path", "product", "product.name", "repositories.items", "repositories.items[1].local_path", "repositories.items[2]"} <= fields
    assert str(M.repo_path(good, "x")) == "/a" and M.repo_path(good, "z") is None


def test_readiness(spark):
    rows = spark.createDataFrame([("k", "Tests", "done", 3, "Good.", ["e"], [], ["n"]), ("l", None, "odd", None, None, None, ["m"], None)], "key string, title string, status string, ask int, summary string, evidence array<string>, missing array<string>, next_steps array<string>")
    assert {tuple(r) for r in M.readiness(rows).collect()} == {("done", 1), ("missing", 1)}
    body = {r.key: r.body for r in M.report(rows).collect()}
    assert body == {"k": "### Tests\n\n- Ask: 3\n- Status: done\n- Summary: Good.\n- Evidence:\n  - e\n- Next steps:\n  - n", "l": "### l\n\n- Ask: \n- Status: missing\n- Missing:\n  - m"}


def test_refresh(spark, tmp_path):
    before = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    now = spark.createDataFrame([(1, "a"), (2, "B"), (4, "d")], "k int, v string")
    assert {tuple(r) for r in refresh.changes(now, before, "k", "v").collect()} == {(2, "changed"), (3, "removed"), (4, "added")}
    for part in (before, now):
        part.write.mode("append").parquet(str(tmp_path / "in"))
        refresh.refresh(spark, str(tmp_path / "in"), "k int, v string", lambda df: df.where("k > 1"), str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4

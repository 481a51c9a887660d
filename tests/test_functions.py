"""Text scalars against plain specifications, and the traps of the survey."""

import html
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgraph.functions import code as C
from quillgraph.functions import lists as L
from quillgraph.functions import privacy as P
from quillgraph.functions import text as T
from quillgraph.functions import urls as U

TEXTS = st.lists(st.text(alphabet="aB1 -_.#*`|\n é~(", max_size=40), min_size=1, max_size=25)


def rows(spark, values, *columns):
    return [tuple(r) for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").orderBy("i").select(*columns).collect()]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(TEXTS)
def test_scalars(spark, values):
    x = F.col("x")
    got = rows(spark, values, T.normalize(x), T.dedupe_key(x), T.slug(x), T.safe_filename(x), T.tokens(x), L.unique_lines(T.lines(x), 3))
    for v, (norm, key, slug, name, toks, uniq) in zip(values, got, strict=True):
        assert norm == " ".join(v.split())
        assert key == re.sub("[^a-z0-9]+", "", v.lower())
        assert slug == (re.sub("[^A-Za-z0-9]+", "-", v).strip("-").lower()[:120] or "item")
        kept = re.sub("[^A-Za-z0-9 ._-]+", "", v)
        assert name == (kept.strip(" ")[:120].rstrip(" .") or "Untitled")
        assert sorted(toks) == sorted(set(re.findall("[A-Za-z0-9]{3,}", v.lower())))
        want, seen = [], set()
        for line in v.split("\n"):
            k = re.sub("[^a-z0-9]+", "", line.lower())
            if k and k not in seen and len(want) < 3:
                seen.add(k)
                want.append(" ".join(line.split()))
        assert uniq == want


def test_titles(spark):
    values = ["12-foo-3d-bar", "a|b `c`", "", "# One\n## Two", "plain\n# Late", "\n\n   first line  \nsecond"]
    got = rows(spark, values, T.display_title(F.col("x")), T.page_title(F.col("x"), F.lit("none")), T.note_title(F.col("x"), F.lit("9-fall-back")))
    assert got[0][0] == "Foo 3D Bar" and got[1][0] == "a b 'c'" and got[2] == ("Untitled", "none", "Fall Back")
    assert got[3][1:] == ("One", "One") and got[4][1:] == ("Late", "Late") and got[5][1] == "first line"


def test_urls(spark):
    values = ["https://a.test.org/x).", "http://example.com/", "https://x.internal/a", "ftp://a.b", "https://nodot/", "https://a.test.org/${id}", "https://KB.test.org:8080/article/12345?x#y", "https://docs.google.com/d"]
    got = rows(spark, values, U.clean_url(F.col("x")), U.host(F.col("x")), U.known_article_url(F.col("x")), U.special_status(F.col("x"), ["a.test.org"]))
    assert [g[0] for g in got] == ["https://a.test.org/x", None, None, None, None, None, values[6], values[7]]
    assert got[6][1:3] == ("kb.test.org", "https://KB.test.org:8080/article/12345")
    assert got[0][3] == "stale-doc-reference" and got[7][3] == "needs-google-drive" and got[2][3] is None


def test_fetch_status(spark):
    df = spark.createDataFrame([(401, None, "x"), (500, None, "x"), (None, "timeout", None), (200, None, ""), (200, None, "Please Log in"), (200, None, "ok")], "s int, e string, b string")
    assert [r[0] for r in df.select(U.fetch_status(F.col("s"), F.col("e"), F.col("b"))).collect()] == ["auth-gated", "blocked", "blocked", "binary-or-empty", "auth-gated", "mirrored"]


def test_redaction(spark):
    text = "x http://u:p@h.org/ me@mail.org 10.0.0.1 172.16.3.4 172.32.0.1 192.168.1.1 Ada Lovelace Ada"
    out = rows(spark, [text], P.redact_names(P.redact(F.col("x")), F.array(F.lit("Ada Byron"), F.lit("Ada Lovelace"))))[0][0]
    assert out == "x http://[REDACTED_CREDENTIALS]@h.org/ [REDACTED_EMAIL] [REDACTED_PRIVATE_IP] [REDACTED_PRIVATE_IP] 172.32.0.1 [REDACTED_PRIVATE_IP] [REDACTED_PERSON] Ada"


def test_code(spark):
    body = "#!/bin/sh\n\n/* Loads\n * things */\n// and more\nclass Foo {\nexport async function loadIt(a) { }\n// TODO\n} catch (e) { return null; }\nconsole.log(1)"
    x = F.col("x")
    comments, classes, functions, risks = rows(spark, [body], C.leading_comments(x), C.symbols(x, "classes"), C.symbols(x, "functions"), C.risks(x, F.lit("a/.gitlab-ci/x.js")))[0]
    assert comments == ["Loads", "things", "and more"] and classes == ["Foo"] and functions == ["loadIt"]
    assert risks == ["todo", "debug-log", "swallowed-error", "legacy-path"]
    paths = ["Dockerfile", "a/Fastfile", "x.TSX", "x", ".py", "src/api/userAuth.service.js"]
    got = rows(spark, paths, C.language(x), C.is_code(x), C.path_focus(x))
    assert [g[0] for g in got] == ["Dockerfile", "Ruby DSL", "TSX", "Code", "Code", "JavaScript"]
    assert [g[1] for g in got] == [True, True, True, False, False, True] and got[5][2] == ["user auth.service"]


def test_analysis(spark):
    body = "\t// handles  billing\r\n\t\t# more\nclass UserAccount {\nfunction loadItem(a) { fetch(u) }\n// Redis"
    sample = "  loadItem(a)\t{ "
    a = rows(spark, [body], C.analysis(F.col("x"), F.lit("src/billing/userAuth.js"), F.lit(sample), ["old.org"]))[0][0]
    assert (a.language, a.artifact_kind, a.comments, a.classes, a.functions) == ("JavaScript", "Service or integration module", ["handles billing", "more"], ["UserAccount"], ["loadItem"])
    assert a.implementation == ["kind: Service or integration module", "classes: UserAccount", "functions: loadItem", "shows: http", "systems: Redis"]
    assert a.intentions == ["handles billing", "more", "path: billing, user auth", "symbols: user account, load item", "matches: loadItem(a) {"]
    assert (a.risks, a.conflicts) == ([], [])
    plain = rows(spark, [""], C.analysis(F.col("x"), F.lit("src/lib/app"), F.lit(None).cast("string"), []))[0][0]
    assert plain.intentions == ["found by search: code artifact"]


def test_white_space(spark):
    values = ["\t// one\n \t/* two\r\n\t * three */\nx", "\t \r\n\t\u00a0Title \t\r\nrest", "\t a/b.md/ \r"]
    got = rows(spark, values, C.leading_comments(F.col("x")), T.page_title(F.col("x"), F.lit("none")), T.link_target(F.col("x")), T.imported_markdown(F.col("x")))
    assert got[0][0] == ["one", "two", "three"] and got[1][1] == "Title" and got[2][2] == "a/b" and got[1][3] == "Title\nrest"
    assert rows(spark, ["\tc.md#x\t"], T.wiki_target(F.col("x"), F.lit("a/b.md")))[0][0] == "a/c.md"


def test_entities(spark):
    values = ["a &amp; b &lt;&gt; &#65;&#x42;", "&eacute;&nbsp;|&hellip; &amp;lt;", "&#0; &#x80; &#128512; &#99999999999;", "&copy 2 &ltx &notit; &nothing &", "none"]
    assert [r[0] for r in rows(spark, values, T.unescape(F.col("x")))] == [html.unescape(v) for v in values]


def test_entities_that_a_semicolon_ends(spark):
    values = ["a&amp;&amp", "&amp;lt;&lt;&lt &eacute;&#65;&#65 &notit; &copy 2", "&am", "cut &quot"]
    page = F.concat(F.lit("<title>"), F.col("x"), F.lit("</title>"))
    got = rows(spark, values, T.unescape(F.col("x"), ended=True), T.html_title(page, F.lit("none"), ended=True), T.html_text(page, ended=True))
    assert got == [(v,) * 3 for v in ["a&&amp", "&lt;<&lt éA&#65 &notit; &copy 2", "&am", "cut &quot"]]


def test_pages_with_cut_entities_match_sql(spark, tmp_path):
    import duckdb

    from quillgraph.plans import registry

    pages = [(i, f"https://a{i % 3}.test.org/x/{i}", f"<html><title>one &amp; two{cut}</title><script>x</script><p>1 &lt; 2 &quot;{cut}</p></html>") for i, cut in enumerate(["", "&amp", "&quot", "&am", "&amp;amp", "&", "&copy", "&lt"])]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("html_text", "html_title", "slugify_title", "mirror_files", "page_domain_top", "mirrored_tree", "scanned_sources"):
        df = registry.QUERIES[name](spark, str(tmp_path))
        found = con.execute(registry.ORACLE_SQL[name])
        names = [d[0] for d in found.description]
        assert sorted(map(tuple, df.select(names).collect()), key=str) == sorted(found.fetchall(), key=str), name


def test_signals(spark):
    text = "# Head\n\n- a bullet of some length\n- a bullet of some length\nA paragraph that goes on for more than thirty.\nhttps://a.test.org/x. Article 12345"
    s = rows(spark, [text], L.signals(F.col("x")))[0][0]
    assert (s.headings, s.bullets, s.paragraphs[0][:11], s.urls, s.article_refs) == (["Head"], ["a bullet of some length"], "A paragraph", ["https://a.test.org/x"], ["12345"])


def test_imported_markdown(spark):
    values = ["head\n*Source:* x\n---\n\nBody  \nComments\n\n*Source:* y\nmore", "a\n---\nb", "x\r\n\r\ny"]
    assert [r[0] for r in rows(spark, values, T.imported_markdown(F.col("x")))] == ["Body\nmore", "a\n---\nb", "x\ny"]

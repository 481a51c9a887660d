"""The frontmatter parser; expectations are written by hand."""

import pytest
from pyspark.sql import functions as F

from quillgraph.functions.frontmatter import parse
from quillgraph.operators import graph as G

CASES = [
    ("type: note\nstatus: open", {"type": ["note"], "status": ["open"]}),
    ("tags:\n  - inbox\n  - capture", {"tags": ["inbox", "capture"]}),
    ("tags:\n- a\n- 'b, c'\ntitle: x", {"tags": ["a", "b, c"], "title": ["x"]}),
    ("tags: [a, \"b, c\", 'd]e']\nn: 1", {"tags": ["a", "b, c", "d]e"], "n": ["1"]}),
    ("tags: []\nempty:\nnothing: ~\nnull_too: null", {"tags": [], "empty": [], "nothing": [], "null_too": []}),
    ('title: "say \\"hi\\"\\nthere \\u00e9"', {"title": ['say "hi"\nthere é']}),
    ("title: 'it''s: here' # note", {"title": ["it's: here"]}),
    ("title: plain # comment\nurl: http://x.org/#a", {"title": ["plain"], "url": ["http://x.org/#a"]}),
    ("text: |\n  one\n  two\n\nafter: x", {"text": ["one\ntwo"], "after": ["x"]}),
    ("text: >\n  one\n  two\nafter: x", {"text": ["one two"], "after": ["x"]}),
    ("long: this goes\n  on here\n  and here\nb: 2", {"long": ["this goes on here and here"], "b": ["2"]}),
    ('q: "starts\n  and ends"\nb: 2', {"q": ["starts and ends"], "b": ["2"]}),
    ("f: [a,\n  b,\n  c]\nb: 2", {"f": ["a", "b", "c"], "b": ["2"]}),
    ("# only a comment\n\na: 1\n\n# more\nb: 2", {"a": ["1"], "b": ["2"]}),
    ("a: 1\na: 2", {"a": ["2"]}),
    ("no key here\na: 1", {"a": ["1"]}),
    ("time: 10:30\nwith space: v", {"time": ["10:30"], "with space": ["v"]}),
    ("nested:\n  inner: 1\nb: 2", {"nested": [], "b": ["2"]}),
    ('entity: "unclosed', {"entity": ['"unclosed']}),
    ("items:\n  - \"x: y\"\n  -\n  - [z]", {"items": ["x: y", "", "[z]"]}),
]


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(i, f"---\n{block}\n---\nbody: no\n") for i, (block, _) in enumerate(CASES)] + [(-1, "no block"), (-2, None), (-3, "---\n---\n"), (-4, "---\r\na: 1\n---\n"), (-5, "---\na: 1\nnever closed")]
    return {r.i: r.f for r in spark.createDataFrame(rows, "i int, t string").select("i", parse(F.col("t")).alias("f")).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_block(parsed, i):
    assert parsed[i] == CASES[i][1]


def test_no_block(parsed):
    assert all(parsed[i] == {} for i in (-1, -2, -3, -4, -5))


def test_tags_and_required_fields(spark):
    notes = [("a.md", "---\ntype: problem\narea: [x]\nstatus:\n  - open\ntags:\n  - Inbox\n  - other\n---\n"), ("b.md", "---\ntype: 'problem'\narea: ''\nstatus: []\ntags: [raw, \"#inbox\"]\n---\n"), ("c.md", "---\ntype: node\nnode_type: >\n  hub\n  of hubs\ntags: outbox\n---\n")]
    known = G.nodes(spark.createDataFrame(notes, "path string, body string"))
    assert {r.path: r.missing for r in G.missing_fields(known).collect()} == {"b.md": ["area", "status"], "c.md": ["title"]}
    assert {r.path for r in G.tagged(known, "inbox").collect()} == {"a.md", "b.md"}
    assert {r.path: r.n for r in known.select("path", G.field("node_type").alias("n")).collect()}["c.md"] == "hub of hubs"

"""Hub notes; the expected texts are written by hand."""

from quillgraph.operators.hubs import Block, Hub, Part, render

FACTS = [
    *(("support", t, f"{i:03}", f"[[s{i}]]") for i in range(1, 6) for t in (["Billing", "Access"] if i % 2 else ["Billing"])),
    ("wiki", "ops", "b", "[[w2]]"), ("wiki", "ops", "a", "[[w1]]"), ("wiki", None, "c", "[[w3]]"),
    ("repo", "Billing", "1", "`web`"), ("repo", "Billing", "2", "`api`"), ("link", "mirrored", "u1", "u1"), ("link", "blocked", "u2", "u2"), ("link", "blocked", "u3", "u3"),
]
HUBS = [
    Hub("Support Hub", (Block((Part("text", "All articles."), Part("text"))), Block((Part("text", "## {section}"), Part("text"), Part("text", "- Note: [[Capability - {section}]]"), Part("list", fact="support", limit=3, more="- ... `{n}` more"), Part("inline", "- Repositories: {lines}", "repo"), Part("text")), over="support")), ("support", "hub"), related=("Home",)),
    Hub("Links", (Block((Part("total", "- Links: `{n}`", "link"), Part("total", "- Blocked: `{n}`", "link", "blocked"), Part("total", "- Stale: `{n}`", "link", "stale"), Part("counts", "- {one}: `{n}`", "link", top=True), Part("list", fact="link", limit=2, more="- {n} more"))),), kind="review"),
    Hub("Wiki", (Block((Part("text", "## {section}"), Part("total", "- Count: `{n}`", "wiki"), Part("list", fact="wiki", limit=25)), over="wiki"), Block((Part("counts", "{one}={n}", "nothing"), Part("list", fact="nothing"))))),
]


def test_render(spark):
    got = {r.hub: r.body for r in render(spark.createDataFrame(FACTS, "fact string, section string, ord string, line string").repartition(3), HUBS).collect()}
    assert got["Support Hub"].split("\n") == [
        "---", "type: hub", "source: generated", "tags:", "  - support", "  - hub", "---", "# Support Hub", "", "All articles.", "",
        "## Access", "", "- Note: [[Capability - Access]]", "- [[s1]]", "- [[s3]]", "- [[s5]]", "",
        "## Billing", "", "- Note: [[Capability - Billing]]", "- [[s1]]", "- [[s2]]", "- [[s3]]", "- ... `2` more", "- Repositories: `web`, `api`", "", "## Related notes", "", "- [[Home]]",
    ]
    assert got["Links"].split("\n") == ["---", "type: review", "source: generated", "---", "# Links", "", "- Links: `3`", "- Blocked: `2`", "- Stale: `0`", "- blocked: `2`", "- mirrored: `1`", "- u1", "- u2", "- 1 more"]
    assert got["Wiki"].split("\n")[6:] == ["## ", "- Count: `1`", "- [[w3]]", "## ops", "- Count: `2`", "- [[w1]]", "- [[w2]]"]


def test_sections_beyond_the_limit_are_counted(spark):
    hub = Hub("H", (Block((Part("text", "## {section}"), Part("list", fact="f", limit=1, more="- {n} more")), over="f", limit=2), Block((Part("text", "end"),))))
    facts = [("f", f"s{i}", str(j), f"l{j}") for i in range(5) for j in range(3)]
    (got,) = render(spark.createDataFrame(facts, "fact string, section string, ord string, line string"), [hub]).collect()
    assert got.body.split("\n")[4:] == ["# H", "", "## s0", "- l0", "- 2 more", "## s1", "- l0", "- 2 more", "... `3` more sections", "end"]


def test_no_facts(spark):
    got = {r.hub: r.body for r in render(spark.createDataFrame([], "fact string, section string, ord string, line string"), HUBS).collect()}
    assert "- Links: `0`" in got["Links"] and got["Wiki"].endswith("# Wiki\n")

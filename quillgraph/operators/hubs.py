"""Hub, map, log and index notes: many documents out of one table of facts, in one pass for all of them.

A fact is a row of fact (its kind), section, ord and line. What a hub shows is a specification: blocks of parts, once or for every
section of a fact. All counts come from one GROUPING SETS aggregate, all lists from one ranking whose limit acts below the shuffle, and
all lines of all hubs meet in one small aggregate: no hub has a job of its own, and no list grows with the data."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import saved

ALL = "*"  # the section that stands for all sections of a fact
MOST = 200  # lines of a list, and sections of a block, at most: how many more there are is told


@dataclass(frozen=True)
class Part:
    """One piece of a block. kind: text (a line), total (a line with {n}), list (lines of a fact, then `more` with {n} if there are
    further ones), inline (the lines of a fact in one line, at {lines}), counts (a line for each section of a fact, with {section}
    and {n}, the most frequent first if `top`). `section` names a section other than the block's; {section} is the block's."""

    kind: str
    text: str = ""
    fact: str = ""
    section: str = ""
    limit: int = MOST
    more: str = ""
    top: bool = False


@dataclass(frozen=True)
class Block:
    """Parts that are shown once, or for each section of the fact `over`, in order of sections; after `limit` of them, how many more."""

    parts: tuple[Part, ...]
    over: str = ""
    limit: int = MOST
    more: str = "... `{n}` more sections"


@dataclass(frozen=True)
class Hub:
    name: str
    blocks: tuple[Block, ...]
    tags: tuple[str, ...] = field(default=())
    kind: str = "hub"
    related: tuple[str, ...] = field(default=())
    folder: str = ""

    @property
    def key(self) -> str:
        return f"{self.folder}/{self.name}" if self.folder else self.name


def head(hub: Hub) -> list[str]:
    tags = ["tags:", *(f"  - {t}" for t in hub.tags)] if hub.tags else []
    return ["---", f"type: {hub.kind}", "source: generated", *tags, "---", f"# {hub.name}", ""]


def specification(hubs: list[Hub]) -> list[tuple]:
    """(hub, block, part, over, most, kind, text, fact, section, lim, more, top) rows."""
    rows = []
    for hub in hubs:
        before = Block(tuple(Part("text", line) for line in head(hub)))
        after = Block(tuple(Part("text", line) for line in (["## Related notes", "", *(f"- [[{r}]]" for r in hub.related)] if hub.related else [])))
        for b, block in enumerate((before, *hub.blocks, after)):
            rows += [(hub.key, b, i, block.over, block.limit, p.kind, p.text, p.fact, p.section, p.limit, p.more, p.top) for i, p in enumerate(block.parts)]
            if block.over:
                rows.append((hub.key, b, len(block.parts), "", block.limit, "rest", block.more, block.over, "", block.limit, "", False))
    return rows


SPEC = "hub string, block int, part int, over string, most int, kind string, text string, fact string, section string, lim int, more string, top boolean"


def counted(facts: DataFrame) -> DataFrame:
    """fact, section (ALL for a whole fact), n: by GROUPING SETS."""
    sets = facts.sparkSession.sql("SELECT fact, section, grouping(section) AS whole, count(*) AS n FROM {facts} GROUP BY GROUPING SETS ((fact, section), (fact))", facts=facts)
    return sets.select("fact", F.when(F.col("whole") == 1, ALL).otherwise(F.col("section")).alias("section"), "n")


def first_lines(facts: DataFrame, limit: int) -> DataFrame:
    """fact, section, rank, line: the first lines of each section, and of each fact as a whole (section ALL), by ord."""
    each = facts.select("fact", F.explode(F.array("section", F.lit(ALL))).alias("section"), "ord", "line")
    return each.withColumn("rank", F.row_number().over(Window.partitionBy("fact", "section").orderBy("ord", "line"))).where(F.col("rank") <= limit).drop("ord")


def render(facts: DataFrame, hubs: list[Hub]) -> DataFrame:
    """hub (folder and name), body for every hub of the list. facts: fact, section, ord, line (strings; null sections count as ''). A hub whose facts have
    no rows is rendered with zeros and without lines."""
    spark = facts.sparkSession
    rows = specification(hubs)
    spec = F.broadcast(spark.createDataFrame(rows, SPEC))  # a row for each part of each hub
    told = saved(facts.select("fact", F.coalesce("section", F.lit("")).alias("section"), "ord", "line"), "facts")
    counts = saved(counted(told), "fact-counts")
    lines = first_lines(told, max([r[9] for r in rows if r[5] in ("list", "inline")], default=1))

    placed = counts.where(F.col("section") != ALL).withColumn("place", F.row_number().over(Window.partitionBy("fact").orderBy("section"))).where(F.col("place") <= MOST)
    over = placed.select(F.col("fact").alias("over"), F.col("section").alias("at"), "place")
    once = spec.where("over = ''").withColumn("at", F.lit("")).withColumn("place", F.lit(0))
    each = spec.where("over <> ''").join(over, "over").where("place <= most").select(*once.columns)
    # which section of its fact a part shows: the one it names, else the block's, else all
    parts = once.unionByName(each).withColumn("of", F.when(F.col("section") != "", F.col("section")).when(F.col("over") != "", F.col("at")).otherwise(ALL))
    parts = saved(parts.withColumn("text", F.replace("text", F.lit("{section}"), F.col("at"))), "hub-parts")
    n_of = counts.select("fact", F.col("section").alias("of"), "n")
    lines_of = lines.select("fact", F.col("section").alias("of"), "rank", "line")
    key = ["hub", "block", "place", "part"]

    def line(df: DataFrame, step, text) -> DataFrame:
        return df.select(*key, step.cast("int").alias("step"), text.alias("line"))

    shown = parts.where("kind IN ('list', 'inline')").join(lines_of, ["fact", "of"]).where("rank <= lim")
    with_n = parts.join(n_of, ["fact", "of"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    more = with_n.where("kind = 'list' AND more <> '' AND n > lim").withColumn("rest", (F.col("n") - F.col("lim")).cast("string"))
    inline = shown.where("kind = 'inline'").groupBy(*key, "text").agg(F.array_join(F.array_sort(F.collect_list(F.struct("rank", "line")))["line"], ", ").alias("joined"))
    per = parts.where("kind = 'counts'").join(counts.where(F.col("section") != ALL).select("fact", F.col("section").alias("one"), "n"), "fact")
    per = per.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.when(F.col("top"), -F.col("n")).otherwise(0), "one"))).where(F.col("rank") <= MOST).where("rank <= lim")
    sections = counts.where(F.col("section") != ALL).groupBy("fact").agg(F.count("*").alias("n"))
    rest = parts.where("kind = 'rest'").join(sections, "fact").where("n > lim").withColumn("place", F.lit(MOST + 1))
    every = [
        line(rest, F.lit(0), F.replace("text", F.lit("{n}"), (F.col("n") - F.col("lim")).cast("string"))),
        line(parts.where("kind = 'text'"), F.lit(0), F.col("text")),
        line(with_n.where("kind = 'total'"), F.lit(0), F.replace("text", F.lit("{n}"), F.col("n").cast("string"))),
        line(shown.where("kind = 'list'"), F.col("rank"), F.concat(F.lit("- "), "line")),
        line(more, F.col("lim") + 1, F.replace("more", F.lit("{n}"), F.col("rest"))),
        line(inline, F.lit(0), F.replace("text", F.lit("{lines}"), F.col("joined"))),
        line(per, F.col("rank"), F.replace(F.replace("text", F.lit("{n}"), F.col("n").cast("string")), F.lit("{one}"), F.col("one"))),
    ]
    whole = every[0]
    for rows_ in every[1:]:
        whole = whole.unionByName(rows_)
    ordered = F.array_sort(F.collect_list(F.struct("block", "place", "part", "step", "line")))  # as long as the specification allows
    return whole.groupBy("hub").agg(F.array_join(ordered["line"], "\n").alias("body"))

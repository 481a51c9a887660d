"""Code search: files that mention a topic's keywords, ranked, pruned, matched with notes, and registered per file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import code as C
from ..functions import keywords
from ..functions import text as T
from ..functions.let import let
from .topics import Topic, of_topics

LINES_PER_FILE = keywords.LINES_PER_FILE
SEARCHED, KEPT, PER_NOTE = 40, 24, 8


def hits(files: DataFrame, profile: list[Topic]) -> DataFrame:
    """files (repo, path, body) to topic, repo, path, score, line_number, sample: the lines (three at most) of each code file that
    contain a keyword of more than two characters, in the repositories of the topic. The keywords of all topics are one automaton: a
    file is read once, up to where all topics of its repository have their lines."""
    wanted = files.where(C.is_code(F.col("path")) & ~C.is_ignored(F.col("path")))
    keyed = [(t.key, [w for w in t.keywords if len(w) > 2], t.repos) for t in profile]
    each = wanted.select("repo", "path", F.explode(keywords.lines(F.col("repo"), F.col("body"), keyed, LINES_PER_FILE)).alias("e"))
    return each.select("e.topic", "repo", "path", "e.score", "e.line_number", F.left(T.normalize(F.col("e.line")), F.lit(180)).alias("sample"))


def top(found: DataFrame, limit: int = SEARCHED) -> DataFrame:
    """The best files of each topic, by score, then repository and path; the limit acts before the shuffle too."""
    rank = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("score"), "repo", "path", "line_number", "sample"))
    return found.withColumn("rank", rank).where(F.col("rank") <= limit)


def prune(ranked: DataFrame, limit: int = KEPT, by: str = "topic") -> DataFrame:
    """At most `limit` files of each group: those of low signal after all others, each file once, else in rank order."""
    low = C.is_low_signal(F.col("repo"), F.col("path"), F.col("sample"))
    once = ranked.withColumn("low", low).withColumn("nth", F.row_number().over(Window.partitionBy(by, "repo", "path").orderBy("low", "rank"))).where("nth = 1")
    place = F.row_number().over(Window.partitionBy(by).orderBy("low", "rank"))
    return once.withColumn("place", place).where(F.col("place") <= limit).drop("low", "nth", "rank")


def for_notes(notes: DataFrame, kept: DataFrame, limit: int = PER_NOTE) -> DataFrame:
    """notes (note_id, topics, keywords, and columns to keep) to the hits of each note: those of its topics (first topic first, each
    file once), ranked by score plus shared tokens, four less for low signal, then path; low signal last; at most `limit`.

    kept has at most KEPT files a topic: one list per topic is broadcast, and a note ranks its own lists where it lies."""
    low = C.is_low_signal(F.col("repo"), F.col("path"), F.col("sample"))
    entry = F.struct("place", low.alias("low"), "repo", "path", "score", "line_number", "sample", T.tokens(F.concat_ws(" ", "path", "sample", "repo")).alias("tokens"))
    lists = kept.groupBy("topic").agg(F.array_sort(F.collect_list(entry)).alias("hits"))
    keep = [c for c in notes.columns if c != "keywords"]
    asked = of_topics(notes.select(*keep, F.array_distinct(F.flatten(F.transform("keywords", T.tokens))).alias("words")), lists, ["hits"])
    same = lambda a, b: (a["repo"] == b["repo"]) & (a["path"] == b["path"])
    once = let(F.col("hits"), lambda all_: F.filter(all_, lambda h, i: ~F.exists(F.slice(all_, 1, i), lambda o: same(o, h))))
    points = lambda h: h["score"] + F.size(F.array_intersect(F.col("words"), h["tokens"])) - F.when(h["low"], 4).otherwise(0)
    scored = F.transform(once, lambda h: F.struct(h["low"].alias("low"), (-points(h)).alias("minus"), h["path"].alias("path"), h["repo"].alias("repo"), h["line_number"].alias("line_number"), h["sample"].alias("sample")))
    each = asked.select(*keep, F.posexplode(F.slice(F.array_sort(scored), 1, limit)).alias("at", "h"))
    return each.select(*keep, "h.repo", "h.path", "h.line_number", "h.sample", (-F.col("h.minus")).alias("points"), (F.col("at") + 1).alias("place"))


def registry(found: DataFrame, kept: DataFrame, limits: tuple[int, int, int] = (60, 60, 40)) -> DataFrame:
    """One row per file: its first hit, how many support notes, wiki notes and topics use it, and the first of each as lists.

    found: hits of notes (note_id, kind, topics, repo, path, line_number, sample, place); kept: hits of topics (topic, repo, path,
    line_number, sample, place). Notes come before topics, support notes first. Names are ranked with the limit below the shuffle
    before any are gathered, so a file that a third of all notes use stays a set of rows."""
    number = F.when(F.col("kind") == "support", 0).when(F.col("kind") == "wiki", 1).otherwise(2)
    user = lambda kind, name, place, line_number, sample: F.struct(kind.alias("kind"), name.alias("name"), place.cast("int").alias("place"), line_number.cast("int").alias("line_number"), sample.cast("string").alias("sample"))
    hit = [F.col(c) for c in ("place", "line_number", "sample")]
    own = F.array(user(number, F.lpad(F.col("note_id").cast("string"), 20, "0"), *hit))
    more = F.transform("topics", lambda t: user(F.lit(2), t, F.lit(None), F.lit(None), F.lit(None)))
    rows = found.select("repo", "path", F.explode(F.concat(own, more)).alias("u")).unionByName(kept.select("repo", "path", user(F.lit(2), F.col("topic"), *hit).alias("u"))).select("repo", "path", "u.*")
    once = rows.groupBy("repo", "path", "kind", "name").agg(F.min(F.when(F.col("place").isNotNull(), F.struct(*hit))).alias("hit"))
    first = F.min(F.when(F.col("hit").isNotNull(), F.struct("kind", "name", "hit"))).alias("first")
    counts = once.groupBy("repo", "path").agg(first, *(F.count_if(F.col("kind") == i).alias(f"n_{k}") for i, k in enumerate(("support", "wiki", "topic"))))
    rank = F.row_number().over(Window.partitionBy("repo", "path", "kind").orderBy("name"))
    listed = once.select("repo", "path", "kind", "name").withColumn("rank", rank).where(F.col("rank") <= max(limits)).where(F.col("rank") <= F.get(F.array(*map(F.lit, limits)), F.col("kind")))
    named = [F.when(F.col("kind") == i, F.struct("rank", F.regexp_replace("name", "^0+(?=[0-9])", "").alias("name"))) for i in range(3)]
    lists = listed.groupBy("repo", "path").agg(*(F.array_sort(F.collect_list(x))["name"].alias(k) for x, k in zip(named, ("support", "wiki", "topics"), strict=True)))
    return counts.join(lists, ["repo", "path"]).select("repo", "path", "first.hit.line_number", "first.hit.sample", "n_support", "n_wiki", "n_topic", "support", "wiki", "topics")


def owner(files: DataFrame, roots: list[tuple[str, str]]) -> DataFrame:
    """files (path) with `repo`: the first declared repository whose root is a prefix of the path. Roots are configuration."""
    chain = None
    for repo, root in roots:
        under = F.startswith(F.col("path"), F.lit(root.rstrip("/") + "/"))
        chain = F.when(under, F.lit(repo)) if chain is None else chain.when(under, F.lit(repo))
    return files.withColumn("repo", F.lit(None).cast("string") if chain is None else chain)


def representative(files: DataFrame, limit: int = 14) -> DataFrame:
    """files (repo, path): preferred names first, then code files within four path parts in path order, `limit` of each repository."""
    # Names that say most about a repository, in this order.
    preferred = ["README.md", "package.json", "Dockerfile", "Gemfile", "Podfile", "docker-compose.local-platform.yml", "docker-compose.yml", "app.js", "fastlane/Fastfile"]
    at = F.array_position(F.array(*map(F.lit, preferred)), F.col("path"))
    usable = (at > 0) | ((F.size(F.split("path", "/")) <= 4) & ~C.is_ignored(F.col("path")) & C.is_code(F.col("path")))
    order = Window.partitionBy("repo").orderBy(F.when(at > 0, at).otherwise(len(preferred) + 1), "path")
    return files.where(usable).withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)

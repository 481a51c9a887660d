"""Secret scans (operator 1): a random forest over candidate strings. Native: DataFrame and SQL functions and Spark ML only."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.let import let
from .common import BROADCAST_IDS, saved, small, table

_CHARS = "A-Za-z0-9+/_-"
#: A candidate is a run of 16 or more of these characters (several of them with dots between are one, as in JSON web tokens), a run of
#: 8 or more with letters and digits, or one of 6 or more that a key word and = or : stand before. The look-behind keeps this linear.
CANDIDATE = (
    rf"(?<![{_CHARS}])(?:[{_CHARS}]{{16,}}+(?:\.[{_CHARS}]{{16,}}+)*+|(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[{_CHARS}]{{8,}}+"
    rf"|(?<=(?i:passw(?:or)?d|pwd|secret|token|key)[\"' ]{{0,2}}[=:][\"' ]{{0,2}})[{_CHARS}]{{6,}}+)"
)
SHORTEST = 6
BEFORE, AFTER = 40, 20  # characters of neighbouring text
TAUGHT = 4000  # labelled findings of each class that the forest learns from, the smallest by hash: a bound on training only
WORDS, PAIRS = 4000, 150  # most frequent words of the corpus that are its dictionary, and most frequent letter pairs of these
TREES, DEPTH, THRESHOLD = 25, 6, 0.4
MANY = 20  # texts that hold an ordinary value
MARK = "[SECRET]"
KEYWORDS = "secret token passw pwd api_key apikey api-key credential bearer auth private access".split()
HARMLESS = "sha1 sha256 md5 checksum digest commit revision uuid guid etag integrity hash http www phone isbn".split()
# Formats of keys that are secrets wherever they stand.
FORMATS = {
    "cloud": "^(AKIA|ASIA)[0-9A-Z]{16}$",
    "forge": "^gh[pousr]_[A-Za-z0-9]{36}$|^glpat-[A-Za-z0-9_-]{20}$",
    "payment": "^[sr]k_(live|test)_[A-Za-z0-9]{16,}$",
    "chat": "^xox[abprs]-[A-Za-z0-9-]{10,}$",
    "maps": "^AIza[A-Za-z0-9_-]{35}$",
    "web token": r"^eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+$",
}


@dataclass
class Words:
    """What the corpus says of ordinary text: its dictionary, and the letter pairs that its words are full of."""

    dictionary: list[str]
    pairs: list[str]


def ordinary(docs: DataFrame) -> Words:
    """The WORDS words of three and more letters that most rows hold, and their PAIRS most frequent letter pairs, weighted by rows."""
    words = F.array_distinct(F.split(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), "[^a-z]+"))
    held = docs.select(F.explode(words).alias("word")).where("length(word) BETWEEN 3 AND 30").groupBy("word").count()
    top = held.orderBy(F.desc("count"), "word").limit(WORDS).collect()
    pairs: Counter = Counter()
    for r in top:
        for a, b in zip(r["word"], r["word"][1:]):
            pairs[a + b] += r["count"]
    return Words([r["word"] for r in top], [p for p, _ in sorted(pairs.items(), key=lambda x: (-x[1], x[0]))[:PAIRS]])


def signals(value: Column, before: Column, after: Column, path: Column, known: Words) -> dict[str, Column]:
    """The numbers that the forest sees of one candidate."""
    n = F.length(value).cast("double")
    low = F.lower(value)
    near = F.lower(before)

    def count(text: Column, pattern: str) -> Column:
        return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("double")

    def found(text: Column, pattern: str) -> Column:
        return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).cast("double")

    parts = F.regexp_extract_all(F.lower(F.regexp_replace(value, "([a-z])([A-Z])", "$1 $2")), F.lit("[a-z]{3,}"), F.lit(0))
    in_dictionary = F.filter(parts, lambda w: w.isin(known.dictionary)) if known.dictionary else F.array().cast("array<string>")
    return {
        "length": n,
        "turns": found(value, "([a-z](?=[^a-z])|[A-Z](?=[^A-Z])|[0-9](?=[^0-9]))") / n,
        "vowel_turns": found(low, "([aeiou](?=[^aeiou0-9]))") / n,
        "usual_pairs": found(low, f"(?=({'|'.join(known.pairs) or '  '}))") / n,
        "coverage": F.aggregate(in_dictionary, F.lit(0), lambda s, w: s + F.length(w)).cast("double") / n,
        "digits": count(value, "[0-9]") / n,
        "upper": count(value, "[A-Z]") / n,
        "hex": count(value, "[0-9a-fA-F]") / n,
        "marks": count(value, "[+/_.-]") / n,
        "variety": F.size(F.array_distinct(F.split(value, ""))).cast("double") / n,
        "key_near": near.rlike("|".join(KEYWORDS)).cast("double"),
        "assigned": before.rlike("[=:]\\s*[\"']?$").cast("double"),
        "harmless_near": near.rlike("|".join(HARMLESS)).cast("double"),
        "quoted": (before.rlike("[\"']$") & after.rlike("^[\"']")).cast("double"),
        "at_or_dot": (before.rlike("[@./]$") | after.rlike("^[@.]")).cast("double"),
        "trial_path": F.coalesce(F.lower(path).rlike("test|example|sample|mock|fixture|vendor"), F.lit(False)).cast("double"),
        "path_depth": F.coalesce(F.size(F.split(path, "/")), F.lit(0)).cast("double"),
    }


@dataclass
class Forest:
    """Trees as nested tuples: (signal, threshold, left, right) or the leaf's share of secrets."""

    trees: list

    def score(self, x: dict[str, Column]) -> Column:
        def of(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            name, at, left, right = node
            return F.when(x[name] <= at, of(left)).otherwise(of(right))

        return reduce(lambda a, b: a + b, map(of, self.trees)) / len(self.trees)


def _around(gaps: Column, found: Column, i: Column) -> tuple[Column, Column]:
    """The BEFORE characters before the candidate found[i] and the AFTER after it, other candidates among them included; each gap is
    given with its own BEFORE last and AFTER first characters. Between two candidates stands a character at least, so a candidate and
    its gap fill SHORTEST + 1 characters, and a fixed number of neighbours fills the context."""
    part = SHORTEST + 1
    left, right = [gaps[i]["before"]], []
    for k in range(1, -(-BEFORE // part) + 1):
        left += [F.right(F.get(found, i - k), F.lit(BEFORE)), F.get(gaps, i - k)["before"]]
    for k in range(1, -(-AFTER // part) + 1):
        right += [F.get(gaps, i + k)["after"], F.left(F.get(found, i + k), F.lit(AFTER))]
    before = F.concat(*(F.coalesce(c, F.lit("")) for c in reversed(left)))
    return F.right(before, F.lit(BEFORE)), F.left(F.concat(*(F.coalesce(c, F.lit("")) for c in right)), F.lit(AFTER))


def _pieces(gaps: Column, found: Column) -> Column:
    """For each candidate a struct of its value and its neighbourhood."""

    def piece(value: Column, i: Column) -> Column:
        before, after = _around(gaps, found, i)
        return F.struct(value.alias("value"), before.alias("before"), after.alias("after"))

    return F.transform(found, piece)


def _ends(gaps: Column) -> Column:
    return F.transform(gaps, lambda g: F.struct(F.length(g).alias("n"), F.right(g, F.lit(BEFORE)).alias("before"), F.left(g, F.lit(AFTER)).alias("after")))


def candidates(docs: DataFrame, path: str) -> DataFrame:
    """One row per candidate: row (of docs), doc_id, text_hash, place (its number in the text), start, value, before, after, path."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    of_path = F.col(path).cast("string") if path in docs.columns else F.lit(None).cast("string")
    cut = docs.where(text.rlike(CANDIDATE)).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), of_path.alias("path"), F.split(text, CANDIDATE).alias("gaps"), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("found"))
    keep = ["doc_id", "text_hash", "path"]
    held = saved(cut.select(F.monotonically_increasing_id().alias("row"), *keep, "found", _ends(F.col("gaps")).alias("gaps")), "candidates")
    each = held.select("row", *keep, F.transform("gaps", lambda g: g["n"]).alias("sizes"), F.posexplode(_pieces(F.col("gaps"), F.col("found"))).alias("place", "piece"))
    each = each.select("row", *keep, "place", "piece.*", F.get("sizes", F.col("place")).alias("n"))
    so_far = F.sum(F.col("n") + F.length("value")).over(Window.partitionBy("row").orderBy("place"))
    return each.select("row", *keep, "place", (so_far - F.length("value")).cast("long").alias("start"), "value", "before", "after")


def rule_labels(found: DataFrame, formats: dict[str, str] | None = None) -> DataFrame:
    """Findings labelled by rules where these are sure. Secrets (1): FORMATS, and what has letters and digits right after a key word
    and = or :. Not (0): words and names (letters, in parts joined by marks, with two digits at most at the end), numbers, checksums
    and identifiers that say so, and values that MANY texts hold. Other findings are left out. The prefix of a format and how many
    texts hold a value are no signals of the forest."""
    value, near = F.col("value"), F.lower("before")
    after_key = near.rlike("(token|passw(or)?d|pwd|secret|api.?key)[\"' ]{0,2}[=:][\"' ]{0,2}$")
    keyed = after_key & value.rlike("[A-Za-z]") & value.rlike("[0-9]")
    secret = value.rlike("|".join((FORMATS if formats is None else formats).values()) or "^$") | keyed
    common = found.groupBy("value").agg(F.approx_count_distinct("text_hash").alias("n")).where(F.col("n") >= MANY).select(F.xxhash64("value").alias("of_value")).distinct()
    usual = F.broadcast(common) if small(common) else common
    marked = found.join(usual.withColumn("usual", F.lit(True)), F.xxhash64("value") == F.col("of_value"), "left")
    clean = (~after_key & value.rlike("^[A-Za-z]+([/_.-]+[A-Za-z]+)*[/_.-]?[0-9]{0,2}$")) | value.rlike("^[0-9]+$") | near.rlike("(" + "|".join(HARMLESS) + ")\\W{0,3}$") | F.col("usual")
    return marked.withColumn("label", F.when(secret, F.lit(1.0)).when(clean, F.lit(0.0))).where("label IS NOT NULL").drop("usual", "of_value")


def train(labelled: DataFrame, known: Words) -> Forest:
    """A forest from labelled findings (value, before, after, path, label). Of each class the TAUGHT smallest by hash teach it, so
    training is bounded and the same however rows are dealt. With one class only, every candidate scores that class; with none, 0."""
    x = signals(*(F.col(c) for c in ("value", "before", "after", "path")), known)
    mark = F.xxhash64("value", "before", "after", "path")
    taught = reduce(DataFrame.union, (labelled.where(F.col("label") == y).withColumn("mark", mark).orderBy("mark", "value", "before").limit(TAUGHT) for y in (0.0, 1.0)))
    taught = saved(taught.select("label", *(c.alias(n) for n, c in x.items())), "taught").coalesce(1)  # at most 2 * TAUGHT rows
    seen = {r[0] for r in taught.select("label").distinct().collect()}
    if len(seen) < 2:
        return Forest([float(max(seen, default=0.0))])
    model = RandomForestClassifier(labelCol="label", featuresCol="signals", numTrees=TREES, maxDepth=DEPTH, seed=11).fit(VectorAssembler(inputCols=list(x), outputCol="signals").transform(taught))
    names = list(x)

    def walk(node):
        if "Leaf" in node.getClass().getSimpleName():
            stats = list(node.impurityStats().stats())
            return float(stats[1] / max(sum(stats), 1e-12))
        split = node.split()
        return names[split.featureIndex()], float(split.threshold()), walk(node.leftChild()), walk(node.rightChild())

    return Forest([walk(t._java_obj.rootNode()) for t in model.trees])


def _scored(docs: DataFrame, path: str, labelled: DataFrame | None) -> DataFrame:
    found = saved(candidates(docs, path), "found")
    known = ordinary(docs)
    forest = train(labelled if labelled is not None else rule_labels(found), known)
    x = signals(*(F.col(c) for c in ("value", "before", "after", "path")), known)
    told = found.select("doc_id", "text_hash", "place", "start", "value", *(c.alias(f"_{n}") for n, c in x.items()))
    return told.withColumn("score", forest.score({n: F.col(f"_{n}") for n in x})).drop(*(f"_{n}" for n in x)).withColumn("secret", F.col("score") >= THRESHOLD)


def scan(docs: DataFrame, path: str = "source", labelled: DataFrame | None = None) -> DataFrame:
    """doc_id, start, length, value, score, secret for every candidate in docs (doc_id, text, and a path column if there is one).

    start counts characters from 0. The forest learns from `labelled` (value, before, after, path, label 0 or 1), by default from
    the findings that rule_labels() is sure of; its dictionary and letter pairs come from all texts. Null and empty texts have no
    candidates; a null doc_id stays null; repeated rows give repeated findings; an empty table gives no rows. Whole texts are
    searched."""
    return _scored(docs, path, labelled).select("doc_id", "start", F.length("value").cast("long").alias("length"), "value", "score", "secret")


def redact(docs: DataFrame, path: str = "source", labelled: DataFrame | None = None) -> DataFrame:
    """docs with all columns; in `text`, each secret is replaced by MARK. Other texts are untouched, nulls stay null.

    Candidates are scored as rows; what comes back to a text is which of its candidates are secrets."""
    places, names = "_secret_places", ["_of_id", "_of_text"]
    hits = _scored(docs, path, labelled).where("secret").groupBy(F.col("doc_id").alias(names[0]), F.col("text_hash").alias(names[1])).agg(F.collect_set("place").alias(places))
    hits = saved(hits, "secrets")
    size = hits.agg(F.count("*") + F.coalesce(F.sum(F.size(places)), F.lit(0))).first()[0]
    same = docs["doc_id"].cast("long").eqNullSafe(hits[names[0]]) & (F.xxhash64(docs["text"]) == hits[names[1]])

    def cleared(cut: Column) -> Column:
        shown = F.transform(cut["found"], lambda v, i: F.concat(F.get(cut["gaps"], i), F.when(F.array_contains(F.col(places), i), F.lit(MARK)).otherwise(v)))
        return F.concat(F.array_join(shown, ""), F.element_at(cut["gaps"], -1))

    text = F.col("text").cast("string")
    cut = F.struct(F.split(text, CANDIDATE).alias("gaps"), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("found"))
    marked = docs.join(F.broadcast(hits) if size <= BROADCAST_IDS else hits, same, "left")
    return marked.withColumn("text", F.when(F.col(places).isNull(), F.col("text")).otherwise(let(cut, cleared))).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "length", F.sha2("value", 256).alias("value_sha256"), "score", "secret")

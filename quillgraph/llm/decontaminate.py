"""Benchmark decontamination (operator 3): spaced seeds join test and training texts. Native: DataFrame and SQL functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.let import let
from .common import saved, small, table

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Token positions that a seed hashes (1) or ignores (0).
MASKS = ("1110111", "11011011", "110101011")
MATCH, MISMATCH = 1, -2
#: A segment along one diagonal counts with this score, or with SHARE of the item's length if that is less.
SCORE, SHARE = 12, 0.7
BLOCK_SEEDS = 600_000  # of the benchmark, broadcast at once (some 60 bytes each): a larger benchmark takes more passes
BROADCAST_PAIRS, BROADCAST_WORDS = 200_000, 1_000_000  # larger tables of diagonals or items are joined by a shuffle


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits (all of non-ASCII counts as such)."""
    return F.split(F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), f"^{SEPARATORS}|{SEPARATORS}$", ""), SEPARATORS)


def seeds(words: Column, place: Column) -> list[Column]:
    """For each mask the hash of the tokens that it selects from `place` on; null where the text ends before the mask does."""
    out = []
    for number, mask in enumerate(MASKS):
        picked = [F.get(words, place + i) for i, bit in enumerate(mask) if bit == "1"]
        out.append(F.when(place + len(mask) <= F.size(words), F.xxhash64(F.lit(number), *picked)))
    return out


def _seeded(texts: DataFrame, keep: list[str]) -> DataFrame:
    """One row for each place and mask: the kept columns, `place` and `seed`."""
    # posexplode would have Catalyst filter on the size of the token list first, and so tokenise every text twice
    places = texts.select(*keep, F.posexplode_outer("words").alias("place", "word"))
    return places.select(*keep, "place", F.explode(F.array(*seeds(F.col("words"), F.col("place")))).alias("seed"))


def _segment(doc: Column, item: Column) -> Column:
    """The best local segment of two aligned token lists: struct(score, length, last), matches +1 and mismatches -2."""
    hits = F.zip_with(doc, item, lambda a, b: F.when(a == b, F.lit(MATCH)).otherwise(F.lit(MISMATCH)))
    start = F.struct(*(F.lit(0).alias(n) for n in ("run", "length", "at", "score", "best", "last")))

    def step(s: Column, hit: Column) -> Column:
        grows = s["run"] + hit > 0
        run, length = F.when(grows, s["run"] + hit).otherwise(F.lit(0)), F.when(grows, s["length"] + 1).otherwise(F.lit(0))
        better = run > s["score"]
        return F.struct(run.alias("run"), length.alias("length"), (s["at"] + 1).alias("at"), F.greatest(run, s["score"]).alias("score"), F.when(better, length).otherwise(s["best"]).alias("best"), F.when(better, s["at"]).otherwise(s["last"]).alias("last"))

    return F.aggregate(hits, start, step)


def _verified(text: Column, item: Column, diagonals: Column) -> Column:
    """The best segment on any of the diagonals: struct(score, length, first_word). The text is tokenised once."""

    def on(words: Column, diagonal: Column) -> Column:
        from_doc, from_item = F.greatest(diagonal, F.lit(0)), F.greatest(-diagonal, F.lit(0))
        common = F.least(F.size(words) - from_doc, F.size(item) - from_item)
        best = _segment(F.slice(words, from_doc + 1, common), F.slice(item, from_item + 1, common))
        return let(best, lambda s: F.struct(s["score"].alias("score"), s["best"].alias("length"), (from_doc + s["last"] - s["best"] + 1).alias("first_word")))

    return let(tokens(text), lambda words: F.array_max(F.transform(diagonals, lambda d: on(words, d))))


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, text_hash, item_id, score, length, first_word for every document (doc_id, text) and benchmark item (item_id, text)
    that share a passage: a run of tokens, equal but for substitutions, found around a common seed and verified word by word.

    Each seed hit fixes a diagonal. Hits become the distinct diagonals of a document and an item before anything is scored, so a
    shared passage is scored once, however long it is; on each diagonal the best local segment counts from SCORE on, or SHARE of the
    length of a shorter item. All places of all texts are seeded. The benchmark's seeds enter in blocks of about BLOCK_SEEDS, dealt
    by hash and each broadcast against one scan of the documents: a large benchmark costs scans and no shuffle of the corpus, and
    none is too large.

    Texts that are null or have fewer tokens than the shortest mask (7) share nothing, and items of fewer tokens say too little to
    tell a leak from chance: they match nothing. Items with equal tokens are one item (the smallest item_id; null ids are left out),
    other texts of one item_id are searched each. Repeated rows of a document give one row; a null doc_id stays null. Empty tables
    give no rows. Other columns are ignored."""
    shape = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), tokens(F.col("text")).alias("item")).where(f"item_id IS NOT NULL AND size(item) >= {min(map(len, MASKS))}")
    items = saved(items.groupBy("item").agg(F.min("item_id").alias("item_id")).withColumn("no", F.monotonically_increasing_id()), "items")
    index = _seeded(items.select("no", F.col("item").alias("words")), ["no", "words"]).where("seed IS NOT NULL").select("seed", "no", F.col("place").alias("item_place"))
    index = saved(index, "item-seeds")
    blocks, found = max(1, -(-index.count() // BLOCK_SEEDS)), []
    for block in range(blocks):
        part = index.where(F.pmod(F.xxhash64("no", "item_place"), F.lit(blocks)) == block)
        hits = _seeded(shape.select("doc_id", "text_hash", tokens(F.col("text")).alias("words")), ["doc_id", "text_hash", "words"]).join(F.broadcast(part), "seed")
        found.append(hits.select("doc_id", "text_hash", "no", (F.col("place") - F.col("item_place")).alias("diagonal")))
    pairs = reduce(DataFrame.unionByName, found).groupBy("doc_id", "text_hash", "no").agg(F.collect_set("diagonal").alias("diagonals"))
    pairs = saved(pairs.withColumnsRenamed({"doc_id": "of_id", "text_hash": "of_hash"}), "diagonals")
    size = pairs.agg(F.count("*").alias("n"), F.sum(F.size("diagonals")).alias("diagonals")).first()
    few_pairs = size.n + (size.diagonals or 0) <= BROADCAST_PAIRS  # some 100 bytes each
    few_words = (items.agg(F.sum(F.size("item"))).first()[0] or 0) <= BROADCAST_WORDS  # some 20 bytes each
    same = shape["doc_id"].eqNullSafe(pairs["of_id"]) & (shape["text_hash"] == pairs["of_hash"])
    both = shape.join(F.broadcast(pairs) if few_pairs else pairs, same).join(F.broadcast(items) if few_words else items, "no")
    scored = both.select("doc_id", "text_hash", "item_id", F.size("item").alias("size"), _verified(F.col("text"), F.col("item"), F.col("diagonals")).alias("s"))
    enough = F.col("s.score") >= F.least(F.lit(float(SCORE)), SHARE * F.col("size"))
    return scored.where(enough).groupBy("doc_id", "text_hash", "item_id").agg(F.max("s").alias("s")).select("doc_id", "text_hash", "item_id", "s.*")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that share no passage with the benchmark."""
    names = [f"_{n}" for n in ("hit_id", "hit_hash")]
    hits = saved(overlaps(docs, benchmark).select(F.col("doc_id").alias(names[0]), F.col("text_hash").alias(names[1])).distinct(), "leaks")
    same = docs["doc_id"].cast("long").eqNullSafe(hits[names[0]]) & (F.xxhash64(docs["text"]) == hits[names[1]])
    return docs.join(F.broadcast(hits) if small(hits) else hits, same, "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.col("score").cast("long").alias("score"), F.col("length").cast("long").alias("n_words"), F.col("first_word").cast("long").alias("first_word"))

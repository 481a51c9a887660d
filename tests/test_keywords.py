"""The keyword automaton against plain searches, and its time against the size of the profile."""

import random
import time

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillgraph.functions import keywords as K
from quillgraph.plans import registry


def plain_scores(keyed, head, text):
    out = []
    for key, words in keyed:
        n = sum(3 if head is not None and w in head else 1 if w in (text or "") else 0 for w in words)
        if n:
            out.append((-n, key))
    return out


def plain_lines(keyed, group, text, limit=3):
    out = []
    for key, words, groups in keyed:
        if group in groups and words:
            found = [(i, line) for i, line in enumerate((text or "").replace("\r\n", "\n").split("\n"), 1) if any(w.lower() in line.lower() for w in words)][:limit]
            if found:
                out.append((key, len(found), *found[0]))
    return out


def made(rng, n, letters="abcd \n"):
    return "".join(rng.choice(letters) for _ in range(n))


def test_scores_and_lines_by_plain_searches(spark):
    rng = random.Random(7)
    keyed = [(f"k{i}", [made(rng, rng.choice([1, 2, 3, 4]), "abcd ") for _ in range(rng.choice([0, 1, 5]))] + ([""] if i == 3 else [])) for i in range(12)]
    rows = [(i, None if i % 13 == 0 else made(rng, rng.choice([0, 3, 9])), None if i % 17 == 0 else made(rng, rng.choice([0, 5, 40, 300]))) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, head string, text string")
    got = {r.id: [(e.minus, e.key) for e in r.s] for r in df.select("id", K.scores(F.col("head"), F.col("text"), keyed).alias("s")).collect()}
    assert got == {i: plain_scores(keyed, head, text) for i, head, text in rows}
    grouped = [(k, [w.upper() if j % 2 else w for j, w in enumerate(words) if w], [f"g{i % 3}", f"g{i % 4}"]) for i, (k, words) in enumerate(keyed)]
    files = [(i, f"g{i % 5}", text if i % 3 else text and text.replace("\n", "\r\n")) for i, _, text in rows]
    df = spark.createDataFrame(files, "id int, g string, text string")
    got = {r.id: [tuple(e) for e in r.s] for r in df.select("id", K.lines(F.col("g"), F.col("text"), grouped).alias("s")).collect()}
    assert got == {i: plain_lines(grouped, g, text) for i, g, text in files}


def test_lines_fold_letters_of_any_alphabet(spark):
    """Places and matches are those of a regular expression without case."""
    texts = ["one\n// handles CIÓN\nción", "Straße\nſCHULE ciÓn", "İİ ΣΑΣ\nσας", "STRASSE\nKelvin", "\u212aelvin"]
    keyed = [("a", ["ción", "sch"], ["g"]), ("b", ["ΣΑΣ", "kelvin"], ["g"]), ("c", ["STRAẞE"], ["g"])]
    df = spark.createDataFrame([(i, "g", t) for i, t in enumerate(texts)], "id int, g string, text string")
    got = {r.id: [tuple(e) for e in r.s] for r in df.select("id", K.lines(F.col("g"), F.col("text"), keyed).alias("s")).collect()}
    assert got == {
        0: [("a", 2, 2, "// handles CIÓN")], 1: [("a", 1, 2, "ſCHULE ciÓn"), ("c", 1, 1, "Straße")], 2: [("b", 2, 1, "İİ ΣΑΣ")], 3: [("b", 1, 2, "Kelvin")], 4: [("b", 1, 1, "\u212aelvin")],
    }


@pytest.fixture(scope="module")
def capitals(spark, tmp_path_factory):
    """Tables with one file whose lines have a keyword in accented capitals, among the first of its topic by these lines alone."""
    at = tmp_path_factory.mktemp("capitals")
    docs = [(i, "aa CIÓNX bb" if i == 111 else f"adob w{i} bb", "es", "src6", 11) for i in range(1, 401)]
    pages = [(i, f"https://a{i}.test.org/x/{i}", "<title>t</title>p") for i in range(8)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(at / "documents.parquet"))
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(str(at / "pages.parquet"))
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet/*.parquet'")
    return str(at), con


@pytest.mark.parametrize("name", ["code_search", "code_hit_top_files", "code_hit_prune", "code_hit_rerank", "code_reference_registry", "code_notes", "capability_notes", "hub_notes"])
def test_accented_capitals_match_sql(spark, capitals, name):
    at, con = capitals
    df = registry.QUERIES[name](spark, at)
    found = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(map(tuple, df.select(names).collect()), key=str) == sorted(found.fetchall(), key=str)


def test_no_keywords(spark):
    df = spark.createDataFrame([("a", "b")], "head string, text string")
    assert df.select(K.scores(F.col("head"), F.col("text"), [("k", [])]).alias("s"), K.lines(F.col("head"), F.col("text"), []).alias("t")).collect() == [([], [])]


def test_a_hundred_times_the_keywords_take_no_longer_than_twice():
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = sorted({made(rng, rng.randint(6, 12), letters) for _ in range(5000)})
    texts = [" ".join(made(rng, rng.randint(3, 10), letters) for _ in range(2000)) + " " + rng.choice(words) for _ in range(60)]
    heads, bodies = pa.array([t[:40] for t in texts]), pa.array(texts)

    def seconds(some):
        keyed = [(f"k{i}", some[i::10]) for i in range(10)]
        args = (tuple(k for k, _ in keyed), *K.index(keyed), heads, bodies)
        K._scores(*args)  # builds the automaton
        took = []
        for _ in range(5):
            began = time.perf_counter()
            K._scores(*args)
            took.append(time.perf_counter() - began)
        return min(took)

    few, many = seconds(words[::100]), seconds(words)
    assert many < 2 * few, (few, many)

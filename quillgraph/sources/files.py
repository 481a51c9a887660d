"""Readers: folders of files as DataFrames. Paths may be in any store that Spark reads."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from ..functions import code as C
from ..functions import lists as Li
from ..functions import text as T
from ..functions import urls as U

#: Inventories that other jobs exchange as JSON.
INVENTORIES = {
    "support_articles": "article_id string, title string, relative_path string, source_url string, link_count int, category string",
    "wiki_pages": "title string, relative_path string, section string, link_count int",
    "docx_extracts": "path string, relative_path string, extract_path string, title string, char_count int, error string",
    "external_links": "url string, domain string, source_refs array<string>, status string, http_status int, final_url string, content_type string, final_domain string, title string, error string, mirror_path string",
    "repo_snapshots": "name string, role string, branch string, path string, path_exists boolean, readme_title string, readme_summary string, top_dirs array<string>, key_files array<string>, monorepo_apps array<string>, monorepo_services array<string>",
}
# Files that tell how a repository is built.
KEY_FILES = ["README.md", "package.json", "Gemfile", "Podfile", "DockerFile", "docker-compose.yml"]


def absolute_path(x: str) -> Column:
    """A file's path as it is named, from the URL that Spark gives."""
    return F.url_decode(F.replace(F.col(x), F.lit("+"), F.lit("%2B")))


def relative_to(root: str) -> Column:
    """`absolute_path` as seen from root."""
    return F.regexp_replace("absolute_path", "^.*?" + re.escape(re.sub("^[a-z0-9]+:/+", "", root).strip("/")) + "/", "")


def texts(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """relative_path, text: one row per file below root whose name matches; the whole text, whatever its size."""
    rows = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(root, wholetext=True)
    named = rows.select(F.col("value").alias("text"), absolute_path("_metadata.file_path").alias("absolute_path"))
    return named.select(relative_to(root).alias("relative_path"), "text")


def support_articles(spark: SparkSession, root: str, template: str = "", read: Callable[[SparkSession, str], DataFrame] = texts) -> DataFrame:
    """Articles of a folder: number (from a name like 123-title.md), title, links, category; and their text. read is texts(), or
    note_files.texts() for very many small files; so it is in the readers below."""
    rows = read(spark, root)
    name = F.regexp_extract("relative_path", r"([^/]+)\.md$", 1)
    number = F.regexp_extract(name, r"^(\d+)-", 1)
    return rows.select(
        number.alias("article_id"), T.page_title(F.col("text"), name).alias("title"), "relative_path", U.article_url(number, F.lit(template)).alias("source_url"),
        F.size(Li.urls(F.col("text"), 1 << 20)).alias("link_count"), F.when(number != "", "support-article").otherwise("reference-doc").alias("category"), "text",
    )


def wiki_pages(spark: SparkSession, root: str | None, read: Callable[[SparkSession, str], DataFrame] = texts) -> DataFrame:
    """Pages of a wiki; the section is the first folder, or root. Without a wiki there are no rows."""
    if not root:
        return spark.createDataFrame([], INVENTORIES["wiki_pages"] + ", text string")
    parts = F.split("relative_path", "/")
    section = F.when(F.size(parts) > 1, parts[0]).otherwise("root")
    return read(spark, root).select(T.page_title(F.col("text"), F.col("relative_path")).alias("title"), "relative_path", section.alias("section"), F.size(Li.urls(F.col("text"), 1 << 20)).alias("link_count"), "text")


def refs(rows: DataFrame, prefix: str = "") -> DataFrame:
    """url, ref for every valid link of rows with relative_path and text."""
    found = rows.select(F.concat(F.lit(prefix), "relative_path").alias("ref"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(U.URL), F.lit(0)))).alias("url"))
    return found.select(U.clean_url(F.col("url")).alias("url"), "ref").where("url IS NOT NULL").distinct()


def _docx(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    word = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    for batch in batches:
        out = []
        for path, content in zip(batch["relative_path"], batch["content"], strict=True):
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    paragraphs = ElementTree.fromstring(z.read("word/document.xml")).iter(f"{word}p")
                text = "\n".join("".join(t.text or "" for t in p.iter(f"{word}t")) for p in paragraphs)
                out.append((path, text, len(text), None))
            except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, OSError) as e:
                out.append((path, None, None, f"{type(e).__name__}: {e}"[:300]))
        yield pd.DataFrame(out, columns=["relative_path", "text", "char_count", "error"])


def docx(spark: SparkSession, root: str) -> DataFrame:
    """relative_path, text, char_count, error: a file that can't be read has its error, the others go on."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", True).load(root)
    named = rows.select(absolute_path("path").alias("absolute_path"), "content").select(relative_to(root).alias("relative_path"), "content")
    return named.mapInPandas(_docx, "relative_path string, text string, char_count int, error string")


def code_files(spark: SparkSession, root: str, repo: str) -> DataFrame:
    """repo, path, body of the code files of a repository, without ignored folders; MAX_CHARS characters of each are analysed."""
    rows = texts(spark, root, "*").select(F.lit(repo).alias("repo"), F.col("relative_path").alias("path"), F.col("text").alias("body"))
    return rows.where(C.is_code(F.col("path")) & ~C.is_ignored(F.col("path")))


def repo_snapshot(files: DataFrame) -> DataFrame:
    """files (repo, path) to one row per repository: 20 top folders, key files, 50 apps and 80 services, sorted.

    Values are made distinct and ranked before they are gathered, so a repository with many files costs no long list."""
    top = files.where(F.contains("path", F.lit("/"))).select("repo", F.lit("top_dirs").alias("kind"), F.split_part("path", F.lit("/"), F.lit(1)).alias("name"))
    key = files.where(F.col("path").isin(KEY_FILES)).select("repo", F.lit("key_files").alias("kind"), F.col("path").alias("name"))
    mono = [files.where(F.col("path").rlike(f"^{d}/[^/]+/")).select("repo", F.lit(k).alias("kind"), F.split_part("path", F.lit("/"), F.lit(2)).alias("name")) for d, k in (("apps", "monorepo_apps"), ("services", "monorepo_services"))]
    most = F.when(F.col("kind") == "top_dirs", 20).when(F.col("kind") == "monorepo_apps", 50).otherwise(80)
    every = top.union(key).union(mono[0]).union(mono[1]).where(~F.startswith("name", F.lit("."))).distinct()
    few = every.withColumn("nth", F.row_number().over(Window.partitionBy("repo", "kind").orderBy("name"))).where(F.col("nth") <= most)
    lists = [F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("name")))).alias(k) for k in ("top_dirs", "key_files", "monorepo_apps", "monorepo_services")]
    return files.select("repo").distinct().join(few, "repo", "left").groupBy("repo").agg(*lists)


def readme_summary(text: Column) -> tuple[Column, Column]:
    """The title, and the first line that is no heading (240 characters at most)."""
    first = F.get(F.filter(F.transform(T.lines(text), T.normalize), lambda s: (s != "") & ~F.startswith(s, F.lit("#"))), F.lit(0))
    return T.page_title(text, F.lit("")), F.left(F.coalesce(first, F.lit("")), F.lit(240))


def inventory(spark: SparkSession, path: str, name: str, lines: bool = False) -> DataFrame:
    """An inventory in JSON: one array in each file, or with `lines` a row in each line, as write_inventories() leaves them."""
    return spark.read.schema(INVENTORIES[name]).option("multiLine", not lines).json(path)


def notes(spark: SparkSession, root: str, ignored: str = "", read: Callable[[SparkSession, str], DataFrame] = texts) -> DataFrame:
    """path, body of a folder of notes, without the editor's own folder and a report that is left out."""
    rows = read(spark, root).select(F.col("relative_path").alias("path"), F.col("text").alias("body"))
    return rows.where(~F.contains(F.concat(F.lit("/"), "path"), F.lit("/.obsidian/")) & (F.col("path") != ignored))


def fetch_schema() -> Ty.StructType:
    """What inventory() of operators.links looks up: a cache of fetched pages, filled by whatever crawler there is."""
    return Ty._parse_datatype_string("url string, http_status int, error string, body string")

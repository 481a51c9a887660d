"""Link inventory: merged references, status by lookups, counts and uncaptured evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from .lookup import lookup
from .positions import settled


LISTED = 25  # references that a listing shows of each URL


def merge_refs(*links: DataFrame) -> DataFrame:
    """Distinct (url, ref) rows of several (url, ref) tables: the merged references, one row each, so that a URL which a third of
    all documents cite stays a set of rows and never becomes one list."""
    return reduce(DataFrame.unionByName, (x.select("url", "ref") for x in links)).distinct()


def listed(merged: DataFrame, limit: int = LISTED) -> DataFrame:
    """url, n_refs, more, refs: how many references a URL has, how many beyond the limit, and the first ones in order. References
    are ranked with the limit below the shuffle before any are gathered."""
    first = merged.withColumn("rank", F.row_number().over(Window.partitionBy("url").orderBy("ref"))).where(F.col("rank") <= limit)
    first = first.groupBy("url").agg(F.array_sort(F.collect_list("ref")).alias("refs"))
    return merged.groupBy("url").agg(F.count("*").alias("n_refs")).join(first, "url").select("url", "n_refs", F.greatest(F.col("n_refs") - limit, F.lit(0)).alias("more"), "refs")


def clean_links(links: DataFrame) -> DataFrame:
    """(url, ref) rows whose URL is valid, with the cleaned URL."""
    return links.withColumn("url", U.clean_url(F.col("url"))).where("url IS NOT NULL")


def split_local(links: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links whose normalised URL is a known article, and the others."""
    keyed = links.withColumn("known_url", U.known_article_url(F.col("url")))
    ours = known.select(U.known_article_url(F.col("url")).alias("known_url")).where("known_url IS NOT NULL").distinct()
    return keyed.join(ours, "known_url", "left_semi").drop("known_url"), keyed.join(ours, "known_url", "left_anti").drop("known_url")


def inventory(links: DataFrame, known: DataFrame, fetched: DataFrame, stale_hosts: list[str]) -> DataFrame:
    """links (url, ref) to one row per URL: url, domain, status, http_status, n_refs.

    A known article is local evidence; a drive or stale host is not fetched; for the rest the outcome of a fetch decides, looked up
    in `fetched` (url, http_status, error, body). What has no row there was not reachable: blocked."""
    local, remote = split_local(links, known)

    def counted(rows: DataFrame) -> DataFrame:
        return rows.select("url", "ref").distinct().groupBy("url").agg(F.count("*").alias("n_refs")).withColumn("domain", U.host(F.col("url")))

    here = counted(local).select("url", "domain", F.lit("local-support-evidence").alias("status"), F.lit(None).cast("int").alias("http_status"), "n_refs")
    rest = counted(remote).withColumn("special", U.special_status(F.col("url"), stale_hosts))
    unfetched = F.col("special").isin("needs-google-drive", "stale-doc-reference")
    special = rest.where(unfetched).select("url", "domain", F.col("special").alias("status"), F.lit(None).cast("int").alias("http_status"), "n_refs")
    asked = rest.where(~F.coalesce(unfetched, F.lit(False))).join(fetched.withColumn("found", F.lit(True)), "url", "left")
    status = F.when(F.col("found"), U.fetch_status(F.col("http_status"), F.col("error"), F.col("body"))).otherwise("blocked")
    return here.unionByName(special).unionByName(asked.select("url", "domain", status.alias("status"), "http_status", "n_refs"))


def uncaptured(records: DataFrame) -> DataFrame:
    return records.where(F.col("status").isin(U.UNCAPTURED) & (F.coalesce("url", F.lit("")) != ""))


def restricted(records: DataFrame) -> DataFrame:
    return records.where(F.col("status").isin(U.RESTRICTED))


def counts(records: DataFrame, column: str) -> DataFrame:
    return records.groupBy(column).agg(F.count("*").alias("n"))


def most_common(records: DataFrame, column: str, first: str, limit: int) -> DataFrame:
    """The `limit` most frequent values; of equal counts the one seen first, by the smallest `first`."""
    found = records.groupBy(column).agg(F.count("*").alias("n"), F.min(first).alias("first_seen"))
    return found.orderBy(F.desc("n"), "first_seen").limit(limit)


def stale_refs(links: DataFrame, records: DataFrame) -> DataFrame:
    """How many stale links each source document has; a URL that many documents cite is spread."""
    stale = records.where("status = 'stale-doc-reference'").select("url")
    return lookup(links.select("url", "ref").distinct(), stale, "url", how="left_semi").groupBy("ref").agg(F.count("*").alias("n_stale"))


def records(listed_urls: DataFrame, refs: DataFrame, fetched: DataFrame, ended: bool = False) -> DataFrame:
    """The complete record of every URL of an inventory(): url, domain, status, http_status, final_url, final_domain, content_type, title,
    error, mirror_path, n_refs and the first references.

    refs is listed(): url, refs; fetched has url, http_status, error, body, final_url, content_type. Only what was fetched has the columns
    of a fetch; a page that was read has a title (of HTML its own, else the URL), and a mirrored one the path of its file. A URL that was
    fetched more than once has a record for each fetch, with what that fetch says. ended: see unescape()."""
    asked = ~F.col("status").isin("local-support-evidence", "needs-google-drive", "stale-doc-reference")
    page = fetched.select("url", "http_status", "final_url", "content_type", "error", T.html_title(F.col("body"), F.col("url"), ended).alias("_title"), F.lit(True).alias("_found"))
    full = listed_urls.drop("http_status").join(refs.select("url", "refs"), "url", "left").join(page, "url", "left")
    got = asked & F.col("_found")
    read = got & F.col("error").isNull() & (F.col("http_status") < 400)
    title = F.when(F.contains("content_type", F.lit("text/html")), F.col("_title")).otherwise(F.col("url"))
    final = U.host(F.col("final_url"))
    path = F.regexp_extract("final_url", r"^https?://[^/?#]*([^?#]*)", 1)
    mirror = F.concat(final, F.lit("/"), T.slug(F.when(path == "", final).otherwise(path)), F.lit(".md"))
    return full.select(
        "url", "domain", "status", F.when(got, F.col("http_status")).alias("http_status"), F.when(got, F.col("final_url")).alias("final_url"), F.when(got, final).alias("final_domain"), F.when(got, F.col("content_type")).alias("content_type"),
        F.when(read, title).alias("title"), F.when(got, F.col("error")).alias("error"), F.when(F.col("status") == "mirrored", mirror).alias("mirror_path"), "n_refs", "refs",
    )


def in_order(records_: DataFrame) -> DataFrame:
    """Records with their `position` in the order of status, domain and URL, over all rows and without one task that sees them all.
    Records of one URL, fetched more than once, go by what the fetches say, so that positions are the same in every run."""
    told = ("http_status", "final_url", "content_type", "title", "error")
    return settled(records_, *(F.col(c) for c in ("status", "domain", "url", *told)))

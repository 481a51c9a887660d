"""URLs: validity, hosts, article links, status before any fetch and after it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .let import let

URL = r"https?://[^\s)>\]\"']+"
# Characters that end a sentence rather than a URL, and parts that mark a placeholder.
TRAILING = ".,;:)]}`\"'"
PLACEHOLDERS = ["{", "}", "<", ">", "${", "yourhub", "yourdomain", "yourcompany", "example.com", "window.location", "author.email", "url.com"]
ARTICLE_URL = r"(?i)/article/(\d{4,8})(?:[/?#].*)?$"
UNCAPTURED = ["blocked", "auth-gated", "likely-auth-gated", "needs-google-drive", "binary-or-empty"]
RESTRICTED = ["blocked", "auth-gated", "likely-auth-gated", "needs-google-drive"]
SIGN_IN = "(?i)sign in|log in|login"


def strip_trailing(x: Column) -> Column:
    return F.rtrim(x, F.lit(TRAILING))


def host(x: Column) -> Column:
    """Lower-cased host, without credentials and port; a regular expression, as parse_url throws on odd URLs."""
    return F.lower(F.regexp_extract(x, r"^[a-z]+://(?:[^/?#@]*@)?([^/?#:@]+)", 1))


def clean_url(x: Column) -> Column:
    """The URL without trailing marks; null if it isn't http(s), is a placeholder, has blanks, or its host has no dot or is internal."""

    def checked(url: Column) -> Column:
        place = F.regexp_extract(url, "^https?://([^/?#]*)", 1)
        placeholder = reduce(lambda a, b: a | b, (F.contains(F.lower(url), F.lit(p)) for p in PLACEHOLDERS))
        ok = url.rlike("^https?://") & ~placeholder & ~url.rlike("[ \n`]") & F.contains(place, F.lit(".")) & ~F.endswith(place, F.lit(".internal"))
        return F.when(ok, url)

    return let(strip_trailing(F.trim(x)), checked)


def article_id(x: Column) -> Column:
    return let(F.regexp_extract(x, ARTICLE_URL, 1), lambda n: F.when(n != "", n))


def article_url(number: Column, template: Column) -> Column:
    """The template filled with an article number; '' unless the number is all digits and there is a template."""
    return F.when(number.rlike(r"^\d+$") & (template != ""), F.replace(template, F.lit("{article_id}"), number)).otherwise("")


def known_article_url(x: Column) -> Column:
    """scheme://host/article/id for links to articles; any other URL loses its fragment."""
    article = lambda n: F.concat(F.regexp_extract(x, "^(https?://[^/?#]*)", 1), F.lit("/article/"), n)
    return F.coalesce(article(article_id(x)), F.substring_index(x, "#", 1))


def special_status(x: Column, stale_hosts: list[str]) -> Column:

    def status(at: Column) -> Column:
        stale = at.isin(stale_hosts) if stale_hosts else F.lit(False)
        drive = F.startswith(at, F.lit("docs.google.com")) | F.startswith(at, F.lit("drive.google.com"))
        gated = F.contains(at, F.lit("confluence.")) | F.contains(at, F.lit("zendesk.com"))
        return F.when(drive, "needs-google-drive").when(stale, "stale-doc-reference").when(gated, "likely-auth-gated")

    return let(host(x), status)


def fetch_status(http_status: Column, error: Column, body: Column) -> Column:
    """What a fetch came to: refused, failed, empty, a sign-in page, or a body that can be mirrored."""
    return (
        F.when(http_status.isin(401, 403), "auth-gated")
        .when((http_status >= 400) | error.isNotNull(), "blocked")
        .when(F.coalesce(body, F.lit("")) == "", "binary-or-empty")
        .when(F.left(body, F.lit(2000)).rlike(SIGN_IN), "auth-gated")
        .otherwise("mirrored")
    )

"""Redaction of credentials in URLs, e-mail addresses, private addresses and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .let import let

# What is searched and what it becomes.
CREDENTIALS = (r"(https?://)([^/\s@]+)@", "$1[REDACTED_CREDENTIALS]@")
EMAIL = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[REDACTED_EMAIL]")
PRIVATE_IP = (r"\b(?:10(?:\.\d{1,3}){3}|172\.(?:1[6-9]|2\d|3[0-1])(?:\.\d{1,3}){2}|192\.168(?:\.\d{1,3}){2})\b", "[REDACTED_PRIVATE_IP]")
PERSON = "[REDACTED_PERSON]"
# two and more capitalised words in a row; possessive, as Java takes a stack frame for each word of a group that may give some back
CAPITALS = r"\b[A-Z][a-z]++(?: [A-Z][a-z]++\b)++"


def redact(x: Column) -> Column:
    for pattern, mark in (CREDENTIALS, EMAIL, PRIVATE_IP):
        x = F.regexp_replace(x, pattern, mark.replace("$1[", "$1\\["))
    return x


def phrases(x: Column) -> Column:
    """All neighbouring two and three capitalised words of a text, each once: what may be a name."""
    of = lambda w: F.flatten(F.transform(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.array(*(F.when(i + n <= F.size(w), F.array_join(F.slice(w, i + 1, n), " ")) for n in (2, 3)))))
    runs = F.transform(F.regexp_extract_all(x, F.lit(CAPITALS), F.lit(0)), lambda r: let(F.split(r, " "), of))
    return F.array_distinct(F.array_compact(F.flatten(runs)))


def redact_names(x: Column, names: Column) -> Column:
    """The text with every phrase that is one of the names (an array) marked: from the left, three words before two."""

    def cleared(run: Column) -> Column:
        words = F.split(run, " ")
        start = F.struct(F.lit(0).alias("skip"), F.array().cast("array<string>").alias("shown"))

        def step(w: Column, s: Column, i: Column) -> Column:
            is_name = {n: F.array_contains(names, F.array_join(F.slice(w, i + 1, n), " ")) & (i + n <= F.size(w)) for n in (2, 3)}
            put = lambda text, skip: F.struct(F.lit(skip).alias("skip"), F.array_append(s["shown"], text).alias("shown"))
            passed = F.struct((s["skip"] - 1).alias("skip"), s["shown"].alias("shown"))
            return F.when(s["skip"] > 0, passed).when(is_name[3], put(F.lit(PERSON), 2)).when(is_name[2], put(F.lit(PERSON), 1)).otherwise(put(F.get(w, i), 0))

        shown = let(words, lambda w: F.array_join(F.aggregate(F.sequence(F.lit(0), F.size(w) - 1), start, lambda s, i: step(w, s, i))["shown"], " "))
        return F.when(F.exists(names, lambda n: F.contains(run, n)), shown).otherwise(run)

    def whole(text: Column) -> Column:
        pieces = F.arrays_zip(F.split(text, CAPITALS).alias("gap"), F.transform(F.regexp_extract_all(text, F.lit(CAPITALS), F.lit(0)), cleared).alias("shown"))
        return F.array_join(F.transform(pieces, lambda p: F.concat(p["gap"], F.coalesce(p["shown"], F.lit("")))), "")

    return let(x, whole)

"""Names of notes, by what they are of."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T
from .let import let

LONG = 180  # characters of the names that end in a hash or a path
HINT = 48


def _parts(*parts: Column | str) -> Column:
    return F.concat_ws(" - ", *(F.lit(p) if isinstance(p, str) else p for p in parts))


def _base(path: Column) -> Column:
    """The name of a file without its last suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def support(article_id: Column, path: Column, title: Column) -> Column:
    """Of an article, by its number; without one, by what stands before the first dash of its file name."""
    number = F.coalesce(article_id, F.lit(""))
    return T.safe_filename(F.when(number != "", _parts("Support", number, title)).otherwise(_parts("Support Reference", F.substring_index(_base(path), "-", 1), title)))


def wiki(path: Column, title: Column) -> Column:
    """Of a wiki page: its section, its title, its file name where that says something else, and eight digits of its path's SHA-1."""
    section = F.when(F.contains(path, F.lit("/")), F.split_part(path, F.lit("/"), F.lit(1))).otherwise("Root")
    digest = F.left(F.sha1(path), F.lit(8))
    named = lambda hint: F.when(T.dedupe_key(hint) != T.dedupe_key(title), _parts("Wiki", section, title, hint, digest)).otherwise(_parts("Wiki", section, title, digest))
    return T.safe_filename(let(T.safe_filename(F.replace(_base(path), F.lit("-"), F.lit(" ")), HINT), named), LONG)


def repo(name: Column) -> Column:
    return T.safe_filename(_parts("Repo", name))


def capability(title: Column) -> Column:
    return T.safe_filename(_parts("Capability", title))


def code_reference(repository: Column, path: Column) -> Column:
    return T.safe_filename(_parts("Code Ref", repository, F.replace(path, F.lit("/"), F.lit(" -- "))), LONG)

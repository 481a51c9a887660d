"""Text scalars as Column expressions."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from .let import let

#: Named entities of HTML 5, as the html module lists them; those without a semicolon are read only where no longer name goes on.
ENTITIES = {name.rstrip(";"): text for name, text in sorted(html5.items(), key=lambda e: e[0].endswith(";"))}
_BARE = "|".join(sorted((name for name in html5 if not name.endswith(";")), key=lambda name: (-len(name), name)))
#: Numbers that stand for other characters, as browsers read them.
ODD_NUMBERS = {n: bytes([n]).decode("cp1252", errors="replace") for n in range(0x80, 0xA0)}
# Lines that are left-overs of a web page.
NOISE = "^(?i)(pleasesign into comment|comments|posted|sign in|log in|login)$"
SOURCE_LINE = "*source:*"
HEADING = r"(?m)^[ \t]{0,3}#{1,6}[ \t]+([^\n]*[^\s])[ \t]*$"
H1 = r"(?m)^[ \t]*#[ \t]+([^\n]*[^\s])[ \t]*$"
ARTICLE = r"(?i)\bArticle\s+(\d{4,6})\b"


def strip(x: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def normalize(x: Column) -> Column:
    """White space of any kind collapses to single spaces; none is left at the ends."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def dedupe_key(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^a-z0-9]+", "")


def slug(x: Column, limit: int = 120) -> Column:
    """Lower-cased runs of ASCII letters and digits, joined by dashes; 'item' if there are none."""
    return F.coalesce(_filled(F.left(F.lower(F.btrim(F.regexp_replace(x, "[^A-Za-z0-9]+", "-"), F.lit("-"))), F.lit(limit))), F.lit("item"))


def spaced(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, "[^A-Za-z0-9]+", " "))


def safe_filename(x: Column, limit: int = 120) -> Column:
    kept = F.left(F.trim(F.regexp_replace(x, "[^A-Za-z0-9 ._-]+", "")), F.lit(limit))
    return F.coalesce(_filled(F.rtrim(kept, F.lit(" ."))), F.lit("Untitled"))


def title_case(x: Column) -> Column:
    """Every run of a-z starts with a capital (so 3d becomes 3D); for text of a-z, digits and spaces."""
    runs = F.regexp_extract_all(x, F.lit("[a-z]+|[^a-z]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.substring(r, 2, 1 << 30))), "")


def display_title(x: Column) -> Column:
    def shown(flat: Column) -> Column:
        named = title_case(F.replace(F.regexp_replace(F.lower(flat), r"^\d+-", ""), F.lit("-"), F.lit(" ")))
        return F.left(F.when(F.lower(flat).rlike(r"^\d+-[a-z0-9-]+$"), named).otherwise(flat), F.lit(160))

    return F.coalesce(_filled(let(normalize(F.translate(x, "`|", "' ")), shown)), F.lit("Untitled"))


def _filled(x: Column) -> Column:
    """Null for ''."""
    return let(x, lambda v: F.when(v != "", v))


def lines(x: Column) -> Column:
    """Lines of a text; a final line break makes no further line."""
    return F.split(F.regexp_replace(F.replace(x, F.lit("\r\n"), F.lit("\n")), "\n$", ""), "\n")


def _first_line(x: Column, tidy) -> Column:
    return F.get(F.filter(F.transform(lines(x), tidy), lambda line: line != ""), F.lit(0))


def page_title(x: Column, fallback: Column) -> Column:
    """The first level-one heading, else the first line with anything on it (160 characters at most), else the fallback."""
    return F.coalesce(_filled(normalize(F.regexp_extract(x, H1, 1))), F.left(_first_line(x, strip), F.lit(160)), fallback)


def note_title(x: Column, fallback: Column) -> Column:
    """The first heading of any level, else the first line, else the fallback; shown as a display title."""
    return display_title(F.coalesce(_filled(F.regexp_extract(x, HEADING, 1)), _first_line(x, normalize), fallback))


def tokens(x: Column) -> Column:
    """Distinct lower-cased runs of three or more ASCII letters and digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit("[A-Za-z0-9]{3,}"), F.lit(0)))


def unescape(x: Column, ended: bool = False) -> Column:
    """Text of HTML with its numeric and named entities read; what is none stays. Texts without an ampersand are not searched.
    ended: only entities that a semicolon ends are read, so that '&amp' at the end of a cut title stays."""

    def named(raw: Column) -> Column:
        bare = F.regexp_extract(raw, f"^&({_BARE})", 1)
        start = F.lit(None).cast("string") if ended else F.when(bare != "", F.concat(F.try_element_at(_entities(), bare), F.substring(raw, F.length(bare) + 2, F.length(raw))))
        return F.coalesce(F.try_element_at(_entities(), F.regexp_extract(raw, "^&([^;]+);$", 1)), start, raw)

    def numbered(digits: Column, base: int) -> Column:
        n = F.when(F.length(digits) <= 7, F.conv(digits, base, 10).cast("int"))
        odd = F.try_element_at(F.create_map(*(F.lit(v) for kv in ODD_NUMBERS.items() for v in kv)), n)
        wrong = n.isNull() | (n == 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
        utf16 = F.lpad(F.hex(n), 8, "0")
        return F.when(wrong, F.lit("\ufffd")).otherwise(F.coalesce(odd, F.decode(F.unhex(utf16), "UTF-32")))

    def read(e: Column) -> Column:
        hexes, digits = F.regexp_extract(e, "^&#[xX]([0-9a-fA-F]+);?$", 1), F.regexp_extract(e, "^&#([0-9]+);?$", 1)
        return F.when(hexes != "", numbered(hexes, 16)).when(digits != "", numbered(digits, 10)).otherwise(named(e))

    pattern = "&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]{1,31});" if ended else f"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]{{1,31}};|{_BARE})"

    def whole(text: Column) -> Column:
        found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), read)
        pieces = F.arrays_zip(F.split(text, pattern).alias("gap"), found.alias("shown"))
        return F.array_join(F.transform(pieces, lambda p: F.concat(p["gap"], F.coalesce(p["shown"], F.lit("")))), "")

    return let(x, lambda text: F.when(F.contains(text, F.lit("&")), whole(text)).otherwise(text))


def _entities() -> Column:
    return F.from_json(F.lit(json.dumps(ENTITIES)), "map<string,string>")


def html_text(x: Column, ended: bool = False) -> Column:
    bare = F.regexp_replace(F.regexp_replace(x, r"(?is)<(script|style)[^>]*>.*?</\1>", " "), "<[^>]+>", " ")
    return normalize(unescape(bare, ended))


def html_title(x: Column, fallback: Column, ended: bool = False) -> Column:
    found = F.regexp_extract(x, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.coalesce(_filled(normalize(unescape(found, ended))), fallback)


def identifier_words(x: Column) -> Column:
    return F.lower(normalize(F.regexp_replace(F.translate(x, "_-", "  "), "([a-z0-9])([A-Z])", "$1 $2")))


def is_noise(flat: Column) -> Column:
    """Of a normalised line."""
    return (flat == "") | flat.rlike(NOISE) | F.startswith(F.lower(flat), F.lit(SOURCE_LINE))


def imported_markdown(x: Column) -> Column:
    """A provenance header before the first rule goes if it names its source; so do noise and blank lines."""

    def body(flat: Column) -> Column:
        return let(F.instr(flat, "\n---\n"), lambda at: F.when((at > 0) & F.contains(F.left(flat, at - 1), F.lit("*Source:*")), F.substring(flat, at + 5, F.length(flat))).otherwise(flat))

    kept = F.filter(F.transform(lines(let(F.replace(x, F.lit("\r\n"), F.lit("\n")), body)), lambda s: F.regexp_replace(s, r"(?U)\s+$", "")), lambda s: ~let(normalize(s), is_noise))
    return strip(F.array_join(kept, "\n"))


def link_target(x: Column) -> Column:
    return F.regexp_replace(F.rtrim(strip(x), F.lit("/")), r"\.md$", "")


def wiki_target(target: Column, path: Column) -> Column:
    """The path of a relative link to a markdown file, seen from the folder of `path`; null for anything else."""
    bare = F.substring_index(F.substring_index(strip(target), "#", 1), "?", 1)
    folder = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    ok = ~F.contains(target, F.lit("://")) & F.endswith(bare, F.lit(".md"))
    return F.when(ok, F.when(folder == "", bare).otherwise(F.concat(folder, F.lit("/"), bare)))


def frontmatter_block(x: Column) -> Column:
    return F.regexp_extract(x, r"^---\n((?s).*?)\n---\n?", 1)


def flat_frontmatter(x: Column) -> Column:
    """Flat `key: value` lines of the block at the top, as a map; of repeated keys the last counts."""
    pairs = F.filter(F.split(frontmatter_block(x), "\n"), lambda s: F.contains(s, F.lit(":")))
    entries = F.transform(pairs, lambda s: F.struct(F.trim(F.substring_index(s, ":", 1)).alias("k"), F.trim(F.substring(s, F.instr(s, ":") + 1, F.length(s))).alias("v")))
    return let(entries, lambda all_: F.map_from_entries(F.filter(all_, lambda e, i: ~F.exists(F.slice(all_, i + 2, F.size(all_)), lambda o: o["k"] == e["k"]))))

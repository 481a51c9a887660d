"""The frontmatter of a note as lists of values: one fold over its lines, with a small state machine.

It reads what notes have at their top: `key: value`, values in single or double quotes, lists in brackets or one item a line, block
text after | or >, values that go on in indented lines, and comments. Nested mappings are not read: their lines are indented and part
of no value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .let import let
from .text import frontmatter_block

KEY = r"^([^\s:#\-\"'\[{][^:]*?)\s*:(?:\s+(.*))?$"
ITEM = r"^\s*-(?:\s+(.*))?$"
DOUBLE = r'^"((?:[^"\\]|\\.)*)"\s*(?:#.*)?$'
SINGLE = r"^'((?:[^']|'')*)'\s*(?:#.*)?$"
FLOW = r"""^\[((?:"(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\]"'])*)\]\s*(?:#.*)?$"""
FLOW_ITEM = r"""\s*("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^,]+)"""

_NONE = "cast(array() as array<string>)"


def _group(x: Column, pattern: str) -> Column:
    return F.regexp_extract(x, pattern, 1)


def scalar(x: Column) -> Column:
    """One value without its quotes; a plain one without its comment."""

    def read(v: Column) -> Column:
        double = F.get(F.from_json(F.concat(F.lit('["'), _group(v, DOUBLE), F.lit('"]')), "array<string>"), F.lit(0))
        plain = F.rtrim(F.regexp_replace(v, r"(?:^|\s+)#.*$", ""))
        return F.when(v.rlike(DOUBLE), F.coalesce(double, _group(v, DOUBLE))).when(v.rlike(SINGLE), F.replace(_group(v, SINGLE), F.lit("''"), F.lit("'"))).otherwise(plain)

    return let(F.trim(x), read)


def _flow(x: Column) -> Column:
    found = F.regexp_extract_all(_group(x, FLOW), F.lit(FLOW_ITEM), F.lit(1))
    return F.filter(F.transform(found, scalar), lambda v: v != "")


def _state(s: Column | None = None, **new: Column) -> Column:
    kinds = {"key": "string", "mode": "string", "text": "string", "items": "array<string>", "out": "array<struct<k:string,v:array<string>>>"}
    return F.struct(*((new[k] if k in new else s[k]).cast(t).alias(k) for k, t in kinds.items()))


def _value(s: Column) -> Column:
    """The values of the key at hand: none for an empty or null one."""
    text = F.when(s["text"].isin("", "~", "null"), F.expr(_NONE)).otherwise(F.array(s["text"]))
    return F.when(s["mode"].isin("list", "done"), s["items"]).when(s["mode"].isin("literal", "folded"), F.array(F.rtrim(s["text"], F.lit(" \n")))).when(s["mode"] == "open", F.expr(_NONE)).otherwise(text)


def _flushed(s: Column) -> Column:
    """What is read so far, with the key at hand."""
    return F.when(s["key"].isNull(), s["out"]).otherwise(F.array_append(s["out"], F.struct(s["key"].alias("k"), _value(s).alias("v"))))


def _begun(s: Column, value: Column) -> dict[str, Column]:
    """The state of a key at its first line."""
    quoted, listed = value.rlike(DOUBLE) | value.rlike(SINGLE), value.rlike(FLOW)
    mode = (
        F.when(value.rlike(r"^(#.*)?$"), "open").when(value.rlike(r"^[|>][+-]?\s*$"), F.when(F.startswith(value, F.lit("|")), "literal").otherwise("folded"))
        .when(quoted | listed, "done").when(value.rlike("^[\"']"), "quoted").when(F.startswith(value, F.lit("[")), "flow").otherwise("plain")
    )
    items = F.when(listed, _flow(value)).when(quoted, F.array(scalar(value))).otherwise(F.expr(_NONE))
    text = F.when(mode == "plain", scalar(value)).when(mode.isin("quoted", "flow"), value).otherwise("")
    return {"mode": mode, "items": items, "text": text}


def _step(s: Column, line: Column) -> Column:
    bare = F.trim(F.translate(line, "\r\t", "  "))
    indented = line.rlike(r"^[ \t]")

    def told(b: Column) -> Column:
        whole = F.concat_ws(" ", s["text"], b)
        closed = whole.rlike(DOUBLE) | whole.rlike(SINGLE)
        unfinished = F.when(
            s["mode"] == "quoted", F.when(closed, _state(s, mode=F.lit("done"), items=F.array(scalar(whole)))).otherwise(_state(s, text=whole))
        ).otherwise(F.when(whole.rlike(FLOW), _state(s, mode=F.lit("done"), items=_flow(whole))).otherwise(_state(s, text=whole)))
        block = _state(s, text=F.when(s["text"] == "", b).otherwise(F.concat(s["text"], F.when(s["mode"] == "literal", F.lit("\n")).otherwise(F.lit(" ")), b)))
        item = _state(s, mode=F.lit("list"), items=F.array_append(s["items"], scalar(F.regexp_extract(b, ITEM, 1))))
        key = let(F.coalesce(F.trim(F.regexp_extract(b, KEY, 2)), F.lit("")), lambda v: _state(s, key=_group(b, KEY), out=_flushed(s), **_begun(s, v)))
        more = _state(s, mode=F.lit("plain"), text=F.trim(F.concat_ws(" ", s["text"], scalar(b))))
        return (
            F.when(s["mode"].isin("quoted", "flow"), unfinished).when(s["mode"].isin("literal", "folded") & (indented | (b == "")), block)
            .when((b == "") | F.startswith(b, F.lit("#")), s).when(s["mode"].isin("open", "list") & b.rlike(ITEM), item)
            .when(~indented & b.rlike(KEY), key).when(indented & (s["mode"] == "plain") | indented & (s["mode"] == "open") & ~b.rlike(KEY), more).otherwise(s)
        )

    return let(bare, told)


def parse(x: Column) -> Column:
    """map<string, array<string>> of the block at the top of a text; of repeated keys the last counts. A text without a block (or a null
    one) has an empty map; a key without a value, or with null or ~, has no values; block
    text ends without a line break."""
    start = _state(key=F.lit(None), mode=F.lit("open"), text=F.lit(""), items=F.expr(_NONE), out=F.expr("cast(array() as array<struct<k:string,v:array<string>>>)"))
    found = F.aggregate(F.split(F.coalesce(frontmatter_block(x), F.lit("")), "\n"), start, _step, _flushed)
    return let(found, lambda all_: F.map_from_entries(F.filter(all_, lambda e, i: ~F.exists(F.slice(all_, i + 2, F.size(all_)), lambda o: o["k"] == e["k"]))))

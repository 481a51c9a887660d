"""Chat formatting (operator 8): link tool calls with results, order them, validate arguments, write canonical JSON."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from decimal import Decimal
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, saved, small, table

#: Schemas of the tools that the query derives calls for. Schema tables of any size work; up to this many rows are broadcast.
BROADCAST_SCHEMAS = 10_000
#: Conversations of at most this many calls and parents are ordered in one task each; longer ones by joins.
IN_TASK = 20_000
SCHEMAS = {
    "search": {"type": "object", "properties": {"query": {"type": "string"}, "limit": {"type": "integer", "minimum": 0}}, "required": ["query", "limit"], "additionalProperties": False},
    "lookup": {"type": "object", "properties": {"key": {"type": "string"}, "exact": {"type": "boolean"}}, "required": ["key"], "additionalProperties": False},
    "summarise": {"type": "object", "properties": {"text": {"type": "string"}, "style": {"enum": ["short", "long"]}}, "required": ["text", "style"]},
}


def _number(value: Decimal) -> str:
    """One text for equal numbers: plain digits up to 21 places before and 7 after the point, else digits and an exponent."""
    sign, digits, exponent = value.as_tuple()
    text = "".join(map(str, digits)).lstrip("0")
    kept = text.rstrip("0")
    if not kept:
        return "0"
    exponent += len(text) - len(kept)
    point = len(kept) + exponent
    if 0 < point <= 21:
        plain = kept[:point].ljust(point, "0") + (f".{kept[point:]}" if len(kept) > point else "")
    elif -7 < point <= 0:
        plain = f"0.{'0' * -point}{kept}"
    else:
        plain = f"{kept[0]}{'.' * (len(kept) > 1)}{kept[1:]}e{point - 1}"
    return "-" * sign + plain


def _string(value: str) -> str:
    """Lone halves of surrogate pairs, which are no text, stay escaped."""
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", json.dumps(value, ensure_ascii=False))


def canonical(value) -> str:
    """One text for equal values: keys in order of code points, no spaces, no escapes that JSON doesn't need, and numbers by value, so
    that 1, 1.0 and 1e0 are the same."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{_string(k)}:{canonical(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, str):
        return _string(value)
    if value is None or isinstance(value, bool):
        return json.dumps(value)
    return _number(Decimal(value))


def parsed(text: str):
    """JSON with exact numbers. NaN and infinities are refused; of repeated keys the last counts."""

    def refused(name: str):
        raise ValueError(name)

    return json.loads(text, parse_float=Decimal, parse_int=Decimal, parse_constant=refused)


def _is(value, kind) -> bool:
    number = isinstance(value, Decimal)
    return {"string": isinstance(value, str), "integer": number and value == value.to_integral_value(), "number": number, "boolean": isinstance(value, bool), "object": isinstance(value, dict), "array": isinstance(value, list), "null": value is None}.get(kind, False)


def violations(value, schema, at: str = "$") -> list[str]:
    """What of type (a name or a list of names), enum, minimum, maximum, required, properties, additionalProperties and items is
    broken, in order. A schema of true allows everything; false, or anything that is no schema, allows nothing. Keywords with values
    of the wrong kind say nothing."""
    if not isinstance(schema, dict):
        return [] if schema is True else [f"{at}: not allowed"]
    get = lambda name, kind: schema[name] if isinstance(schema.get(name), kind) else None
    if kinds := get("type", (str, list)):
        kinds = [kinds] if isinstance(kinds, str) else [k for k in kinds if isinstance(k, str)]
        if not any(_is(value, k) for k in kinds):
            return [f"{at}: not of type {' or '.join(kinds)}"]
    out = []
    if (allowed := get("enum", list)) is not None and canonical(value) not in map(canonical, allowed):
        out.append(f"{at}: not one of the allowed values")
    if isinstance(value, Decimal):
        low, high = get("minimum", Decimal), get("maximum", Decimal)
        out += [f"{at}: below the minimum"] * (low is not None and value < low) + [f"{at}: above the maximum"] * (high is not None and value > high)
    if isinstance(value, dict):
        known, more = get("properties", dict) or {}, schema.get("additionalProperties", True)
        out += [f"{at}: lacks {k}" for k in get("required", list) or [] if isinstance(k, str) and k not in value]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{at}.{k}")
            elif more is False:
                out.append(f"{at}: has unknown {k}")
            elif isinstance(more, dict):
                out += violations(value[k], more, f"{at}.{k}")
    if isinstance(value, list) and isinstance(schema.get("items"), (dict, bool)):
        for i, x in enumerate(value):
            out += violations(x, schema["items"], f"{at}[{i}]")
    return out


@lru_cache(maxsize=256)
def _schema(text: str):
    return parsed(text)


def judge(arguments: str | None, schema: str | None) -> tuple[str, list[str]]:
    """The canonical text of the arguments (null if they can't be parsed) and what is wrong with them."""
    if arguments is None:
        return "null", ["$: no arguments"]
    try:
        value = parsed(arguments)
        text = canonical(value)
    except (ValueError, ArithmeticError, RecursionError):
        return "null", ["$: not JSON"]
    if schema is None:
        return text, ["$: unknown tool"]
    try:
        wrong = violations(value, _schema(schema))
    except (ValueError, ArithmeticError, RecursionError):
        wrong = ["$: its schema can't be read"]
    return text, [_string(w)[1:-1] if re.search("[\ud800-\udfff]", w) else w for w in wrong]


def _message(r: dict) -> tuple[list[str], str]:
    """Errors and canonical JSON of a call and its result; parts that are canonical already are put together in order of their keys."""
    call = result = "null"
    wrong = []
    if r["has_call"]:
        arguments, wrong = judge(r["arguments"], r["schema"])
        call = f'{{"arguments":{arguments},"id":{canonical(r["call_id"])},"name":{canonical(r["name"])},"parents":{canonical(r["parents"])}}}'
    if r["has_result"]:
        result = canonical({"id": r["call_id"], "content": r["content"]})
    return wrong, f'{{"call":{call},"conversation":{canonical(r["conv_id"])},"depth":{canonical(r["depth"])},"result":{result}}}'


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order of their conversations: `at` is a row's place among those of its conversation in this part."""
    last, n = ..., 0
    for whole in batches:
        for start in range(0, len(whole), 1000):
            batch = whole.slice(start, 1000)
            errors, messages, at = [], [], []
            for r in batch.to_pylist():
                last, n = r["conv_id"], n + 1 if r["conv_id"] == last else 0
                at.append(n)
                wrong, message = _message(r)
                errors.append(wrong)
                messages.append(message)
            kept = batch.select(["conv_id", "call_id", "result_no", "depth", "in_cycle", "has_call", "has_result"])
            kept = kept.append_column("errors", pa.array(errors, pa.list_(pa.string()))).append_column("message", pa.array(messages, pa.string()))
            yield kept.append_column("part", pa.array([TaskContext.get().partitionId()] * len(batch), pa.int32())).append_column("at", pa.array(at, pa.int64()))


def _order(group: pa.Table) -> pa.Table:
    """Depths of one conversation: calls are taken once all their parents are; those never taken depend on themselves."""
    calls = dict(zip(group.column("call_id").to_pylist(), group.column("parents").to_pylist(), strict=True))
    waits, children = Counter(), {}
    for call, parents in calls.items():
        for p in parents:
            waits[call] += 1
            children.setdefault(p, []).append(call)
    depth, ready = {}, [c for c in calls if not waits[c]]
    depth |= dict.fromkeys(ready, 0)
    while ready:
        above = ready.pop()
        for c in children.get(above, []):
            depth[c] = max(depth.get(c, 0), depth[above] + 1)
            waits[c] -= 1
            if not waits[c]:
                ready.append(c)
    found = [(group.column("conv_id")[0].as_py(), c, None if waits[c] else depth[c], bool(waits[c])) for c in calls]
    return pa.Table.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.bool_()))], names=["conv_id", "call_id", "depth", "in_cycle"])


def _chains(nodes: DataFrame) -> DataFrame:
    """nodes (conv_id, call_id, up) with `root` and `far`: where the chain of ups ends and how far; null for chains that never end.

    Pointer doubling: rounds grow with the logarithm of the longest chain; each is one join in which a call has one row."""
    up = F.col("up")
    state = saved(nodes.select("conv_id", "call_id", "up", F.coalesce("up", "call_id").alias("root"), F.when(up.isNull(), 0).otherwise(1).cast("long").alias("far")), "chains")
    for _ in range(max(state.count(), 1).bit_length() + 1):
        if state.where("up IS NOT NULL").isEmpty():
            break
        above = state.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("root").alias("top"), F.col("far").alias("more"))
        moved = state.where("up IS NOT NULL").join(above, ["conv_id", "up"]).select("conv_id", "call_id", F.col("next").alias("up"), F.col("top").alias("root"), (F.col("far") + F.col("more")).alias("far"))
        state, before = saved(state.where("up IS NULL").unionByName(moved), "chains"), state
        forget(before)
    ends = F.col("up").isNull()
    return state.select("conv_id", "call_id", F.when(ends, F.col("root")).alias("root"), F.when(ends, F.col("far")).alias("far"))


def _order_by_joins(calls: DataFrame) -> DataFrame:
    """Depths of any number of calls, without gathering a conversation. Calls of one parent hang in chains, which pointer doubling
    measures; what is left are the calls of several parents, taken round by round once the roots of all their parents' chains are."""
    nodes = saved(calls.select("conv_id", "call_id", "parents", F.when(F.size("parents") == 1, F.col("parents")[0]).alias("up")), "nodes")
    chains = saved(_chains(nodes), "chained")
    joints = nodes.where(F.size("parents") > 1).select("conv_id", F.col("call_id").alias("joint"), F.explode("parents").alias("call_id"))
    edges = joints.join(chains, ["conv_id", "call_id"]).select("conv_id", "joint", "root", (F.col("far") + 1).alias("far"))
    edges = saved(edges, "joints")
    known = saved(nodes.where(F.size("parents") == 0).select("conv_id", F.col("call_id").alias("root"), F.lit(0).cast("long").alias("depth")), "known")
    while True:
        left = edges.join(known.select("conv_id", F.col("root").alias("joint")), ["conv_id", "joint"], "left_anti")
        ready = left.join(known, ["conv_id", "root"], "left").groupBy("conv_id", "joint").agg(F.max(F.col("depth") + F.col("far")).alias("depth"), F.count_if(F.col("depth").isNull()).alias("waits"))
        new = saved(ready.where("waits = 0").select("conv_id", F.col("joint").alias("root"), "depth"), "known")
        if new.isEmpty():
            break
        known = known.unionByName(new)
    found = chains.join(known, ["conv_id", "root"], "left").select("conv_id", "call_id", (F.col("depth") + F.col("far")).alias("depth"))
    return found.withColumn("in_cycle", F.col("depth").isNull())


def depths(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, depth, in_cycle for distinct calls (conv_id, call_id, parents): 0 without a known parent, else one more than
    the deepest parent. A call that depends on itself, or on one that does, has no depth.

    Conversations of at most IN_TASK calls and parents are ordered in one task each, all others by joins, so that no task gathers
    more than this."""
    each = calls.select("conv_id", "call_id", F.explode(F.array_distinct("parents")).alias("parent")).where("parent IS NOT NULL")
    known = each.join(calls.select("conv_id", F.col("call_id").alias("parent")), ["conv_id", "parent"]).groupBy("conv_id", "call_id").agg(F.collect_set("parent").alias("parents"))
    linked = saved(calls.select("conv_id", "call_id").join(known, ["conv_id", "call_id"], "left").withColumn("parents", F.coalesce("parents", F.array().cast("array<string>"))), "links")
    large = saved(linked.groupBy("conv_id").agg(F.sum(1 + F.size("parents")).alias("n")).where(F.col("n") > IN_TASK).select("conv_id"), "large")
    if large.isEmpty():
        return linked.groupBy("conv_id").applyInArrow(_order, "conv_id long, call_id string, depth long, in_cycle boolean")
    large = F.broadcast(large) if small(large) else large
    rest = linked.join(large, "conv_id", "left_anti").groupBy("conv_id").applyInArrow(_order, "conv_id long, call_id string, depth long, in_cycle boolean")
    return rest.unionByName(_order_by_joins(linked.join(large, "conv_id", "left_semi")))


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row for each result and for each call without result: conv_id, position, call_id, result_no, depth, status, errors, message.

    calls: conv_id, call_id, name, arguments (JSON text), and parent_id, or parent_ids (a list), or both. results: conv_id, call_id,
    result_no, content. schemas: name, schema (JSON text). Calls and results meet by (conv_id, call_id). position counts the rows of
    a conversation from 0 in order of (depth, call_id, result_no, content), what has no depth last: a call stands after all its
    parents. status: ok; unanswered (no result); orphan (no such call); invalid (errors says why); cycle (the call depends on
    itself; it has no depth). message is canonical JSON of the call and its result.

    Of calls that repeat an id in a conversation the smallest (name, arguments, parents) counts; repeated results are all kept.
    Calls without conv_id or call_id are left out, results without them are orphans. Null names or arguments are invalid, and so are
    arguments that are no JSON; lone surrogates stay escaped. Parents that name no call count as none. Unknown tools are invalid, and
    so are calls of a tool whose schema can't be read; of several schemas of a tool the smallest text counts, null ones don't. Empty
    tables are allowed; with both empty there are no rows. Texts are whole; conversations are dealt to tasks in sorted parts, so
    that no task gathers a long one."""
    one = F.array(F.col("parent_id").cast("string")) if "parent_id" in calls.columns else F.array().cast("array<string>")
    several = F.coalesce(F.col("parent_ids").cast("array<string>"), F.array().cast("array<string>")) if "parent_ids" in calls.columns else F.array().cast("array<string>")
    parents = F.array_sort(F.array_distinct(F.array_compact(F.concat(one, several))))
    c = calls.select(F.col("conv_id").cast("long").alias("conv_id"), *(F.col(n).cast("string").alias(n) for n in ("call_id", "name", "arguments")), parents.alias("parents")).where("conv_id IS NOT NULL AND call_id IS NOT NULL")
    first = F.min(F.struct(*(F.coalesce(n, F.lit("")).alias(f"k_{n}") for n in ("name", "arguments")), "parents", "name", "arguments")).alias("s")
    c = saved(c.groupBy("conv_id", "call_id").agg(first).select("conv_id", "call_id", "s.name", "s.arguments", "s.parents"), "calls")
    s = schemas.where("schema IS NOT NULL").groupBy("name").agg(F.min("schema").alias("schema"))
    full = c.join(depths(c), ["conv_id", "call_id"]).join(F.broadcast(s) if small(s, BROADCAST_SCHEMAS) else s, "name", "left").withColumn("has_call", F.lit(True))
    r = results.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("call_id").cast("string").alias("call_id"), F.col("result_no").cast("long").alias("result_no"), F.col("content").cast("string").alias("content"), F.lit(True).alias("has_result"))
    answered = r.join(full, ["conv_id", "call_id"], "left")
    silent = full.join(r.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_anti")
    rows = answered.unionByName(silent, allowMissingColumns=True)
    rows = saved(rows.withColumns({"has_call": F.coalesce("has_call", F.lit(False)), "has_result": F.coalesce("has_result", F.lit(False)), "in_cycle": F.coalesce("in_cycle", F.lit(False))}), "linked")
    order = ["conv_id", F.col("depth").asc_nulls_last(), "call_id", "result_no", "content"]
    done = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_format, "conv_id long, call_id string, result_no long, depth long, in_cycle boolean, has_call boolean, has_result boolean, errors array<string>, message string, part int, at long")
    done = saved(done, "formatted")
    forget(rows)
    counts = done.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("n")).where("before > 0")  # a part goes on with one conversation at most
    before = before.select(F.col("conv_id").alias("of_conv"), F.col("part").alias("of_part"), "before")
    placed = done.join(F.broadcast(before), done["conv_id"].eqNullSafe(before["of_conv"]) & (done["part"] == before["of_part"]), "left")
    status = F.when(~F.col("has_call"), "orphan").when(F.col("in_cycle"), "cycle").when(F.size("errors") > 0, "invalid").when(~F.col("has_result"), "unanswered").otherwise("ok")
    position = F.col("at") + F.coalesce("before", F.lit(0))
    return placed.select("conv_id", position.alias("position"), "call_id", "result_no", "depth", status.alias("status"), "errors", "message")


def derived(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that the conversations stand for: every assistant turn calls a tool with its whole text, depending on the
    call of the assistant turn before, and in every third turn on the one before that too; every user turn is the result of the call
    one turn earlier. Some calls break their schema and some results have no call, by turn and text length alone."""
    t = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    call = lambda turn: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    n = F.length("text")
    kind = n % 3
    name = F.when(kind == 0, "search").when(kind == 1, "lookup").otherwise("summarise")
    json_of = lambda **fields: F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())))
    arguments = F.when(n % 11 == 5, json_of(limit=n % 10)).when(kind == 0, json_of(query=F.col("text"), limit=n % 10)).when(kind == 1, json_of(key=F.col("text"), exact=n % 2 == 0)).otherwise(json_of(text=F.col("text"), style=F.when(n % 2 == 0, "short").otherwise("long")))
    calls = t.where("role = 'assistant'").select("conv_id", call(F.col("turn")).alias("call_id"), F.filter(F.array(*(F.when(F.col("turn") - back >= 0, call(F.col("turn") - back)) for back in (2, 4))), lambda p, i: p.isNotNull() & ((i == 0) | (F.col("turn") % 3 == 0))).alias("parent_ids"), name.alias("name"), arguments.alias("arguments"))
    results = t.where("role = 'user'").select("conv_id", call(F.col("turn") - 1).alias("call_id"), F.col("turn").alias("result_no"), F.col("text").alias("content"))
    return calls, results


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = derived(table(spark, sf_dir, "conversations"))
    schemas = spark.createDataFrame([(k, canonical(v)) for k, v in SCHEMAS.items()], "name string, schema string")
    return link(calls, results, schemas).withColumn("errors", F.array_join("errors", "; "))

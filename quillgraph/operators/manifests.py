"""Checks of many product manifests at once: JSON as VARIANT, its fields as rows, rules as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.manifest import PATHS, REQUIRED, REQUIRED_OF_REPOSITORY, REQUIRED_PARTS, STATUSES
from ..sources.shared import saved

# JSON of what counts as not given.
EMPTY = ["null", "false", "0", "0.0", '""', "[]", "{}"]
AUDIT, READINESS = "audit.md", "readiness.md"


def parsed(manifests: DataFrame) -> DataFrame:
    """manifest, root (VARIANT) for rows of manifest (a name of its own) and text (JSON); root is null for what is no mapping."""
    root = F.try_parse_json(F.coalesce("text", F.lit("")))
    return manifests.select("manifest", root.alias("root")).select("manifest", F.when(_kind(F.col("root")) == "OBJECT", F.col("root")).alias("root"))


def _kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, ...; null for a field that is not there."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _members(rows: DataFrame, of: str) -> DataFrame:
    """manifest, prefix, place, key, value of the members of a VARIANT column."""
    return rows.sparkSession.sql(f"SELECT t.manifest, t.prefix, e.pos AS place, e.key, e.value FROM {{rows}} t, LATERAL variant_explode(t.{of}) e", rows=rows)


def fields(roots: DataFrame) -> DataFrame:
    """manifest, path, kind, json: every field of manifests down to the items of lists: a, a.b, a.b[0], a.b[0].c. Each level is one
    variant_explode() over all manifests; a mapping's members below a list item are the last."""
    none = F.lit("")
    out, rows = [], roots.select("manifest", none.alias("prefix"), F.col("root").alias("v")).where("v IS NOT NULL")
    for _ in range(4):
        named = F.when(F.col("key").isNull(), F.concat("prefix", F.lit("["), F.col("place").cast("string"), F.lit("]"))).when(F.col("prefix") == "", F.col("key")).otherwise(F.concat("prefix", F.lit("."), "key"))
        level = _members(rows, "v").select("manifest", named.alias("path"), F.col("value"), _kind(F.col("value")).alias("kind"))
        out.append(level.select("manifest", "path", "kind", F.to_json("value").alias("json")))
        rows = level.where(F.col("kind").isin("OBJECT", "ARRAY")).select("manifest", F.col("path").alias("prefix"), F.col("value").alias("v"))
    whole = out[0]
    for level in out[1:]:
        whole = whole.unionByName(level)
    return whole


def _text(json: Column) -> Column:
    """A JSON string as text, other JSON as it is."""
    return F.get(F.from_json(F.concat(F.lit("["), json, F.lit("]")), "array<string>"), F.lit(0))


def _asked(names: DataFrame, rules: list[str]) -> DataFrame:
    """manifest, path: every rule for every manifest; the rules are a fixed list."""
    return names.select("manifest", F.explode(F.array(*map(F.lit, rules))).alias("path"))


def _broken(rows: DataFrame, message: Column | str, level: str = "error") -> DataFrame:
    return rows.select("manifest", F.lit(level).alias("level"), F.col("path").alias("field"), (F.lit(message) if isinstance(message, str) else message).alias("message"))


def violations(manifests: DataFrame, known: DataFrame | None = None, told: DataFrame | None = None) -> DataFrame:
    """manifest, level, field, message: one row for each broken rule of each manifest, as plans.manifest.violations() has for one.

    A text that is no JSON mapping is one error of field ''. With `known` (path), paths that it lacks are warnings. Rules meet the
    fields by equi-joins on manifest and path; nothing is collected. Fields lie in the shared folder, as many rules read them; told:
    fields() of the manifests, where they are at hand."""
    roots = parsed(manifests)
    told = saved(fields(roots), "manifest-fields") if told is None else told
    good = roots.where("root IS NOT NULL").select("manifest")
    given = told.where(~F.col("json").isin(EMPTY)).select("manifest", "path")
    mapping = told.where("kind = 'OBJECT'").select("manifest", "path")
    parts = told.where(F.col("path").isin(REQUIRED))
    item = F.regexp_extract("path", r"^(repositories\.items\[\d+\])$", 1)
    items = told.select("manifest", "path", "kind", item.alias("item")).where("item <> ''")
    full_items = items.where("kind = 'OBJECT'").join(given, ["manifest", "path"], "left_semi")
    of_item = full_items.select("manifest", F.explode(F.array(*(F.concat("path", F.lit(f".{k}")) for k in REQUIRED_OF_REPOSITORY))).alias("path"))
    named = told.where(F.col("path").rlike(r"^repositories\.items\[\d+\]\.name$")).join(given, ["manifest", "path"], "left_semi").select("manifest", _text(F.col("json")).alias("name"))
    twice = named.groupBy("manifest", "name").count().where("count > 1")
    category = r"^engineering_readiness\.categories\[\d+\]"
    status = told.where(F.col("path").rlike(category + r"\.status$")).select("manifest", F.regexp_extract("path", category, 0).alias("at"), _text(F.col("json")).alias("status")).where(~F.col("status").isin(STATUSES) | F.col("status").isNull())
    key = told.where(F.col("path").rlike(category + r"\.key$")).select("manifest", F.regexp_extract("path", category, 0).alias("at"), _text(F.col("json")).alias("key"))
    bad_status = status.join(key, ["manifest", "at"], "left").select("manifest", F.concat(F.lit("engineering_readiness."), F.coalesce("key", F.lit("None"))).alias("path"))
    out = [
        roots.where("root IS NULL").select("manifest", F.lit("error").alias("level"), F.lit("").alias("field"), F.lit("the root must be a mapping").alias("message")),
        _broken(_asked(good, REQUIRED).join(told, ["manifest", "path"], "left_anti"), "is required"),
        _broken(parts.join(mapping, ["manifest", "path"], "left_anti"), "is no mapping"),
        _broken(_asked(good, [f"{k}.{n}" for k, names in REQUIRED_PARTS.items() for n in names]).join(given, ["manifest", "path"], "left_anti"), "is required"),
        _broken(_asked(good, ["repositories.items"]).join(given, ["manifest", "path"], "left_anti"), "is empty"),
        _broken(items.where("kind <> 'OBJECT' OR kind IS NULL"), "is no mapping"),
        _broken(of_item.join(given, ["manifest", "path"], "left_anti"), "is required"),
        _broken(twice.withColumn("path", F.lit("repositories.items")), F.concat("name", F.lit(" occurs more than once"))),
        _broken(bad_status, f"status is none of {', '.join(STATUSES)}"),
        _broken(_asked(good, ["engineering_readiness.categories", "automation_pack"]).join(given, ["manifest", "path"], "left_anti"), "is empty", "warning"),
    ]
    if known is not None:
        paths = told.where(F.col("path").isin([f"{k}.{n}" for k, n in PATHS]) | F.col("path").rlike(r"^repositories\.items\[\d+\]\.local_path$"))
        at = paths.join(given, ["manifest", "path"], "left_semi").select("manifest", "path", _text(F.col("json")).alias("at"))
        missing = at.join(known.select(F.col("path").alias("at")).distinct(), "at", "left_anti")
        out.append(_broken(missing, F.concat("at", F.lit(" does not exist")), "warning"))
    whole = out[0]
    for rows in out[1:]:
        whole = whole.unionByName(rows)
    return whole


def readiness(told: DataFrame) -> DataFrame:
    """manifest, status, n: readiness categories of each manifest by status; a missing or unknown one counts as missing. told: fields()."""
    category = r"^engineering_readiness\.categories\[\d+\]"
    listed = told.where(F.col("path").rlike(category + "$")).select("manifest", F.col("path").alias("at"))
    said = told.where(F.col("path").rlike(category + r"\.status$")).select("manifest", F.regexp_extract("path", category, 0).alias("at"), _text(F.col("json")).alias("status"))
    status = F.when(F.col("status").isin(STATUSES), F.col("status")).otherwise("missing")
    return listed.join(said, ["manifest", "at"], "left").groupBy("manifest", status.alias("status")).agg(F.count("*").alias("n"))


def doctor(manifests: DataFrame, known: DataFrame, told: DataFrame | None = None) -> DataFrame:
    """manifest, manifest_ok, validate_ok, vault_ok, audit_ok, readiness_ok, healthy: the state of every product of a portfolio. known
    (path) are the paths that exist: a vault, and its audit and readiness reports."""
    roots = parsed(manifests)
    told = saved(fields(roots), "manifest-fields") if told is None else told
    failed = violations(manifests, told=told).where("level = 'error'").select("manifest").distinct().withColumn("_failed", F.lit(True))
    vault = told.where("path = 'product.vault_path'").select("manifest", _text(F.col("json")).alias("vault"))
    rows = roots.select("manifest", F.col("root").isNotNull().alias("manifest_ok")).join(failed, "manifest", "left").join(vault, "manifest", "left")
    there = known.select(F.col("path").alias("_at")).distinct()
    for name, suffix in (("vault_ok", ""), ("audit_ok", f"/{AUDIT}"), ("readiness_ok", f"/{READINESS}")):
        rows = rows.withColumn("_at", F.concat("vault", F.lit(suffix))).join(there.withColumn(name, F.lit(True)), "_at", "left").drop("_at").withColumn(name, F.coalesce(name, F.lit(False)))
    rows = rows.withColumn("validate_ok", F.col("_failed").isNull())
    flags = ["manifest_ok", "validate_ok", "vault_ok", "audit_ok", "readiness_ok"]
    healthy = F.col(flags[0])
    for f in flags[1:]:
        healthy = healthy & F.col(f)
    return rows.select("manifest", *flags, healthy.alias("healthy"))


#: Paths of a manifest that a readiness report looks at.
CHECKED = {
    "Vault path": "product.vault_path", "Workspace path": "product.workspace_path", "Source corpus": "sources.corpus_path", "Source mirror": "sources.mirror_path", "Auth cache": "sources.auth_cache_path",
    "Local clone root": "repositories.local_clone_root", "Safe mirror root": "repositories.safe_mirror_root",
}
_CATEGORY = "struct<key:string,title:string,status:string,ask:string,summary:string,evidence:array<string>,missing:array<string>,next_steps:array<string>>"


def reports(manifests: DataFrame, known: DataFrame, home: str = "automations") -> DataFrame:
    """manifest, body: the readiness report of every product: a summary by status, which paths exist, which automations are installed
    (home/<id>/automation.toml), and the categories. known (path) are the paths that exist.

    The paths of all manifests, some ten each, meet the known ones in one join and return to their manifests as a short list; a text
    that is no JSON mapping has no report."""
    roots = parsed(manifests).where("root IS NOT NULL")
    get = lambda path, kind: F.try_variant_get("root", f"$.{path}", kind)
    automations = get("automation_pack", "map<string,struct<automation_id:string,status:string>>")
    rows = roots.select(
        "manifest", *(F.coalesce(get(f"product.{k}", "string"), F.lit(other)).alias(k) for k, other in (("name", "Product"), ("slug", ""), ("mode", ""))),
        F.coalesce(F.size(get("repositories.items", "array<variant>")), F.lit(0)).alias("n_repos"), F.coalesce(get("engineering_readiness.categories", f"array<{_CATEGORY}>"), F.expr(f"cast(array() as array<{_CATEGORY}>)")).alias("categories"),
        F.array(*(F.struct(F.lit(i).alias("at"), F.lit(label).alias("label"), get(path, "string").alias("path")) for i, (label, path) in enumerate(CHECKED.items()))).alias("paths"),
        F.array_sort(F.transform(F.filter(F.map_entries(F.coalesce(automations, F.expr("cast(map() as map<string,struct<automation_id:string,status:string>>)"))), lambda e: e["value"].isNotNull()), lambda e: F.struct(e["key"].alias("key"), F.coalesce(e["value"]["automation_id"], F.lit("")).alias("id"), F.coalesce(e["value"]["status"], F.lit("unknown")).alias("status")))).alias("automations"),
    )
    asked = F.concat(F.transform("paths", lambda p: p["path"]), F.transform("automations", lambda a: F.concat(F.lit(f"{home}/"), a["id"], F.lit("/automation.toml"))))
    each = rows.select("manifest", F.explode(F.array_distinct(F.array_compact(asked))).alias("path"))
    there = each.join(known.select("path").distinct(), "path", "left_semi").groupBy("manifest").agg(F.collect_set("path").alias("there"))  # some ten paths each
    full = rows.join(there, "manifest", "left").withColumn("there", F.coalesce("there", F.expr("cast(array() as array<string>)")))
    yes = lambda path: F.when(F.coalesce(F.array_contains("there", path), F.lit(False)), "yes").otherwise("no")
    status = lambda c: F.when(c["status"].isin(STATUSES), c["status"]).otherwise("missing")
    count = lambda s: F.size(F.filter("categories", lambda c: status(c) == s)).cast("string")
    ticked = lambda label, x: F.concat(F.lit(f"- {label}: `"), x, F.lit("`"))

    def listed(label: str, items: Column, mark: str = "") -> Column:
        return F.when(F.size(items) > 0, F.concat(F.lit(f"- {label}:\n"), F.array_join(F.transform(items, lambda x: F.concat(F.lit(f"  - {mark}"), x, F.lit(mark))), "\n")))

    def category(c: Column) -> Column:
        title = F.coalesce(c["title"], c["key"], F.lit("Untitled"))
        said = F.when(F.coalesce(c["summary"], F.lit("")) != "", F.concat(F.lit("- Summary: "), c["summary"]))
        return F.concat_ws("\n", F.concat(F.lit("### "), title, F.lit("\n")), ticked("Ask", F.coalesce(c["ask"], F.lit(""))), ticked("Status", status(c)), said, listed("Evidence", c["evidence"], "`"), listed("Missing", c["missing"]), listed("Next steps", c["next_steps"]))

    automation = lambda a: F.concat(F.lit("- "), a["key"], F.lit(": id `"), F.when(a["id"] == "", "missing").otherwise(a["id"]), F.lit("`, status `"), a["status"], F.lit("`, installed `"), yes(F.concat(F.lit(f"{home}/"), a["id"], F.lit("/automation.toml"))), F.lit("`"))
    parts = [
        F.concat(F.lit("# "), "name", F.lit(" Engineering Readiness Report")), F.concat_ws("\n", ticked("Product slug", F.col("slug")), ticked("Mode", F.col("mode")), ticked("Repositories declared", F.col("n_repos").cast("string"))),
        F.lit("## Status Summary"), F.concat_ws("\n", *(ticked(s.title(), count(s)) for s in STATUSES)), F.lit("## Runtime Checks"), F.array_join(F.transform("paths", lambda p: F.concat(F.lit("- "), p["label"], F.lit(" exists: `"), yes(p["path"]), F.lit("`"))), "\n"),
        F.lit("## Automation Checks"), F.when(F.size("automations") > 0, F.array_join(F.transform("automations", automation), "\n")), F.lit("## Readiness Categories"), F.when(F.size("categories") > 0, F.array_join(F.transform("categories", category), "\n\n")),
    ]
    return full.select("manifest", F.concat(F.concat_ws("\n\n", *parts), F.lit("\n")).alias("body"))

"""Configuration of a product: reading, checking and defaults. Small dictionaries on the driver; violations as a DataFrame."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What a manifest must have, and the statuses of a readiness category.
REQUIRED = ["product", "sources", "profile", "repositories", "automation_pack", "engineering_readiness"]
REQUIRED_PARTS = {
    "product": ["name", "slug", "mode", "vault_path", "workspace_path"], "sources": ["corpus_path", "mirror_path", "auth_cache_path"],
    "profile": ["intelligence_path"], "repositories": ["local_clone_root", "safe_mirror_root"],
}
REQUIRED_OF_REPOSITORY = ["owner", "name", "role", "default_branch", "local_path", "url"]
PATHS = [("product", "vault_path"), ("product", "workspace_path"), ("sources", "corpus_path"), ("repositories", "local_clone_root")]
STATUSES = ["done", "partial", "missing"]


def load(text: str) -> dict:
    """A mapping from YAML, or from JSON where no YAML reader is installed."""
    try:
        import yaml
    except ImportError:
        try:
            found = json.loads(text)
        except json.JSONDecodeError as e:
            raise ValueError("no YAML reader is installed, and this is no JSON") from e
    else:
        found = yaml.safe_load(text)
    if not isinstance(found, dict):
        raise ValueError("the root must be a mapping")
    return found


def slug(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", name.lower()).strip("-") or "product"


def defaults(name: str) -> dict:
    """A manifest with everything that is required and nothing known yet."""
    areas = ["Ownership", "Local setup", "Testing", "Delivery", "Observability", "Security", "Data", "Documentation"]
    category = lambda title: {"key": slug(title), "title": title, "status": "missing", "ask": 0, "summary": "", "evidence": [], "missing": [], "next_steps": []}
    return {
        "product": {"name": name, "slug": slug(name), "mode": "product", "vault_path": f"vaults/{slug(name)}", "workspace_path": "."},
        "profile": {"intelligence_path": f"profiles/{slug(name)}.yaml"},
        "sources": {"corpus_path": "sources/corpus", "mirror_path": "sources/mirror", "docx_extract_path": "", "auth_cache_path": "sources/auth", "support_article_url_template": "", "stale_doc_hosts": []},
        "repositories": {"local_clone_root": "repositories", "safe_mirror_root": "mirrors", "items": []},
        "automation_pack": {},
        "engineering_readiness": {"categories": [category(a) for a in areas]},
    }


def violations(spark: SparkSession, manifest: dict, exists: Callable[[str], bool] | None = None) -> DataFrame:
    """level (error or warning), field, message: one row for each broken rule. With `exists`, paths are checked too."""
    rows = [("error", k, "is required") for k in REQUIRED if k not in manifest]
    part = {k: manifest.get(k) if isinstance(manifest.get(k), dict) else {} for k in REQUIRED}
    rows += [("error", k, "is no mapping") for k in part if k in manifest and not isinstance(manifest[k], dict)]
    rows += [("error", f"{k}.{name}", "is required") for k, names in REQUIRED_PARTS.items() for name in names if not part[k].get(name)]
    items = part["repositories"].get("items") or []
    rows += [("error", "repositories.items", "is empty")] * (not items)
    rows += [("error", f"repositories.items[{i}]", "is no mapping") for i, item in enumerate(items) if not isinstance(item, dict)]
    items = [item if isinstance(item, dict) else {} for item in items]
    rows += [("error", f"repositories.items[{i}].{k}", "is required") for i, item in enumerate(items) for k in REQUIRED_OF_REPOSITORY if item and not item.get(k)]
    names = [item.get("name") for item in items]
    rows += [("error", "repositories.items", f"{n} occurs more than once") for n in sorted({n for n in names if n and names.count(n) > 1})]
    categories = part["engineering_readiness"].get("categories") or []
    rows += [("warning", "engineering_readiness.categories", "is empty")] * (not categories)
    rows += [("error", f"engineering_readiness.{c.get('key')}", f"status is none of {', '.join(STATUSES)}") for c in categories if c.get("status", "missing") not in STATUSES]
    rows += [("warning", "automation_pack", "is empty")] * (not part["automation_pack"])
    if exists is not None:
        paths = {f"{k}.{name}": part[k].get(name) for k, name in PATHS} | {f"repositories.items[{i}].local_path": item.get("local_path") for i, item in enumerate(items)}
        rows += [("warning", field, f"{at} does not exist") for field, at in paths.items() if at and not exists(at)]
    return spark.createDataFrame(rows, "level string, field string, message string")


def repo_path(manifest: dict, role: str) -> PurePosixPath | None:
    """The path of the first repository of a role."""
    return next((PurePosixPath(r["local_path"]) for r in manifest.get("repositories", {}).get("items", []) if r.get("role") == role and r.get("local_path")), None)


def readiness(categories: DataFrame, *by: str) -> DataFrame:
    """status, n: categories by status (and by other columns); a missing or unknown status counts as missing."""
    status = F.when(F.col("status").isin(STATUSES), F.col("status")).otherwise("missing")
    return categories.groupBy(*by, status.alias("status")).agg(F.count("*").alias("n"))


def report(categories: DataFrame) -> DataFrame:
    """key, body: the part of a readiness report on each category (key, title, status, ask, summary, and evidence, missing and
    next_steps as arrays), as markdown."""

    def listed(label: str, name: str) -> Column:
        return F.when(F.size(name) > 0, F.concat(F.lit(f"- {label}:\n"), F.array_join(F.transform(F.col(name), lambda x: F.concat(F.lit("  - "), x)), "\n")))

    status = F.when(F.col("status").isin(STATUSES), F.col("status")).otherwise("missing")
    lines = [
        F.concat(F.lit("### "), F.coalesce("title", "key", F.lit("Untitled")), F.lit("\n")), F.concat(F.lit("- Ask: "), F.coalesce(F.col("ask").cast("string"), F.lit(""))), F.concat(F.lit("- Status: "), status),
        F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit("- Summary: "), "summary")), listed("Evidence", "evidence"), listed("Missing", "missing"), listed("Next steps", "next_steps"),
    ]
    return categories.select("key", F.concat_ws("\n", *lines).alias("body"))


def add_brain(registry: dict, brain: dict) -> dict:
    """The registry with one more brain; slugs are unique."""
    if any(b["slug"] == brain["slug"] for b in registry.get("brains", [])):
        raise ValueError(f"{brain['slug']} is registered already")
    return registry | {"brains": [*registry.get("brains", []), brain]}


def doctor(brains: DataFrame) -> DataFrame:
    """How many brains there are and how many lack a manifest, vault, profile, audit or readiness report (boolean columns)."""
    flags = ["has_manifest", "has_vault", "has_profile", "has_audit", "has_readiness"]
    return brains.agg(F.count("*").alias("n"), *(F.count_if(~F.coalesce(f, F.lit(False))).alias(f.replace("has", "lacks")) for f in flags))

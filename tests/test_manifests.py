"""Checks of many manifests at once against the check of one on the driver."""

import json

from pyspark.sql import functions as F

from quillgraph.operators import manifests as Ms
from quillgraph.plans import manifest as M


def changed(**parts):
    made = M.defaults("A B")
    made["repositories"]["items"] = [{"owner": "o", "name": "n", "role": "r", "default_branch": "main", "local_path": "x", "url": "u"}]
    made["automation_pack"] = {"daily": {"automation_id": "a", "status": "on"}}
    for path, value in parts.items():
        at = made
        *above, last = path.split("__")
        for k in above:
            at = at[k]
        if value is ...:
            del at[last]
        else:
            at[last] = value
    return made


CASES = {
    "whole": changed(), "none": {}, "no_product": changed(product=...), "list": changed(product=[1]), "empty": changed(product__name="", sources__corpus_path=None, repositories__items=[]),
    "items": changed(repositories__items=[{"owner": "o", "name": "n"}, 5, {}, {"name": "n", "url": "u"}]), "pack": changed(automation_pack={}, engineering_readiness={"categories": []}),
    "status": changed(engineering_readiness={"categories": [{"key": "k", "status": "odd"}, {"key": "l", "status": "done"}, {"key": "m"}]}), "zero": changed(product__name=0, product__slug=False),
}


def test_as_one_by_one(spark):
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in CASES.items()] + [("broken", "{"), ("null", None), ("array", "[1]")], "manifest string, text string").repartition(3)
    known = ["x", "."]
    got = Ms.violations(df, spark.createDataFrame([(k,) for k in known], "path string"))
    want = {("broken", "error", "", "the root must be a mapping"), ("null", "error", "", "the root must be a mapping"), ("array", "error", "", "the root must be a mapping")}
    for name, one in CASES.items():
        want |= {(name, *r) for r in M.violations(spark, one, lambda p: p in known).collect()}
    assert {tuple(r) for r in got.collect()} == want
    health = {r.manifest: r for r in Ms.doctor(df, spark.createDataFrame([("vaults/a-b",), ("vaults/a-b/audit.md",), ("vaults/a-b/readiness.md",)], "path string")).collect()}
    assert health["whole"].healthy and not health["list"].vault_ok and health["items"].vault_ok and not health["items"].validate_ok and not health["broken"].manifest_ok and len(health) == len(CASES) + 3
    counts = {(r.manifest, r.status): r.n for r in Ms.readiness(Ms.fields(Ms.parsed(df))).collect()}
    assert counts["status", "missing"] == 2 and counts["status", "done"] == 1 and counts["whole", "missing"] == 8 and ("pack", "missing") not in counts


def test_fields_have_paths(spark):
    df = spark.createDataFrame([("m", '{"a": {"b": [{"c": "x"}, [1]]}, "d": "é\\"", "e": null}')], "manifest string, text string")
    got = {r.path: r.json for r in Ms.fields(Ms.parsed(df)).where(F.col("kind") != "OBJECT").collect()}
    assert got == {"a.b": '[{"c":"x"},[1]]', "a.b[0].c": '"x"', "a.b[1]": "[1]", "a.b[1][0]": "1", "d": '"é\\""', "e": "null"}


def test_reports(spark):
    made = changed(engineering_readiness={"categories": [{"key": "tests", "title": "Testing", "status": "done", "ask": 3, "summary": "All right.", "evidence": ["ci"], "next_steps": ["more", "docs"]}, {"key": "docs"}]}, automation_pack={"b": {"status": "on"}, "a": {"automation_id": "x1", "status": "off"}, "z": 5})
    df = spark.createDataFrame([("m", json.dumps(made)), ("empty", "{}"), ("broken", "[")], "manifest string, text string")
    known = spark.createDataFrame([("vaults/a-b",), ("automations/x1/automation.toml",), ("automations/x1/automation.toml",)], "path string")
    got = {r.manifest: r.body for r in Ms.reports(df, known).collect()}
    assert got["m"] == """# A B Engineering Readiness Report

- Product slug: `a-b`
- Mode: `product`
- Repositories declared: `1`

## Status Summary

- Done: `1`
- Partial: `0`
- Missing: `1`

## Runtime Checks

- Vault path exists: `yes`
- Workspace path exists: `no`
- Source corpus exists: `no`
- Source mirror exists: `no`
- Auth cache exists: `no`
- Local clone root exists: `no`
- Safe mirror root exists: `no`

## Automation Checks

- a: id `x1`, status `off`, installed `yes`
- b: id `missing`, status `on`, installed `no`

## Readiness Categories

### Testing

- Ask: `3`
- Status: `done`
- Summary: All right.
- Evidence:
  - `ci`
- Next steps:
  - more
  - docs

### docs

- Ask: ``
- Status: `missing`
"""
    assert got["empty"].startswith("# Product Engineering Readiness Report") and got["empty"].endswith("## Readiness Categories\n") and "broken" not in got

"""Static analysis of code files as Column expressions: language, artifact, symbols, comments, risks, signals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T
from .let import let
from .lists import unique_lines

MAX_CHARS = 32_000
# File name suffixes and languages.
LANGUAGES = {
    ".js": "JavaScript", ".jsx": "JSX", ".ts": "TypeScript", ".tsx": "TSX", ".rb": "Ruby", ".go": "Go", ".yml": "YAML", ".yaml": "YAML",
    ".json": "JSON", ".swift": "Swift", ".m": "Objective-C", ".mm": "Objective-C++", ".h": "C/Objective-C header", ".sh": "Shell", ".sql": "SQL", ".py": "Python",
}
# File names, folders, path and name parts that are told apart.
SPECIAL_FILES = ["Dockerfile", "Gemfile", "Podfile", "Fastfile", "Rakefile"]
IGNORED_FOLDERS = [".git", "node_modules", "Pods", "vendor", "dist", "build", "__pycache__"]
LOW_SIGNAL = [".gitlab-ci", "package-lock.json", "yarn.lock", "pnpm-lock", "jquery", "bootstrap", "react-16", "test-data", "fake-cards", "graphiql/rails"]
TEST_ENDINGS = [".test.js", ".test.jsx", ".test.ts", ".test.tsx", ".spec.js", ".spec.jsx", ".spec.ts", ".spec.tsx", "_test.go", "_spec.rb"]
# Systems that a file may mention.
SYSTEMS = ["salesforce", "marketo", "hubspot", "eloqua", "tango", "oauth", "sso", "captcha", "redis", "postgres", "mysql", "metabase", "looker", "docker", "kubernetes", "fastlane", "referral"]
# Folders that say nothing of what a file is about.
GENERIC_FOLDERS = [
    "src", "lib", "internal", "app", "apps", "services", "service", "components", "component", "modules", "module", "shared", "common", "utils", "devops", "domain", "api", "client", "server", "web",
    "mobile", "ios", "android", "config", "configs", "scripts", "test", "tests", "spec", "specs",
]
# What each detector looks for.
UI = r"\b(?:React|render\(|useState|useEffect|Component\b|UIViewController)\b"
RISKS = {
    "todo": r"(?i)\b(?:TODO|FIXME|XXX)\b",
    "debug-log": r"\b(?:console\.(?:log|debug|warn|error)|print)\s*\(",
    "swallowed-error": r"(?is)(?:catch\s*\([^)]*\)\s*\{[^{}]{0,240}return\s+(?:null|undefined|false|0|\"\"|''))|(?:except\s+[A-Za-z_][A-Za-z0-9_]*\s*:\s*return\s+(?:None|False|0|\"\"|''))|(?:rescue\s+[A-Za-z_:][A-Za-z0-9_:]*\s*;\s*nil)",
    "raw-html": r"\b(?:innerHTML\s*=|dangerouslySetInnerHTML)\b",
    "eval": r"\beval\b",
    "plain-http": r"(?i)http://",
}
SIGNALS = {
    "http": r"(?i)\b(?:fetch|axios|curl|http\.|https\.|Net::HTTP|requests\.)",
    "environment": r"\b(?:process\.env|ENV\[|os\.Getenv|System\.getenv)\b",
    "async": r"\b(?:async|await|Promise<|Promise\.|go\s+[A-Za-z_]|dispatch_async)\b",
    "sql": r"(?i)\b(?:select|insert|update|delete|create\s+table|alter\s+table)\b",
    "ui": UI,
}
SYMBOLS = {
    "classes": (8, [r"\bclass\s+([A-Z][A-Za-z0-9_]*)\b", r"\btype\s+([A-Z][A-Za-z0-9_]*)\s+(?:struct|interface)\b", r"\binterface\s+([A-Z][A-Za-z0-9_]*)\b", r"@interface\s+([A-Z][A-Za-z0-9_]*)\b"]),
    "functions": (10, [
        r"\bexport\s+(?:default\s+)?(?:async\s+)?function\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(",
        r"\b(?:async\s+)?function\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(",
        r"\bfunc\s+(?:\([^)]+\)\s*)?([A-Za-z_][A-Za-z0-9_]*)\s*\(",
        r"\bdef\s+([A-Za-z_][A-Za-z0-9_!?=]*)\s*\(",
        r"\b(?:const|let|var)\s+([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z0-9_,\s]+)\s*=>",
    ]),
    "types": (8, [r"\btype\s+([A-Z][A-Za-z0-9_]*)\s*=", r"\benum\s+([A-Z][A-Za-z0-9_]*)\b", r"(?i)\b(?:CREATE|ALTER)\s+(?:TABLE|VIEW|INDEX|FUNCTION|PROCEDURE)\s+([A-Za-z_][A-Za-z0-9_.]*)"]),
}


def _any(x: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(x, F.lit(p)) for p in parts))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """The last dot and what follows, lower-cased; '' for none, or for a name that only starts with a dot."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def is_code(path: Column) -> Column:
    return file_name(path).isin(SPECIAL_FILES) | suffix(path).isin(list(LANGUAGES))


def is_ignored(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, IGNORED_FOLDERS)))


def is_low_signal(repo: Column, path: Column, sample: Column) -> Column:
    return _any(F.lower(F.concat_ws(" ", repo, path, sample)), LOW_SIGNAL)


def language(path: Column) -> Column:
    by_suffix = F.create_map(*(F.lit(v) for kv in LANGUAGES.items() for v in kv))
    name = file_name(path)
    return F.when(name == "Dockerfile", "Dockerfile").when(name.isin(SPECIAL_FILES[1:]), "Ruby DSL").otherwise(F.coalesce(F.try_element_at(by_suffix, suffix(path)), F.lit("Code")))


def artifact_kind(path: Column, body: Column) -> Column:
    """The first rule that holds names the kind of file."""
    # The labels of kinds.
    low, end = F.lower(path), suffix(path)
    rules = [
        (file_name(path) == "Dockerfile", "Container build definition"),
        (F.contains(low, F.lit("docker-compose")), "Container orchestration config"),
        (_any(low, [".gitlab-ci", ".github/workflows/"]), "CI/CD pipeline config"),
        (reduce(lambda a, b: a | b, (F.endswith(low, F.lit(e)) for e in TEST_ENDINGS)), "Automated test suite"),
        (_any(low, ["package-lock.json", "yarn.lock", "pnpm-lock"]), "Dependency lockfile"),
        (end == ".sql", "SQL script"),
        (end.isin(".yml", ".yaml"), "YAML configuration"),
        (end == ".json", "JSON configuration or schema"),
        (end.isin(".jsx", ".tsx"), "Frontend component module"),
        (end.isin(".js", ".ts") & (_any(low, ["component", "view", "container", "page"]) | body.rlike(UI)), "Frontend or UI module"),
        (end.isin(".js", ".ts") & _any(low, ["service", "api", "integration", "connector", "gateway", "auth"]), "Service or integration module"),
        (end.isin(".js", ".ts"), "Application module"),
        (end == ".go", "Go package or service"),
        (end == ".rb", "Ruby class or service"),
        (end == ".swift", "iOS source file"),
        (end.isin(".m", ".mm", ".h"), "Objective-C source file"),
        (end == ".sh", "Shell automation script"),
        (end == ".py", "Python module"),
    ]
    first, *rest = rules
    return reduce(lambda c, r: c.when(*r), rest, F.when(*first)).otherwise("Code artifact")


def symbols(body: Column, kind: str) -> Column:
    limit, patterns = SYMBOLS[kind]
    return unique_lines(F.concat(*(F.regexp_extract_all(body, F.lit(p), F.lit(1)) for p in patterns)), limit)


def systems(body: Column, path: Column) -> Column:
    """Systems that path or body name, with a capital, at most six."""
    found = let(F.lower(F.concat(path, F.lit("\n"), body)), lambda low: F.array(*(F.when(F.contains(low, F.lit(s)), F.lit(s.title())) for s in SYSTEMS)))
    return F.slice(F.array_compact(found), 1, 6)


def risks(body: Column, path: Column) -> Column:
    """Names of the detectors that fire, in their order; the path is asked after the errors."""
    fired = [F.when(body.rlike(p), F.lit(n)) for n, p in RISKS.items()]
    fired.insert(3, F.when(F.contains(F.lower(path), F.lit("gitlab")), F.lit("legacy-path")))
    return F.array_compact(F.array(*fired))


def conflicts(body: Column, path: Column, stale_hosts: list[str]) -> Column:
    stale = _any(F.lower(body), stale_hosts) if stale_hosts else F.lit(False)
    return F.array_compact(F.array(
        F.when(F.contains(F.lower(path), F.lit("gitlab")), F.lit("legacy-path")),
        F.when(stale, F.lit("stale-host")),
        F.when(_any(F.lower(path), ["package-lock.json", "yarn.lock", "pnpm-lock"]) & (artifact_kind(path, body) == "Dependency lockfile"), F.lit("lockfile")),
    ))


def signals(body: Column, path: Column) -> Column:
    """Which kinds of behaviour a file shows; SQL also by its suffix."""
    return F.array_compact(F.array(*(F.when(body.rlike(p) | (suffix(path) == ".sql" if n == "sql" else F.lit(False)), F.lit(n)) for n, p in SIGNALS.items())))


def _named(label: str, names: Column, limit: int) -> Column:
    return F.when(F.size(names) > 0, F.concat(F.lit(f"{label}: "), F.array_join(F.slice(names, 1, limit), ", ")))


def implementation(kind: Column, symbols_of: dict[str, Column], shown: Column, found: Column) -> Column:
    """What a file is made of, a line each, ten at most: its kind, its main classes, functions and types, its behaviour, its systems."""
    lines = [F.concat(F.lit("kind: "), kind), *(_named(k, symbols_of[k], n) for k, n in (("classes", 5), ("functions", 6), ("types", 5)))]
    return F.slice(F.array_compact(F.concat(F.array(*lines), F.transform(shown, lambda n: F.concat(F.lit("shows: "), n)), F.array(_named("systems", found, 6)))), 1, 10)


def intentions(kind: Column, focus: Column, symbols_of: dict[str, Column], comments: Column, sample: Column) -> Column:
    """What a file is there for, six lines at most: its first two comment lines, what its path and its symbols are about, and the
    sample line that a search found; without any of them, that it was found."""
    words = unique_lines(F.transform(F.concat(*(symbols_of[k] for k in ("classes", "functions", "types"))), T.identifier_words), 5)
    shown = F.when(F.coalesce(sample, F.lit("")) != "", F.concat(F.lit("matches: "), F.left(T.normalize(sample), F.lit(180))))
    lines = F.array_compact(F.concat(F.slice(comments, 1, 2), F.array(_named("path", focus, 5), _named("symbols", words, 5), shown)))
    none = F.array(F.concat(F.lit("found by search: "), F.lower(kind)))
    return unique_lines(let(lines, lambda found: F.when(F.size(found) > 0, found).otherwise(none)), 6)


def path_focus(path: Column) -> Column:
    """Words of the path's parts, without generic folders, at most five."""
    parts = F.filter(F.split(path, "/"), lambda p: (T.dedupe_key(p) != "") & ~T.dedupe_key(p).isin(GENERIC_FOLDERS))
    return unique_lines(F.transform(parts, lambda p: T.identifier_words(F.regexp_replace(p, r"^(.+)\.[^.]+$", "$1"))), 5)


def leading_comments(body: Column, limit: int = 4) -> Column:
    """The comment at the top of a file (first 80 lines): line comments and block comments, up to the first line of code.

    One pass over the lines carries (inside a block, finished, lines so far)."""
    start = F.struct(F.lit(False).alias("block"), F.lit(False).alias("done"), F.array().cast("array<string>").alias("found"))

    def step(s: Column, raw: Column) -> Column:
        line = T.strip(raw)
        opens = F.startswith(line, F.lit("/*"))
        inside = s["block"] | opens
        rest = F.when(opens, F.substring(line, 3, 1 << 30)).otherwise(line)
        closes = F.contains(rest, F.lit("*/"))
        in_block = T.strip(F.ltrim(F.when(closes, F.substring_index(rest, "*/", 1)).otherwise(rest), F.lit("*")))
        marked = line.rlike("^(//|#|--|;)")
        comment = T.normalize(F.when(line.rlike("^(//|--)"), F.substring(line, 3, 1 << 30)).otherwise(F.substring(line, 2, 1 << 30)))
        shebang, nothing = F.startswith(line, F.lit("#!")), line == ""
        skip = s["done"] | shebang | (nothing & (F.size(s["found"]) == 0) & ~s["block"])
        said = F.when(skip, F.lit("")).when(inside, T.normalize(in_block)).when(marked, comment).otherwise("")
        found = F.when(said != "", F.concat(s["found"], F.array(said))).otherwise(s["found"])
        done = s["done"] | (F.size(found) >= limit) | (~skip & ~inside & ~marked)
        return F.struct(F.when(skip, s["block"]).otherwise(inside & ~closes).alias("block"), done.alias("done"), found.alias("found"))

    return unique_lines(F.aggregate(F.slice(T.lines(body), 1, 80), start, step, lambda s: s["found"]), limit)


def analysis(body: Column, path: Column, sample: Column, stale_hosts: list[str], most: int | None = None) -> Column:
    """All of it for one file, as a struct; of a whole body, or of its first `most` characters (MAX_CHARS is a usual limit)."""

    def of(body: Column) -> Column:
        kinds = F.struct(*(symbols(body, k).alias(k) for k in SYMBOLS))
        first = F.struct(artifact_kind(path, body).alias("artifact_kind"), kinds.alias("symbols"), leading_comments(body).alias("comments"), signals(body, path).alias("behaviour"), systems(body, path).alias("systems"), path_focus(path).alias("focus"))
        return let(first, lambda f: rest(body, f, {k: f["symbols"][k] for k in SYMBOLS}))

    def rest(body: Column, f: Column, named: dict[str, Column]) -> Column:
        return F.struct(
            language(path).alias("language"), f["artifact_kind"].alias("artifact_kind"), *(x.alias(k) for k, x in named.items()), f["comments"].alias("comments"),
            implementation(f["artifact_kind"], named, f["behaviour"], f["systems"]).alias("implementation"), intentions(f["artifact_kind"], f["focus"], named, f["comments"], sample).alias("intentions"),
            risks(body, path).alias("risks"), conflicts(body, path, stale_hosts).alias("conflicts"),
        )

    return let(body if most is None else F.left(body, F.lit(most)), of)

"""Writers: inventories as JSON or Parquet, notes as files or as a table of paths and bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import text as T


def write_json(df: DataFrame, path: str, overwrite: bool = True) -> None:
    """Overwriting replaces what is there; else a path that exists is left alone."""
    df.write.mode("overwrite" if overwrite else "ignore").json(path)


def tidy(body: Column) -> Column:
    """No white space at line ends, one line break at the end."""
    return F.concat(F.regexp_replace(F.regexp_replace(body, r"[ \t]+(?=\n|$)", ""), r"\s+$", ""), F.lit("\n"))


def write_notes(notes: DataFrame, path: str, overwrite: bool = True) -> None:
    """notes (section, name, body): a folder for each section with rows of name and body, bodies tidied."""
    rows = notes.select("section", T.safe_filename(F.col("name")).alias("name"), tidy(F.col("body")).alias("body"))
    rows.write.mode("overwrite" if overwrite else "ignore").partitionBy("section").parquet(path)


def summary(**tables: DataFrame) -> DataFrame:
    """name, n: how many rows each table has, as one job."""
    first, *rest = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    for df in rest:
        first = first.unionByName(df)
    return first


def write_inventories(tables: dict[str, DataFrame], path: str) -> dict[str, int]:
    """Write every table as JSON below path/<name>, and tell how many rows each has: they are counted while they are written."""
    counts = {}
    for name, df in tables.items():
        seen = Observation(name)
        write_json(df.observe(seen, F.count(F.lit(1)).alias("n")), f"{path}/{name}")
        counts[name] = seen.get["n"]
    return counts


def scalar(x: Column) -> Column:
    """A YAML scalar: JSON text, which YAML reads."""
    return F.to_json(F.array(x)).substr(F.lit(2), F.length(F.to_json(F.array(x))) - 2)


def frontmatter(**fields: Column) -> Column:
    lines = [F.concat(F.lit(f"{k}: "), scalar(v)) for k, v in fields.items()]
    return F.concat_ws("\n", F.lit("---"), *lines, F.lit("---"))


def section(title: str, lines: Column, otherwise: str) -> Column:
    """A heading and a list; a sentence instead where the list is empty."""
    listed = F.when(F.size(lines) > 0, F.array_join(F.transform(lines, lambda s: F.concat(F.lit("- "), s)), "\n")).otherwise(otherwise)
    return F.concat(F.lit(f"## {title}\n\n"), listed)


def render_note(title: Column, fields: dict[str, Column], sections: list[tuple[str, Column, str]], body: Column) -> Column:
    """A whole note from structured columns: frontmatter, title, sections, content."""
    return F.concat_ws("\n\n", frontmatter(**fields), F.concat(F.lit("# "), title), *(section(*s) for s in sections), F.lit("## Content"), body)

"""Sinks: flat CSV, nested JSON, Markdown, ledgers and rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimforge.sources.readers import split_rejects

#: The flat export's columns; their order is frozen.
CSV_COLUMNS = ("id", "company", "segment", "state", "phase", "mw", "announced", "confidence")


def write_csv(projects: DataFrame, path: str) -> None:
    """One file in a stable order; for reports, whose size is a reader's."""
    projects.select(*CSV_COLUMNS).orderBy("state", "company", "id").coalesce(1).write.mode("overwrite").option("header", True).option("lineSep", "\n").csv(path)


def nested(projects: DataFrame, children: dict[str, DataFrame], key: str = "id", child_key: str = "project_id") -> DataFrame:
    """``id, document``: each project with its children as JSON, children in the order of their columns."""
    out = projects
    for name, child in children.items():
        fields = [c for c in child.columns if c != child_key]
        rows = child.groupBy(child_key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
        out = out.join(rows, out[key] == rows[child_key], "left").drop(child_key)
    return out.select(key, F.to_json(F.struct(*[c for c in out.columns])).alias("document"))


def _report(rows: DataFrame) -> list:
    """The rows of a report; for results of a reader's size, so rows past 10,000 raise."""
    found = rows.limit(10_001).collect()
    if len(found) > 10_000:
        raise ValueError("over 10,000 rows: no report")
    return found


def html(rows: DataFrame, title: str) -> str:
    """A page of its own with a table of a report's rows."""
    from html import escape

    line = lambda tag, cells: "<tr>" + "".join(f"<{tag}>{escape('' if x is None else str(x))}</{tag}>" for x in cells) + "</tr>"
    body = "\n".join(line("td", r) for r in _report(rows))
    return f'<!DOCTYPE html>\n<html><head><meta charset="utf-8"><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1>\n<table>\n{line("th", rows.columns)}\n{body}\n</table></body></html>\n'


def markdown(rows: DataFrame, title: str) -> str:
    """A table of a report's rows."""
    found = _report(rows)
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    lines = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in found]) + "\n"


def append_ledger(rows: DataFrame, path: str) -> None:
    """A JSON line for each row."""
    rows.write.mode("append").json(path)


def read_ledger(spark, path: str, schema: str) -> DataFrame:
    """The ledger's rows; malformed lines are left out."""
    parsed = F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    return spark.read.text(path).select(parsed.alias("r")).where("r is not null and r._bad is null").select("r.*").drop("_bad")


def write_rejects(df: DataFrame, rules: dict, path: str) -> DataFrame:
    """Writes rows that break a rule with the reasons, and returns the others."""
    good, bad = split_rejects(df, rules)
    bad.write.mode("overwrite").json(path)
    return good

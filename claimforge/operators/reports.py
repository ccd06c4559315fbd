"""Filters, coverage, exposure, rollups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def filtered(projects: DataFrame, company: str | None = None, state: str | None = None, phase: str | None = None, min_confidence: int | None = None,
             open_risks: DataFrame | None = None) -> DataFrame:
    """Conjunction of what is given; with ``open_risks`` only projects that have one, each once."""
    tests: list[Column] = []
    if company:
        tests.append(F.contains(F.lower("company"), F.lit(company.lower())))
    if state:
        tests.append(F.col("state") == state)
    if phase:
        tests.append(F.col("phase") == phase)
    if min_confidence is not None:
        tests.append(F.col("confidence") >= min_confidence)
    found = projects.where(reduce(lambda a, b: a & b, tests)) if tests else projects
    if open_risks is not None:
        found = found.join(open_risks, found["id"] == open_risks["project_id"], "left_semi")
    return found


def gap_coverage(rows: DataFrame, fields: dict[str, tuple[Column, Column]]) -> DataFrame:
    """``field, applicable, filled, pct`` from one pass; each field has (applies, value)."""
    counts = rows.agg(*[x for f, (applies, value) in fields.items() for x in (
        F.count_if(applies).alias(f"{f}_a"), F.count_if(applies & value.isNotNull()).alias(f"{f}_f"))])
    entries = [F.struct(F.lit(f).alias("field"), F.col(f"{f}_a").alias("applicable"), F.col(f"{f}_f").alias("filled")) for f in fields]
    rows = counts.select(F.explode(F.array(*entries)).alias("x")).select("x.*")
    return rows.withColumn("pct", F.bround(F.try_divide(F.lit(100.0) * F.col("filled"), F.col("applicable")), 0).cast("long"))


def exposure(risks: DataFrame, projects: DataFrame, by: str) -> DataFrame:
    """Open risks: each project's worst severity per group, then its MW (in cents) by severity, weighted 1, 1/2, 1/4."""
    worst = risks.where("status = 'open'").groupBy(by, "project_id").agg(F.max("severity_rank").alias("worst"))
    cents = F.round(F.col("mw") * 100).cast("long")
    joined = worst.join(projects.select(F.col("id").alias("project_id"), "mw"), "project_id")
    side = lambda k: F.sum(F.when(F.col("worst") == k, cents).otherwise(0))
    return joined.groupBy(by).agg(
        F.count("*").alias("projects"), side(3).alias("blocking"), side(2).alias("material"), side(1).alias("watch"),
        F.count_if(F.col("mw").isNull()).alias("uncosted")).withColumn("weighted", F.col("blocking") + F.col("material") / 2 + F.col("watch") / 4)


def year_grid(rows: DataFrame, date: str, value: Column, limit: int = 6) -> DataFrame:
    """``year, value`` for every year from the first to the last, ``limit`` at most; years without rows have 0."""
    sums = rows.groupBy(F.year(date).alias("year")).agg(F.sum(value).alias("value"))
    grid = sums.agg(F.min("year").alias("a"), F.max("year").alias("b")).where("a is not null").select(F.explode(F.sequence("a", F.least("b", F.col("a") + limit - 1))).alias("year"))
    return grid.join(sums, "year", "left").select("year", F.coalesce("value", F.lit(0)).alias("value"))


def top_by(rows: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")

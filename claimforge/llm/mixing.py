"""Mixing sources to target weights by subset-sum budget fitting.

Each source gets a target of words.  Whole repeats of the source come first; what is left of the
target is a budget that a subset of its documents has to fit.  Documents are counted by exact length,
and a bounded-knapsack dynamic program over lengths says how many of each to take; the documents are
then drawn by a seeded hash.  Only counts by length meet in one task, never documents.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimforge.llm.common import numbered
from claimforge.session import ensure_checkpoint_dir

#: The dynamic program's table; a budget beyond it is first filled in proportion to the counts.
TABLE = 1 << 16
#: Documents of one source and length that are ranked together.
DRAW = 4096


def targets(sources: DataFrame, most: float = 3.0) -> DataFrame:
    """``source, source_size`` to ``source, source_size, target``.

    Sources by code point, null last, weigh 1, 2, 3, repeating, and share all words; a target stops at
    ``most`` times its source's size, and the excess is shared again by weight until none is above.
    The table has a row a source.
    """
    weighed = sources.withColumn("w", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1).checkpoint()
    cap = F.col("source_size") * F.lit(float(most))
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    rate = 0.0
    while True:  # the rate only rises, and each round but the last caps a source more
        over = F.col("w") * F.lit(rate) > cap
        row = weighed.agg(F.sum(F.when(over, cap).otherwise(0.0)).alias("held"), F.sum(F.when(over, 0).otherwise(F.col("w"))).alias("free"), F.sum(over.cast("int")).alias("capped")).first()
        if not row.free:
            break
        found = (total - row.held) / row.free
        if found <= rate:
            break
        rate = found
    return weighed.select("source", "source_size", F.least(cap, F.col("w") * F.lit(rate)).alias("target"))


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, table: int = TABLE) -> np.ndarray:
    """How many documents of each length to take, so that their words come as near ``budget`` as they can."""
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    taken = np.zeros(len(lengths), np.int64)
    usable = (lengths > 0) & (counts > 0)
    total = int((lengths * counts)[usable].sum())
    if budget <= 0 or not total:
        return taken
    if budget >= total:
        return np.where(usable, counts, 0)
    if 2 * budget > total:  # what stays out is the smaller budget to fit
        return np.where(usable, counts - fit_budget(lengths, counts, total - int(budget), table), 0)
    rest = int(budget)
    if rest > table:
        share = counts * ((rest - table) / total)
        taken = np.where(usable, np.floor(share), 0).astype(np.int64)
        rest -= int((taken * lengths).sum())
        # one more of each length, those first that lost most by rounding, until the table holds the rest
        for k in np.argsort(-(share - taken), kind="stable"):
            if rest <= table:
                break
            if usable[k] and taken[k] < counts[k] and lengths[k] <= rest:
                taken[k] += 1
                rest -= int(lengths[k])
        for k in np.argsort(-lengths, kind="stable"):
            if rest > table and usable[k]:
                more = min(int(counts[k] - taken[k]), rest // int(lengths[k]))
                taken[k] += more
                rest -= more * int(lengths[k])
    most = rest + min(rest, table)  # a sum above the budget may be nearer than any below
    reach, came = np.zeros(most + 1, bool), np.full(most + 1, -1, np.int32)
    reach[0] = True
    items: list[tuple[int, int]] = []
    for k in np.argsort(-lengths, kind="stable"):
        size, left = int(lengths[k]), int(counts[k] - taken[k]) if usable[k] else 0
        left, part = min(left, most // size if size else 0), 1
        while left > 0:
            many = min(part, left)
            left, part = left - many, part * 2
            jump = many * size
            fresh = reach[:most + 1 - jump] & ~reach[jump:]
            if fresh.any():
                came[jump:][fresh] = len(items)
                reach[jump:] |= fresh
                items.append((int(k), many))
        if reach[rest]:
            break
    sums = np.flatnonzero(reach)
    at = int(sums[np.argmin(np.abs(sums - rest))])
    while at:
        k, many = items[came[at]]
        taken[k] += many
        at -= many * int(lengths[k])
    return taken


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("size", ignore_index=True)
    size, target = int(pdf["source_size"][0]), float(pdf["target"][0])
    repeats = int(target // size) if size else 0
    take = fit_budget(pdf["size"].to_numpy(), pdf["docs"].to_numpy(), round(target - repeats * size))
    return pd.DataFrame({"source": pdf["source"], "size": pdf["size"], "repeats": repeats, "take": take})


def word_count(text: F.Column) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42, row_col: str | None = None) -> DataFrame:
    """``doc_id, size, source_size, target, copies`` for every row, and ``row``, what ``row_col`` says of it.

    ``copies`` is how often the mix has the row, 0 to 3.  Null texts have no words; words of a null source are
    a source's, too.  The draw hangs on seed, id and text only; of rows alike in all three those of lower
    ``row_col`` come first, and without it they are interchangeable.  Other columns are not read.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size"), (F.col(row_col) if row_col else F.lit(0)).cast("long").alias("row"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("draw")).checkpoint()
    counts = rows.groupBy("source", "size").agg(F.count("*").alias("docs")).checkpoint()
    wanted = targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size"))).checkpoint()

    def same(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
        """Join on keys that may be null."""
        renamed = b.select(*(F.col(k).alias(f"_{k}") if k in keys else F.col(k) for k in b.columns))
        on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        return a.join(renamed, on).drop(*(f"_{k}" for k in keys))

    fitted = same(counts, wanted, "source").groupBy("source").applyInPandas(_fit, "source string, size long, repeats int, take long")
    plan = same(same(counts, fitted, "source", "size"), wanted, "source").checkpoint()
    # the first `take` of a source and length by draw: parts of about DRAW rows are ranked, whole parts counted
    parted = same(rows, plan, "source", "size").withColumn("part", F.floor(
        F.shiftrightunsigned("draw", 33) / F.lit(float(2**31)) * F.ceil(F.col("docs") / DRAW)))
    before = parted.groupBy("source", "size", "part").agg(F.count("*").alias("n"))
    before = before.withColumn("before", F.sum("n").over(Window.partitionBy("source", "size").orderBy("part")) - F.col("n")).drop("n")
    ranked = parted.withColumn("rank", F.row_number().over(Window.partitionBy("source", "size", "part").orderBy(F.shiftrightunsigned("draw", 33), "draw", "doc_id", "row")))
    return same(ranked, before, "source", "size", "part").select(
        "doc_id", "row", "size", "source_size", "target",
        (F.col("repeats") + (F.col("before") + F.col("rank") <= F.col("take")).cast("int")).alias("copies"))


def mix_documents(docs: DataFrame, seed: int = 42) -> DataFrame:
    """The rows of ``docs`` that the mix takes, repeats included, with all their columns.

    Every row is planned and taken for itself: rows without id and rows that repeat another come as often as
    the plan has each of them.
    """
    rows = numbered(docs)
    row, copies, copy = rows.columns[-1], *(f"{n}_{uuid.uuid4().hex}" for n in ("copies", "copy"))  # docs may have columns of any name
    plan = mix_plan(rows, seed=seed, row_col=row).where("copies > 0").select(F.col("row").alias(row), F.col("copies").alias(copies))
    taken = rows.join(plan, row).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return taken.drop(row, copies, copy)

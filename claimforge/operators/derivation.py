"""Derived values of what changed: dirty keys from a delta of claims, and only what hangs on them worked out again.

The result equals a full derivation: what isn't dirty has the claims that it had when its stored values were derived.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimforge.functions.numbers import h200_equivalent
from claimforge.operators.claims import strength

#: What a derivation reads of a claim; ``precision`` is how exactly a source stated a date (day, month, quarter, ...).
READS = ["key", "url", "field", "value_num", "value_date", "precision", "confirmed", "weight", "fetched_at", "decided_against"]
#: What it gives.
DERIVED = ["mw", "h200", "online", "online_precision", "sources"]


def dirty_keys(before: DataFrame, after: DataFrame) -> DataFrame:
    """Keys whose claims differ, as bags of rows: by counts and sums of row hashes on each side, combined before one shuffle.

    A key on one side only is dirty, and so is one with a row more of the same.
    """
    def side(df: DataFrame, sign: int) -> DataFrame:
        row = F.xxhash64(*[x for c in READS if c != "key" for x in (F.col(c), F.col(c).isNull())])
        return df.select("key", F.lit(sign).alias("n"), (row.cast("decimal(20,0)") * sign).alias("a"), (F.hash(row).cast("long") * sign).alias("b"))

    both = side(before, -1).union(side(after, 1)).groupBy("key").agg(F.sum("n").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    return both.where("n <> 0 or a <> 0 or b <> 0").select("key")


def derive(claims: DataFrame) -> DataFrame:
    """``key`` and ``DERIVED``: the strongest capacity and what it runs, the strongest date with the precision of its source, sources.

    The precision is that of the strongest claim which states the chosen date with one: another source's is about another date.
    """
    live = claims.where("not coalesce(decided_against, false)")
    of = lambda field, value: F.when((F.col("field") == field) & F.col(value).isNotNull(), strength(value))
    found = live.groupBy("key").agg(F.max_by("value_num", of("mw", "value_num")).alias("mw"), F.max_by("value_date", of("online", "value_date")).alias("online"), F.count_distinct("url").alias("sources"))
    stated = live.where("field = 'online' and precision is not null").groupBy("key", F.col("value_date").alias("online")).agg(F.max_by("precision", strength("precision")).alias("online_precision"))
    keys = claims.select("key").distinct()
    return keys.join(found, "key", "left").join(stated, ["key", "online"], "left").select(
        "key", "mw", h200_equivalent(F.col("mw")).alias("h200"), "online", "online_precision", F.coalesce("sources", F.lit(0)).alias("sources"))


def rederive(stored: DataFrame, before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The derived table after a change of claims, and ``key, field, old, new`` of every value that moved.

    ``stored`` is what ``derive(before)`` gave.  Keys without claims any more are gone; what isn't dirty is taken as it is stored.
    """
    dirty = dirty_keys(before, after).checkpoint()
    fresh = derive(after.join(dirty, "key", "left_semi")).checkpoint()
    table = stored.join(dirty, "key", "left_anti").select("key", *DERIVED).unionByName(fresh)
    old = stored.join(dirty, "key", "left_semi").select("key", *[F.col(c).cast("string").alias(f"old_{c}") for c in DERIVED])
    both = old.join(fresh.select("key", *[F.col(c).cast("string").alias(f"new_{c}") for c in DERIVED]), "key", "full_outer")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"old_{c}").alias("old"), F.col(f"new_{c}").alias("new")) for c in DERIVED])).alias("x")
    return table, both.select("key", each).select("key", "x.*").where("not (old <=> new)")

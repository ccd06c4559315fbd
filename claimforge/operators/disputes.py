"""Options of a dispute: claims of one field in groups around the strongest claim that each agrees with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimforge.functions.numbers import values_conflict
from claimforge.session import ensure_checkpoint_dir

#: Distinct values of a field that are folded in one array; fields with more find their options round by round.
MOST_VALUES = 1000


def leader_clusters(values: DataFrame, keys: list[str], value: str, strength: list[str], most: int = MOST_VALUES) -> DataFrame:
    """``keys, option, value, claims``: options numbered from 1 by strength, the strongest claim's value, and how many claims agree.

    The strongest claim leads the first option; each claim in turn joins the first option whose leader it doesn't conflict with,
    or leads one of its own.  Agreement isn't transitive: which claims lead depends on the order.  Equal values share their
    option, so distinct values with their strongest claim are enough.  Null values are left out.
    """
    ensure_checkpoint_dir(values.sparkSession)
    distinct = values.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("value")).agg(F.max(F.struct(*strength)).alias("strength"), F.count("*").alias("claims")).checkpoint()
    sizes = distinct.groupBy(*keys).agg(F.count("*").alias("n"))
    ordered = F.reverse(F.array_sort(F.collect_list(F.struct("strength", "value"))))
    few = distinct.join(sizes.where(F.col("n") <= most), keys, "left_semi").groupBy(*keys).agg(ordered.alias("ordered"))
    agrees = lambda heads, v: F.exists(heads, lambda h: ~values_conflict(h, v))
    heads = F.aggregate("ordered", F.array().cast("array<double>"), lambda led, c: F.when(agrees(led, c["value"]), led).otherwise(F.array_append(led, c["value"])))
    leaders = few.select(*keys, F.posexplode(heads).alias("at", "leader")).select(*keys, (F.col("at") + 1).alias("option"), "leader")
    many = distinct.join(sizes.where(F.col("n") > most), keys, "left_semi").checkpoint()
    option = 0
    while not many.isEmpty():  # as many rounds as options: each leader is apart from all before it, so there are few
        option += 1
        strongest = many.groupBy(*keys).agg(F.max_by("value", "strength").alias("leader"))
        leaders = leaders.union(strongest.select(*keys, F.lit(option).alias("option"), "leader")).checkpoint()
        many = many.join(strongest, keys).where(values_conflict(F.col("value"), F.col("leader"))).drop("leader").checkpoint()
    joined = distinct.join(leaders, keys).where(~values_conflict(F.col("value"), F.col("leader")))
    own = joined.groupBy(*keys, "value").agg(F.min_by(F.struct("option", "leader", "claims"), "option").alias("x")).select(*keys, "x.*")
    return own.groupBy(*keys, "option").agg(F.first("leader").alias("value"), F.sum("claims").alias("claims"))


def disputes(claims: DataFrame, keys: list[str], value: str, strength: list[str]) -> DataFrame:
    """The options of those keys that have two or more: what a judge has to decide on."""
    options = leader_clusters(claims, keys, value, strength).checkpoint()
    return options.join(options.where("option = 2").select(*keys), keys, "left_semi")

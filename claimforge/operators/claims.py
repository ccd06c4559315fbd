"""Claims to golden records: ordering, policies, conflicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimforge.functions.text import PHASES, TERMINAL

#: Columns that a claim has: ``decided_against, confirmed, weight, fetched_at, url, value_num, value_str``.
STRENGTH = ("confirmed", "weight", "fetched_at", "url")


def strength(*extra: str) -> Column:
    """What orders claims: confirmed ones, strong sources, recent ones, and the URL as the last tie-break."""
    return F.struct(*(F.coalesce(F.col(c), F.lit(False)).alias(c) if c == "confirmed" else F.col(c) for c in (*STRENGTH, *extra)))


def ranked(claims: DataFrame, *keys: str) -> DataFrame:
    """Claims with ``rank``, 1 the strongest of its key; claims that a decision ruled out come last."""
    order = [F.col("decided_against").asc(), F.col("confirmed").desc(), F.col("weight").desc(), F.col("fetched_at").desc(), F.col("url").desc()]
    return claims.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def explode_claims(sources: DataFrame, fields: list[str], json_col: str = "claims") -> DataFrame:
    """A row for each claim of a source's JSON object; malformed JSON, other fields and nulls give none."""
    parsed = F.from_json(json_col, "map<string,string>")
    rows = sources.select("*", F.explode(parsed).alias("field", "value_str")).drop(json_col)
    return rows.where(F.col("field").isin(*fields) & F.col("value_str").isNotNull()).withColumn("value_num", F.col("value_str").try_cast("double"))


def resolve(claims: DataFrame, policy: str, *keys: str) -> DataFrame:
    """``keys, value``: one value a key, in one aggregation that combines before its only shuffle.

    Claims that a decision ruled out don't count; if any claim is confirmed, only confirmed ones do.
    ``prefer_weight`` and ``fill_only`` take the strongest claim's number; ``max`` the largest number;
    ``min`` the least string; ``ladder`` the strongest terminal phase, else the furthest one.
    A key whose claims are all ruled out has no row: its existing value stays, see ``with_existing``.
    """
    live = claims.where("not decided_against")
    sure = F.coalesce(F.col("confirmed"), F.lit(False))
    if policy in ("prefer_weight", "fill_only"):
        return live.groupBy(*keys).agg(F.max_by("value_num", strength()).alias("value"))
    if policy == "max":
        best = F.max(F.when(F.col("value_num").isNotNull(), F.struct(sure.alias("sure"), "value_num"))).alias("best")
        any_sure = F.max(sure).alias("any")
        found = live.groupBy(*keys).agg(best, any_sure)  # an unconfirmed number doesn't stand in for confirmed words
        return found.select(*keys, F.when(F.col("best.sure") == F.col("any"), F.col("best.value_num")).alias("value"))
    if policy == "min":
        return live.groupBy(*keys).agg(F.min(F.struct((~sure).alias("unsure"), "value_str")).alias("best")).select(*keys, F.col("best.value_str").alias("value"))
    if policy == "ladder":
        rank = F.array_position(F.array(*map(F.lit, PHASES)), F.col("value_str"))
        stopped = F.col("value_str").isin(*TERMINAL)
        aggregates = [F.max(sure).alias("any")]
        for name, side in (("sure", sure), ("all", F.lit(True))):
            aggregates += [
                F.max_by(F.when(stopped & side, F.col("value_str")), F.when(stopped & side, strength())).alias(f"stopped_{name}"),
                F.max(F.when(side & (rank > 0), rank)).alias(f"rank_{name}"),
            ]
        found = live.groupBy(*keys).agg(*aggregates)
        pick = lambda n: F.coalesce(F.col(f"stopped_{n}"), F.try_element_at(F.array(*map(F.lit, PHASES)), F.col(f"rank_{n}").cast("int")))
        return found.select(*keys, F.when(F.col("any"), pick("sure")).otherwise(pick("all")).alias("value"))
    raise ValueError(f"no such policy: {policy}")


def with_existing(rows: DataFrame, resolved: DataFrame, key: str, existing: str, fill_only: bool = False) -> DataFrame:
    """``rows`` with ``value``: the resolved one, the existing one where there is none (or always, if fill only)."""
    joined = rows.join(resolved, key, "left")
    order = (existing, "value") if fill_only else ("value", existing)
    return joined.withColumn("value", F.coalesce(*map(F.col, order)))


def collisions(claims: DataFrame, key: str, tolerance: float = 0.2) -> DataFrame:
    """``key, winner, rival, decided_by``: the strongest claim and the first one that conflicts with it.

    Only live claims compete; ``decided_by`` is the first rule that tells the two apart.
    """
    from claimforge.functions.numbers import values_conflict

    live = claims.where("not decided_against")
    best = live.groupBy(key).agg(F.max_by(F.struct("value_num", "confirmed", "weight", "fetched_at", "url"), strength()).alias("w"))
    against = live.join(best, key).where((F.col("confirmed") | ~F.col("w.confirmed")) & values_conflict(F.col("value_num"), F.col("w.value_num"), tolerance))
    rival = against.groupBy(key, "w").agg(F.max_by(F.struct("value_num", "confirmed", "weight", "fetched_at", "url"), strength()).alias("r"))
    by = F.when(F.col("w.weight") > F.col("r.weight"), "weight").when(F.col("w.fetched_at") > F.col("r.fetched_at"), "recency").otherwise("tie_break")
    return rival.select(key, F.col("w.value_num").alias("winner"), F.col("r.value_num").alias("rival"), by.alias("decided_by"))


def confidence(sources: DataFrame, key: str, values: list[str], fields_col: str = "fields") -> DataFrame:
    """``key, score`` from 0 to 3.

    Placeholders and derived sources don't count; none left gives 0.  The strongest weight, 2 at most; plus 1
    for two independent domains; plus 1 if domains agree on a value; minus 1 if testimony conflicts; 1 at
    most with under five populated fields; 3 if verified; 1 at least.  Comparisons are with the first value in
    ``position`` order, as sources come.
    """
    real = F.coalesce(~F.col("placeholder") & ~F.col("derived"), F.lit(False))
    testimony = real & F.coalesce(~F.col("tertiary"), F.lit(False))
    named = testimony & (F.coalesce(F.col(fields_col), F.lit("")) != "") & (F.coalesce(F.col("domain"), F.lit("")) != "")
    stated = lambda v: F.when(testimony & F.col(v).isNotNull(), F.struct("position", v))
    of_domain = sources.groupBy(key, "domain").agg(
        F.bool_or(real).alias("real"), F.bool_or(named).alias("named"), *[F.max(F.when(real, F.col(c))).alias(c) for c in ("weight", "populated", "verified")],
        *[x for v in values for x in (F.min(stated(v)).alias(f"first_{v}"), F.min(F.when(testimony, F.col(v))).alias(f"low_{v}"), F.max(F.when(testimony, F.col(v))).alias(f"high_{v}"))])
    rows = of_domain.groupBy(key).agg(
        F.bool_or("real").alias("real"), F.count_if(F.col("named")).alias("domains"), *[F.max(c).alias(c) for c in ("weight", "populated", "verified")],
        *[x for v in values for x in (
            F.min(f"first_{v}")[v].alias(f"first_{v}"), F.min(f"low_{v}").alias(f"low_{v}"), F.max(f"high_{v}").alias(f"high_{v}"),
            F.min(F.col(f"first_{v}")[v]).alias(f"low_first_{v}"), F.max(F.col(f"first_{v}")[v]).alias(f"high_first_{v}"), F.count(f"first_{v}").alias(f"stating_{v}"))])
    from claimforge.functions.numbers import values_conflict

    # the further a value is from the first, the more it conflicts: the least and the greatest tell for all
    apart = lambda v, kind: reduce(lambda a, b: a | b, [values_conflict(F.col(f"{end}_{kind}{v}"), F.col(f"first_{v}")) for end in ("low", "high")])
    conflict = reduce(lambda a, b: a | b, [apart(v, "") for v in values])
    agree = reduce(lambda a, b: a | b, [(F.col(f"stating_{v}") >= 2) & ~apart(v, "first_") for v in values])
    score = F.least(F.col("weight"), F.lit(2)) + (F.col("domains") >= 2).cast("int") + agree.cast("int") - conflict.cast("int")
    score = F.when(F.col("populated") < 5, F.least(score, F.lit(1))).otherwise(score)
    score = F.greatest(F.lit(1), F.least(F.lit(3), F.when(F.col("verified"), 3).otherwise(score)))
    return rows.select(key, F.when(F.col("real"), score).otherwise(0).cast("int").alias("score"))

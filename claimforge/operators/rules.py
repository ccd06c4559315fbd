"""Rules over records and what lies beneath them: contradictions and implausible figures, a row for each finding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimforge.functions.identity import looks_like_county
from claimforge.functions.numbers import is_blank, values_conflict
from claimforge.operators.progress import IMPLIED, RISK_TRACK, TRACKS

BUILDING, LIVE, ENDED = ("construction", "operational"), "operational", ("paused", "cancelled")
ERROR, WARNING = "error", "warning"


def _any(condition: Column) -> Column:
    return F.coalesce(F.bool_or(condition), F.lit(False))


def findings(rows: DataFrame, rules: dict[str, tuple[str, Column]], *keep: str) -> DataFrame:
    """``keep, code, severity`` for every rule that holds: the rules are one array expression, so all run in one scan."""
    found = [F.when(holds, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for code, (severity, holds) in rules.items()]
    return rows.select(*keep, F.explode(F.array_compact(F.array(*found))).alias("f")).select(*keep, "f.code", "f.severity")


def nested_blocks(blocks: DataFrame) -> DataFrame:
    """``project_id, inner, outer``: tranches of a project whose key has all segments of another's, and more.

    ``blocks`` has ``project_id, block_key``, segments joined by dots.  A pair meets on the outer key's first segment.
    """
    keys = blocks.where("block_key is not null").select("project_id", "block_key").distinct().withColumn("parts", F.array_distinct(F.split("block_key", r"\.")))
    outer = keys.select("project_id", F.col("block_key").alias("outer"), F.col("parts").alias("outer_parts"), F.array_min("parts").alias("segment"))
    inner = keys.select("project_id", F.col("block_key").alias("inner"), F.col("parts").alias("inner_parts"), F.explode("parts").alias("segment")).where(F.size("inner_parts") > 1)
    return inner.join(outer, ["project_id", "segment"]).where(
        (F.size("outer_parts") < F.size("inner_parts")) & (F.size(F.array_except("outer_parts", "inner_parts")) == 0)).select("project_id", "inner", "outer")


def _reached(events: DataFrame) -> DataFrame:
    """``project_id, event_type``: milestones that were seen and those that they imply."""
    implied = F.create_map(*[x for k, v in IMPLIED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    every = F.concat(F.array("event_type"), F.coalesce(F.try_element_at(implied, F.col("event_type")), F.array().cast("array<string>")))
    return events.select("project_id", F.explode(every).alias("event_type")).distinct()


def contradictions(projects: DataFrame, claims: DataFrame, blocks: DataFrame, events: DataFrame, risks: DataFrame, as_of: str) -> DataFrame:
    """``id, code, severity`` of every contradiction between a record and its evidence, as of a day.

    ``projects``: id, phase, mw_planned, mw_built, announced, online, city, tenant.  ``claims``: project_id,
    value_num, quote.  ``blocks``: project_id, block_key, mw, state (``live``, ``ended``, else pending), confirmed,
    online, placed.  ``events``: project_id, event_type, event_date.  ``risks``: project_id, category, status.
    Each is aggregated by project, then met once.  Records without any evidence keep the rules that ask for none.
    """
    today = F.lit(as_of).cast("date")
    quote = F.trim(F.coalesce("quote", F.lit("")))
    of_claims = claims.groupBy("project_id").agg(F.count("value_num").alias("claims"), F.max("value_num").alias("claimed"), _any(is_blank(quote)).alias("no_quote"))
    live, pending = F.col("state") == "live", ~F.col("state").isin("live", "ended")
    of_blocks = blocks.groupBy("project_id").agg(
        F.count("*").alias("blocks"), F.sum("mw").alias("rolled_up"), _any(live).alias("live"), _any(pending).alias("pending"), _any(live & F.col("confirmed")).alias("live_cited"),
        _any(pending & (F.col("online") < today)).alias("late"), _any(F.col("online") >= today).alias("ahead"), _any(~F.col("placed")).alias("unplaced"))
    milestones = [m for ms in TRACKS.values() for m in ms]
    of_events = events.groupBy("project_id").agg(
        F.count("*").alias("events"), _any((F.col("event_type") == "energized") & (F.col("event_date") <= today)).alias("energized"),
        _any((F.col("event_date") > today) & F.col("event_type").isin(*milestones)).alias("future"))
    reached = _reached(events)
    of_reached = reached.groupBy("project_id").agg(
        _any(F.col("event_type").isin(*TRACKS["construction"])).alias("started"), _any(F.col("event_type") == "equipment_install").alias("equipped"))
    last = F.create_map(*[F.lit(x) for category, track in RISK_TRACK.items() for x in (category, TRACKS[track][-1])])
    blocked = risks.where(F.coalesce("status", F.lit("open")) == "open").select("project_id", F.try_element_at(last, F.col("category")).alias("event_type"))
    finished = blocked.join(reached, ["project_id", "event_type"], "left_semi").select("project_id").distinct().withColumn("finished", F.lit(True))
    nested = nested_blocks(blocks).select("project_id").distinct().withColumn("nested", F.lit(True))

    x = projects
    for beneath in (of_claims, of_blocks, of_events, of_reached, finished, nested):
        x = x.join(beneath, x["id"] == beneath["project_id"], "left").drop("project_id")
    is_set = lambda name: F.coalesce(F.col(name), F.lit(False))
    count = lambda name: F.coalesce(F.col(name), F.lit(0))
    operational, built = F.col("phase") == LIVE, F.col("mw_built").isNotNull()
    open_end = is_set("energized") & ~F.col("phase").isin(LIVE, *ENDED)
    unread = operational & ~built & F.col("mw_planned").isNotNull()
    support = F.greatest("claimed", "rolled_up")
    rules = {
        "value_without_evidence": (WARNING, F.col("mw_planned").isNotNull() & support.isNull()),
        "value_above_its_evidence": (WARNING, (F.col("mw_planned") > support) & values_conflict(F.col("mw_planned"), support)),
        "phase_without_construction": (WARNING, F.col("phase").isin(*BUILDING) & (count("events") > 0) & ~is_set("energized") & ~built & ~is_set("started")),
        "milestone_in_the_future": (WARNING, is_set("future")),
        "live_block_without_cited_capacity": (WARNING, unread & is_set("live")),
        "operational_without_built_capacity": (WARNING, unread & ~is_set("live")),
        "built_capacity_uncited_in_blocks": (WARNING, operational & built & is_set("live") & ~is_set("live_cited")),
        "no_block_for_energisation": (WARNING, open_end & (count("blocks") > 0) & ~is_set("live")),
        "energized_but_not_operational": (ERROR, open_end & ~((count("blocks") > 0) & ~is_set("live")) & ~(is_set("live") & is_set("pending"))),
        "built_exceeds_planned": (ERROR, F.col("mw_built") > F.col("mw_planned")),
        "online_before_announced": (ERROR, F.col("online") < F.col("announced")),
        "block_past_its_own_date": (WARNING, is_set("late")),
        "past_its_own_date": (WARNING, ~is_set("late") & (F.col("online") < today) & ~F.col("phase").isin(LIVE, *ENDED) & ~is_set("ahead")),
        "block_label_ambiguous": (WARNING, is_set("unplaced")),
        "blocks_may_double_count": (WARNING, is_set("nested")),
        "cancelled_but_building": (ERROR, F.col("phase").isin(*ENDED) & is_set("equipped")),
        "obstacle_on_a_finished_track": (WARNING, is_set("finished")),
        "placeholder_value": (ERROR, F.col("tenant").isNotNull() & (F.col("tenant") != "") & is_blank(F.col("tenant"))),
        "placeholder_quote": (WARNING, is_set("no_quote")),
        "city_holds_a_county_name": (WARNING, looks_like_county(F.col("city"), folded=True)),
    }
    return findings(x, rules, "id")


def implausible(projects: DataFrame, blocks: DataFrame) -> DataFrame:
    """``id, code``: figures of ``id, mw, usd, chips, confidence`` that can't well be right, with tranches ``project_id, mw``.

    Megawatts; whole dollars; chips that a capacity runs.
    """
    largest = blocks.groupBy("project_id").agg(F.max("mw").alias("largest"))
    x = projects.join(largest, projects["id"] == largest["project_id"], "left")
    mw, per_mw = F.col("mw"), F.try_divide(F.col("usd"), F.col("mw")) / 1e6
    ratio = F.try_divide(F.col("chips") * 1.3 / 1000, mw)
    alike = F.lit(False)
    for factor in (1000.0, 100.0):  # one figure in two units
        for a, b in ((mw, F.col("largest")), (F.col("largest"), mw)):
            alike = alike | F.coalesce(F.abs(F.try_divide(a, b * factor) - 1) <= 0.15, F.lit(False))
    rules = {
        "same_figure_two_units": alike, "campus_exceeds_worlds_largest": mw > 8000, "giant_capacity_unconfirmed": (mw >= 1000) & (F.col("confidence") < 2),
        "usd_per_mw_out_of_band": (mw >= 5) & ~per_mw.between(0.3, 60), "investment_below_build_cost": (mw >= 500) & (per_mw < 3),
        "h200_disagrees_with_capacity": ~ratio.between(0.5, 2), "block_out_of_scale": F.col("largest") > 3 * mw,
    }
    return findings(x, {k: (WARNING, v) for k, v in rules.items()}, "id").select("id", "code")


def provenance(claims: DataFrame, key: str = "project_id") -> DataFrame:
    """``key, tier``: how well the winning claim carries a value: reported, derived, unconfirmed, inferred or defaulted.

    ``claims`` has ``confirmed, decided_against, weight, fetched_at, url, value_num, quoted``; a value that no live
    claim states is defaulted, one whose claims have no quote is inferred.
    """
    live = F.col("value_num").isNotNull() & ~F.col("decided_against")
    order = F.struct("confirmed", "weight", "fetched_at", "url")
    best = claims.groupBy(key).agg(F.max_by(F.struct("confirmed", "weight", "quoted"), F.when(live, order)).alias("w"))
    tier = (
        F.when(F.col("w").isNull(), "defaulted").when(F.col("w.confirmed") & (F.col("w.weight") >= 2), "reported").when(F.col("w.confirmed"), "derived")
        .when(F.col("w.quoted"), "unconfirmed").otherwise("inferred")
    )
    return best.select(key, tier.alias("tier"))


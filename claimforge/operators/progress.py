"""Standing of projects on their tracks: relational, over small fixed dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tracks in order with their milestones, what milestones imply, the track that a risk blocks, severities.
TRACKS = {
    "site_control": ["announced", "land_acquired"], "permits": ["permit_filed", "permit_approved"],
    "power": ["interconnection_agreement", "energized"], "construction": ["site_work", "groundbreaking", "equipment_install"],
    "commercial": ["first_customer"],
}
IMPLIED = {
    "site_work": ["announced", "land_acquired"], "groundbreaking": ["announced", "land_acquired", "permit_filed", "permit_approved"],
    "equipment_install": ["announced", "land_acquired", "permit_filed", "permit_approved"],
    "energized": ["announced", "land_acquired", "permit_filed", "permit_approved"], "permit_approved": ["permit_filed"], "land_acquired": ["announced"],
}
RISK_TRACK = {
    "grid_capacity": "power", "transmission": "power", "permitting": "permits", "community_opposition": "permits", "environmental": "permits",
    "water": "permits", "equipment_supply": "construction", "chip_supply": "construction", "financing": "commercial", "offtake": "commercial",
}
SEVERITIES = ["watch", "material", "blocking"]


def dimensions(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Milestones with track and rung; implications; tracks of risks."""
    rungs = [(m, t, k, n) for k, (t, ms) in enumerate(TRACKS.items()) for n, m in enumerate(ms, 1)]
    return (
        spark.createDataFrame(rungs, "event_type string, track string, track_no int, rung int"),
        spark.createDataFrame([(m, i) for m, ms in IMPLIED.items() for i in ms], "event_type string, implied string"),
        spark.createDataFrame(list(RISK_TRACK.items()), "category string, track string"),
    )


def standing(events: DataFrame, risks: DataFrame, as_of: str) -> DataFrame:
    """``project_id, track, rung, observed, next_milestone, severity`` for every project of either table and every track.

    Milestones dated after ``as_of`` don't count, undated ones do.  What observed milestones imply counts one
    step deep.  ``rung`` is the furthest reached, 0 if none; ``severity`` the worst open risk's rank, null if none.
    """
    rungs, implied, risk_track = dimensions(events.sparkSession)
    seen = events.where(F.col("event_date").isNull() | (F.col("event_date") <= F.lit(as_of).cast("date"))).select("project_id", "event_type").distinct()
    inferred = seen.join(F.broadcast(implied), "event_type").select("project_id", F.col("implied").alias("event_type")).withColumn("observed", F.lit(0))
    reached = seen.withColumn("observed", F.lit(1)).union(inferred).join(F.broadcast(rungs), "event_type")
    far = reached.groupBy("project_id", "track").agg(F.max("rung").alias("rung"), F.count_distinct(F.when(F.col("observed") == 1, F.col("event_type"))).alias("observed"))
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.coalesce("severity", F.lit("watch"))).cast("int")
    held = risks.where("status = 'open'").join(F.broadcast(risk_track), "category").groupBy("project_id", "track").agg(F.max(rank).alias("severity"))
    every = events.select("project_id").union(risks.select("project_id")).distinct().select("project_id", F.explode(F.array(*map(F.lit, TRACKS))).alias("track"))
    rows = every.join(far, ["project_id", "track"], "left").join(held, ["project_id", "track"], "left").na.fill(0, ["rung", "observed"])
    after = rungs.select("track", (F.col("rung") - 1).alias("rung"), F.col("event_type").alias("next_milestone"))
    return rows.join(F.broadcast(after), ["track", "rung"], "left").select("project_id", "track", "rung", "observed", "next_milestone", "severity")


def binding_blocker(standings: DataFrame) -> DataFrame:
    """``project_id, track``: the blocked track of the worst severity, the earliest of equals."""
    order = F.array_position(F.array(*map(F.lit, TRACKS)), F.col("track"))
    return standings.where("severity is not null").groupBy("project_id").agg(F.max_by("track", F.struct("severity", (-order).alias("o"))).alias("track"))

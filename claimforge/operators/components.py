"""Connected components of an edge DataFrame, by min-label propagation with pointer jumping."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimforge.session import ensure_checkpoint_dir

#: Edges for each file of a checkpoint; what shuffles have beyond such files and two a core is written together.
FILE_ROWS = 250_000


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 200) -> DataFrame:
    """``(node, component)`` for every node on an edge; the component is its smallest node.

    Each round takes the least label among a node's neighbours, then jumps to the label of that
    label, so path lengths shrink geometrically.  Labels are checkpointed each round: the lineage
    stays short, and a lost executor costs no earlier round.  Hubs are safe: labels meet nodes by
    joins whose one side has a single row a node, and minima are combined before the shuffle.

    Edges with a null end are ignored; an empty input gives no rows.
    """
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    # one scan for both directions: edges may be dear to find
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    both = pairs.select(ways.alias("way")).select("way.*").distinct().checkpoint()
    files = max(2 * spark.sparkContext.defaultParallelism, ceil(both.count() / FILE_ROWS))
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")).coalesce(files).checkpoint()
    for _ in range(max_rounds):
        around = (
            both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("l")), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("l").alias("l"))
        )
        hooked = labels.join(around, "node").select("node", F.col("label").alias("old"), F.least("label", "l").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        moved = hooked.join(jump, "mid", "left").select(
            "node", F.least("mid", F.coalesce("far", "mid")).alias("label"), "old").coalesce(files).checkpoint()
        changed = moved.where("label <> old").limit(1).count()
        labels = moved.select("node", "label")
        if not changed:
            return labels.select("node", F.col("label").alias("component"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")

"""Combine independent evidence for a link, and votes over detections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotvalue.operators.skew import top_per_group

# Weight of a source with full certainty, and the gap below which two items are tied.
WEIGHTS = {"api_match": 0.9, "hash": 0.8, "visual": 0.6}
OTHER_WEIGHT = 0.5
NEAR_TIE = 0.05


def fuse(events: DataFrame, weights: dict[str, float] | None = None, tie: float = NEAR_TIE) -> DataFrame:
    """One resolved item per icon from events of several sources.

    Repeats of one source are folded to its strongest verdict per item, independent sources
    corroborate by ``1 - product(1 - weight * certainty / 100)``, the newest manual event wins
    outright and a runner-up within ``tie`` marks a conflict.
    """
    weights = WEIGHTS if weights is None else weights
    manual = events.where(F.col("source") == "manual").groupBy("icon_id").agg(
        F.max_by("item_id", "seq").alias("manual_item")
    )
    weight = F.lit(OTHER_WEIGHT)
    for source, value in weights.items():
        weight = F.when(F.col("source") == source, value).otherwise(weight)
    verdicts = events.where(F.col("source") != "manual").groupBy("icon_id", "item_id", "source").agg(
        F.max("certainty").alias("certainty")
    )
    scored = verdicts.groupBy("icon_id", "item_id").agg(
        F.bround(1 - F.product(1 - weight * F.col("certainty") / 100), 6).alias("score"),
        F.count(F.lit(1)).alias("sources"),
    )
    best = top_per_group(scored, ["icon_id"], [F.col("score").desc(), F.col("item_id")], 2)
    pairs = best.groupBy("icon_id").agg(
        *[F.max(F.when(F.col("rn") == 1, F.col(c))).alias(c) for c in ("item_id", "score", "sources")],
        F.max(F.when(F.col("rn") == 2, F.col("score"))).alias("second"),
    )
    both = pairs.join(manual, "icon_id", "full_outer")
    fixed = F.col("manual_item").isNotNull()
    close = F.coalesce(F.bround(F.col("score") - F.col("second"), 6) < tie, F.lit(False))
    return both.select(
        "icon_id",
        F.coalesce("manual_item", "item_id").alias("item_id"),
        F.when(fixed, 1.0).otherwise(F.col("score")).alias("score"),
        F.when(fixed, 0).otherwise(F.col("sources")).cast("bigint").alias("sources"),
        (~fixed & close).alias("conflict"),
    )


def majority(votes: DataFrame) -> DataFrame:
    """Most frequent name per icon; equal counts go to the first name in order."""
    counted = votes.groupBy("icon_id", "name").agg(F.count(F.lit(1)).alias("votes"))
    best = top_per_group(counted, ["icon_id"], [F.col("votes").desc(), F.col("name")], 1)
    return best.drop("rn")

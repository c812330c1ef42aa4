"""Reports over training logs and detections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_summary(metrics: DataFrame, quality: str = "mAP50") -> DataFrame:
    """Best epoch (highest quality, earliest on a tie), last epoch and wall time of each model."""
    best = F.max_by(F.struct("epoch", quality), F.struct(F.col(quality), -F.col("epoch")))
    last = F.max_by(F.struct("epoch", quality, "time"), "epoch")
    runs = metrics.groupBy("model").agg(best.alias("b"), last.alias("l"))
    return runs.select(
        "model",
        F.col("b.epoch").alias("best_epoch"),
        F.col(f"b.{quality}").alias("best_quality"),
        F.col("l.epoch").alias("last_epoch"),
        F.col(f"l.{quality}").alias("last_quality"),
        F.col("l.time").alias("seconds"),
    )


def confidence_report(detections: DataFrame, *keys: str) -> DataFrame:
    """Count, mean, median and minimum confidence per group.

    Confidences have three decimals: they are counted per value first, so a group of any
    size reaches the median as at most a thousand weighted values.
    """
    counted = detections.groupBy(*keys, F.bround(F.col("det_conf") * 1000).cast("bigint").alias("milli")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return counted.groupBy(*keys).agg(
        F.sum("n").alias("detections"),
        F.bround(F.sum(F.col("milli") * F.col("n")) / F.sum("n") / 1000, 6).alias("mean_conf"),
        F.bround(F.percentile("milli", 0.5, F.col("n")) / 1000, 6).alias("median_conf"),
        (F.min("milli") / 1000).alias("min_conf"),
    )


def recall_by(truth: DataFrame, *keys: str, found: str = "found") -> DataFrame:
    return truth.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if(F.col(found)).alias("hits"),
        F.bround(F.count_if(F.col(found)) / F.count(F.lit(1)), 4).alias("recall"),
    )


def version_delta(detections: DataFrame, old: str, new: str) -> DataFrame:
    """Detections per session in two model versions and the difference."""
    both = detections.where(F.col("version").isin(old, new))
    counts = both.groupBy("session_id").agg(
        F.count_if(F.col("version") == old).alias("before"), F.count_if(F.col("version") == new).alias("after")
    )
    return counts.withColumn("gain", F.col("after") - F.col("before"))

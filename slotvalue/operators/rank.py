"""Session results: totals, quantities, orderings and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotvalue.functions.geometry import whole_pixels
from slotvalue.functions.rounding import round_share
from slotvalue.functions.text import shown_name
from slotvalue.operators.resolve import identified
from slotvalue.operators.skew import rank_within, small_groups, top_per_group

# Most detections kept per image, detector thresholds.
MAX_DETECTIONS = 400
SCAN_CONFIDENCE = 0.25
PREDICT_CONFIDENCE = 0.4


def confident(detections: DataFrame, threshold: float = SCAN_CONFIDENCE) -> DataFrame:
    return detections.where(F.col("det_conf") >= threshold)


def cap_detections(detections: DataFrame, most: int) -> DataFrame:
    """The detector's own limit: the most confident detections of each image.

    ``MAX_DETECTIONS`` is the detector's number; what it cuts off is told by ``overflow``.
    """
    order = [F.col("det_conf").desc(), F.col("det_idx")]
    return top_per_group(detections, ["session_id"], order, most).drop("rn")


def overflow(detections: DataFrame, most: int) -> DataFrame:
    """Images with more detections than the limit, and how many are over it."""
    counts = detections.groupBy("session_id").agg(F.count(F.lit(1)).alias("detections"))
    return counts.where(F.col("detections") > most).withColumn("over", F.col("detections") - most)


def raw_detections(output: DataFrame, most: int | None, threshold: float = SCAN_CONFIDENCE) -> DataFrame:
    """Detector output as detections: threshold, whole pixels, rounded scores.

    ``most`` is the limit per image, None for none.

    ``output`` has the columns of a detection with fractional boxes and full-precision scores.
    The threshold applies to the unrounded confidence.
    """
    kept = confident(output, threshold)
    kept = kept if most is None else cap_detections(kept, most)
    return kept.withColumns(
        {
            "icon_id": F.col("icon_id").cast("string"),
            "box": whole_pixels(F.col("box")),
            "det_conf": round_share(F.col("det_conf"), 3),
            "ocr_score": round_share(F.coalesce("ocr_score", F.lit(0.0)), 2),
        }
    )


def session_summary(records: DataFrame) -> DataFrame:
    def from_source(source):
        return F.count_if(F.col("source") == source)

    return records.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("detections"),
        F.count("source").alias("identified"),
        F.coalesce(F.sum("value"), F.lit(0)).alias("total"),
        F.coalesce(from_source("yolo"), F.lit(0)).alias("by_yolo"),
        F.coalesce(from_source("ocr"), F.lit(0)).alias("by_ocr"),
        F.coalesce(from_source("override"), F.lit(0)).alias("by_override"),
    )


ITEM = ["id", "name", "short", "width", "height", "value", "slots", "per_slot"]


def collapse(records: DataFrame, first_seen: bool = False) -> DataFrame:
    """Equal items of a session as one row with a quantity.

    All item columns depend on the id, so they are plain grouping columns and the
    aggregation stays a hash aggregation with partial sums before the shuffle.  The
    icon and box of the first detection are added on request.
    """
    # Items without an id are told apart by their names, which are a grouping column as well.
    found = identified(records)
    first = F.min(F.struct("det_idx", "icon_id", "box")).alias("_first") if first_seen else F.min("det_idx").alias("first_det")
    rows = found.groupBy("session_id", *ITEM).agg(F.count(F.lit(1)).alias("qty"), first)
    if not first_seen:
        return rows
    parts = [F.col("_first.det_idx").alias("first_det"), F.struct("_first.icon_id", "_first.box").alias("first")]
    return rows.select("session_id", *ITEM, "qty", *parts)


def rank_by_slot(records: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Position of each identified detection, highest value per slot first.

    ``sizes`` has a row ``(session_id)`` for at least every record and is cheap to read; with it, sessions that are all
    small are ranked whole.
    """
    order = [F.col("per_slot").desc(), F.col("det_idx")]
    return rank_within(identified(records), ["session_id"], order, out="position", whole=small_groups(sizes, ["session_id"]))


def keep_ditch(records: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Split the collapsed items of a session at the median.

    The better half (rounded up) is ``keep``, best first; the rest is ``ditch``, worst first.  ``sizes`` as in
    ``rank_by_slot``: small sessions are collapsed and ranked where one shuffle brought them.
    """
    order = [F.col("per_slot").desc(), F.col("first_det")]
    whole = small_groups(sizes, ["session_id"])
    items = collapse(identified(records).repartition("session_id") if whole else records)
    ranked = rank_within(items, ["session_id"], order, total="n", whole=whole)
    keep = F.col("rn") <= F.ceil(F.col("n") / 2)
    return (
        ranked.withColumn("list", F.when(keep, "keep").otherwise("ditch"))
        .withColumn("position", F.when(keep, F.col("rn")).otherwise(F.col("n") - F.col("rn") + 1).cast("int"))
        .drop("rn", "n")
    )


def least_certain(records: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Review order of a session: least certain first, unidentified rows count as 0; ``sizes`` as in ``rank_by_slot``."""
    order = [F.coalesce("certainty", F.lit(0.0)), F.col("det_idx")]
    return rank_within(records, ["session_id"], order, out="position", whole=small_groups(sizes, ["session_id"]))


def top_report(records: DataFrame, n: int) -> DataFrame:
    """The ``n`` best detections of the whole table."""
    best = identified(records).orderBy(F.col("per_slot").desc(), "session_id", "det_idx").limit(n)
    return best.select(
        "session_id", "det_idx", shown_name(F.col("short"), F.col("name")).alias("label"),
        "source", "slots", "per_slot", "value",
    )


def stack_totals(records: DataFrame, quantity: str = "quantity") -> DataFrame:
    """Sum of printed stack counts of equal items in a session."""
    return identified(records).groupBy("session_id", "id").agg(F.sum(quantity).alias("quantity"))

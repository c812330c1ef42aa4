"""Row types of the landed files."""

from __future__ import annotations

from pyspark.sql import types as T

OFFER = T.StructType(
    [
        T.StructField("priceRUB", T.LongType()),
        T.StructField("vendor", T.StructType([T.StructField("name", T.StringType())])),
    ]
)

CATALOG_ITEM = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("shortName", T.StringType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("types", T.ArrayType(T.StringType())),
        T.StructField("basePrice", T.LongType()),
        T.StructField("avg24hPrice", T.LongType()),
        T.StructField("lastLowPrice", T.LongType()),
        T.StructField("gridImageLink", T.StringType()),
        T.StructField("sellFor", T.ArrayType(OFFER)),
    ]
)

AUTO_LINK = T.StructType(
    [
        T.StructField("item_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("short", T.StringType()),
        T.StructField("w", T.IntegerType()),
        T.StructField("h", T.IntegerType()),
        T.StructField("price", T.LongType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("margin", T.DoubleType()),
        T.StructField("alts", T.ArrayType(T.StringType())),
        T.StructField("match", T.StringType()),
        T.StructField("fp", T.ArrayType(T.IntegerType())),
    ]
)

LINK_EVENT = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("ts", T.StringType()),
        T.StructField("icon_id", T.StringType()),
        T.StructField("item_id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("certainty", T.IntegerType()),
        T.StructField("note", T.StringType()),
    ]
)

DETECTION = T.StructType(
    [
        T.StructField("session_id", T.StringType()),
        T.StructField("det_idx", T.LongType()),
        T.StructField("icon_id", T.StringType()),
        T.StructField("box", T.ArrayType(T.IntegerType())),
        T.StructField("det_conf", T.DoubleType()),
        T.StructField("ocr_id", T.StringType()),
        T.StructField("ocr_score", T.DoubleType()),
        T.StructField("ocr_raw", T.StringType()),
    ]
)

SAMPLE = T.StructType(
    [
        T.StructField("ts", T.StringType()),
        T.StructField("session", T.StringType()),
        T.StructField("crop", T.StringType()),
        T.StructField("box", T.ArrayType(T.IntegerType())),
        T.StructField("icon_id", T.StringType()),
        T.StructField("item_id", T.StringType()),
        T.StructField("item_name", T.StringType()),
    ]
)

GRID = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
        T.StructField("w", T.DoubleType()),
        T.StructField("h", T.DoubleType()),
        T.StructField("cols", T.IntegerType()),
        T.StructField("rows", T.IntegerType()),
    ]
)

# Column names of the training log.
METRIC_COLUMNS = [
    "epoch",
    "time",
    "train/box_loss",
    "train/cls_loss",
    "train/dfl_loss",
    "metrics/precision(B)",
    "metrics/recall(B)",
    "metrics/mAP50(B)",
    "metrics/mAP50-95(B)",
    "val/box_loss",
    "val/cls_loss",
    "val/dfl_loss",
    "lr/pg0",
    "lr/pg1",
    "lr/pg2",
]

METRICS = T.StructType(
    [
        T.StructField(name, T.IntegerType() if name == "epoch" else T.DoubleType())
        for name in METRIC_COLUMNS
    ]
)

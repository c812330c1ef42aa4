"""Scans of catalog, link, event, session, image, grid and metric files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotvalue.functions import images
from slotvalue.functions.geometry import footprint
from slotvalue.functions.pricing import best_offer
from slotvalue.operators.skew import top_per_group
from slotvalue.operators.spatial import cell_geometry
from slotvalue.schema import AUTO_LINK, CATALOG_ITEM, GRID, LINK_EVENT, METRICS
from slotvalue.sources import files

CORRUPT = "_corrupt"


def path_exists(spark: SparkSession, path: str) -> bool:
    """True if the path (a glob is allowed) names at least one file."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)
    return found is not None and len(found) > 0


def empty(spark: SparkSession, schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_catalog_arrays(spark: SparkSession, path: str) -> DataFrame:
    """Catalog from files that hold one JSON array each; ``pos`` is the place in the array.

    An array cannot be split, so land large catalogs as several files or as JSON lines.
    """
    if not path_exists(spark, path):
        return empty(spark, T.StructType([*CATALOG_ITEM.fields, T.StructField("file", T.StringType()), T.StructField("pos", T.IntegerType())]))
    text = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    items = F.from_json("value", T.ArrayType(CATALOG_ITEM))
    return text.select("file", F.posexplode(items).alias("pos", "item")).select("item.*", "file", "pos")


def read_catalog_lines(spark: SparkSession, path: str) -> DataFrame:
    """Catalog as JSON lines with an own ``pos`` field; splittable."""
    schema = T.StructType([*CATALOG_ITEM.fields, T.StructField("pos", T.LongType())])
    return spark.read.schema(schema).json(path) if path_exists(spark, path) else empty(spark, schema)


def latest_items(items: DataFrame, *order: str) -> DataFrame:
    """One row per id: the last duplicate wins."""
    order = order or ("pos",)
    return top_per_group(items, ["id"], [F.col(c).desc() for c in order], 1).drop("rn")


def flat_catalog(items: DataFrame) -> DataFrame:
    """Column names the operators use; the offers are reduced to the best one."""
    return items.select(
        F.col("id").alias("item_id"),
        "name",
        F.col("shortName").alias("short"),
        "width",
        "height",
        F.col("avg24hPrice").alias("avg24h"),
        F.col("lastLowPrice").alias("low"),
        best_offer(F.col("sellFor")).alias("vendor"),
        F.col("basePrice").alias("base"),
        F.col("gridImageLink").alias("link"),
    )


def _json_map(spark: SparkSession, path: str, value: T.DataType) -> DataFrame:
    schema = T.StructType([T.StructField("icon_id", T.StringType()), T.StructField("value", value)])
    if not path_exists(spark, path):
        return empty(spark, schema)
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", T.MapType(T.StringType(), value))).alias("icon_id", "value"))


def read_auto_links(spark: SparkSession, path: str) -> DataFrame:
    """Matcher result: JSON map icon to match; a missing file is an empty table."""
    return _json_map(spark, path, AUTO_LINK).select("icon_id", "value.*")


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    return _json_map(spark, path, T.StringType()).withColumnRenamed("value", "item_id")


def read_link_events(spark: SparkSession, path: str) -> DataFrame:
    """Event log with an explicit ``seq`` per line.  Bad lines stay, with ``_corrupt`` set."""
    schema = T.StructType([*LINK_EVENT.fields, T.StructField(CORRUPT, T.StringType())])
    if not path_exists(spark, path):
        return empty(spark, schema)
    reader = spark.read.schema(schema).option("mode", "PERMISSIVE")
    return reader.option("columnNameOfCorruptRecord", CORRUPT).json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(seq, line)``: the lines of text files, numbered from 0 by file name and line, whatever the size of a file.

    Files are split as always.  A task counts the lines of each of its splits, which it sees in order; the lines of
    all splits before, known from one count per split, are added to that.
    """
    rows = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line")
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, int] = {}
        for batch in batches:
            places = []
            for split in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[split] = seen.get(split, -1) + 1
                places.append(seen[split])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], ["file", "block", "line", "place"])

    numbered = rows.mapInArrow(count, "file string, block bigint, line string, place bigint")
    splits = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("file", "block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = splits.select("file", "block", before.alias("start"))
    return numbered.join(starts, ["file", "block"]).select((F.col("start") + F.col("place")).alias("seq"), "line")


def read_plain_log(spark: SparkSession, path: str) -> DataFrame:
    """Event log without ``seq``: the number of the line becomes the order (``numbered_lines``)."""
    if not path_exists(spark, path):
        return empty(spark, LINK_EVENT)
    rest = T.StructType([f for f in LINK_EVENT.fields if f.name != "seq"])
    event = F.from_json(F.trim("line"), rest)
    # An object is kept whatever fields it has; blank lines, broken lines and other values are not.
    parsed = numbered_lines(spark, path).where(F.get_json_object("line", "$").startswith("{")).select("seq", event.alias("e"))
    return parsed.select("seq", "e.*").select(*LINK_EVENT.fieldNames())


def clean_events(events: DataFrame) -> DataFrame:
    """Readable events of a log that was read with ``read_link_events``."""
    return events.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def log_report(events: DataFrame) -> DataFrame:
    """Lines and last ``seq`` per source; broken lines count as ``rejected``.

    One pass over all fields: a query on the corrupt column alone is not allowed.
    """
    kind = F.when(F.col(CORRUPT).isNotNull(), "rejected").otherwise(F.col("source"))
    return events.groupBy(kind.alias("source")).agg(F.count(F.lit(1)).alias("lines"), F.max("seq").alias("last_seq"))


def list_sessions(results: DataFrame) -> DataFrame:
    """Session ids that have a stored result, newest first.

    ``results`` is read from ``<root>/<session>/scan.json`` or from a table partitioned by
    ``session_id``; ids are time stamps, so they sort as text.
    """
    return results.select("session_id").distinct().orderBy(F.col("session_id").desc())


def session_of_path() -> Column:
    return F.regexp_extract("_metadata.file_path", "([^/]+)/[^/]+$", 1)


def read_sessions(spark: SparkSession, root: str, schema: T.StructType | str) -> DataFrame:
    """Stored results, one JSON document per session folder."""
    docs = spark.read.schema(schema).option("multiLine", True).json(f"{root}/*/scan.json")
    return docs.withColumn("session_id", session_of_path())


def replay(stored: DataFrame, session_id: str) -> DataFrame:
    """Records of one session; prunes to its partition when stored by ``session_id``."""
    return stored.where(F.col("session_id") == session_id)


def read_icons(spark: SparkSession, path: str, digests: bool = True) -> DataFrame:
    """PNG files with a numeric name: size in pixels, bytes and footprint, and the digest if it is asked for.

    Width and height are bytes 17 to 24 of a file.  Without digests no more than these bytes are read; with them, files
    are read in ranges.
    """
    stem = F.regexp_extract("path", r"([^/]+)\.png$", 1)
    px_w, px_h = images.size_in_header("data")
    sized = files.read_headers(spark, path, images.HEADER_BYTES, ".png").withColumn("stem", stem).where(F.col("stem").rlike("^[0-9]+$"))
    sized = sized.select("path", F.col("stem").cast("bigint").alias("icon_id"), px_w.alias("px_w"), px_h.alias("px_h"), "length")
    if digests:
        sized = sized.join(files.tree_digests(files.read_ranges(spark, path, suffix=".png")).select("path", "sha256"), "path")
    own = ["icon_id", "px_w", "px_h", *(["sha256"] if digests else []), "length"]
    return sized.select(*own, footprint(F.col("px_w")).alias("cells_w"), footprint(F.col("px_h")).alias("cells_h"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of a cache folder by stem and length; the content is not read."""
    if not path_exists(spark, path):
        return empty(spark, "item_id string, length bigint")
    found = spark.read.format("binaryFile").load(path)
    return found.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("item_id"), "length")


def file_digests(spark: SparkSession, path: str, range_bytes: int = files.RANGE_BYTES) -> DataFrame:
    """Name, length and digest of every file below a folder; large files are read in ranges (``files.tree_digests``)."""
    found = files.tree_digests(files.read_ranges(spark, path, range_bytes))
    return found.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "length", "sha256")


def read_grids(spark: SparkSession, path: str) -> DataFrame:
    """Containers with the size of one cell; columns and rows default to one."""
    grids = spark.read.schema(GRID).option("multiLine", True).json(path)
    return cell_geometry(grids)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Training logs, one CSV per model folder; loss columns keep their names."""
    logs = spark.read.schema(METRICS).option("header", True).csv(path)
    return logs.withColumn("model", session_of_path()).withColumn("mAP50", F.col("`metrics/mAP50(B)`"))


def snapshot_age(spark: SparkSession, path: str, now: str) -> DataFrame:
    """Hours between the newest file of a snapshot and ``now``; null if there is no file."""
    if not path_exists(spark, path):
        return spark.range(1).select(F.lit(None).cast("double").alias("age_h"))
    found = spark.read.format("binaryFile").load(path).select("modificationTime")
    newest = F.max(F.unix_timestamp("modificationTime"))
    return found.agg(((F.unix_timestamp(F.lit(now)) - newest) / 3600).alias("age_h"))


def stale(age_h: Column, ttl_h: float = 24.0) -> Column:
    """A missing snapshot is infinitely old."""
    return F.coalesce(age_h >= ttl_h, F.lit(True))


def list_images(templates: DataFrame, sessions: DataFrame, calibrated: DataFrame) -> DataFrame:
    """Templates and sessions that can be calibrated, and whether a session has its grids.

    Templates get the ``tpl:`` prefix and are never marked as reviewed.
    """
    marked = sessions.select("id").join(
        calibrated.select("id", F.lit(True).alias("reviewed")).distinct(), "id", "left"
    )
    return templates.select(F.concat(F.lit("tpl:"), "id").alias("id"), F.lit(False).alias("reviewed")).unionByName(
        marked.select("id", F.coalesce("reviewed", F.lit(False)).alias("reviewed"))
    )

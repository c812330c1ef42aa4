"""Domain tables derived from the driver's parquet tables.

Everything is a deterministic expression over whole tables.  Money is an integer
number of cents per row before any sum, so results do not depend on the order of sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotvalue.functions.pricing import fallback_price

SCREEN_W = 1920
SCREEN_H = 1080


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _int(col: str, factor: int = 1) -> Column:
    return F.round(F.col(col) * factor).cast("bigint")


def _text(col: str | Column) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("string")


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = raw(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("ok"),
        F.col("l_partkey").alias("pk"),
        F.col("l_suppkey").alias("sk"),
        F.col("l_linenumber").cast("bigint").alias("ln"),
        _int("l_quantity").alias("qty"),
        _int("l_extendedprice", 100).alias("cents"),
        _int("l_discount", 100).alias("disc"),
        _int("l_tax", 100).alias("tax"),
        F.col("l_returnflag").alias("rf"),
        F.col("l_linestatus").alias("ls"),
        F.unix_date(F.to_date("l_shipdate")).cast("bigint").alias("day"),
    )
    return lines.withColumn("unit", F.expr("cents div qty"))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average and latest-low unit price and the best vendor offer per part.

    The latest day and its lowest price share one long (day above, inverted price below),
    which keeps the aggregation a hash aggregation.
    """
    width = 1 << 40
    low_key = F.col("day") * width + (width - 1 - F.col("unit"))
    per_part = line_items(spark, sf_dir).groupBy("pk").agg(
        F.sum("unit").alias("total"),
        F.count(F.lit(1)).alias("n"),
        F.max("unit").alias("top"),
        F.max(low_key).alias("low_key"),
    )
    return per_part.select(
        "pk",
        F.expr("total div n").alias("avg24h"),
        (width - 1 - F.pmod("low_key", F.lit(width))).alias("low"),
        F.expr("top div 12").alias("vendor"),
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = raw(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size", _int("p_retailprice", 100).alias("cents"))
    joined = part.join(prices(spark, sf_dir), F.col("p_partkey") == F.col("pk"), "left")
    key, size = F.col("p_partkey"), F.col("p_size")
    return joined.select(
        _text(key).alias("item_id"),
        F.col("p_name").alias("name"),
        F.when(key % 31 == 0, "").otherwise(F.col("p_brand")).alias("short"),
        F.when(key % 23 == 0, 0).otherwise(1 + size % 3).cast("int").alias("width"),
        F.when(key % 29 != 0, 1 + F.expr("p_size div 3") % 2).cast("int").alias("height"),
        F.when(key % 7 != 0, F.col("avg24h")).alias("avg24h"),
        F.when(key % 11 == 0, 0).otherwise(F.col("low")).alias("low"),
        F.when(key % 5 != 0, F.col("vendor")).alias("vendor"),
        (F.col("cents") * (1 + size % 7)).alias("base"),
        key.alias("pos"),
    )


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog columns without prices; needs no pass over the line items."""
    key = F.col("p_partkey")
    return raw(spark, sf_dir, "part").select(
        _text(key).alias("item_id"),
        F.col("p_name").alias("name"),
        F.when(key % 31 == 0, "").otherwise(F.col("p_brand")).alias("short"),
        key.alias("pos"),
    )


def detection_index() -> Column:
    """Number of a line within its order: small columns side by side in one long (55 bits)."""
    packed = F.col("day")
    for col, bits in (("tax", 4), ("disc", 4), ("qty", 6), ("ln", 3), ("cents", 24)):
        packed = packed * (1 << bits) + F.col(col)
    return packed


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One session per order."""
    rows = line_items(spark, sf_dir)
    x0 = (F.col("qty") * 37 + F.col("ln") * 211) % 1700
    y0 = (F.col("disc") * 91 + F.col("tax") * 53 + F.col("ln") * 67) % 900
    x1 = x0 + 64 + F.col("pk") % 3 * 63
    y1 = y0 + 64 + F.expr("pk div 3") % 2 * 63
    no_text = F.col("sk") % 4 == 0
    return rows.select(
        _text("ok").alias("session_id"),
        detection_index().alias("det_idx"),
        _text("pk").alias("icon_id"),
        F.array(*[c.cast("int") for c in (x0, y0, x1, y1)]).alias("box"),
        ((1000 - F.col("tax") * 95) / 1000).alias("det_conf"),
        F.when(no_text, "")
        .when(F.col("sk") % 11 == 0, F.concat(F.lit("gone-"), _text("sk")))
        .when(F.col("ln") % 3 == 0, _text("pk"))
        .otherwise(_text("sk"))
        .alias("ocr_id"),
        F.when(no_text, 0.0).otherwise((100 - F.col("disc") * 7) / 100).alias("ocr_score"),
        F.concat_ws("-", "rf", _text("ln")).alias("ocr_raw"),
        F.col("qty").alias("quantity"),
    )


def session_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Narrow scan for the size probe of rankings by session."""
    return raw(spark, sf_dir, "lineitem").select(_text("l_orderkey").alias("session_id"))


def auto_links(spark: SparkSession, sf_dir: str, priced: bool = False) -> DataFrame:
    key = F.col("p_partkey")
    part = raw(spark, sf_dir, "part")
    matched = key % 13 != 0
    links = part.select(
        _text(key).alias("icon_id"),
        F.when(matched, F.when(key % 17 == 0, F.concat(F.lit("gone-"), _text(key))).otherwise(_text(key))).alias("item_id"),
        F.when(matched, F.col("p_name")).alias("name"),
        F.when(matched, F.col("p_brand")).alias("short"),
        F.when(matched, (F.col("p_size") * 8 + key % 10) / 10).alias("score"),
        F.when(matched & (key % 19 != 0), key * 7 % 80 / 10).alias("margin"),
    )
    if not priced:
        return links
    price = fallback_price(F.col("avg24h"), F.col("low"), F.col("base"), default_zero=False)
    by_icon = catalog(spark, sf_dir).select(F.col("item_id").alias("icon_id"), price.alias("_price"))
    joined = links.join(by_icon, "icon_id", "left")
    return joined.withColumn("price", F.when(F.col("item_id").isNotNull(), F.col("_price"))).drop("_price")


def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One flat override per supplier; those of rich suppliers name an unknown item."""
    key = F.col("s_suppkey")
    target = F.when(F.col("s_acctbal") > 7000, F.concat(F.lit("unknown-"), _text(key))).otherwise(_text(key + 1))
    return raw(spark, sf_dir, "supplier").select(_text(key * 17).alias("icon_id"), target.alias("item_id"))


def link_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return raw(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"),
        _text("user_id").alias("icon_id"),
        F.when(k % 10 == 0, "").otherwise(_text(k)).alias("item_id"),
        F.when(F.col("event_type") == "purchase", "manual").otherwise("visual").alias("source"),
        F.lit(100).alias("certainty"),
        F.lit("").alias("note"),
    )


def evidence_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    source = (
        F.when((kind == "purchase") & (F.col("user_id") % 3 == 0), "manual")
        .when(kind == "view", "hash")
        .when(kind == "signup", "api_match")
        .otherwise("visual")
    )
    return raw(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        _text("user_id").alias("icon_id"),
        _text(F.get_json_object("props", "$.k").cast("int") % 20).alias("item_id"),
        source.alias("source"),
        (F.col("event_id") * 7 % 101).cast("int").alias("certainty"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image vectors in colour range: 64 doubles per icon, blocked by label."""
    vec = F.transform("embedding", lambda v: v.cast("double") * 255)
    return raw(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("icon_id"), F.col("label").alias("block"), vec.alias("vec"))


def icon_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Icons with an alpha channel."""
    return vectors(spark, sf_dir).withColumn("alpha", F.transform("vec", lambda v: F.abs(v)))


def catalog_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pictures as another renderer would store them: posterised."""
    return vectors(spark, sf_dir).select(
        F.col("icon_id").alias("item_id"), "block", F.transform("vec", lambda v: F.bround(v / 24) * 24).alias("vec")
    )


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every picture as three renderers draw it: as it is, and with coarser and coarser colours."""
    drawn = lambda step: F.transform("vec", lambda v: F.bround(v / step) * step)
    views = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), v.alias("vec")) for i, v in enumerate([F.col("vec"), drawn(6), drawn(10)])]))
    return vectors(spark, sf_dir).select("icon_id", "block", views.alias("view")).select(
        (F.col("icon_id") * 4 + F.col("view.i")).alias("icon_id"), "block", F.col("view.vec").alias("vec")
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets with content: digest per document, blocked by language."""
    return raw(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("icon_id"), F.col("lang").alias("block"), F.sha1("text").alias("sig"),
    )


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("icon_id"), "source", F.sha2("text", 256).alias("sha256")
    )


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One container per supplier; some have no columns or rows given."""
    key = F.col("s_suppkey")
    cols, rows = 1 + key % 5, 1 + F.expr("s_suppkey div 5") % 4
    return raw(spark, sf_dir, "supplier").select(
        key.alias("grid_id"),
        F.col("s_nationkey").alias("scope"),
        (key * 173 % 1500).cast("double").alias("x"),
        (key * 97 % 800).cast("double").alias("y"),
        (cols * 63 + key % 2).cast("double").alias("w"),
        (rows * 63 + key % 3).cast("double").alias("h"),
        F.when(key % 9 != 0, cols).cast("int").alias("cols"),
        F.when(key % 10 != 0, rows).cast("int").alias("rows"),
    )


def typed_text() -> Column:
    """A part name as text recognition might return it: intact, one letter lost, or spaced out."""
    cut = F.lit(2).cast("bigint") + F.col("p_partkey") % 4
    lost = F.concat(F.substring(F.col("p_name"), F.lit(1), cut.cast("int")), F.substring(F.col("p_name"), (cut + 2).cast("int"), F.lit(100)))
    spaced = F.concat(F.lit(" "), F.replace(F.upper("p_name"), F.lit(" "), F.lit("\u00a0 ")))
    return F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 1, lost).otherwise(spaced)


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed words of a box: the name on the top strip right to left, the type below."""
    part = raw(spark, sf_dir, "part").select(F.col("p_partkey").alias("box_id"), typed_text().alias("line"), "p_type")
    every = F.concat(F.split(F.trim("line"), " "), F.array("p_type"))
    listed = part.select("box_id", F.size(every).alias("n"), F.posexplode(every).alias("word_idx", "text"))
    below = F.col("word_idx") == F.col("n") - 1
    return listed.select(
        "box_id",
        "word_idx",
        "text",
        (F.col("word_idx") * 40 % 70).cast("double").alias("x"),
        F.when(below, 50.0).otherwise(2.0).alias("y"),
        F.lit(30.0).alias("w"),
        F.lit(10.0).alias("h"),
        F.lit(64.0).alias("box_height"),
    )


def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed texts, one per part: an id, the beginning of a name in capitals, two letters, one letter, the type."""
    key, name = F.col("p_partkey"), F.col("p_name")
    typed = (
        F.when(key % 5 == 0, key.cast("string"))
        .when(key % 5 == 1, F.upper(F.substring(name, 1, 9)))
        .when(key % 5 == 2, F.substring(name, 3, 2))
        .when(key % 5 == 3, F.substring(name, 2, 1))
        .otherwise(F.lower("p_type"))
    )
    return raw(spark, sf_dir, "part").select(typed.alias("query")).distinct()

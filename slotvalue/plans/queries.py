"""Registered queries: one function of (spark, sf_dir) per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotvalue.functions import geometry, hashing, pricing, text
from slotvalue.functions import images as image_bytes
from slotvalue.functions.rounding import round_share
from slotvalue.operators import (
    dataset,
    duplicates,
    evidence,
    links,
    manifest,
    matching,
    names,
    rank,
    reports,
    resolve,
    spatial,
)
from slotvalue.operators.skew import shuffle_width
from slotvalue.plans import tables as t
from slotvalue.runtime import scratch_path
from slotvalue.schema import METRIC_COLUMNS
from slotvalue.sources import files, readers, writers
from slotvalue.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SEED = 7


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def link_map(spark, sf):
    return links.project_links(t.auto_links(spark, sf), t.overrides(spark, sf), t.link_events(spark, sf))


def records(spark, sf, basis="avg24h", keep=()):
    return resolve.resolve(t.detections(spark, sf), link_map(spark, sf), t.catalog(spark, sf), basis, keep)


FLAT = [
    "session_id", "det_idx", "icon_id", "source", "certainty", "agree", "id", "name", "short",
    "width", "height", "value", "slots", "per_slot",
]


# --- session results -------------------------------------------------------------------


@query
def keep_ditch(spark, sf):
    return rank.keep_ditch(records(spark, sf), t.session_sizes(spark, sf))


@query
def rank_by_slot(spark, sf):
    rows = records(spark, sf).select("session_id", "det_idx", "source", "id", "per_slot")
    return rank.rank_by_slot(rows, t.session_sizes(spark, sf)).drop("source")


@query
def session_summary(spark, sf):
    return rank.session_summary(records(spark, sf))


@query
def session_summary_low(spark, sf):
    return rank.session_summary(records(spark, sf, "low"))


@query
def collapse_qty(spark, sf):
    rows = rank.collapse(records(spark, sf), first_seen=True)
    return rows.select(
        "session_id", "id", "name", "per_slot", "value", "qty", "first_det",
        F.col("first.icon_id").alias("first_icon"), F.col("first.box")[0].alias("first_x0"),
    )


@query
def least_certain(spark, sf):
    rows = records(spark, sf).select("session_id", "det_idx", "certainty", "source")
    return rank.least_certain(rows, t.session_sizes(spark, sf))


@query
def top_report(spark, sf):
    return rank.top_report(records(spark, sf), 25)


@query
def stack_totals(spark, sf):
    return rank.stack_totals(records(spark, sf, keep=["quantity"]))


@query
def slot_labels(spark, sf):
    label = text.slot_label(F.col("short"), F.col("name"), F.col("per_slot"))
    return resolve.identified(records(spark, sf)).select("session_id", "det_idx", label.alias("label"))


# --- identity --------------------------------------------------------------------------


@query
def resolve_identity(spark, sf):
    return records(spark, sf).select(*FLAT)


@query
def resolve_nested(spark, sf):
    """Both candidates of each record."""
    rows = records(spark, sf)
    return rows.select(
        "session_id", "det_idx",
        F.col("yolo.id").alias("yolo_id"), F.col("yolo.score").alias("yolo_score"),
        F.col("yolo.margin").alias("yolo_margin"), F.col("yolo.override").alias("yolo_override"),
        F.col("yolo.certainty").alias("yolo_certainty"), F.col("ocr.id").alias("text_id"),
        F.col("ocr.width").alias("text_width"), F.col("ocr.score").alias("text_score"), F.col("ocr.raw").alias("text_raw"),
    )


@query
def identity_agreement(spark, sf):
    return records(spark, sf).groupBy("source", "agree").agg(F.count(F.lit(1)).alias("n"))


@query
def unidentified(spark, sf):
    return resolve.unidentified(records(spark, sf)).select("session_id", "det_idx", "icon_id", "certainty")


@query
def all_records(spark, sf):
    rows = records(spark, sf)
    found = resolve.identified(rows).select("session_id", "det_idx", "source", "value")
    unknown = resolve.unidentified(rows).select("session_id", "det_idx", "source")
    return resolve.all_records(found, unknown)


@query
def detections_roundtrip(spark, sf):
    rows = resolve.detections_of(records(spark, sf))
    return rows.select(
        "session_id", "det_idx", "icon_id", "det_conf", "ocr_id", "ocr_score", "ocr_raw",
        *[F.col("box")[i].alias(f"b{i}") for i in range(4)],
    )


@query
def reprojection(spark, sf):
    """Resolving the reconstructed detections again under the other price basis."""
    again = resolve.resolve(
        resolve.detections_of(records(spark, sf)), link_map(spark, sf), t.catalog(spark, sf), "low"
    )
    return rank.session_summary(again)


@query
def confident_detections(spark, sf):
    kept = rank.confident(t.detections(spark, sf), rank.PREDICT_CONFIDENCE)
    return kept.select("session_id", "det_idx", "det_conf")


@query
def capped_detections(spark, sf):
    """At most 400 detections per image; an image here is a supplier's shelf."""
    shelf = t.line_items(spark, sf).select(
        F.col("sk").cast("string").alias("session_id"), ((1000 - F.col("tax") * 95) / 1000).alias("det_conf"),
        t.detection_index().alias("det_idx"),
    )
    return rank.cap_detections(shelf, rank.MAX_DETECTIONS)


@query
def detection_overflow(spark, sf):
    """Images with more detections than the detector reports, and how many it drops."""
    shelf = t.line_items(spark, sf).select(F.col("sk").cast("string").alias("session_id"))
    return rank.overflow(shelf, rank.MAX_DETECTIONS)


@query
def raw_detections(spark, sf):
    """Detector output with fractional boxes and long scores, cleaned up."""
    share = (F.col("cents") % 100003) / 100003
    output = t.line_items(spark, sf).select(
        F.col("ok").cast("string").alias("session_id"), t.detection_index().alias("det_idx"), F.col("pk").alias("icon_id"),
        F.array(*[(F.col("cents") % m).cast("double") / 8 for m in (9001, 7001)]).alias("box"),
        share.alias("det_conf"), (F.col("cents") % 81 / 80).alias("ocr_score"),
    )
    rows = rank.raw_detections(output, rank.MAX_DETECTIONS)
    return rows.select("session_id", "det_idx", "icon_id", F.col("box")[0].alias("x0"), F.col("box")[1].alias("y0"), "det_conf", "ocr_score")


@query
def session_listing(spark, sf):
    return readers.list_sessions(t.session_sizes(spark, sf))


@query
def session_replay(spark, sf):
    """Stored detections of the newest session."""
    rows = t.detections(spark, sf)
    newest = t.session_sizes(spark, sf).agg(F.max("session_id").alias("session_id"))
    kept = rows.join(newest, "session_id", "left_semi")
    return kept.select("session_id", "det_idx", "icon_id", "det_conf", "ocr_id", "ocr_score")


# --- prices ----------------------------------------------------------------------------


def _value(spark, sf, basis):
    items = resolve.item_entries(t.catalog(spark, sf), basis)
    slots = F.col("width") * F.col("height")
    return items.select(
        "item_id", "short", "width", "height", "value", pricing.value_per_slot(F.col("value"), slots).alias("per_slot")
    )


@query
def effective_value_avg(spark, sf):
    return _value(spark, sf, "avg24h")


@query
def effective_value_low(spark, sf):
    return _value(spark, sf, "low")


@query
def effective_value_default(spark, sf):
    """An unknown basis means the average."""
    return _value(spark, sf, pricing.price_basis("yesterday"))


@query
def fallback_price(spark, sf):
    args = [F.col(c) for c in ("avg24h", "low", "base")]
    return t.catalog(spark, sf).select(
        "item_id", pricing.fallback_price(*args).alias("price"), pricing.fallback_price(*args, default_zero=False).alias("copied")
    )


@query
def best_vendor(spark, sf):
    """Best price in a nested array of offers, as catalogs deliver it."""
    offers = F.transform(
        F.sequence(F.lit(1), F.col("p_size") % 4 + 1),
        lambda i: F.struct((F.col("p_partkey") * i * 7919 % 10007).alias("priceRUB")),
    )
    listed = F.when(F.col("p_size") % 5 != 0, F.slice(offers, 2, 4))
    return t.raw(spark, sf, "part").select("p_partkey", pricing.best_offer(listed).alias("vendor"))


# --- links -----------------------------------------------------------------------------


@query
def link_projection(spark, sf):
    return links.with_certainty(link_map(spark, sf))


@query
def link_latest_event(spark, sf):
    return links.latest_manual_links(t.link_events(spark, sf))


@query
def link_certainty(spark, sf):
    rows = t.auto_links(spark, sf).withColumn("override", F.lit(False))
    return links.with_certainty(rows).select("icon_id", "score", "margin", "certainty")


def _map(spark, sf):
    return links.effective_map(t.auto_links(spark, sf, priced=True), t.overrides(spark, sf), t.catalog(spark, sf))


@query
def effective_map(spark, sf):
    return _map(spark, sf)


def _review(spark, sf, mode):
    return links.review(_map(spark, sf), mode, 400, seed=SEED).select("icon_id", "name", "source", "doubt")


@query
def review_worst(spark, sf):
    return _review(spark, sf, "worst")


@query
def review_best(spark, sf):
    return _review(spark, sf, "best")


@query
def review_random(spark, sf):
    return _review(spark, sf, "random")


@query
def near_tie_links(spark, sf):
    return matching.near_ties(t.auto_links(spark, sf)).select("icon_id", "score", "margin")




@query
def unique_match(spark, sf):
    """Ids, parts of names of all lengths, and texts that fit nothing, typed for every part."""
    return links.resolve_unique(t.names(spark, sf), t.searches(spark, sf), listed=15)


@query
def find_asked(spark, sf):
    """How many names hold each typed text, by the inverted index."""
    found = links.find_asked(t.names(spark, sf), t.searches(spark, sf))
    return found.groupBy("query").agg(F.count(F.lit(1)).alias("hits"), F.min("pos").alias("first_pos"))


@query
def find_items(spark, sf):
    return links.find_items(t.names(spark, sf), ["Gold", "bolt"]).drop("pos")


@query
def search_items(spark, sf):
    found = links.search_items(t.catalog(spark, sf), "  Red ", limit=25)
    return resolve.item_entries(found)


@query
def evidence_fusion(spark, sf):
    return evidence.fuse(t.evidence_events(spark, sf))


@query
def majority_vote(spark, sf):
    votes = t.detections(spark, sf).where(F.col("ocr_id") != "").select("icon_id", F.col("ocr_id").alias("name"))
    return evidence.majority(votes)


# --- matching --------------------------------------------------------------------------


def _matches(spark, sf):
    images = t.catalog_images(spark, sf)
    shown = images.select("item_id", F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("name"))
    return matching.match_table(t.icon_queries(spark, sf), images, shown)


@query
def topk_match(spark, sf):
    return matching.nearest(t.icon_queries(spark, sf), t.catalog_images(spark, sf)).select(
        "icon_id", "item_id", "rank", F.bround("distance", 4).alias("distance")
    )


@query
def match_table(spark, sf):
    return _matches(spark, sf).withColumn("alts", F.array_join("alts", ";"))


@query
def match_quality(spark, sf):
    return matching.match_quality(_matches(spark, sf))


@query
def block_counts(spark, sf):
    return matching.block_counts(t.catalog_images(spark, sf))


@query
def name_index(spark, sf):
    items = t.names(spark, sf)
    short = names.name_index(items, "short").select(F.lit("short").alias("kind"), "key", "item_id")
    return short.unionByName(names.name_index(items, "name").select(F.lit("full").alias("kind"), "key", "item_id"))


def _texts(spark, sf):
    return t.raw(spark, sf, "part").select(text.normalise(t.typed_text()).alias("text")).distinct()


@query
def normalised_text(spark, sf):
    """Normalised text of every conversation turn, by digest and length."""
    clean = text.normalise(F.col("text"))
    return t.raw(spark, sf, "conversations").select(
        "conv_id", "turn", F.sha1(clean).alias("digest"), F.length(clean).alias("chars")
    )


@query
def name_match_exact(spark, sf):
    items = t.names(spark, sf)
    return names.exact_names(_texts(spark, sf), names.name_index(items, "short"), names.name_index(items, "name"))


@query
def name_match_fuzzy(spark, sf):
    return names.match_names(_texts(spark, sf), t.names(spark, sf))


@query
def name_match_levenshtein(spark, sf):
    return names.levenshtein_best(_texts(spark, sf), names.name_index(t.names(spark, sf), "name"))


@query
def box_text(spark, sf):
    return names.assemble_text(t.words(spark, sf), ["box_id"])


@query
def text_in_box(spark, sf):
    return names.identify_boxes(t.words(spark, sf), t.names(spark, sf), ["box_id"])


# --- duplicates ------------------------------------------------------------------------

BITS = 64
NEAR = 4


def _drawn_hash(spark, sf):
    """64-bit average hash of every picture of every renderer."""
    sig, _ = hashing.signature(F.col("vec"), 64, "average", BITS)
    return t.rendered(spark, sf).select("icon_id", "block", sig.alias("sig"))


@query
def exact_dups(spark, sf):
    return duplicates.exact_groups(t.documents(spark, sf))


@query
def exact_dup_members(spark, sf):
    return duplicates.exact_members(t.documents(spark, sf))


@query
def dup_groups(spark, sf):
    return duplicates.group_table(duplicates.exact_members(t.documents(spark, sf)))


@query
def average_hash(spark, sf):
    sig = hashing.average_hash(F.col("vec"), 64)
    return t.vectors(spark, sf).select("icon_id", sig[0].alias("w0"), sig[1].alias("w1"))


@query
def gradient_hash(spark, sf):
    sig = hashing.gradient_hash(F.col("vec"), 64)
    return t.vectors(spark, sf).select("icon_id", sig[0].alias("w0"), sig[1].alias("w1"))


@query
def dct_hash(spark, sf):
    sig = hashing.dct_hash(F.col("vec"), 64, 16)
    return t.vectors(spark, sf).select("icon_id", sig[0].alias("w0"))


@query
def near_dup_pairs(spark, sf):
    pairs = duplicates.near_pairs(_drawn_hash(spark, sf), BITS, NEAR)
    return pairs.select("block", "rep_a", "rep_b", "distance", "copies_a", "copies_b")


@query
def near_dup_clusters(spark, sf):
    return duplicates.near_members(_drawn_hash(spark, sf), BITS, NEAR)


@query
def dup_summary(spark, sf):
    return duplicates.compare_methods(t.rendered(spark, sf), 64)


@query
def document_dup_summary(spark, sf):
    docs = t.documents(spark, sf)
    return duplicates.method_summary(duplicates.exact_members(docs), docs, "exact")


# --- training-set tables ---------------------------------------------------------------


def _classed(spark, sf):
    docs = t.documents(spark, sf)
    return dataset.canonical_class(docs.select("icon_id", "block"), duplicates.exact_members(docs))


def _icons(spark, sf):
    """Icons with a footprint from pixel sizes."""
    part = t.raw(spark, sf, "part")
    px_w, px_h = 10 + F.col("p_size") * 13, 40 + F.col("p_partkey") % 17 * 63
    return part.select(
        F.col("p_partkey").alias("icon_id"), geometry.footprint(px_w).alias("cells_w"), geometry.footprint(px_h).alias("cells_h")
    ).where(geometry.footprint_allowed(F.col("cells_w"), F.col("cells_h")))


@query
def icon_footprints(spark, sf):
    return _icons(spark, sf)


@query
def canonical_class(spark, sf):
    return _classed(spark, sf).select("icon_id", "canonical", "ambiguous")


@query
def class_vocab(spark, sf):
    return dataset.class_vocabulary(_classed(spark, sf))


@query
def class_members(spark, sf):
    classed = _classed(spark, sf)
    return dataset.class_members(classed, dataset.class_vocabulary(classed))


@query
def class_metadata(spark, sf):
    """Metadata lines, read back field by field."""
    lines = writers.class_metadata(dataset.class_vocabulary(_classed(spark, sf)))
    fields = F.from_json("value", "class_idx bigint, name string, ambiguous boolean, icons bigint")
    return lines.select(fields.alias("c")).select("c.*")


PER_CLASS = 3
WORKERS = 7
MAX_OBJS = 35


def _queue(spark, sf):
    copies = dataset.replicate(_icons(spark, sf), PER_CLASS)
    return dataset.shuffled(copies, SEED, "icon_id", "copy", total="total")


@query
def balanced_queue(spark, sf):
    return _queue(spark, sf).select("icon_id", "copy", "position")


@query
def chunk_queue(spark, sf):
    return dataset.chunked(_queue(spark, sf), WORKERS).groupBy("chunk").agg(
        F.count(F.lit(1)).alias("rows"), F.min("position").alias("first_position")
    )


@query
def scene_batches(spark, sf):
    return dataset.scenes(_queue(spark, sf), MAX_OBJS).select("icon_id", "copy", "scene")


@query
def train_val_split(spark, sf):
    placed = dataset.split_scenes(dataset.scenes(_queue(spark, sf), MAX_OBJS), SEED)
    return placed.groupBy("scene", "split").agg(F.count(F.lit(1)).alias("objects"))


@query
def turned_icons(spark, sf):
    return dataset.turned(_queue(spark, sf), SEED, "icon_id", "copy").select(
        "icon_id", "copy", "turned", "cells_w", "cells_h"
    )


@query
def sampled_icons(spark, sf):
    return dataset.sample_first(_icons(spark, sf), SEED, 100, "icon_id")


@query
def label_rows(spark, sf):
    """Label line of every detection box, relative to the screen."""
    b = F.col("box")
    rel = geometry.relative_box(b[0], b[1], b[2] - b[0], b[3] - b[1], F.lit(t.SCREEN_W), F.lit(t.SCREEN_H))
    rows = t.detections(spark, sf).withColumn("r", rel)
    line = dataset.label_line(F.col("icon_id").cast("int"), *[F.col(f"r.{c}") for c in ("cx", "cy", "w", "h")])
    return rows.select("session_id", "det_idx", line.alias("line"))


@query
def grid_cells(spark, sf):
    return spatial.cell_geometry(t.grids(spark, sf)).select("grid_id", "cols", "rows", F.bround("cw", 6).alias("cw"), F.bround("ch", 6).alias("ch"))


@query
def placements(spark, sf):
    return spatial.placements(spatial.cell_geometry(t.grids(spark, sf)), 2, 1).select("grid_id", "col", "row")


@query
def placed_labels(spark, sf):
    """Label of a 2x1 footprint at every admissible cell."""
    spots = spatial.placements(spatial.cell_geometry(t.grids(spark, sf)), 2, 1)
    box = dataset.label_box(
        *[F.col(c) for c in ("x", "y", "cw", "ch", "col", "row")], F.lit(2), F.lit(1), F.lit(t.SCREEN_W), F.lit(t.SCREEN_H)
    )
    return spots.withColumn("b", box).select("grid_id", "col", "row", *[round_share(F.col(f"b.{c}"), 6).alias(c) for c in ("cx", "cy", "w", "h")])


@query
def correction_samples(spark, sf):
    """A correction per returned icon of an order, applied to all its boxes there."""
    fixes = t.line_items(spark, sf).where(F.col("rf") == "R").groupBy("ok", "pk").agg(
        F.max("day").alias("day"), F.min("sk").alias("sk")
    )
    events = fixes.select(
        F.col("ok").cast("string").alias("session_id"), F.col("pk").cast("string").alias("icon_id"),
        F.col("day").cast("string").alias("ts"), F.col("sk").cast("string").alias("item_id"),
    )
    rows = dataset.corrections(events, t.detections(spark, sf), t.names(spark, sf))
    return rows.withColumn("box", F.array_join(F.transform("box", lambda v: v.cast("string")), ","))


def _drawn(spark, sf):
    """Hand-drawn rectangles, corners in any order, some tiny, some unlabelled."""
    rows = t.raw(spark, sf, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    x0, y0 = (cents % 19000) / 10, (cents % 10007) / 10
    x1, y1 = x0 + (F.col("o_orderkey") % 41 - 20) / 2, y0 + (cents % 53) / 4
    return rows.select(
        F.col("o_orderkey").cast("string").alias("session_id"),
        F.col("o_orderstatus").alias("ts"),
        F.transform(geometry.ordered_box(x0, y0, x1, y1), lambda v: v.cast("double")).alias("box"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_custkey").cast("string")).alias("item_id"),
    )


@query
def missed_samples(spark, sf):
    rows = dataset.missed_samples(_drawn(spark, sf), t.names(spark, sf))
    return rows.withColumn("box", F.array_join(F.transform("box", lambda v: v.cast("string")), ","))


@query
def gallery_merge(spark, sf):
    """Generated placements and real corrected crops per class."""
    icons = _icons(spark, sf).withColumn("canonical", F.col("icon_id")).withColumn("ambiguous", F.lit(False))
    vocabulary = dataset.class_vocabulary(icons)
    placed = dataset.replicate(icons.join(vocabulary.select("canonical", "class_idx"), "canonical"), PER_CLASS)
    real = t.detections(spark, sf).select(F.col("icon_id").cast("bigint").alias("icon_id"), F.col("session_id").alias("crop"))
    return dataset.with_gallery(placed, real, vocabulary).groupBy("class_idx", "origin").agg(F.count(F.lit(1)).alias("n"))


@query
def parsed_boxes(spark, sf):
    """Boxes given as text; a broken one is null."""
    tail = F.when(F.col("o_orderstatus") == "P", "x").otherwise("9")
    given = F.concat_ws(",", *[F.col(c).cast("string") for c in ("o_orderkey", "o_custkey")], F.lit(" 12"), tail)
    box = geometry.parse_box(given)
    return t.raw(spark, sf, "orders").select("o_orderkey", *[box[i].alias(f"b{i}") for i in range(4)])


@query
def rescaled_words(spark, sf):
    return t.words(spark, sf).select(
        "box_id", "word_idx", *[F.bround(geometry.rescale(F.col(c), 6), 4).alias(c) for c in ("x", "y", "w", "h")]
    )


# --- geometry --------------------------------------------------------------------------


def _boxes(spark, sf):
    b = F.col("box")
    return t.detections(spark, sf).select(
        "session_id", F.col("det_idx").alias("box_id"), b[0].alias("x0"), b[1].alias("y0"), b[2].alias("x1"), b[3].alias("y1")
    )


@query
def word_to_box(spark, sf):
    """The box drawn last under each word of a session."""
    b = F.col("box")
    words = t.detections(spark, sf).select(
        "session_id", F.col("det_idx").alias("word_id"), (b[0] + F.col("quantity") * 3).alias("x"), (b[1] + F.col("quantity") * 2).alias("y")
    )
    return spatial.topmost(words, _boxes(spark, sf), "session_id", ["word_id"], "box_id", "box_id")


@query
def point_in_container(spark, sf):
    """Customers as clicks on the containers of their nation."""
    points = t.raw(spark, sf, "customer").select(
        F.col("c_nationkey").alias("scope"), F.col("c_custkey").alias("click"),
        (F.col("c_custkey") * 37 % t.SCREEN_W).alias("x"), (F.col("c_custkey") * 91 % t.SCREEN_H).alias("y"),
    )
    boxes = t.grids(spark, sf).select(
        "scope", "grid_id", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("h")).alias("y1")
    )
    return spatial.topmost(points, boxes, "scope", ["click"], "grid_id", "grid_id")


# --- manifests -------------------------------------------------------------------------


@query
def asset_digests(spark, sf):
    return t.assets(spark, sf).select("icon_id", "sha256")


@query
def set_fingerprint(spark, sf):
    return manifest.set_fingerprint(t.assets(spark, sf))


def _trained(spark, sf):
    """Icon of every model class: a model per market segment, a class per customer."""
    return t.raw(spark, sf, "customer").select(
        F.concat(F.lower("c_mktsegment"), F.lit("-v"), F.col("c_nationkey").cast("string")).alias("model"),
        (F.col("c_custkey") * 3).cast("string").alias("icon_id"), F.col("c_custkey").alias("class_idx"),
    )


def _cached(spark, sf):
    return t.raw(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("icon_id"))


@query
def missing_assets(spark, sf):
    return manifest.missing_assets(_trained(spark, sf), _cached(spark, sf)).select("model", "icon_id")


@query
def release_summary(spark, sf):
    return manifest.release_summary(_trained(spark, sf), _cached(spark, sf))


def _hashed(spark, sf):
    return t.raw(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("icon_id"), F.sha2("p_name", 256).alias("sha256"))


@query
def model_fingerprint(spark, sf):
    """The fingerprint over one sorted list of lines, for the icon set of each model."""
    icons = _trained(spark, sf).select("model", "icon_id").distinct().join(_hashed(spark, sf), "icon_id")
    return manifest.small_set_fingerprint(icons, ["model"])


RANGE = 512


def _released(spark, sf):
    """``(name, length, sha256)`` of the files of all releases, written and digested in ranges of a few hundred bytes.

    A release has its links in one file and its icons in files of up to a thousand customers.
    """
    line = F.concat("icon_id", F.lit(":"), F.sha2(F.col("class_idx").cast("string"), 256), F.lit("\n"))
    rows = _trained(spark, sf).select("model", "class_idx", line.alias("line"))
    part = F.concat(F.lit("icons/part-"), F.floor(F.col("class_idx") / 1000).cast("string"), F.lit(".txt"))
    rows = rows.withColumn("file", F.explode(F.array(F.lit("links/links.txt"), part)))
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("class_idx", "line"))), lambda r: r["line"]), "")
    path = scratch_path(spark, "release")
    files.write_files(rows.groupBy("model", "file").agg(content.alias("content")).select(F.concat_ws("/", "model", "file").alias("name"), "content"), path)
    return files.tree_digests(files.read_ranges(spark, path, RANGE)).select(files.stored_name().alias("name"), "length", "sha256")


@query
def release_files(spark, sf):
    return _released(spark, sf)


@query
def release_manifest(spark, sf):
    parts = F.split("name", "/", 2)
    listed = _released(spark, sf).select(parts[0].alias("model"), parts[1].alias("file"), "sha256")
    built = manifest.release_manifest(_trained(spark, sf), _hashed(spark, sf), "2024-01-01T00:00:00", files=listed)
    return built.withColumn("files", F.array_join(F.transform("files", lambda f: F.concat_ws(":", f["file"], f["sha256"])), " "))


def _png_pixels():
    """Pictures of different shapes, as whole grey values."""
    width = F.element_at(F.array(*map(F.lit, (8, 16, 4, 64))), (F.col("icon_id") % 4 + 1).cast("int"))
    grey = F.transform("vec", lambda v: F.floor(F.abs(v)).cast("int") % 256)
    return width, grey


def _picture_files(spark, sf):
    width, grey = _png_pixels()
    path = scratch_path(spark, "pictures")
    pictures = t.vectors(spark, sf).select(F.concat(F.col("icon_id").cast("string"), F.lit(".png")).alias("name"), image_bytes.png(grey, width).alias("content"))
    files.write_files(pictures, path)
    return path


@query
def image_files(spark, sf):
    """Pictures written as PNG files; their sizes come from the first bytes of each file."""
    return readers.read_icons(spark, _picture_files(spark, sf), digests=False)


@query
def image_contents(spark, sf):
    """Pictures written as PNG files, read back whole and decoded."""
    whole = files.read_ranges(spark, _picture_files(spark, sf), suffix=".png")
    grey = F.array_join(image_bytes.grey_values("data"), ",")
    stem = F.regexp_extract("path", r"([^/]+)\.png$", 1).cast("bigint")
    return whole.select(stem.alias("icon_id"), F.md5(grey).alias("grey_md5"))


@query
def model_names(spark, sf):
    split = text.model_and_version(F.col("name"))
    listed = t.raw(spark, sf, "customer").select(F.lower("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("string").alias("n"))
    name = F.when(F.col("n") == "0", F.col("segment")).when(F.col("n") == "1", F.concat(F.lit("-"), "segment")).otherwise(
        F.concat_ws("-", "segment", F.lit("x"), "n")
    )
    return listed.select(name.alias("name")).distinct().withColumn("s", split).select("name", "s.model", "s.version")


@query
def ordered_icons(spark, sf):
    rows = t.line_items(spark, sf).select(F.col("pk").alias("icon"), F.col("ok").alias("pos"))
    return manifest.ordered_distinct(rows, "icon", "pos")


def _pictures(spark, sf, live):
    """Trained and current pictures; the current ones have edits, moves and removals."""
    rows = t.vectors(spark, sf)
    if live:
        key = F.col("icon_id")
        vec = F.when(key % 7 == 0, F.reverse("vec")).when(key % 11 == 0, F.transform("vec", lambda v: v + 3)).otherwise(F.col("vec"))
        moved = F.when(key % 13 == 0, key + 1_000_000).when(key % 17 == 0, key + 2_000_000).otherwise(key)
        vec = F.when(key % 17 == 0, F.transform("vec", lambda v: -v)).otherwise(vec)
        rows = rows.select(moved.alias("icon_id"), vec.alias("vec"))
    numbers = F.transform("vec", lambda v: F.round(v).cast("int").cast("string"))
    return rows.select("icon_id", F.sha2(F.array_join(numbers, ","), 256).alias("sha256"), hashing.gradient_hash(F.col("vec"), 64).alias("sig"))


@query
def manifest_drift(spark, sf):
    return manifest.drift(_pictures(spark, sf, False), _pictures(spark, sf, True))


@query
def fetch_worklist(spark, sf):
    key = F.col("p_partkey")
    link = F.when(key % 6 == 0, None).when(key % 9 == 0, "").otherwise(F.concat(F.lit("https://icons.example/"), key.cast("string")))
    items = t.raw(spark, sf, "part").select(key.cast("string").alias("item_id"), link.alias("link"))
    files = t.raw(spark, sf, "orders").groupBy(F.col("o_custkey").cast("string").alias("item_id")).agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("length")
    )
    return manifest.worklist(items, files)


@query
def freshness(spark, sf):
    """Age of each feed at a fixed time."""
    now = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    newest = t.raw(spark, sf, "events").groupBy("event_type", "user_id").agg(F.max("ts").alias("ts"))
    seconds = F.expr("timestampdiff(SECOND, ts, now)")
    aged = newest.withColumn("now", now).withColumn("age_h", seconds / 3600)
    # Rounded for display only.
    return aged.select("event_type", "user_id", F.bround("age_h", 1).alias("age_h"), readers.stale(F.col("age_h"), 24.0).alias("stale"))


@query
def image_listing(spark, sf):
    """Templates and sessions with their calibration flag."""
    templates = t.raw(spark, sf, "nation").select(F.col("n_name").alias("id"))
    sessions = t.raw(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"))
    return readers.list_images(templates, sessions, t.session_sizes(spark, sf).select(F.col("session_id").alias("id")))


# --- reports ---------------------------------------------------------------------------


@query
def confidence_report(spark, sf):
    rows = t.detections(spark, sf).withColumn("turned", F.col("quantity") % 2 == 0)
    return reports.confidence_report(rows, "turned")


@query
def recall_report(spark, sf):
    rows = records(spark, sf, keep=["quantity"])
    return reports.recall_by(
        rows.select((F.col("quantity") % 2 == 0).alias("turned"), F.col("source").isNotNull().alias("found")), "turned"
    )


@query
def version_delta(spark, sf):
    """Detections per session in two versions; the old one needs more confidence."""
    rows = t.detections(spark, sf)
    old = rank.confident(rows, rank.PREDICT_CONFIDENCE).select("session_id", F.lit("v2").alias("version"))
    new = rank.confident(rows).select("session_id", F.lit("v3").alias("version"))
    return reports.version_delta(old.unionByName(new), "v2", "v3")


@query
def training_summary(spark, sf):
    """Best and last epoch; a model is an event type, an epoch an event."""
    log = t.raw(spark, sf, "events").select(
        F.col("event_type").alias("model"), F.col("event_id").alias("epoch"), F.col("value").alias("mAP50"),
        (F.col("event_id") * 2).alias("time"),
    )
    return reports.run_summary(log)


# --- files and streams -----------------------------------------------------------------


@query
def catalog_last_wins(spark, sf):
    """Repeated catalog entries: the line items as price observations, the last one per item."""
    seen = t.line_items(spark, sf).select(
        F.col("pk").cast("string").alias("id"), F.col("unit").alias("basePrice"), F.col("ok").alias("file"), t.detection_index().alias("pos")
    )
    return readers.latest_items(seen, "file", "pos")


def _staged_events(spark, sf):
    """The event log as JSON lines below the shared folder."""
    path = scratch_path(spark, "events")
    writers.append_log(t.link_events(spark, sf), path)
    return path


@query
def event_log_scan(spark, sf):
    """The log written as JSON lines together with broken lines, and read back."""
    path = _staged_events(spark, sf)
    t.raw(spark, sf, "supplier").select(F.concat(F.lit("{broken "), "s_name").alias("value")).write.mode("append").text(path)
    return readers.log_report(readers.read_link_events(spark, path))


@query
def label_files(spark, sf):
    """Label text of the container cells, written per split and scene and read back."""
    spots = spatial.placements(spatial.cell_geometry(t.grids(spark, sf)), 1, 1)
    box = dataset.label_box(
        *[F.col(c) for c in ("x", "y", "cw", "ch", "col", "row")], F.lit(1), F.lit(1), F.lit(t.SCREEN_W), F.lit(t.SCREEN_H)
    )
    placed = spots.select(F.col("scope").alias("scene"), F.col("grid_id").alias("class_idx"), box.alias("b")).select("scene", "class_idx", "b.*")
    path = scratch_path(spark, "labels")
    writers.write_labels(dataset.split_scenes(placed, SEED), path)
    return writers.read_labels(spark, path)


CATALOG = ["item_id", "name", "short", "width", "height", "avg24h", "low", "base"]


@query
def catalog_json_scan(spark, sf):
    """The catalog landed as JSON arrays, a thousand items each, and read back."""
    items = t.catalog(spark, sf).select(
        F.floor(F.col("pos") / 1000).alias("part"), "pos",
        F.struct(
            F.col("item_id").alias("id"), "name", F.col("short").alias("shortName"), "width", "height",
            F.col("avg24h").alias("avg24hPrice"), F.col("low").alias("lastLowPrice"), F.col("base").alias("basePrice"),
        ).alias("item"),
    )
    arrays = items.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("pos", "item"))).alias("rows"))
    content = F.to_json(F.transform("rows", lambda r: r["item"]))
    path = scratch_path(spark, "catalog")
    files.write_files(arrays.select(F.format_string("items-%09d.json", "part").alias("name"), content.alias("content")), path)
    found = readers.read_catalog_arrays(spark, path + "/*/*.json").withColumn("file", F.regexp_extract("file", "[^/]+$", 0))
    return readers.flat_catalog(readers.latest_items(found, "file", "pos")).select(*CATALOG)


@query
def link_map_scan(spark, sf):
    """The matcher's links landed as JSON maps and read back, under an override map that does not exist."""
    links_now = t.auto_links(spark, sf)
    match = F.struct("item_id", "name", "short", "score", "margin")
    # As many maps as it takes to keep each at about a thousand icons.
    maps = -(-max(1, links_now.count()) // 1000)
    parts = links_now.groupBy(F.pmod(F.xxhash64("icon_id"), F.lit(maps)).alias("part")).agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("icon_id", match)))).alias("content")
    )
    path = scratch_path(spark, "links")
    files.write_files(parts.select(F.concat(F.lit("map-"), F.col("part").cast("string"), F.lit(".json")).alias("name"), "content"), path)
    pinned = readers.read_overrides(spark, path + "/missing.json").select("icon_id", F.lit(True).alias("pinned"))
    found = readers.read_auto_links(spark, path + "/*/*.json").join(pinned, "icon_id", "left")
    return found.select("icon_id", "item_id", "name", "short", "score", "margin", F.coalesce("pinned", F.lit(False)).alias("pinned"))


@query
def snapshot_scan(spark, sf):
    """The catalog written as a snapshot and read back."""
    return spark.read.parquet(writers.write_snapshot(t.catalog(spark, sf), "catalog")).select(*CATALOG)


@query
def metrics_csv(spark, sf):
    """Training logs as CSV, one folder per model, and their summary."""
    known = {"epoch": F.col("event_id").cast("int"), "time": F.col("event_id") * 2.0, "metrics/mAP50(B)": F.col("value")}
    log = t.raw(spark, sf, "events").select(
        F.col("event_type").alias("model"), *[known.get(c, F.lit(0.0)).alias(c) for c in METRIC_COLUMNS]
    )
    path = scratch_path(spark, "metrics")
    log.write.partitionBy("model").option("header", True).csv(path)
    logs = readers.read_metrics(spark, path + "/*/*.csv").withColumn("model", F.regexp_replace("model", "^model=", ""))
    return reports.run_summary(logs)


@query
def plain_log_scan(spark, sf):
    """The event log as its writers leave it, without numbers: a few files that are read in many splits."""
    events = t.link_events(spark, sf)
    lines = events.select("seq", F.to_json(F.struct("ts", "icon_id", "item_id", "source", "certainty", "note")).alias("value"))
    path = scratch_path(spark, "log")
    ordered = lines.repartitionByRange("seq").sortWithinPartitions("seq")
    ordered.select(F.explode(F.when(F.col("seq") % 50 == 0, F.array("value", F.lit(""), F.lit("{cut of"))).otherwise(F.array("value")))).write.text(path)
    small = spark.newSession()
    small.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    small.conf.set("spark.sql.files.minPartitionNum", "1")
    # A large log has many such splits; a task takes several of them.
    small.conf.set("spark.sql.files.maxPartitionNum", str(4 * shuffle_width(spark.range(1))))
    return readers.read_plain_log(small, path).select("seq", "icon_id", "item_id", "source")


def _link_stream(spark, sf, runs, **more):
    """Folders of links and state after the event log arrived in parts, each met by a stream that starts anew."""
    events, out, state = (scratch_path(spark, label) for label in ("events", "links", "state"))
    for run in range(runs):
        writers.append_log(t.link_events(spark, sf).where(F.col("seq") % runs == run), events)
        jobs.maintain_links(jobs.stream_events(spark, events), out, state, **more).awaitTermination()
    return out, state


@query
def stream_current_links(spark, sf):
    """Manual links out of the state of a stream that was restarted twice."""
    _, state = _link_stream(spark, sf, 3)
    return jobs.links_in_state(spark, state)


@query
def stream_compacted_links(spark, sf):
    """The same links out of the versions, which the stream compacts as it goes."""
    out, _ = _link_stream(spark, sf, 5, compact_every=2)
    return jobs.current_links(spark, out)


@query
def link_changes(spark, sf):
    """What a reader that has seen the first of three versions still has to read."""
    out, _ = _link_stream(spark, sf, 3)
    return jobs.changes_since(spark, out, 0).select("icon_id", "item_id", "seq", "version")


def _staged_detections(spark, sf):
    path = scratch_path(spark, "detections")
    t.detections(spark, sf).drop("quantity").write.option("compression", "zstd").parquet(path)
    return path


def _landed(spark, rows, label):
    """A table as its snapshot: what every batch or slice reads is computed once."""
    return spark.read.parquet(writers.write_snapshot(rows, label))


BUCKETS = 16


def _layered(spark, sf):
    """Manual links on top of the other layers."""
    auto, flat = t.auto_links(spark, sf), t.overrides(spark, sf)
    return lambda manual: links.project_links(auto, flat, manual.withColumn("source", F.lit("manual")))


def _no_corrections(spark):
    return readers.empty(spark, "icon_id string, item_id string, seq bigint")


@query
def stream_valued_records(spark, sf):
    """Sessions valued as their detections arrive."""
    scans, out, state = _staged_detections(spark, sf), scratch_path(spark, "records"), scratch_path(spark, "state")
    arriving = jobs.stream_detections(spark, scans)
    shown, catalog = _landed(spark, link_map(spark, sf), "links"), _landed(spark, t.catalog(spark, sf), "catalog")
    jobs.value_detections(arriving, lambda: shown, lambda: catalog, out, state, buckets=BUCKETS).awaitTermination()
    return rank.session_summary(jobs.current_records(spark, out))


@query
def stream_split_sessions(spark, sf):
    """Sessions whose detections arrive in several batches."""
    scans, out, state = (scratch_path(spark, label) for label in ("detections", "records", "state"))
    rows = t.detections(spark, sf).drop("quantity")
    shown, catalog = _landed(spark, link_map(spark, sf), "links"), _landed(spark, t.catalog(spark, sf), "catalog")
    # Each part is as many files as its tasks write; every run of the stream takes the new files as one batch.
    for part in range(4):
        rows.where(F.pmod("det_idx", F.lit(4)) == part).write.mode("append").option("compression", "zstd").parquet(scans)
        jobs.value_detections(
            jobs.stream_detections(spark, scans), lambda: shown, lambda: catalog, out, state, buckets=BUCKETS
        ).awaitTermination()
    return rank.session_summary(jobs.current_records(spark, out))


@query
def stream_reprojection(spark, sf):
    """Records without corrections, then a stream of corrections that redoes only the sessions it touches."""
    layered = _layered(spark, sf)
    store, links_out, out, state = (scratch_path(spark, label) for label in ("store", "links", "records", "state"))
    scanned = t.detections(spark, sf).drop("quantity")
    catalog = _landed(spark, t.catalog(spark, sf), "catalog")
    jobs.store_detections(scanned, store, BUCKETS)
    jobs.reproject(spark, store, None, layered(_no_corrections(spark)), catalog, out, 0, "first", buckets=BUCKETS)
    jobs.maintain_records(
        jobs.stream_events(spark, _staged_events(spark, sf)), store, layered, lambda: catalog, links_out, out, state, buckets=BUCKETS
    ).awaitTermination()
    return rank.session_summary(jobs.current_records(spark, out))


@query
def stream_scan_and_correct(spark, sf):
    """Half of each session is scanned, then corrected, then the other half is scanned into the same store."""
    layered = _layered(spark, sf)
    scans, store, links_out, out = (scratch_path(spark, label) for label in ("detections", "store", "links", "records"))
    scanned, corrected = scratch_path(spark, "state"), scratch_path(spark, "state")
    rows, catalog = t.detections(spark, sf).drop("quantity"), _landed(spark, t.catalog(spark, sf), "catalog")

    def scan(part):
        rows.where(F.col("det_idx") % 2 == part).write.mode("append").option("compression", "zstd").parquet(scans)
        jobs.value_detections(
            jobs.stream_detections(spark, scans), lambda: layered(jobs.current_links(spark, links_out)), lambda: catalog,
            out, scanned, store=store, buckets=BUCKETS,
        ).awaitTermination()

    scan(0)
    jobs.maintain_records(
        jobs.stream_events(spark, _staged_events(spark, sf)), store, layered, lambda: catalog, links_out, out, corrected, buckets=BUCKETS,
    ).awaitTermination()
    scan(1)
    return rank.session_summary(jobs.current_records(spark, out))


@query
def stream_price_refresh(spark, sf):
    """A stale catalog is replaced, and the sessions that show or name a repriced item are redone."""
    shown, catalog = _landed(spark, link_map(spark, sf), "links"), _landed(spark, t.catalog(spark, sf), "catalog")
    old = F.when(F.col("pos") % 3 == 0, F.col("avg24h") + 7).otherwise(F.col("avg24h")).cast(catalog.schema["avg24h"].dataType)
    before = catalog.withColumn("avg24h", old)
    store, out = scratch_path(spark, "store"), scratch_path(spark, "records")
    scanned = t.detections(spark, sf).drop("quantity")
    jobs.store_detections(scanned, store, BUCKETS)
    jobs.reproject(spark, store, None, shown, before, out, 0, "first", buckets=BUCKETS)
    age = readers.snapshot_age(spark, scratch_path(spark, "missing"), "2024-01-15 00:00:00")
    jobs.refresh_prices(
        spark, age, before, lambda: catalog, lambda rows: writers.write_snapshot(rows, "catalog"), spark.read.parquet,
        store, shown, out, 0, buckets=BUCKETS,
    )
    return rank.session_summary(jobs.current_records(spark, out))


@query
def stored_session(spark, sf):
    """One session out of a record store; only its bucket is read."""
    out = scratch_path(spark, "records")
    jobs.write_records(records(spark, sf), out, 0, "first", BUCKETS)
    newest = t.session_sizes(spark, sf).agg(F.max("session_id")).first()[0]
    return jobs.sessions(spark, out, [newest] if newest else [], BUCKETS).select(*FLAT)

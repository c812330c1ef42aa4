"""Link layers, fusion and session results on hand-made rows."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slotvalue.operators import dataset, evidence, links, rank, resolve, skew

CATALOG = "item_id string, name string, short string, width int, height int, avg24h bigint, low bigint, vendor bigint, base bigint"
DETECTION = "session_id string, det_idx bigint, icon_id string, box array<int>, det_conf double, ocr_id string, ocr_score double, ocr_raw string"
LINK = "icon_id string, item_id string, score double, margin double, override boolean"
BOX = [0, 0, 64, 64]


def catalog(spark):
    rows = [
        ("a", "Alpha bolt", "Alpha", 1, 1, 100, 50, 0, 10),
        ("b", "Beta ring", "Beta", 2, 1, 900, None, None, 10),
        ("c", "Gamma", None, 0, None, 0, 0, None, None),
    ]
    return spark.createDataFrame(rows, CATALOG)


def resolved(spark, dets, link_rows):
    detections = spark.createDataFrame([("s", i, icon, BOX, 0.9, ocr, score, "raw") for i, (icon, ocr, score) in enumerate(dets)], DETECTION)
    records = resolve.resolve(detections, spark.createDataFrame(link_rows, LINK), catalog(spark))
    return {r.det_idx: r for r in records.collect()}


def test_fusion_rules(spark):
    link_rows = [
        ("1", "a", 26.0, 2.5, False),
        ("2", "a", None, None, True),
        ("3", "gone", 1.0, 9.0, False),
        ("4", "b", 60.0, 0.0, False),
        ("5", "c", 12.0, 5.0, False),
    ]
    dets = [("1", "b", 0.25), ("1", "b", 0.26), ("2", "b", 1.0), ("3", "b", 0.1), ("3", "", 0.0), ("4", "", 0.0), ("5", "c", 0.2), ("4", "gone", 0.9), ("9", None, None)]
    got = resolved(spark, dets, link_rows)
    assert (got[0].id, got[0].source, got[0].certainty) == ("a", "yolo", 0.25)  # tie goes to the visual side
    assert (got[1].id, got[1].source) == ("b", "ocr")
    assert (got[2].id, got[2].source, got[2].certainty) == ("a", "override", 1.0)
    assert (got[3].id, got[3].source, got[3].yolo) == ("b", "ocr", None)  # dangling link
    assert (got[4].id, got[4].source, got[4].certainty) == (None, None, 0.0)
    assert (got[5].id, got[5].source, got[5].certainty) == ("b", "yolo", 0.0)  # certainty 0 is still chosen
    assert (got[6].value, got[6].per_slot, got[6].agree) == (0, 0, True)  # identified without a price
    assert (got[7].source, got[7].ocr.id, got[7].ocr.score) == ("yolo", "", 0.9)
    assert got[8].source is None
    assert (got[0].ocr.width, got[0].yolo.width) == (2, 1)


def test_round_trip_loses_vanished_text_item(spark):
    detections = spark.createDataFrame([("s", 0, "1", BOX, 0.9, "gone", 0.7, "raw")], DETECTION)
    none = spark.createDataFrame([], LINK)
    row = resolve.detections_of(resolve.resolve(detections, none, catalog(spark))).first()
    assert (row.ocr_id, row.ocr_score, row.ocr_raw) == ("", 0.7, "raw")


def test_detections_without_text_are_spread_over_the_join(spark):
    session = spark.newSession()
    for key, value in {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"}.items():
        session.conf.set(key, value)
    ocr = F.element_at(F.array(F.lit(""), F.lit(None).cast("string")), (F.col("id") % 2 + 1).cast("int"))
    rows = session.range(4000).select(
        F.lit("s").alias("session_id"), F.col("id").alias("det_idx"), F.lit("1").alias("icon_id"), F.array(*map(F.lit, BOX)).alias("box"),
        F.lit(0.9).alias("det_conf"), ocr.alias("ocr_id"), F.lit(0.0).alias("ocr_score"), F.lit("").alias("ocr_raw"),
    )
    items = catalog(session).unionByName(session.createDataFrame([("", "Nameless", "", 1, 1, 5, 5, 0, 5)], CATALOG))
    found = resolve.resolve(rows, session.createDataFrame([("1", "a", 12.0, 5.0, False)], LINK), items)
    parts = found.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ocr.id") != "").alias("named")).collect()
    assert sum(r.n for r in parts) == 4000 and sum(r.named for r in parts) == 0
    assert max(r.n for r in parts) < 1000


def layered(spark):
    auto = spark.createDataFrame(
        [("1", "a", 5.0, 4.0), ("2", "b", 6.0, None), ("3", None, None, None), ("4", "d", 1.0, 1.0)],
        "icon_id string, item_id string, score double, margin double",
    )
    flat = spark.createDataFrame([("2", "x"), ("5", "unknown")], "icon_id string, item_id string")
    events = spark.createDataFrame(
        [(1, "1", "m1", "manual"), (2, "1", "m2", "manual"), (3, "1", "v", "visual"), (4, "5", "", "manual"), (0, "2", "late", "manual")],
        "seq bigint, icon_id string, item_id string, source string",
    )
    return auto, flat, events


def test_link_layers(spark):
    got = {r.icon_id: (r.item_id, r.score, r.margin, r.override) for r in links.project_links(*layered(spark)).collect()}
    assert got == {
        "1": ("m2", None, None, True),
        "2": ("late", None, None, True),
        "4": ("d", 1.0, 1.0, False),
        "5": ("unknown", None, None, True),
    }


def test_projection_ignores_row_order(spark):
    auto, flat, events = layered(spark)
    a = links.project_links(auto, flat, events)
    b = links.project_links(auto.orderBy(F.desc("icon_id")), flat, events.orderBy(F.desc("seq")).repartition(5))
    assert sorted(a.collect()) == sorted(b.collect())


def records(spark):
    dets = [("1", "", 0.0)] * 3 + [("2", "", 0.0)] * 2 + [("3", "", 0.0)] + [("9", "", 0.0)]
    rows = [("s", i, icon, BOX, 0.9, o, s, "") for i, (icon, o, s) in enumerate(dets)]
    link_rows = [("1", "a", 12.0, 5.0, False), ("2", "b", 12.0, 5.0, False), ("3", "c", 12.0, 5.0, False)]
    return resolve.resolve(spark.createDataFrame(rows, DETECTION), spark.createDataFrame(link_rows, LINK), catalog(spark))


def test_summary_counts_every_detection(spark):
    row = rank.session_summary(records(spark)).first()
    assert (row.detections, row.identified, row.total, row.by_yolo, row.by_ocr) == (7, 6, 3 * 100 + 2 * 900, 6, 0)


def test_keep_takes_the_larger_half(spark):
    got = {(r.list, r.position): (r.id, r.qty) for r in rank.keep_ditch(records(spark)).collect()}
    assert got == {("keep", 1): ("b", 2), ("keep", 2): ("a", 3), ("ditch", 1): ("c", 1)}


def test_hot_groups_rank_like_small_ones(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 40).cast("string"))).alias("session_id"),
        (F.col("id") * 7919 % 50).alias("per_slot"),
        "id",
    )
    order = [F.col("per_slot").desc(), F.col("id")]
    place = W.partitionBy("session_id").orderBy(*order)
    whole = W.partitionBy("session_id")
    plain = rows.withColumn("rn", F.row_number().over(place)).withColumn("n", F.count(F.lit(1)).over(whole))
    split = skew.rank_within(rows, ["session_id"], order, total="n")
    assert sorted(split.collect()) == sorted(plain.select(split.columns).collect())


def test_sample_is_the_head_of_the_permutation(spark):
    rows = spark.range(500)
    order = {r.id: r.position for r in dataset.shuffled(rows, 3, "id").collect()}
    for n in (0, 1, 77, 500, 900):
        assert {r.id for r in dataset.sample_first(rows, 3, n, "id").collect()} == {i for i, p in order.items() if p < n}


def test_global_index_in_ranges(spark):
    rows = spark.range(1000).select((F.col("id") * 37 % 101).alias("k"), "id")
    got = skew.global_index(rows, [F.col("k").desc(), F.col("id")], "i")
    expected = sorted(((r.k, r.id) for r in rows.collect()), key=lambda x: (-x[0], x[1]))
    assert sorted((r.i, r.k, r.id) for r in got.collect()) == [(i, k, n) for i, (k, n) in enumerate(expected)]


def test_evidence_repeats_do_not_corroborate(spark):
    schema = "seq bigint, icon_id string, item_id string, source string, certainty int"
    events = [
        (1, "1", "a", "visual", 50), (2, "1", "a", "visual", 50), (3, "1", "a", "visual", 50),
        (4, "2", "a", "visual", 50), (5, "2", "a", "hash", 50),
        (6, "3", "a", "visual", 50), (7, "3", "b", "visual", 48),
        (8, "4", "a", "hash", 100), (9, "4", "z", "manual", 100), (10, "4", "y", "manual", 100),
    ]
    got = {r.icon_id: r for r in evidence.fuse(spark.createDataFrame(events, schema)).collect()}
    assert got["1"].score == 0.3
    assert got["2"].score == 0.58
    assert got["3"].conflict and not got["2"].conflict
    assert (got["4"].item_id, got["4"].score, got["4"].conflict) == ("y", 1.0, False)


def test_majority_tie_goes_to_first_name(spark):
    votes = spark.createDataFrame([("1", "b"), ("1", "a"), ("1", "b"), ("1", "a"), ("2", "z")], "icon_id string, name string")
    assert sorted((r.icon_id, r.name, r.votes) for r in evidence.majority(votes).collect()) == [("1", "a", 2), ("2", "z", 1)]


def test_sample_of_more_rows_than_the_table_holds(spark):
    # 20,000 rows over 4,096 ranges: several rows in the last one
    rows = spark.range(20_000)
    for n in (19_999, 20_000, 20_001, 20_003):
        assert dataset.sample_first(rows, 7, n, "id").distinct().count() == min(n, 20_000)


def test_small_sessions_rank_without_a_second_shuffle(spark, monkeypatch):
    session = spark.newSession()
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    rows = records(session)
    sizes = rows.select("session_id")
    by_size = rank.keep_ditch(rows, sizes)
    text = by_size._jdf.queryExecution().executedPlan().toString()
    # The only shuffle by session is the one that brings its records together.
    assert "REPARTITION_BY_COL" in text and text.count("Exchange hashpartitioning(session_id") == 1
    for same in (rank.rank_by_slot, rank.least_certain, rank.keep_ditch):
        ranked = sorted(same(rows, sizes).collect())
        with monkeypatch.context() as m:
            m.setattr(skew, "WHOLE_GROUP", 1)  # every session is a hot one
            assert sorted(same(rows, sizes).collect()) == ranked == sorted(same(rows).collect())


def test_collapse_shuffles_no_copy_of_the_id(spark):
    rows = rank.collapse(records(spark), first_seen=True)
    text = rows._jdf.queryExecution().executedPlan().toString()
    assert " AS key#" not in text and "min_by" not in text
    got = {r.id: (r.qty, r.first_det, r.first.icon_id, list(r.first.box)) for r in rows.collect()}
    assert got == {"a": (3, 0, "1", BOX), "b": (2, 3, "2", BOX), "c": (1, 5, "3", BOX)}

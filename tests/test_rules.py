"""Worked values of the price, certainty, text and geometry rules."""

import random

import pytest
from pyspark.sql import functions as F

from slotvalue.functions import geometry, hashing, pricing, rounding, text


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def lit(value, kind="double"):
    return F.lit(value).cast(kind)


@pytest.mark.parametrize(
    "score, margin, override, expected",
    [
        (12.0, 5.0, False, 1.0),
        (26.0, 2.5, False, 0.25),
        (21.0, 2.4, False, 0.326),
        (40.0, 9.0, False, 0.0),
        (55.0, 9.0, False, 0.0),
        (3.0, None, False, 0.5),
        (None, 3.0, False, 0.5),
        (None, None, True, 1.0),
        (35.1, 4.9, False, 0.171),
    ],
)
def test_link_certainty(spark, score, margin, override, expected):
    assert one(spark, c=pricing.link_certainty(lit(score), lit(margin), F.lit(override))).c == expected


@pytest.mark.parametrize(
    "avg, low, vendor, base, basis, expected",
    [
        (55864, 23000, 0, 100, "avg24h", 55864),
        (55864, 23000, 0, 100, "low", 23000),
        (55864, 23000, 0, 100, "nonsense", 55864),
        (0, 23000, None, None, "avg24h", 23000),
        (55864, None, None, None, "low", 55864),
        (10, 20, 300, 40, "avg24h", 300),
        (10, 20, 30, 400, "low", 400),
        (None, None, None, None, "avg24h", 0),
    ],
)
def test_effective_value(spark, avg, low, vendor, base, basis, expected):
    args = [lit(v, "bigint") for v in (avg, low, vendor, base)]
    assert one(spark, v=pricing.effective_value(*args, basis)).v == expected


def test_best_offer(spark):
    kind = "array<struct<priceRUB:bigint,vendor:struct<name:string>>>"
    given = ['[{"priceRUB":5},{"priceRUB":null},{"priceRUB":9}]', "[]", None]
    rows = spark.createDataFrame([(g,) for g in given], "j string").select(
        pricing.best_offer(F.from_json("j", kind)).alias("v")
    )
    assert [r.v for r in rows.collect()] == [9, 0, 0]


def test_fallback_price_default(spark):
    args = [lit(v, "bigint") for v in (0, None, None)]
    row = one(spark, zero=pricing.fallback_price(*args), none=pricing.fallback_price(*args, default_zero=False))
    assert (row.zero, row.none) == (0, None)


@pytest.mark.parametrize("value, slots, expected", [(5, 2, 2), (7, 2, 4), (10, 4, 2), (100, 3, 33), (0, 6, 0)])
def test_value_per_slot(spark, value, slots, expected):
    assert one(spark, v=pricing.value_per_slot(lit(value, "bigint"), F.lit(slots))).v == expected


def test_round_share_follows_binary_value(spark):
    rng = random.Random(3)
    values = [rng.random() for _ in range(500)] + [i / 2000 for i in range(2001)] + [0.0, 1.0, 0.0005]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(
        "v",
        rounding.round_share(F.col("v"), 3).alias("three"),
        rounding.round_share(F.col("v"), 2).alias("two"),
        rounding.six_decimals(F.col("v")).alias("text"),
    )
    for row in rows.collect():
        assert (row.three, row.two, row.text) == (round(row.v, 3), round(row.v, 2), "%.6f" % row.v)


@pytest.mark.parametrize("px, cells", [(1, 1), (64, 1), (127, 2), (190, 3), (32, 1), (95, 1), (96, 2)])
def test_footprint(spark, px, cells):
    assert one(spark, c=geometry.footprint(F.lit(px))).c == cells


def test_parse_box(spark):
    given = ["1, 2,30,40", "1,2,3", "a,2,3,4", "1,2,3,4,5", "1.5,2,3,4"]
    rows = spark.createDataFrame([(g,) for g in given], "t string").select(geometry.parse_box(F.col("t")).alias("b"))
    assert [r.b for r in rows.collect()] == [[1, 2, 30, 40], None, None, None, None]


def test_minimum_side(spark):
    rows = spark.createDataFrame([([0, 0, 3, 9],), ([0, 0, 4, 4],)], "b array<int>")
    assert [r.b for r in rows.where(geometry.large_enough(F.col("b"))).collect()] == [[0, 0, 4, 4]]


def test_normalise(spark):
    assert one(spark, t=text.normalise(F.lit(" TP  200\t x "))).t == "tp 200 x"


def test_empty_query_finds_nothing(spark):
    assert one(spark, m=text.mentions(F.lit(""), F.lit("abc"))).m is False


@pytest.mark.parametrize(
    "name, model, version",
    [("core-v3", "core", "v3"), ("a-b-c", "a-b", "c"), ("plain", "plain", ""), ("-v1", "-v1", ""), ("open-", "open", "")],
)
def test_model_and_version(spark, name, model, version):
    row = one(spark, s=text.model_and_version(F.lit(name))).s
    assert (row.model, row.version) == (model, version)


def test_label_uses_name_without_short(spark):
    row = one(
        spark,
        a=text.slot_label(F.lit("Short"), F.lit("Name"), F.lit(1234567)),
        b=text.slot_label(F.lit(""), F.lit("Name"), F.lit(12)),
    )
    assert (row.a, row.b) == ("Short 1,234,567/sl", "Name 12/sl")


def test_hashes_against_plain_python(spark):
    rng = random.Random(5)
    vec = [rng.uniform(-9, 9) for _ in range(40)]
    mean = sum(vec) / 40
    row = spark.createDataFrame([(vec,)], "v array<double>").select(
        hashing.average_hash(F.col("v"), 40).alias("a"), hashing.gradient_hash(F.col("v"), 40).alias("g")
    ).first()
    a = sum(1 << i for i, v in enumerate(vec) if v > mean)
    g = sum(1 << i for i in range(39) if vec[i + 1] > vec[i])
    assert row.a[0] + (row.a[1] << 32) == a
    assert row.g[0] + (row.g[1] << 32) == g

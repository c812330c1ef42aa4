"""Points in boxes of all sizes against plain Python."""

import math
import random

import numpy as np
import pytest

from slotvalue.operators import spatial

POINT = "scope int, point bigint, x double, y double"
BOX = "scope int, box bigint, x0 double, y0 double, x1 double, y1 double"


def pairs(spark, points, boxes):
    found = spatial.points_in_boxes(spark.createDataFrame(points, POINT), spark.createDataFrame(boxes, BOX), "scope")
    rows = [(r.point, r.box) for r in found.collect()]
    assert len(rows) == len(set(rows)) and found.columns == ["scope", "point", "x", "y", "box", "x0", "y0", "x1", "y1"]
    return set(rows)


def brute(points, boxes):
    return {
        (p[1], b[1]) for p in points for b in boxes
        if p[0] == b[0] and None not in (*p, *b) and b[2] <= p[2] <= b[4] and b[3] <= p[3] <= b[5]
    }


@pytest.mark.parametrize("crowd", [5, 20_000])
def test_boxes_of_all_sizes(spark, monkeypatch, crowd):
    monkeypatch.setattr(spatial, "CROWD", crowd)
    rng = random.Random(1)
    points, boxes = [], []
    for i in range(300):
        points.append((i % 2, i, rng.choice([rng.uniform(-500, 500), float(rng.randrange(-5, 6)) * 64, rng.uniform(-1e6, 1e6)]), rng.uniform(-500, 500)))
    for i in range(200):
        side = lambda: 10 ** rng.uniform(-1, 6.5) if i % 7 else 64.0 * rng.randrange(3)
        x, y = rng.uniform(-600, 500), rng.choice([rng.uniform(-600, 500), -64.0, 0.0])
        boxes.append((i % 2, i, x, y, x + side(), y + side()))
    boxes += [(0, 900, 5.0, 5.0, 1.0, 9.0), (0, 901, None, 0.0, 5.0, 5.0), (0, 902, -math.inf, -math.inf, math.inf, math.inf), (0, 903, 0.0, 0.0, 0.0, 0.0), (5, 904, 0.0, 0.0, 1.0, 1.0)]
    points += [(0, 900, None, 1.0), (0, 901, 0.0, 0.0), (0, 902, math.nan, 0.0), (0, 903, 1e300, -1e300), (0, 904, math.inf, 0.0)]
    assert pairs(spark, points, boxes) == brute([p for p in points if p[2] is None or not math.isnan(p[2])], boxes)


def test_a_box_touches_four_squares_at_most(spark):
    rng = random.Random(2)
    boxes = [(0, i, x := rng.uniform(-1e6, 1e6), y := rng.uniform(-1e6, 1e6), x + 2 ** rng.uniform(0, 24), y + 2 ** rng.uniform(0, 24)) for i in range(500)]
    boxes += [(0, 1000 + n, 1.0, 1.0, 1.0 + 64 * 2**n, 2.0) for n in range(16)]
    table = spark.createDataFrame(boxes, BOX)
    most = spatial._gridded_boxes(table, 64).groupBy("box").count().agg({"count": "max"}).first()[0]
    assert most <= 4


def test_one_crowded_scope(spark, monkeypatch):
    monkeypatch.setattr(spatial, "CROWD", 2_000)
    rng = np.random.default_rng(3)
    n, m = 100_000, 400
    xs, ys = np.round(rng.uniform(0, 1e6, (2, n)), 2)
    sizes = 10 ** rng.uniform(0, 6, (2, m))
    x0, y0 = rng.uniform(0, 1e6, (2, m)) - sizes / 2
    points = spark.createDataFrame([(0, i, float(xs[i]), float(ys[i])) for i in range(n)], POINT)
    boxes = spark.createDataFrame([(0, i, float(x0[i]), float(y0[i]), float(x0[i] + sizes[0, i]), float(y0[i] + sizes[1, i])) for i in range(m)], BOX)
    got = {r.point: r.box for r in spatial.topmost(points, boxes, "scope", ["point"], "box", "box").collect()}
    want = np.full(n, -1)
    for i in range(m):
        want[(x0[i] <= xs) & (xs <= x0[i] + sizes[0, i]) & (y0[i] <= ys) & (ys <= y0[i] + sizes[1, i])] = i
    assert got == {i: int(b) for i, b in enumerate(want) if b >= 0} and len(got) > 1000


def test_empty_sides(spark):
    assert pairs(spark, [], []) == pairs(spark, [(0, 1, 1.0, 1.0)], []) == pairs(spark, [], [(0, 1, 0.0, 0.0, 1.0, 1.0)]) == set()


def test_few_boxes_meet_their_points_in_two_shuffles(spark, monkeypatch):
    session = spark.newSession()
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    rng = random.Random(4)
    points = [(i % 9, i // 2, float(rng.randrange(40)), float(rng.randrange(40))) for i in range(300)]
    points += [(0, 900, None, 1.0), (0, 901, math.nan, 0.0), (77, 902, 1.0, 1.0), *points[:3]]
    boxes = [(i % 9, i, x := rng.uniform(-5, 40), y := rng.uniform(-5, 40), x + rng.randrange(30), y + rng.randrange(30)) for i in range(60)]
    boxes += [(0, 900, 5.0, 5.0, 1.0, 9.0), (0, 901, None, 0.0, 50.0, 50.0), (1, 902, -math.inf, -math.inf, math.inf, math.inf)]
    boxes.append((2, None, 0.0, 0.0, 50.0, 50.0))
    table = lambda s: (s.createDataFrame(points, POINT), s.createDataFrame(boxes, BOX))
    top = spatial.topmost(*table(session), "scope", ["point"], "box", "box")
    assert top._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    got = sorted(map(str, top.collect()))
    monkeypatch.setattr(spatial, "FEW", 0)
    assert got == sorted(map(str, spatial.topmost(*table(session), "scope", ["point"], "box", "box").collect())) and len(got) > 100

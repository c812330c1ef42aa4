"""Hard negatives against plain Python."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from slotvalue.llm import negatives

ROW = "vec_id bigint, label bigint, vector array<double>, h1 string, vec string, ids string, row string"


def brute(rows, anchor, positives=5, n=3, low=50, high=95):
    used = sorted({(i, y, tuple(v)) for i, y, v in rows if None not in (i, y, v) and all(x is not None and math.isfinite(x) for x in v)}, key=str)
    out = []
    for i, y, u in used:
        if not anchor(i):
            continue
        scored = [(sum(int(a) * int(b) for a, b in zip(u, v, strict=True)), j, z) for j, z, v in used if j != i and len(v) == len(u)]
        scored = sorted((-max(negatives.LEAST, min(negatives.MOST, s)), j, z) for s, j, z in scored)
        for p, j, z in [x for x in scored if x[2] == y][:positives]:
            fits = [(k, s) for s, k, x in scored if x != y and low * -p <= 100 * -s <= high * -p][:n]
            out += [(i, j, r + 1, k, -p, -s) for r, (k, s) in enumerate(fits)]
    return sorted(out)


def mined(spark, rows, modulus=4, **more):
    table = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], ROW).repartition(3)
    return sorted(map(tuple, negatives.hard_negatives(table, F.col("vec_id") % modulus == 0, **more).collect()))


def labelled(rng, n, width, labels=3, most=9, first=0):
    return [(first + i, rng.randrange(labels), [float(rng.randrange(-2, most)) for _ in range(width)]) for i in range(n)]


@pytest.mark.parametrize("block", [16, 8192])
def test_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(negatives, "FIRST_BLOCK", block)
    monkeypatch.setattr(negatives, "GROWTH", 2)
    rng = random.Random(3)
    rows = labelled(rng, 160, 6) + labelled(rng, 40, 3, first=300)
    rows += [(500 + i, 1, [3.0, 1.0, 0.0, 2.0, 0.0, 1.0]) for i in range(30)]  # one common vector
    rows += [(540 + i, i % 2, [0.0] * 6) for i in range(20)] + [(560 + i, i % 2, []) for i in range(9)]
    rows += [(600, None, [1.0] * 6), (604, 1, None), (608, 1, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (612, 1, [math.nan] * 6), (616, 2, [math.inf] + [0.0] * 5), (None, 1, [1.0] * 6)]
    rows += [rows[0], rows[0], rows[7], (4, 2, [5.0, 5.0, 5.0, 5.0, 5.0, 5.0]), (700, 9, [1.0] * 6)]
    got = mined(spark, rows)
    assert got == brute(rows, lambda i: i % 4 == 0) and len(got) > 300


def test_clustered_vectors_end_their_walk_early(spark, monkeypatch):
    monkeypatch.setattr(negatives, "FIRST_BLOCK", 64)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16)) * 60
    rows = [(i, int(rng.integers(4)), np.floor(centres[i % 12] + rng.normal(size=16)).tolist()) for i in range(600)]
    walked = []
    inner = negatives._tiles
    monkeypatch.setattr(negatives, "_tiles", lambda lists, block, todo, salts: walked.append((block, len(todo))) or inner(lists, block, todo, salts))
    assert mined(spark, rows, 20, low=10, high=99) == brute(rows, lambda i: i % 20 == 0, low=10, high=99)
    assert max(b for b, _ in walked) < 3


def test_components_beyond_doubles_are_exact(spark):
    rng = random.Random(8)
    rows = [(i, i % 2, [float(2**rng.randrange(40)) * rng.randrange(-3, 9), float(rng.randrange(2**30)), 3.0]) for i in range(40)]
    rows += [(50 + i, i % 2, [3e38, 1.0, -1e30 * i]) for i in range(4)]
    assert mined(spark, rows) == brute(rows, lambda i: i % 4 == 0)


def test_scaling_rounds_down(spark):
    values = [0.1, -0.1, -0.0, 1e300, math.inf, None, 0.5 / 256, -0.5 / 256]
    got = spark.createDataFrame([(values,)], "v array<double>").select(negatives.scaled_floor("v", 256)).first()[0]
    assert got == [25.0, -26.0, 0.0, 256e300, math.inf, None, 0.0, -1.0]
    assert math.isnan(spark.createDataFrame([([math.nan],)], "v array<double>").select(negatives.scaled_floor("v", 256)).first()[0][0])


def test_tables_without_anchors_or_negatives(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, 1, [1.0]), (2, 1, [2.0])]) == []
    assert mined(spark, [(4, 1, [1.0])]) == []
    assert mined(spark, [(4, 1, [2.0]), (5, 1, [2.0]), (6, 2, [1.0])]) == [(4, 5, 1, 6, 4, 2)]


def test_bounds_hold():
    rng = np.random.default_rng(2)
    members, candidates = np.floor(rng.normal(size=(40, 8)) * 50), np.floor(rng.normal(size=(300, 8)) * 50)
    centroids = negatives.fit_centroids(members, 5)
    angle = negatives.angles(members, centroids)
    cluster = angle.argmin(axis=1)
    radius = np.array([angle[cluster == c, c].max(initial=0.0) for c in range(5)])
    norm = np.linalg.norm(candidates, axis=1)
    lists = negatives.Lists(centroids, radius, float(norm.max()))
    bound = lists.bounds(candidates, norm)
    best = np.linalg.norm(members, axis=1)[:, None] * bound.T[cluster]
    assert (members @ candidates.T <= best + 1e-6).all()
    assert (bound <= lists.ceiling(lists.bins(bound))).all()


def test_blocks_cover_every_bin():
    counts = np.array([[5, 0, 8192, 1, 70_000, 3], [1, 1, 1, 1, 1, 1]])
    assert negatives._cut(counts).tolist() == [[0, 0, 0, 1, 1, 2], [0] * 6]


def test_compact_vectors_keep_their_values():
    for most in (100.0, 40_000.0, 3e12):
        column = pa.array([[most, -1.0], [], [0.0]], pa.list_(pa.float64()))
        assert negatives.matrix(negatives._compact(column))[0].tolist() == [[most, -1.0], [0.0, 0.0], [0.0, 0.0]]

"""Nearest catalog images of an icon within its footprint."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from slotvalue.functions.pricing import MARGIN_FULL
from slotvalue.operators.packs import map_met, matrix, pack, unpack
from slotvalue.operators.skew import rank_within, shuffle_width, top_per_group
from slotvalue.runtime import scratch_path

# Alpha above this belongs to the icon, matches reported per icon.
ALPHA_FLOOR = 16
BEST = 3

# Candidates of a tile and cells that an image is cut into for bounds.
TILE_ROWS = 512
CELLS = 16
# Queries and tile summaries that meet at once.
PACK_ROWS = 256
# Centres that order the candidates, at most, and the sample and rounds they are fitted with.
MAX_PIVOTS = 512
PIVOT_SAMPLE = 4096
PIVOT_ROUNDS = 6
# Bits of a coarse mean in the order of the candidates, and means in it.
ORDER_BITS = 5
ORDER_MEANS = 4

_OUT = "icon_id bigint, item_id bigint, distance double"
_VISIT = "icon_id bigint, tile bigint, bound double"
_TILE = "block {block}, n int, tile bigint, data binary, summary binary"


def block_counts(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("block").agg(F.count(F.lit(1)).alias("candidates"))


# --- tiles -----------------------------------------------------------------------------


def _coarse(vec: str) -> list[Column]:
    """Means of a few equal parts of a vector."""
    n = F.size(vec)
    step = F.greatest(F.lit(1), F.ceil(n / ORDER_MEANS).cast("int"))

    def mean(i: int) -> Column:
        part = F.slice(vec, F.lit(1) + step * i, step)
        return F.coalesce(F.try_divide(F.aggregate(part, F.lit(0.0), lambda s, x: s + x), F.size(part)), F.lit(0.0))

    return [mean(i) for i in range(ORDER_MEANS)]


def _interleaved(levels: list[Column]) -> Column:
    """Bits of small whole numbers, the highest ones of all first: neighbours in this order are alike."""
    code = F.lit(0).cast("bigint")
    for bit in reversed(range(ORDER_BITS)):
        for level in levels:
            code = F.shiftleft(code, 1).bitwiseOR(F.shiftright(level, bit).bitwiseAND(F.lit(1)))
    return code


def _pivots(candidates: DataFrame) -> dict[int, np.ndarray]:
    """Centres of candidates of each shape, by k-means on a bounded sample; they only steer which candidates lie together."""
    share = min(MAX_PIVOTS, -(-candidates.count() // TILE_ROWS))
    sample = candidates.select("n", "vec").orderBy(F.xxhash64("item_id"), "item_id").limit(PIVOT_SAMPLE).collect()
    found = {}
    for n in {r["n"] for r in sample}:
        x = np.array([r["vec"] for r in sample if r["n"] == n]).reshape(-1, n)
        centres = x[: max(1, round(share * len(x) / len(sample)))]
        for _ in range(PIVOT_ROUNDS):
            own = _distances(x, centres).argmin(axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, own, x)
            size = np.bincount(own, minlength=len(centres))[:, None]
            centres = np.where(size > 0, sums / np.maximum(size, 1), centres)
        found[n] = centres[_chained(centres)]
    return found


def _chained(centres: np.ndarray) -> list[int]:
    """An order in which each centre is followed by the nearest one that is left."""
    apart, order = _distances(centres, centres), [0]
    left = np.ones(len(centres), bool)
    left[0] = False
    while left.any():
        order.append(int(np.where(left, apart[order[-1]], np.inf).argmin()))
        left[order[-1]] = False
    return order


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x**2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres**2).sum(axis=1)


def _nearest_pivot(pivots: dict[int, np.ndarray]):
    @F.pandas_udf(T.IntegerType())
    def nearest_pivot(vec: pd.Series) -> pd.Series:
        out = np.zeros(len(vec), np.int32)
        sizes = vec.map(len).to_numpy()
        for n, centres in pivots.items():
            rows = np.flatnonzero(sizes == n)
            for a in range(0, len(rows) if n else 0, PACK_ROWS):
                some = rows[a : a + PACK_ROWS]
                out[some] = _distances(np.stack(vec.iloc[some].to_numpy()), centres).argmin(axis=1)
        return pd.Series(out)

    return nearest_pivot


def _tiled(candidates: DataFrame) -> DataFrame:
    """Candidates ``(block, n, tile, item_id, vec)`` in tiles of ``TILE_ROWS`` that look alike.

    Within a block and shape they are ordered by the nearest of a few pivots, then by interleaved coarse means;
    ``rank_within`` keeps that balanced when one block holds most of the rows.
    """
    sized = candidates.withColumn("n", F.size("vec"))
    means = sized.select("*", *[m.alias(f"_m{i}") for i, m in enumerate(_coarse("vec"))])
    low, high = means.agg(
        F.min(F.least(*[f"_m{i}" for i in range(ORDER_MEANS)])), F.max(F.greatest(*[f"_m{i}" for i in range(ORDER_MEANS)]))
    ).first()
    width = ((high or 0.0) - (low or 0.0)) or 1.0
    level = lambda m: F.least(F.floor((F.col(m) - F.lit(low or 0.0)) / width * (1 << ORDER_BITS)), F.lit((1 << ORDER_BITS) - 1))
    coded = means.select(
        "block", "n", "item_id", "vec", _interleaved([level(f"_m{i}") for i in range(ORDER_MEANS)]).alias("_code"),
        _nearest_pivot(_pivots(sized))("vec").alias("_pivot"),
    )
    ranked = rank_within(coded, ["block", "n"], [F.col("_pivot"), F.col("_code"), F.col("item_id")], "_place")
    return ranked.select("block", "n", F.floor((F.col("_place") - 1) / TILE_ROWS).alias("tile"), "item_id", "vec")


def _cells(width: int) -> list[slice]:
    step = max(1, -(-width // CELLS))
    return [slice(a, a + step) for a in range(0, width, step)]


def _summarised(table: pa.Table, schema: pa.Schema) -> pa.Table:
    """A tile as one row: its packed candidates and what bounds their distance to any query."""
    block, n, tile = (table.column(c)[0].as_py() for c in ("block", "n", "tile"))
    batch = table.select(["item_id", "vec"]).combine_chunks().to_batches()[0]
    grid = matrix(batch.column("vec"))
    centre = grid.mean(axis=0)
    means = np.array([grid[:, c].mean(axis=1) for c in _cells(n)])
    summary = {
        "tile": [tile], "low": [grid.min(axis=0)], "high": [grid.max(axis=0)], "centre": [centre],
        "radius": [np.sqrt(((grid - centre) ** 2).sum(axis=1).max(initial=0.0))],
        "mean_low": [means.min(axis=1) if n else []], "mean_high": [means.max(axis=1) if n else []],
    }
    rows = {"block": [block], "n": [n], "tile": [tile], "data": [pack(batch)], "summary": [pack(pa.RecordBatch.from_pydict(summary))]}
    return pa.table(rows, schema=schema)


def tile_bounds(vecs: np.ndarray, mask: np.ndarray, summaries: Sequence[pa.RecordBatch]) -> np.ndarray:
    """(query, tile): no candidate of the tile is nearer to the query, as a squared distance under its mask.

    Where a cell is opaque, the squared difference of means times its size bounds the distance (Cauchy-Schwarz); where
    it is masked in part, every opaque value differs at least by its distance from the range of the tile.  Over
    the whole image, the centre is at most a radius away from any candidate, mask or not.
    """
    out = np.zeros((len(vecs), len(summaries)))
    cells = _cells(vecs.shape[1])
    means = np.array([vecs[:, c].mean(axis=1) for c in cells]).T
    opaque = np.array([mask[:, c].all(axis=1) for c in cells]).T
    sizes = np.array([vecs[:, c].shape[1] for c in cells])
    for t, s in enumerate(summaries):
        row = {name: np.asarray(s.column(name)[0].as_py()) for name in ("low", "high", "centre", "radius", "mean_low", "mean_high")}
        off = np.maximum(0.0, np.maximum(row["low"] - vecs, vecs - row["high"])) ** 2 * mask
        cell = np.array([off[:, c].sum(axis=1) for c in cells]).T
        by_mean = np.maximum(0.0, np.maximum(row["mean_low"] - means, means - row["mean_high"])) ** 2 * sizes
        box = np.where(opaque, np.maximum(cell, by_mean), cell).sum(axis=1)
        ball = np.maximum(0.0, np.sqrt((((vecs - row["centre"]) ** 2) * mask).sum(axis=1)) - row["radius"]) ** 2
        out[:, t] = np.maximum(box, ball)
    return out


# --- search ----------------------------------------------------------------------------


def _opaque(alpha: pa.Array) -> np.ndarray:
    return (matrix(alpha) > ALPHA_FLOOR).astype(float)


def _summaries(data: list[bytes]) -> tuple[list[pa.RecordBatch], np.ndarray]:
    found = [unpack(x) for x in data]
    return found, np.array([s.column("tile")[0].as_py() for s in found])


def _visits(first: bool):
    """Tiles that queries have to visit: the one with the lowest bound, or all others that can hold a better candidate."""

    def run(queries: pa.RecordBatch, met: tuple[list[pa.RecordBatch], np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
        summaries, numbers = met
        mask = _opaque(queries.column("alpha"))
        bound = tile_bounds(matrix(queries.column("vec")), mask, summaries) / mask.sum(axis=1)[:, None]
        if first:
            at = (np.arange(len(bound)), bound.argmin(axis=1))
        else:
            kth = queries.column("kth").to_numpy(zero_copy_only=False)[:, None]
            seen = queries.column("tile").to_numpy(zero_copy_only=False)[:, None]
            at = np.nonzero((bound * (1 - 1e-9) <= kth**2) & (numbers != seen))
        icons = queries.column("icon_id").to_numpy(zero_copy_only=False)[at[0]]
        return pa.RecordBatch.from_arrays([pa.array(icons), pa.array(numbers[at[1]]), pa.array(bound[at])], schema=schema)

    return run


def _candidates(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and ids of a tile."""
    tile = unpack(data[0])
    return matrix(tile.column("vec")), tile.column("item_id").to_numpy()


def _best_in_tile(k: int):
    def run(queries: pa.RecordBatch, tile: tuple[np.ndarray, np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
        rows = _scored(queries, *tile, k)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 3, schema, strict=True)], schema=schema)

    return run


def _scored(asked: pa.RecordBatch, grid: np.ndarray, ids: np.ndarray, k: int) -> list[tuple]:
    """``(icon, item, distance)`` of the best ``k`` candidates of a tile for a few queries."""
    rows = []
    vecs, mask = matrix(asked.column("vec")), _opaque(asked.column("alpha"))
    masked = vecs * mask
    # Matrix products give every distance up to rounding; close calls are settled below.
    rough = (masked * vecs).sum(1)[:, None] - 2 * masked @ grid.T + mask @ (grid**2).T
    slack = 1e-9 * (1 + np.abs(rough).max())
    cut = np.partition(rough, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1] + slack
    for i, icon in enumerate(asked.column("icon_id").to_pylist()):
        near = np.flatnonzero(rough[i] <= cut[i])
        exact = np.sqrt((((grid[near] - vecs[i]) * mask[i]) ** 2).sum(1) / mask[i].sum())
        for j in np.lexsort((ids[near], exact))[:k]:
            rows.append((icon, ids[near[j]], exact[j]))
    return rows


def _written(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def build_tiles(candidates: DataFrame, k: int = BEST) -> DataFrame:
    """``(block, n, tile, data, summary)``, written once.

    Copies of one image beyond the ``k`` with the smallest ids cannot appear in a result and are
    dropped first.
    """
    keyed = candidates.select("item_id", "block", F.col("vec").cast("array<double>").alias("vec"))
    keyed = keyed.withColumn("_digest", F.sha2(F.col("vec").cast("string"), 256))
    kept = top_per_group(keyed, ["block", "_digest"], [F.col("item_id")], k, "_copy").drop("_copy", "_digest")
    schema = T.StructType.fromDDL(_TILE.format(block=keyed.schema["block"].dataType.simpleString()))
    arrow = to_arrow_schema(schema)
    tiles = _tiled(kept).groupBy("block", "n", "tile").applyInArrow(lambda table: _summarised(table, arrow), schema)
    return _written(tiles, "tiles")


def tile_visits(queries: DataFrame, tiles: DataFrame, k: int = BEST) -> tuple[DataFrame, DataFrame]:
    """``(visits, found)``: the tiles each query has to meet, and its best ``k`` candidates in them.

    Every query first meets the tile with the lowest bound, which fixes a distance for its ``k``-th candidate, and then
    only those whose bound does not exceed it.
    """
    asked = queries.select("icon_id", "block", F.col("vec").cast("array<double>").alias("vec"), F.col("alpha").cast("array<double>").alias("alpha"))
    asked = asked.withColumn("n", F.size("vec")).where(F.exists("alpha", lambda a: a > ALPHA_FLOOR) & (F.size("alpha") == F.col("n")))
    asked = asked.where(F.col("block").isNotNull())
    key = ["block", "n"]
    # A chunk of the tiles of a block meets a part of its queries, so a hot block is spread over all tasks.
    parts = shuffle_width(tiles)
    chunk = F.floor(F.col("tile") / PACK_ROWS)
    summaries = tiles.select(*key, chunk.alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.col("summary").alias("data"))
    chunks = tiles.groupBy(*key).agg(F.max(chunk).alias("last"))
    one = not chunks.agg(F.max("last")).first()[0]

    def met(df: DataFrame, first: bool) -> DataFrame:
        dealt = df.withColumn("part", F.pmod(F.hash("icon_id"), F.lit(parts)))
        if one:
            dealt = dealt.withColumn("chunk", F.lit(0).cast("bigint"))
        else:
            dealt = dealt.join(chunks, key).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), "last"))).drop("last")
        return map_met(dealt, summaries, [*key, "chunk", "part"], PACK_ROWS, _summaries, _visits(first), _VISIT)

    def best(visits: DataFrame) -> DataFrame:
        there = visits.select("icon_id", "tile").join(asked, "icon_id")
        return map_met(there, tiles.select(*key, "tile", "data"), [*key, "tile"], PACK_ROWS, _candidates, _best_in_tile(k), _OUT)

    start = _written(met(asked, True).groupBy("icon_id").agg(F.min(F.struct("bound", "tile")).alias("v")).select("icon_id", "v.tile", "v.bound"), "visits")
    near = _written(best(start), "near")
    kth = near.groupBy("icon_id").agg(F.when(F.count("*") == k, F.max("distance")).alias("kth"))
    open_ = asked.join(start.select("icon_id", "tile"), "icon_id").join(kth, "icon_id", "left")
    more = _written(met(open_.withColumn("kth", F.coalesce("kth", F.lit(math.inf))), False), "visits")
    return start.unionByName(more), near.unionByName(best(more))


def nearest(queries: DataFrame, candidates: DataFrame, k: int = BEST) -> DataFrame:
    """The ``k`` nearest candidates of each query in the same block, by masked RMS distance.

    ``queries``: ``icon_id, block, vec, alpha``; ``candidates``: ``item_id, block, vec``.  The mask comes from the
    query, so no metric index applies; tiles of similar candidates are skipped by bounds that hold for any
    mask (``tile_bounds``).  Exact: only tiles that cannot hold one of the ``k`` are left out.
    """
    _, found = tile_visits(queries, build_tiles(candidates, k), k)
    return top_per_group(found, ["icon_id"], [F.col("distance"), F.col("item_id")], k, "rank")


def match_table(queries: DataFrame, candidates: DataFrame, names: DataFrame, k: int = BEST) -> DataFrame:
    """One row per icon: best item, rounded score, margin to the second, names of the rest.

    Icons without a candidate keep a row with null match columns.
    """
    ranked = nearest(queries, candidates, k).join(names, "item_id", "left")

    def at(rank, col):
        return F.max(F.when(F.col("rank") == rank, F.col(col)))

    # At most k rows per icon reach this aggregation.
    rest = F.collect_list(F.when(F.col("rank") > 1, F.struct("rank", "name")))
    best = ranked.groupBy("icon_id").agg(
        at(1, "item_id").alias("item_id"),
        at(1, "name").alias("name"),
        F.bround(at(1, "distance"), 1).alias("score"),
        F.bround(at(2, "distance") - at(1, "distance"), 1).alias("margin"),
        F.transform(F.array_sort(rest), lambda r: r["name"]).alias("alts"),
    )
    return queries.select("icon_id", "block").join(best, "icon_id", "left")


def near_ties(matches: DataFrame, threshold: float = MARGIN_FULL) -> DataFrame:
    return matches.where(F.col("margin") < threshold)


def match_quality(matches: DataFrame, threshold: float = MARGIN_FULL) -> DataFrame:
    """Median and 90th percentile of score, median margin, share of near ties.

    Scores and margins have one decimal; they are counted per distinct value first, and the
    exact percentiles are taken over those few weighted values.
    """
    counted = matches.where(F.col("score").isNotNull()).groupBy("score", "margin").agg(
        F.count(F.lit(1)).alias("n")
    )
    with_margin = F.when(F.col("margin").isNotNull(), F.col("n")).otherwise(0)
    return counted.agg(
        F.sum("n").alias("icons"),
        F.bround(F.percentile("score", 0.5, F.col("n")), 4).alias("score_median"),
        F.bround(F.percentile("score", 0.9, F.col("n")), 4).alias("score_p90"),
        F.bround(F.percentile("margin", 0.5, with_margin), 4).alias("margin_median"),
        F.coalesce(F.sum(F.when(F.col("margin") < threshold, F.col("n"))), F.lit(0)).alias("near_ties"),
    )

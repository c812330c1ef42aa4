"""Points in boxes and cells of containers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotvalue.runtime import checkpoint

# Side of the smallest grid squares; those of level n are 2**n times as wide.
SQUARE = 64
# Coordinates beyond this share the outermost squares.
FAR = float(1 << 50)
# Boxes and points of a square that meet in one task; more are split by a hash.
CROWD = 20_000
# Boxes of a scope that are simply tried one after the other.
FEW = 64


def _limited(col: str) -> Column:
    return F.greatest(F.least(F.col(col).cast("double"), F.lit(FAR)), F.lit(-FAR))


def _square(col: Column, level: Column, square: int) -> Column:
    return F.floor(col / (F.pow(F.lit(2.0), level) * square))


def _level(square: int) -> Column:
    """The level whose squares are at least twice as wide as the longer side of a box, so that most boxes touch one or two."""
    longer = F.greatest(_limited("x1") - _limited("x0"), _limited("y1") - _limited("y0"))
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(longer, F.lit(1.0)) * 2 / square)).cast("int"))


def _proper(boxes: DataFrame) -> DataFrame:
    return boxes.where((F.col("x0") <= F.col("x1")) & (F.col("y0") <= F.col("y1")))


def _gridded_boxes(boxes: DataFrame, square: int) -> DataFrame:
    """Boxes once for each square they touch on their level: four at most."""
    placed = _proper(boxes).withColumn("_level", _level(square))

    def span(low, high):
        return F.explode(F.sequence(*[_square(_limited(c), F.col("_level"), square) for c in (low, high)]))

    return placed.withColumn("_sx", span("x0", "x1")).withColumn("_sy", span("y0", "y1"))


def _gridded_points(points: DataFrame, levels: list[int], square: int) -> DataFrame:
    """Points once for each level that holds boxes: each probes one square of it."""
    placed = points.where(~F.isnan("x") & ~F.isnan("y")).withColumn("_level", F.explode(F.array(*map(F.lit, levels))))
    return placed.withColumn("_sx", _square(_limited("x"), F.col("_level"), square)).withColumn(
        "_sy", _square(_limited("y"), F.col("_level"), square)
    )


def _crowded(points: DataFrame, boxes: DataFrame, place: list[str]) -> DataFrame:
    """``(*place, _points, _boxes)``: into how many parts the rows of a crowded square are dealt."""
    count = lambda df, name: df.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / CROWD).cast("int").alias(name))
    return count(points, "_points").join(count(boxes, "_boxes"), place).where((F.col("_points") > 1) | (F.col("_boxes") > 1))


def _survey(points: DataFrame, boxes: DataFrame, scope: str, square: int) -> tuple[list[int], bool]:
    """Levels in use, and whether any scope has more rows of one side than a task should get; one small aggregation."""
    levels, most, _ = _sizes(points, boxes, scope, square)
    return levels, most > CROWD


def _sizes(points: DataFrame, boxes: DataFrame, scope: str, square: int) -> tuple[list[int], int, int]:
    """Levels in use, the most rows of one side in a scope, and the most boxes in a scope."""
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), _level(square))
    rows = _proper(boxes).select(F.col(scope).alias("scope"), F.lit(0).alias("side"), bit.alias("bit"))
    rows = rows.unionByName(points.select(F.col(scope).alias("scope"), F.lit(1).alias("side"), F.lit(0).cast("bigint").alias("bit")))
    scopes = rows.groupBy("scope", "side").agg(F.count(F.lit(1)).alias("n"), F.bit_or("bit").alias("bits"))
    most, drawn, bits = scopes.agg(F.max("n"), F.max(F.when(F.col("side") == 0, F.col("n"))), F.bit_or("bits")).first()
    return [i for i in range(63) if (bits or 0) >> i & 1] or [0], most or 0, drawn or 0


def points_in_boxes(
    points: DataFrame, boxes: DataFrame, scope: str, square: int = SQUARE
) -> DataFrame:
    """Every (point, box) with the point inside or on the edge, within one scope.

    ``points``: scope, ``x, y`` and own columns; ``boxes``: scope, ``x0, y0, x1, y1`` and own
    columns; coordinates are whole or fractional, of any size.  The grid has levels: a box lies on the one whose
    squares are wider than the box, so it touches four at most, and a point looks into one square of
    every level in use.  Both sides meet in an equi join on (scope, level, square) with the exact test behind it.
    Where a scope has many rows, those of its crowded squares are dealt into parts by a hash, and every
    part of one side meets every part of the other, so no task gets them all.  Boxes with a side below zero, and
    points or sides that are null or no number, match nothing.
    """
    return _met(points, boxes, scope, square, *_survey(points, boxes, scope, square))


def _met(points: DataFrame, boxes: DataFrame, scope: str, square: int, levels: list[int], crowded: bool) -> DataFrame:
    place = [scope, "_level", "_sx", "_sy"]
    gridded, placed = _gridded_boxes(boxes, square), _gridded_points(points, levels, square)
    if crowded:
        # Written, since the rows of each square are counted before they are dealt.
        gridded, placed = checkpoint(gridded), checkpoint(placed)
        crowds = _crowded(placed, gridded, place)
        every = lambda parts: F.explode(F.sequence(F.lit(0), F.coalesce(parts, F.lit(1)) - 1))
        own = lambda parts, df: F.pmod(F.xxhash64(*df.columns), F.coalesce(parts, F.lit(1))).cast("int")
        p, b = F.col("_points"), F.col("_boxes")
        placed = placed.join(crowds, place, "left").withColumn("_p", own(p, points)).withColumn("_b", every(b)).drop("_points", "_boxes")
        gridded = gridded.join(crowds, place, "left").withColumn("_b", own(b, boxes)).withColumn("_p", every(p)).drop("_points", "_boxes")
        place = [*place, "_p", "_b"]
    inside = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    return placed.join(gridded, place).where(inside).drop("_level", "_sx", "_sy", "_p", "_b")


def topmost(
    points: DataFrame, boxes: DataFrame, scope: str, point: list[str], box: str, z: str, square: int = SQUARE
) -> DataFrame:
    """For each point the containing box that was drawn last.

    Equal rectangles are reduced to their topmost box and equal positions to one before
    they meet.  Where every scope has few boxes and no crowd of points, its boxes travel as one list that each of its
    points tries, so either side is shuffled once.
    """
    sides = ["x0", "y0", "x1", "y1"]
    levels, most, drawn = _sizes(points, boxes, scope, square)
    if drawn <= FEW and most <= CROWD:
        return _tried(points, boxes, scope, point, box, z)
    shown = boxes.groupBy(scope, *sides).agg(F.max_by(box, z).alias("_box"), F.max(z).alias("_z"))
    spots = points.select(scope, "x", "y").distinct()
    found = _met(spots, shown, scope, square, levels, most > CROWD)
    top = found.groupBy(scope, "x", "y").agg(F.max_by("_box", "_z").alias(box))
    return points.join(top, [scope, "x", "y"]).select(scope, *point, box)


def _tried(points: DataFrame, boxes: DataFrame, scope: str, point: list[str], box: str, z: str) -> DataFrame:
    """``topmost`` for scopes of few boxes."""
    listed = F.struct(F.col(z).alias("z"), F.col(box).alias("box"), "x0", "y0", "x1", "y1")
    shown = _proper(boxes).groupBy(scope).agg(F.collect_list(listed).alias("_shown"))
    over = lambda b: F.col("x").between(b["x0"], b["x1"]) & F.col("y").between(b["y0"], b["y1"])
    met = points.where(~F.isnan("x") & ~F.isnan("y")).join(shown, scope).withColumn("_hits", F.filter("_shown", over)).where(F.size("_hits") > 0)
    drawn = F.filter("_hits", lambda b: b["z"].isNotNull())
    top = F.array_max(F.transform(drawn, lambda b: F.struct(b["z"].alias("z"), b["box"].alias("box"))))
    return met.select(scope, *point, top["box"].alias(box))


def cell_geometry(grids: DataFrame) -> DataFrame:
    cols, rows = F.coalesce("cols", F.lit(1)), F.coalesce("rows", F.lit(1))
    return grids.withColumns({"cols": cols, "rows": rows}).withColumns(
        {"cw": F.col("w") / cols, "ch": F.col("h") / rows}
    )


def placements(grids: DataFrame, footprint_w: int, footprint_h: int) -> DataFrame:
    """Every top-left cell of a container where a footprint fits."""
    fits = grids.where((F.col("cols") >= footprint_w) & (F.col("rows") >= footprint_h))
    return fits.withColumn("col", F.explode(F.sequence(F.lit(0), F.col("cols") - footprint_w))).withColumn(
        "row", F.explode(F.sequence(F.lit(0), F.col("rows") - footprint_h))
    )

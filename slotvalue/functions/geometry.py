"""Box and footprint expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pixel pitch of one slot, footprint limits, smallest box side,
# share of a box that holds the printed name.
SLOT_PX = 63
MAX_CELLS_W = 10
MAX_CELLS_H = 16
MIN_SIDE = 4
TOP_STRIP = 0.45


def footprint(px: Column) -> Column:
    return F.greatest(F.lit(1), F.bround((px - 1) / SLOT_PX).cast("int"))


def footprint_allowed(cells_w: Column, cells_h: Column) -> Column:
    return cells_w.between(1, MAX_CELLS_W) & cells_h.between(1, MAX_CELLS_H)


def ordered_box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.array(F.least(x0, x1), F.least(y0, y1), F.greatest(x0, x1), F.greatest(y0, y1))


def parse_box(text: Column) -> Column:
    """``"x0,y0,x1,y1"`` as integers; null if a part is not an integer or the count is wrong."""
    parts = F.transform(F.split(text, ","), lambda part: F.trim(part).try_cast("int"))
    whole = (F.size(parts) == 4) & F.forall(parts, lambda part: part.isNotNull())
    return F.when(whole, parts)


def large_enough(box: Column, side: int = MIN_SIDE) -> Column:
    return (box[2] - box[0] >= side) & (box[3] - box[1] >= side)


def whole_pixels(box: Column) -> Column:
    return F.transform(box, lambda v: F.bround(v).cast("int"))


def in_top_strip(y: Column, h: Column, box_height: Column) -> Column:
    return y + h / 2 < box_height * TOP_STRIP


def relative_box(x0: Column, y0: Column, w: Column, h: Column, image_w: Column, image_h: Column) -> Column:
    """Centre and size as shares of the image."""
    return F.struct(
        ((x0 + w / 2) / image_w).alias("cx"),
        ((y0 + h / 2) / image_h).alias("cy"),
        (w / image_w).alias("w"),
        (h / image_h).alias("h"),
    )


def rescale(value: Column, factor: float) -> Column:
    return value / F.lit(float(factor))

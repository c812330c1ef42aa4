"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotvalue.runtime import checkpoint


def _star_step(edges: DataFrame, both_ways: bool, scope: list[str]) -> DataFrame:
    """Connect neighbours to the smallest node each vertex can see.

    The large step looks at all neighbours and moves the larger ones; the small step
    looks at the smaller neighbours and moves those and the vertex itself.  Only the
    minimum is aggregated, so a vertex with many neighbours costs one partial row per task.
    """
    links = edges.unionByName(edges.select(*scope, F.col("v").alias("u"), F.col("u").alias("v"))) if both_ways else edges
    lowest = links.groupBy(*scope, "u").agg(F.min("v").alias("m"))
    if both_ways:
        lowest = lowest.select(*scope, "u", F.least("u", "m").alias("m"))
        moved = links.join(lowest, [*scope, "u"]).where(F.col("v") > F.col("u")).select(*scope, F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = links.join(lowest, [*scope, "u"]).where(F.col("v") != F.col("m")).select(*scope, F.col("v").alias("u"), F.col("m").alias("v"))
        moved = moved.unionByName(lowest.select(*scope, "u", F.col("m").alias("v")))
    return moved.where(F.col("u") != F.col("v")).select(
        *scope, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    ).distinct()


def _state(edges: DataFrame, scope: list[str]):
    """Count and checksum of the edge set; one row for the driver."""
    mark = F.sum(F.xxhash64(*scope, "u", "v").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), mark).first())


def connected_components(edges: DataFrame, max_rounds: int = 60, scope: Sequence[str] = ()) -> DataFrame:
    """``(node, root)`` for every node of ``edges (u, v)``; the root is the smallest node.

    With ``scope`` columns, the graphs of all their values are solved in one loop, each on its own; they
    stay in the result.

    The number of rounds grows with the logarithm of the longest chain.  Every round is
    checkpointed, so the plan stays short and a lost executor does not replay it.
    """
    scope = list(scope)
    ordered = edges.where(F.col("u") != F.col("v")).select(
        *scope, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    current = checkpoint(ordered.distinct())
    before = _state(current, scope)
    for _ in range(max_rounds):
        current = checkpoint(_star_step(_star_step(current, True, scope), False, scope))
        after = _state(current, scope)
        if after == before:
            return stars(current, scope)
        before = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def stars(edges: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    roots = edges.select(*scope, F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(*scope, F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)

"""Mixing sources to target weights by entropy balancing.

Every document gets a rate: the change from one copy each with the least relative entropy whose
tokens meet the target of each source, no rate above ``max_copies``.  The solution is an
exponential tilt ``min(max_copies, exp(lambda * size / mean size of the source))``; lambda is the
root of the convex dual's gradient and found by Newton steps, kept inside a bracket.  Rates are then
rounded into copies.

Rates depend on source and size only, so the steps run on a histogram with one row per distinct
(source, size): a source with a third of all rows counts like any other.  Rounding happens on the
histogram as well: copies follow the running sum of the rates in order of size, and the rest is
mended by single copies of the best fitting size.  Only the last step returns to documents; which
of equally long documents get the additional copy is decided by a hash of the id, in parts of
bounded size.

Nulls and repeated rows: a null text has size 0; a null source is a source of its own, the last;
rows with a null id or a repeated id are documents like others, and equal rows may get different
copies.  A source without words has target 0; its documents, like all of size 0, keep one copy.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slotvalue.llm.arrow import packed
from slotvalue.operators.skew import global_index
from slotvalue.runtime import checkpoint, scratch_path

TOKEN = r"[^\x20\x09-\x0D]+"
# Most sources whose table is sent to every task; beyond it the planner chooses the join.
SENT_SOURCES = 50_000
# Decimals of a tilt that count.
TILT_DIGITS = 12
# Equally long documents of one source that are ordered in one task.
CELL_ROWS = 100_000


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("bigint")


def source_targets(sources: DataFrame, weights: Sequence[float], share: float, max_copies: float) -> DataFrame:
    """Adds ``target`` to ``(sid, source, source_size, ...)``: shares by weight below the caps.

    A round computes the level of the sources below their cap; capped ones raise it.  Only two
    sums reach the driver in each.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    sources = sources.withColumns({"_w": weight, "_cap": F.col("source_size") * F.lit(float(max_copies))})
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] * share
    level = 0.0
    while True:
        capped = F.col("_w") * level >= F.col("_cap")
        row = sources.agg(
            F.sum(F.when(capped, F.col("_cap")).otherwise(0.0)), F.sum(F.when(capped, 0.0).otherwise(F.col("_w")))
        ).first()
        if not row[1] or (total - row[0]) / row[1] <= level:
            break
        level = (total - row[0]) / row[1]
    return sources.withColumn("target", F.least(F.col("_w") * level, F.col("_cap"))).drop("_w")


def tilts(cells: DataFrame, sources: DataFrame, max_copies: float, tolerance: float = 1e-7, max_steps: int = 60) -> DataFrame:
    """``(sid, tilt)``: the dual variable of each source's token constraint.

    Sources whose target is their cap, or 0, have no finite solution: every document is taken
    ``max_copies`` times, or not at all.  One aggregation of the histogram per Newton step.
    """
    limit = F.lit(math.log(max_copies))
    empty = F.lit(None).cast("double")
    state = sources.where("target > 0 and target < _cap").select(
        "sid", "target", F.lit(0.0).alias("tilt"), empty.alias("low"), empty.alias("high"), F.lit(1.0).alias("off")
    )
    state = checkpoint(state)
    small = state.count() <= SENT_SOURCES
    for _ in range(max_steps):
        rate = F.exp(F.least(F.col("tilt") * F.col("x"), limit))
        bent = F.when(F.col("tilt") * F.col("x") < limit, F.col("tokens") * F.col("x") * rate).otherwise(0.0)
        sums = cells.join(F.broadcast(state) if small else state, "sid").groupBy("sid", "target", "tilt", "low", "high").agg(
            (F.sum(F.col("tokens") * rate) - F.col("target")).alias("g"), F.sum(bent).alias("d")
        )
        sums = sums.withColumns({
            "low": F.when(F.col("g") < 0, F.col("tilt")).otherwise(F.col("low")),
            "high": F.when(F.col("g") > 0, F.col("tilt")).otherwise(F.col("high")),
        })
        newton = F.when(F.col("d") > 0, F.col("tilt") - F.col("g") / F.col("d"))
        inside = newton.isNotNull() & (F.col("low").isNull() | (newton > F.col("low"))) & (
            F.col("high").isNull() | (newton < F.col("high"))
        )
        other = (
            F.when(F.col("low").isNull(), F.col("tilt") * 2 - 1)
            .when(F.col("high").isNull(), F.col("tilt") * 2 + 1)
            .otherwise((F.col("low") + F.col("high")) / 2)
        )
        step = F.when(F.abs("g") <= tolerance * F.col("target"), F.col("tilt")).otherwise(F.when(inside, newton).otherwise(other))
        state = checkpoint(sums.select("sid", "target", step.alias("tilt"), "low", "high", (F.abs("g") / F.col("target")).alias("off")))
        if (state.agg(F.max("off")).first()[0] or 0.0) <= tolerance:
            break
    # Sums of doubles differ in their last bits with the order of the shuffle; rounded, reruns agree on the rates.
    return state.select("sid", F.round("tilt", TILT_DIGITS).alias("tilt"))


def _round_cells(cells: DataFrame, max_copies: int, mends: int = 8) -> DataFrame:
    """Whole numbers of copies for each cell, near the rates, whose tokens add up to the target.

    A source has at most one cell per distinct document size, so its cells fit one task.
    """
    by_size = W.partitionBy("sid").orderBy("size").rowsBetween(W.unboundedPreceding, 0)
    upto = F.sum(F.col("n") * F.col("rate")).over(by_size)
    cells = cells.withColumn("_upto", F.floor(upto + 0.5))
    before = F.coalesce(F.lag("_upto").over(W.partitionBy("sid").orderBy("size")), F.lit(0))
    cells = cells.withColumn("copies", F.least(F.greatest(F.col("_upto") - before, F.lit(0)), F.col("n") * max_copies))
    for _ in range(mends):
        gap = F.col("target") - F.sum(F.col("copies") * F.col("size")).over(W.partitionBy("sid"))
        cells = cells.withColumn("_gap", gap)
        more = F.col("_gap") > 0
        left = F.abs(F.abs("_gap") - F.col("size"))
        can = (F.col("size") > 0) & F.when(more, F.col("copies") < F.col("n") * max_copies).otherwise(F.col("copies") > 0)
        better = F.when(can & (left < F.abs("_gap")), left)
        best = F.row_number().over(W.partitionBy("sid").orderBy(better.asc_nulls_last(), "size"))
        cells = cells.withColumn("_best", best).withColumn(
            "copies", F.col("copies") + F.when((F.col("_best") == 1) & better.isNotNull(), F.when(more, 1).otherwise(-1)).otherwise(0)
        )
    return cells.drop("_upto", "_gap", "_best")


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    max_copies: int = 2,
) -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies, taken)`` for every document.

    The sources, by code point and null last, weigh ``weights`` over and over; together they get
    ``share`` times all tokens, none more than ``max_copies`` times its own.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "sizes")
    # The texts are read once; all that follows works on ids, sources and sizes.
    docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), token_count(F.col(text)).alias("size")
    ).write.parquet(path)
    sized = spark.read.parquet(path)
    cells = sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    sources = cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("docs"))
    sources = global_index(sources, [F.col("source").asc_nulls_last()], "sid")
    sources = checkpoint(source_targets(sources, weights, share, max_copies))
    known = F.broadcast(sources) if sources.count() <= SENT_SOURCES else sources
    same = lambda a, b: a.join(b, a["source"].eqNullSafe(b["source"])).drop(b["source"])
    cells = same(cells, known).select(
        "sid", "source", "size", "n", "target", "source_size", "_cap",
        (F.col("n") * F.col("size")).cast("double").alias("tokens"),
        F.try_divide(F.col("size") * F.col("docs"), F.col("source_size")).alias("x"),
    )
    cells = checkpoint(cells)
    solved = tilts(cells.where("size > 0").select("sid", "tokens", "x"), sources, max_copies)
    cells = cells.join(solved, "sid", "left")
    rate = (
        F.when(F.col("size") == 0, 1.0)
        .when(F.col("target") <= 0, 0.0)
        .when(F.col("target") >= F.col("_cap"), float(max_copies))
        .otherwise(F.exp(F.least(F.col("tilt") * F.col("x"), F.lit(math.log(max_copies)))))
    )
    cells = _round_cells(cells.withColumn("rate", rate), max_copies)
    cells = checkpoint(
        cells.select(
            "source", "size", "source_size", "target",
            F.floor(F.col("copies") / F.col("n")).alias("base"),
            (F.col("copies") % F.col("n")).alias("extra"),
            "n",
            F.ceil(F.col("n") / CELL_ROWS).alias("parts"),
        )
    )
    order = F.xxhash64("doc_id")
    placed = sized.alias("d").join(
        cells.alias("c"), F.expr("d.source <=> c.source AND d.size = c.size")
    ).select("d.*", "c.source_size", "c.target", "c.base", "c.extra", "c.n", F.pmod(order, F.col("c.parts")).alias("part"))
    # Shares of the additional copies for the parts of a large cell; a small one is one part.
    counts = placed.groupBy("source", "size", "part").agg(
        F.count(F.lit(1)).alias("_rows"), F.first("extra").alias("_extra"), F.first("n").alias("_n")
    )
    upto = F.sum("_rows").over(W.partitionBy("source", "size").orderBy("part"))
    share_of = lambda rows: F.floor(F.col("_extra") * rows / F.col("_n"))
    counts = counts.withColumn("_extra_here", share_of(upto) - share_of(upto - F.col("_rows")))
    counts = counts.select("source", "size", "part", "_extra_here")
    placed = placed.alias("d").join(
        counts.alias("p"), F.expr("d.source <=> p.source AND d.size = p.size AND d.part = p.part")
    ).select("d.*", "p._extra_here")
    rank = F.row_number().over(W.partitionBy("source", "size", "part").orderBy(order, "doc_id"))
    copies = F.col("base") + (F.col("_rank") <= F.col("_extra_here")).cast("bigint")
    return placed.withColumn("_rank", rank).select(
        "doc_id", "source", "size", "source_size", "target",
        copies.alias("copies"), (copies * F.col("size")).alias("taken"),
    )


def attach_copies(docs: DataFrame, mixed: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` with ``size, source_size, target, copies, taken``; the texts are shuffled once.

    Rows that agree in id, source and size get their copies in the order of a hash of the text.
    The new columns replace those of the same name.
    """
    key = lambda i, s: F.sha2(F.to_json(F.struct(i.alias("i"), s.alias("s"), F.col("size"))), 256).alias("key")
    lists = mixed.select(key(F.col("doc_id"), F.col("source")), "source_size", "target", "copies").groupBy("key").agg(
        F.sort_array(F.collect_list("copies")).alias("all"), F.first("source_size").alias("source_size"), F.first("target").alias("target")
    )
    keyed = packed(docs, size=token_count(F.col(text)), i=F.col(doc_id), s=F.col(source)).withColumn("key", key(F.col("i"), F.col("s")))
    nth = F.row_number().over(W.partitionBy("key").orderBy(F.xxhash64(F.col("row").getField(text))))
    out = keyed.join(lists, "key").withColumn("copies", F.element_at("all", nth))
    added = [F.col(c) for c in ("size", "source_size", "target", "copies")] + [(F.col("copies") * F.col("size")).alias("taken")]
    names = {"size", "source_size", "target", "copies", "taken"}
    own = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in names]
    return out.select(*own, *added)

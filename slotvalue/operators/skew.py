"""Ranking and counting that stay balanced when one group holds a large share of the rows."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slotvalue.runtime import checkpoint

# Bits of a digest that name the range a sample is cut in.
SAMPLE_BITS = 12
# Rows of a group that one task may rank by itself.
WHOLE_GROUP = 100_000


def shuffle_width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _ranged(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Rows in sorted ranges of about equal size, numbered by ``_range``.

    The checkpoint freezes the sampled bounds: all uses below see the same ranges.
    """
    spread = df.repartitionByRange(shuffle_width(df), *order).withColumn("_range", F.spark_partition_id())
    return checkpoint(spread)


def _starts(counts: DataFrame) -> tuple[DataFrame, int]:
    """``(_range, _start)``: rows before each range, from one count per range; and all rows.

    A range is a partition, or one of a fixed number of hash ranges, so the driver gets a
    bounded number of counts whatever the size of the table.
    """
    rows = sorted((r["_range"], r["count"]) for r in counts.collect())
    starts = accumulate((n for _, n in rows), initial=0)
    pairs = [(r, s) for (r, _), s in zip(rows, starts, strict=False)]
    return counts.sparkSession.createDataFrame(pairs, "_range int, _start bigint"), sum(n for _, n in rows)


def small_groups(sizes: DataFrame | None, keys: Sequence[str]) -> bool:
    """Whether no group of ``sizes`` has more rows than a task may rank; False if there is no such table."""
    if sizes is None:
        return False
    most = sizes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return (most or 0) <= WHOLE_GROUP


def rank_within(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str = "rn", total: str | None = None, whole: bool = False
) -> DataFrame:
    """1-based position of each row in its group, and optionally the size of the group.

    ``order`` must be total.  The table is cut into sorted ranges by group and order, written
    once, and each range is ranked on its own, so no task sorts more than a range,
    however large a group is.  Only groups that reach over a bound need a shift; there are
    fewer of them than ranges.  Select the columns you need before ranking.

    ``whole`` says that every group is small (``small_groups``): then rows are shuffled by group once and not written.
    """
    keys = list(keys)
    if whole:
        group = W.partitionBy(*keys)
        ranked = df.withColumn(out, F.row_number().over(group.orderBy(*order)))
        return ranked.withColumn(total, F.count(F.lit(1)).over(group)) if total else ranked
    spread = _ranged(df, [*[F.col(k) for k in keys], *order])
    counts = spread.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    wide = counts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_ranges"), F.sum("_n").alias("_total"), F.collect_list(F.struct("_range", "_n")).alias("_parts")
    ).where("_ranges > 1")
    earlier = F.filter("_parts", lambda p: p["_range"] < F.col("_part._range"))
    names = [f"_key_{i}" for i in range(len(keys))]
    shifts = wide.withColumn("_part", F.explode("_parts")).select(
        *[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col("_part._range").alias("_part_range"), "_total",
        F.aggregate(earlier, F.lit(0).cast("bigint"), lambda s, p: s + p["_n"]).alias("_start"),
    )
    whole = W.partitionBy(*keys, "_range")
    local = spread.withColumn("_local", F.row_number().over(whole.orderBy(*order)))
    if total:
        local = local.withColumn("_here", F.count(F.lit(1)).over(whole))
    # At most two rows per range: every bound is crossed by one group.
    same = F.col("_range") == F.col("_part_range")
    for k, n in zip(keys, names, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(n))
    ranked = local.join(F.broadcast(shifts), same, "left")
    ranked = ranked.withColumn(out, (F.col("_local") + F.coalesce("_start", F.lit(0))).cast("int"))
    if total:
        ranked = ranked.withColumn(total, F.coalesce("_total", "_here"))
    return ranked.drop("_range", "_local", "_here", "_start", "_total", "_part_range", *names)


def global_index(df: DataFrame, order: Sequence[Column], out: str) -> DataFrame:
    """0-based position over the whole table in any total order, from a range sort.

    The table is written once, since its ranges are counted before they are numbered.
    """
    spread = _ranged(df, order)
    starts, _ = _starts(spread.groupBy("_range").count())
    local = F.row_number().over(W.partitionBy("_range").orderBy(*order)) - 1
    return (
        spread.withColumn("_local", local)
        .join(F.broadcast(starts), "_range")
        .withColumn(out, (F.col("_local") + F.col("_start")).cast("bigint"))
        .drop("_range", "_local", "_start")
    )


def hashed_index(
    df: DataFrame, hash_col: str, bits: int, order: Sequence[Column], out: str, total: str | None = None
) -> DataFrame:
    """0-based position over the whole table in the order of an evenly spread hash.

    The hash is cut into a few ranges per shuffle partition; each is numbered on its own
    and shifted by the rows before it.  ``order`` must be total and start with the hash.
    """
    wanted = max(1, math.ceil(math.log2(4 * shuffle_width(df))))
    ranged = df.withColumn("_range", F.shiftright(F.col(hash_col), max(0, bits - wanted)).cast("int"))
    starts, rows = _starts(ranged.groupBy("_range").count())
    local = F.row_number().over(W.partitionBy("_range").orderBy(*order)) - 1
    indexed = (
        ranged.withColumn("_local", local)
        .join(F.broadcast(starts), "_range")
        .withColumn(out, (F.col("_local") + F.col("_start")).cast("bigint"))
        .drop("_range", "_local", "_start")
    )
    return indexed.withColumn(total, F.lit(rows).cast("bigint")) if total else indexed


def hashed_first(df: DataFrame, hash_col: str, bits: int, order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows in the order of an evenly spread hash.

    Counts per hash range tell where the cut falls: ranges below it are taken whole and only
    the rows of the range that holds the cut are numbered.
    """
    ranged = df.withColumn("_range", F.shiftright(F.col(hash_col), bits - SAMPLE_BITS).cast("int"))
    left, cut = n, 1 << SAMPLE_BITS  # above all ranges: a table of fewer rows is taken whole
    for r, rows in sorted((r["_range"], r["count"]) for r in ranged.groupBy("_range").count().collect()):
        if rows >= left:
            cut = r
            break
        left -= rows
    edge = ranged.where(F.col("_range") == cut)
    edge = edge.withColumn("_place", F.row_number().over(W.partitionBy("_range").orderBy(*order))).where(F.col("_place") <= left)
    return ranged.where(F.col("_range") < cut).unionByName(edge.drop("_place")).drop("_range")


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str = "rn") -> DataFrame:
    """First ``k`` rows of each group.

    Spark keeps only ``k`` rows per group and task before the shuffle, so a hot group
    never travels whole.
    """
    return df.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(
        F.col(out) <= k
    )


def spread_missing(key: Column, *row_id: Column) -> Column:
    """Salt for an equi join whose left side has many empty keys.

    Rows with a key get 0 and meet a right side salted by ``present_key``; the others get an odd hash of the row and
    find no partner, but no longer meet in one partition.
    """
    missing = key.isNull() | (key == "")
    return F.when(missing, F.xxhash64(*row_id).bitwiseOR(F.lit(1))).otherwise(F.lit(0).cast("bigint"))


def present_key(key: Column) -> Column:
    """Salt of the right side: 0, and an even number that no left row has for an empty key.

    It depends on the row.  The optimizer takes a constant out of the join keys, and the empty ones meet again.
    """
    return F.when(key == "", F.lit(2)).otherwise(F.lit(0)).cast("bigint")

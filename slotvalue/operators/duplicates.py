"""Exact and near duplicates of signatures, only ever within one block.

Input tables have ``icon_id`` (bigint), ``block`` and ``sig`` (array of 32-bit words, or a
digest string for exact groups).  Equal signatures are reduced to one representative
first, so a block full of copies costs one row per task, and no list of members is ever
collected: groups are rows ``(icon_id, root)``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotvalue.functions.hashing import WORD, hamming, signature
from slotvalue.operators.components import connected_components
from slotvalue.operators.skew import global_index
from slotvalue.runtime import checkpoint


# Signatures that decide where the bits are cut, and signatures under one key that are compared with each other.
SAMPLE = 1024
CROWD = 256


def representatives(signatures: DataFrame) -> DataFrame:
    """Distinct signatures per block with their smallest icon and number of copies."""
    return signatures.groupBy("block", "sig").agg(
        F.min("icon_id").alias("rep"), F.count(F.lit(1)).alias("copies")
    )


def exact_groups(signatures: DataFrame) -> DataFrame:
    """One row per group of two or more icons with equal signatures."""
    return representatives(signatures).where(F.col("copies") > 1)


def exact_members(signatures: DataFrame) -> DataFrame:
    """``(icon_id, root)`` of every icon in an exact group; the root is the smallest icon."""
    groups = exact_groups(signatures).select("block", "sig", F.col("rep").alias("root"))
    return signatures.join(groups, ["block", "sig"]).select("icon_id", "root")


# --- near pairs ------------------------------------------------------------------------


@dataclass(frozen=True)
class Spec:
    """One way to call signatures near: their bits, the largest distance, and how the bits are cut.

    ``segments`` has runs of bits ``(start, stop)``.
    """

    config: int
    bits: int
    distance: int
    extra: int
    segments: tuple[tuple[int, int], ...]
    choices: tuple[tuple[int, ...], ...]
    # Bits of some signatures; they only steer where bits are cut.
    sample: np.ndarray

    def finer(self, choice: tuple[int, ...]) -> list[tuple[tuple[int, int], ...]]:
        """The bits outside of a choice of segments, cut once more."""
        left = [p for i, (a, b) in enumerate(self.segments) if i not in choice for p in range(a, b)]
        # With fewer bits left than parts every pair of the bucket is near anyway: no finer key.
        return [_runs(r) for r in even_cuts(self.sample, left, self.distance + 1)] if len(left) > self.distance else []


def _runs(positions: Sequence[int]) -> tuple[tuple[int, int], ...]:
    """Neighbouring bit positions as ranges."""
    runs: list[list[int]] = []
    for p in positions:
        if runs and runs[-1][1] == p:
            runs[-1][1] = p + 1
        else:
            runs.append([p, p + 1])
    return tuple((a, b) for a, b in runs)


def even_cuts(sample: np.ndarray, positions: Sequence[int], pieces: int) -> list[list[int]]:
    """``positions`` cut into ``pieces`` runs whose values repeat about equally often in a sample of bits.

    Every further bit of a run lowers the share of equal pairs by what it tells that the bits before do not.  A run ends
    once the share is down to a limit; the limit is searched at which the last run comes down to it as well.
    """
    positions = list(positions)

    def cut(limit: float) -> list[list[int]]:
        out, run, codes = [], [], np.zeros(len(sample), np.int64)
        for i, p in enumerate(positions):
            run.append(p)
            codes = np.unique(codes * 2 + sample[:, p], return_inverse=True)[1]
            share = ((np.bincount(codes) / max(1, len(sample))) ** 2).sum() if len(sample) else 0.5 ** len(run)
            rest = len(positions) - i - 1
            # Every later run needs a bit.
            if len(out) < pieces - 1 and (share <= limit or rest == pieces - 1 - len(out)) and rest >= pieces - 1 - len(out):
                out.append(run)
                run, codes = [], np.zeros(len(sample), np.int64)
        return [*out, run] if run else out

    low, high, best = 0.0, 1.0, cut(1.0)
    for _ in range(12):
        limit = (low + high) / 2
        runs = cut(limit)
        last = runs[-1]
        codes = sample[:, last] @ (1 << np.arange(len(last), dtype=object)) if len(sample) else np.zeros(0)
        share = sum((n / len(codes)) ** 2 for n in Counter(codes.tolist()).values()) if len(codes) else 0.5 ** len(last)
        best = runs
        low, high = (low, limit) if share <= limit else (limit, high)
    return best


def make_spec(sample: np.ndarray, bits: int, distance: int, extra: int = 2, config: int = 0) -> Spec:
    """Segments, keys and finer cuts for one kind of signature; the sample only decides how evenly keys spread."""
    pieces = min(distance + extra, bits)
    extra = pieces - distance
    if extra < 1:
        raise ValueError("distance must be below the number of bits")
    cuts = even_cuts(sample, range(bits), pieces)
    choices = tuple(combinations(range(pieces), extra))
    return Spec(config, bits, distance, extra, tuple((r[0], r[-1] + 1) for r in cuts), choices, sample)


def _segment(sig: Column, start: int, stop: int) -> Column:
    """Bits ``start`` to ``stop`` of a signature as one text key."""
    parts = []
    while start < stop:
        word, offset = divmod(start, WORD)
        size = min(stop - start, WORD - offset)
        piece = F.shiftright(sig[word], offset).bitwiseAND(F.lit((1 << size) - 1).cast("bigint"))
        parts.append(F.hex(piece))
        start += size
    return F.concat_ws(".", *parts)


def _by_config(specs: Sequence[Spec], value) -> Column:
    """A value that depends on the configuration of the row; only the own one is computed."""
    out = None
    for spec in specs:
        hit = F.col("config") == spec.config
        out = F.when(hit, value(spec)) if out is None else out.when(hit, value(spec))
    return out


def _keyed(reps: DataFrame, specs: Sequence[Spec]) -> DataFrame:
    """Each representative once for each key: the values of one choice of segments."""
    segments = _by_config(specs, lambda s: F.array(*[_segment(F.col("sig"), a, b) for a, b in s.segments]))
    keys = lambda s: F.array(*[
        F.struct(F.array(*map(F.lit, c)).alias("choice"), F.concat_ws("/", *[F.get("segments", F.lit(i)) for i in c]).alias("key")) for c in s.choices
    ])
    spread = reps.withColumn("segments", segments).withColumn("k", F.explode(_by_config(specs, keys)))
    return spread.select("config", "block", "k.choice", "k.key", "sig", "rep", "copies", "segments")


def _refined(keyed: DataFrame, specs: Sequence[Spec]) -> DataFrame:
    """Rows of crowded keys once for each finer key: one run of the bits that the key leaves open.

    Two signatures of a bucket differ in these bits only, in ``distance`` at most, so they agree on one of the
    ``distance + 1`` runs.
    """

    def parts(spec: Spec) -> Column:
        out = None
        for choice in spec.choices:
            runs = spec.finer(choice)
            own = F.array(*[F.concat_ws("/", *[_segment(F.col("sig"), a, b) for a, b in run]) for run in runs]) if runs else F.array(F.lit(""))
            hit = F.col("choice") == F.array(*map(F.lit, choice))
            out = F.when(hit, own) if out is None else out.when(hit, own)
        return out

    finer = keyed.withColumn("parts", _by_config(specs, parts))
    return finer.select("*", F.posexplode("parts").alias("part", "finer"))


def _close_pairs(reps: DataFrame, specs: Sequence[Spec]) -> DataFrame:
    """Near pairs of ``reps (config, block, sig, rep, copies)`` under the specification of their configuration."""
    bucket = ["config", "block", "choice", "key"]
    keyed = checkpoint(_keyed(reps, specs))
    crowded = keyed.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD).select(*bucket)
    crowded = checkpoint(crowded)
    distance, extra = _by_config(specs, lambda s: F.lit(s.distance)), _by_config(specs, lambda s: F.lit(s.extra))
    close = hamming(F.col("sig_a"), F.col("sig_b"))
    # The first common choice holds the first common segments; later meetings of a pair are dropped.
    agree = F.filter(F.sequence(F.lit(0), F.size("segments_a") - 1), lambda i: F.get("segments_a", i) == F.get("segments_b", i))

    def pairs(rows: DataFrame, key: list[str], once: Column | None = None) -> DataFrame:
        own = [c for c in rows.columns if c not in key]
        a, b = (rows.select(*key, *[F.col(c).alias(f"{c}_{side}") for c in own]) for side in "ab")
        met = a.join(b, key).where((F.col("rep_a") < F.col("rep_b")) & (close <= distance) & (F.slice(agree, 1, extra) == F.col("choice")))
        met = met if once is None else met.where(once)
        return met.select("config", "block", "rep_a", "rep_b", close.cast("int").alias("distance"), "copies_a", "copies_b")

    if crowded.isEmpty():
        return pairs(keyed, bucket)
    plain = keyed.join(crowded, bucket, "left_anti")
    refined = _refined(keyed.join(crowded, bucket, "left_semi"), specs)
    # A pair counts at the first run that both agree on.
    first = F.forall(F.sequence(F.lit(0), F.col("part")), lambda i: (i == F.col("part")) | (F.get("parts_a", i) != F.get("parts_b", i)))
    return pairs(plain, bucket).unionByName(pairs(refined, [*bucket, "part", "finer"], first))


def _bit_sample(reps: DataFrame, bits: int) -> np.ndarray:
    """Bits of a bounded sample of signatures, in the order of a hash."""
    rows = reps.select("sig").orderBy(F.xxhash64("sig"), "sig").limit(SAMPLE).collect()
    return np.array([[r["sig"][p // WORD] >> (p % WORD) & 1 for p in range(bits)] for r in rows], np.int64).reshape(len(rows), bits)


def near_pairs(signatures: DataFrame, bits: int, distance: int, extra: int = 2) -> DataFrame:
    """Pairs of distinct signatures at Hamming distance 1 to ``distance``.

    The bits are cut into ``distance + extra`` segments.  Two signatures within the distance
    agree on at least ``extra`` whole segments, so joining on every choice of ``extra``
    segments finds every pair.  More ``extra`` means longer keys (fewer chance meetings) and
    more rows per signature.  A pair is reported once, at its first shared choice.

    The cuts follow the data: each segment tells about as much as the others (``even_cuts``).  Keys that still hold
    over ``CROWD`` signatures, as of flat pictures, are refined by a further segment of the other bits.
    """
    reps = representatives(signatures).withColumn("config", F.lit(0))
    reps = checkpoint(reps)
    return _close_pairs(reps, [make_spec(_bit_sample(reps, bits), bits, distance, extra)]).drop("config")


def near_members(signatures: DataFrame, bits: int, distance: int, extra: int = 2) -> DataFrame:
    """``(icon_id, root)`` of every icon in a single-linkage cluster of two or more.

    Components are computed over distinct signatures; copies join through their signature.
    """
    signed = signatures.select("icon_id", "block", "sig", F.lit(0).alias("config"))
    return _members(signed, {0: (bits, distance, extra)}).select("icon_id", "root")


def _members(signed: DataFrame, ways: dict[int, tuple[int, int, int]]) -> DataFrame:
    """``(config, icon_id, root)`` of the groups of every configuration, from one join and one components loop.

    ``signed``: ``config, icon_id, block, sig``; ``ways``: bits, distance and extra segments of a configuration;
    others group equal signatures only.
    """
    key = ["config", "block", "sig"]
    reps = checkpoint(signed.groupBy(*key).agg(F.min("icon_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    specs = [make_spec(_bit_sample(reps.where(F.col("config") == c), bits), bits, distance, extra, c) for c, (bits, distance, extra) in ways.items()]
    root = F.col("rep")
    groups = reps.withColumn("root", F.lit(None).cast("bigint"))
    if specs:
        pairs = _close_pairs(reps.where(F.col("config").isin([s.config for s in specs])), specs)
        edges = pairs.select("config", F.col("rep_a").alias("u"), F.col("rep_b").alias("v"))
        labels = connected_components(edges, scope=["config"]).withColumnRenamed("node", "rep")
        groups = reps.join(labels, ["config", "rep"], "left")
    groups = groups.where((F.col("copies") > 1) | F.col("root").isNotNull()).select(*key, F.coalesce("root", root).alias("root"))
    return signed.join(groups, key).select("config", "icon_id", "root")


def group_sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("root").agg(F.count(F.lit(1)).alias("size"))


def group_table(members: DataFrame) -> DataFrame:
    """Members with the index of their group: largest group first, then smallest root."""
    indexed = global_index(group_sizes(members), [F.col("size").desc(), F.col("root")], "group_idx")
    return members.join(indexed, "root").select("icon_id", "root", "group_idx", "size")


# Methods that are compared by default: name, size, distance; size 0 stands for exact equality.
CONFIGS = [("exact", 0, 0), ("average", 64, 2), ("average", 64, 4), ("dct", 16, 1), ("gradient", 64, 4)]


def label_of(method: str, size: int, distance: int) -> str:
    return method if method == "exact" else f"{method}-{size}/d{distance}"


def members_by_method(vectors: DataFrame, length: int, configs: Sequence[tuple] = tuple(CONFIGS)) -> DataFrame:
    """``(config, icon_id, root)`` of the duplicate groups of every method; ``config`` is its place in ``configs``.

    ``vectors``: ``icon_id, block, vec``.  All signatures come from one scan, all pairs from one join and all groups from
    one components loop; equal vectors are told by two 64-bit hashes.
    """
    signed, ways = [], {}
    for i, (method, size, distance) in enumerate(configs):
        if method == "exact":
            sig = F.array(F.xxhash64("vec"), F.xxhash64("vec", F.lit(1)))
        else:
            sig, bits = signature(F.col("vec"), length, method, size)
            ways[i] = (bits, distance, 2)
        signed.append(F.struct(F.lit(i).alias("config"), sig.alias("sig")))
    rows = vectors.withColumn("s", F.explode(F.array(*signed))).select("s.config", "icon_id", "block", "s.sig")
    return _members(checkpoint(rows), ways)


def compare_methods(vectors: DataFrame, length: int, configs: Sequence[tuple] = tuple(CONFIGS)) -> DataFrame:
    """One summary row per method: groups, ambiguous icons, their share and the largest group."""
    sizes = members_by_method(vectors, length, configs).groupBy("config", "root").agg(F.count(F.lit(1)).alias("size"))
    found = sizes.groupBy("config").agg(F.count(F.lit(1)).alias("groups"), F.sum("size").alias("ambiguous"), F.max("size").alias("biggest"))
    names = vectors.sparkSession.createDataFrame([(i, label_of(*c)) for i, c in enumerate(configs)], "config int, method string")
    both = names.join(found, "config", "left").na.fill(0, ["groups", "ambiguous", "biggest"]).withColumn("icons", F.lit(vectors.count()).cast("bigint"))
    share = F.bround(100 * F.col("ambiguous") / F.nullif(F.col("icons"), F.lit(0)), 2)
    return both.select("method", "groups", "ambiguous", share.alias("ambiguous_pct"), "biggest", "icons")


def method_summary(members: DataFrame, total: DataFrame, label: str) -> DataFrame:
    """Groups, ambiguous icons, their share and the largest group of one method.

    ``total`` is any table with one row per icon.
    """
    found = group_sizes(members).agg(
        F.count(F.lit(1)).alias("groups"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("ambiguous"),
        F.coalesce(F.max("size"), F.lit(0)).alias("biggest"),
    )
    icons = total.agg(F.count(F.lit(1)).alias("icons"))
    both = found.unionByName(icons, allowMissingColumns=True).agg(
        *[F.max(c).alias(c) for c in ("groups", "ambiguous", "biggest", "icons")]
    )
    share = F.bround(100 * F.col("ambiguous") / F.nullif(F.col("icons"), F.lit(0)), 2)
    return both.select(
        F.lit(label).alias("method"), "groups", "ambiguous", share.alias("ambiguous_pct"), "biggest", "icons"
    )

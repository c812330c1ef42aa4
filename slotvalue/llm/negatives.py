"""Hard negatives from shared candidate lists of anchor clusters.

Rows are labelled vectors of whole numbers; a score is the exact inner product.  An anchor's positives
are its nearest rows of the same label, its hard negatives the nearest rows of another label whose score
lies between ``low`` and ``high`` percent of the positive's.

Anchors are clustered by angle.  For an anchor ``u`` within ``radius`` of its centroid and a candidate ``i``
at angle ``a`` from it, ``score <= |u| * |i| * cos(max(0, a - radius))``.  The part without ``|u|`` is the
same for all members, so each cluster sorts the candidates by it once, and every member walks that list
until the bound of the next candidate is below all that it still needs; what it found is then certified.

On Spark a list is cut into blocks of growing size by a histogram of its bounds.  A round hands out the next
block to the clusters that have members still walking, in tiles of ``TILE_ROWS``; tiles meet packs of members on
(cluster, salt), are walked in order of the bound, and leave a few rows per member.  No list, cluster or label is
ever gathered in one task.  Equal vectors of a label are one entry that keeps its smallest ids, as many
as could be asked for, and equal anchors walk once.

Nulls and odd rows: rows with a null id, label or vector, or a null or non-finite component, take no part.  Exact repeats
count once; rows that share only an id are separate candidates, but never partners of an anchor with
that id.  Vectors of different lengths are never compared; zero and empty vectors score 0.  A score beyond a
long is the nearest long.  Anchors without partners have no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotvalue.llm.arrow import map_batches, shuffle_width
from slotvalue.operators.skew import top_per_group
from slotvalue.runtime import scratch_path

# Anchors that the clusters are fitted on; all anchors are assigned to them.
SAMPLE = 4096
MAX_CLUSTERS = 64
FIT_ROUNDS = 8
# Candidates of the first block of a list; each further block is GROWTH times as long.
FIRST_BLOCK = 8192
GROWTH = 8
BINS = 256
TILE_ROWS = 4096
PACK_ROWS = 256
STEP_ROWS = 2048

LEAST, MOST = -(1 << 63), (1 << 63) - 1
# Rounding of an arc cosine near 1, and of a product of norms.
ANGLE_SLACK, SLACK = 2e-7, 1e-12

ENTRY = "h1 bigint, h2 bigint, label bigint, vec array<double>, ids array<bigint>, norm double"
SLOT = "array<struct<ps:bigint,lo:bigint,hi:bigint>>"


def scaled_floor(vector: str | Column, scale: int) -> Column:
    """``floor(scale * x)`` of each component as a double; null and non-finite components stay."""

    def whole(x: Column) -> Column:
        y = x.cast("double") * F.lit(float(scale))
        # From 2**52 on every double is whole.
        return F.when(F.abs(y) < F.lit(2.0**52), F.floor(y).cast("double")).otherwise(y) + F.lit(0.0)

    return F.transform(vector, whole)


# --- entries and members ---------------------------------------------------------------


def _entries(rows: DataFrame, keep_ids: int) -> DataFrame:
    """Distinct (label, vector) with their smallest ids."""
    top = top_per_group(rows, ["h1", "h2"], [F.col("vec_id")], keep_ids)
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    return (
        top.groupBy("h1", "h2")
        .agg(F.first("label").alias("label"), F.first("vec").alias("vec"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
        .withColumn("norm", norm)
    )


def _finite(vector: str) -> Column:
    return F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))


def matrix(column: pa.Array, width: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, padded with zeros to the longest, and their lengths."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64)
    width = max(width, int(sizes.max(initial=0)))
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = values
    return out, sizes


def _unit(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1, initial=0.0, keepdims=True)
    x = x / np.where(top > 0, top, 1.0)  # squares of large components stay finite
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1.0)


def angles(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Angle of each row to each unit centroid; shorter ones count as padded with zeros."""
    width = max(x.shape[1], centroids.shape[1])
    pad = lambda m: np.pad(m, ((0, 0), (0, width - m.shape[1])))
    return np.arccos(np.clip(_unit(pad(x)) @ pad(centroids).T, -1.0, 1.0))


def fit_centroids(sample: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """Spherical k-means on a bounded sample of the anchors."""
    x = _unit(sample)
    rng = np.random.default_rng(seed)
    centroids = x[rng.permutation(len(x))[:k]]
    for _ in range(FIT_ROUNDS):
        nearest = np.argmax(x @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, x)
        empty = ~np.any(sums, axis=1)
        sums[empty] = centroids[empty]
        centroids = _unit(sums)
    return centroids


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch], schema: pa.Schema):
        for batch in batches:
            angle = angles(matrix(batch.column("vec"))[0], centroids)
            cluster = np.argmin(angle, axis=1)
            own = np.where(batch.column("norm").to_numpy() > 0, angle[np.arange(len(angle)), cluster], 0.0)
            cols = [batch.column(n) for n in schema.names[:-2]]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(cluster.astype(np.int32)), pa.array(own)], schema=schema)

    return run


# --- lists -----------------------------------------------------------------------------


@dataclass
class Lists:
    """What tasks need to sort candidates: a bounded number of centroids and cuts."""

    centroids: np.ndarray
    radius: np.ndarray
    scale: float
    block: np.ndarray | None = None  # (cluster, bin) -> block

    def bounds(self, vectors: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """(candidate, cluster): the largest score with a member of norm 1."""
        apart = np.maximum(0.0, angles(vectors, self.centroids) - self.radius - ANGLE_SLACK)
        return norm[:, None] * np.cos(apart)

    def bins(self, bound: np.ndarray) -> np.ndarray:
        """0 for the highest bounds."""
        return np.clip(((1.0 - bound / self.scale) * (BINS / 2)).astype(np.int64), 0, BINS - 1)

    def ceiling(self, bin_: np.ndarray) -> np.ndarray:
        """No bound in a bin or after it is higher; half a bin is left for rounding."""
        return np.where(bin_ == 0, np.inf, self.scale * (1.0 - (bin_ - 0.5) * 2 / BINS))


def _counted(lists: Lists):
    def run(batches, schema):
        for batch in batches:
            bound = lists.bounds(matrix(batch.column("vec"))[0], batch.column("norm").to_numpy())
            cell = lists.bins(bound) + BINS * np.arange(bound.shape[1])
            cells, n = np.unique(cell, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((cells // BINS).astype(np.int32)), pa.array((cells % BINS).astype(np.int32)), pa.array(n)], schema=schema)

    return run


def _cut(counts: np.ndarray) -> np.ndarray:
    """Block of each (cluster, bin), so that block ``r`` ends after FIRST_BLOCK * GROWTH**r candidates or more."""
    before = np.cumsum(counts, axis=1) - counts
    limits = FIRST_BLOCK * float(GROWTH) ** np.arange(40)
    return np.searchsorted(limits, before, "right")


def _pack(columns: dict[str, pa.Array]) -> bytes:
    batch = pa.RecordBatch.from_pydict(columns)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def _compact(vec: pa.Array) -> pa.Array:
    """The list column with the narrowest of 16-bit, 32-bit and double components."""
    values = pc.list_flatten(vec)
    most = float(np.abs(values.to_numpy(zero_copy_only=False)).max(initial=0.0))
    kind = pa.int16() if most < 1 << 15 else pa.int32() if most < 1 << 31 else pa.float64()
    return vec.cast(pa.list_(kind))


def _tiles(lists: Lists, block: int, clusters: list[int], salts: int):
    """Sorted pieces of the lists of some clusters: the candidates of one block in one batch."""

    def run(batches, schema):
        for number, batch in enumerate(batches):
            vectors, _ = matrix(batch.column("vec"))
            bound = lists.bounds(vectors, batch.column("norm").to_numpy())
            here = lists.block[np.arange(bound.shape[1]), lists.bins(bound)] == block
            compact = pa.RecordBatch.from_arrays(
                [batch.column("label"), batch.column("ids"), _compact(batch.column("vec"))], ["label", "ids", "vec"]
            )
            for c in clusters:
                rows = np.flatnonzero(here[:, c])
                rows = rows[np.argsort(-bound[rows, c], kind="stable")]
                for k in range(0, len(rows), TILE_ROWS):
                    part = rows[k : k + TILE_ROWS]
                    taken = compact.take(pa.array(part))
                    tile = _pack({"bound": pa.array(bound[part, c]), **{n: taken.column(n) for n in ("label", "ids", "vec")}})
                    salt = (number + k // TILE_ROWS + int(part[0])) % salts
                    yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([salt], pa.int32()), pa.array([tile])], schema=schema)

    return run


def _packs():
    """Members of a cluster by the hundred."""

    def run(batches, schema):
        for batch in batches:
            cluster = batch.column("cluster").to_numpy()
            for c in np.unique(cluster):
                rows = np.flatnonzero(cluster == c)
                for k in range(0, len(rows), PACK_ROWS):
                    taken = batch.take(pa.array(rows[k : k + PACK_ROWS]))
                    pack = _pack({n: taken.column(n) for n in ("h1", "h2", "label", "vec", "norm", "slots")})
                    yield pa.RecordBatch.from_arrays([pa.array([int(c)], pa.int32()), pa.array([pack])], schema=schema)

    return run


# --- walking ---------------------------------------------------------------------------


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers: doubles where those are exact, otherwise integers cut to a long."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if float(np.abs(a).max(initial=0.0)) * float(np.abs(b).max(initial=0.0)) * max(width, 1) < 2.0**52:
        return a @ b.T
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    return np.clip(whole(a) @ whole(b).T, LEAST, MOST)


class _Walk:
    """The best finds of one member for one slot: scores in [lo, hi], best first, ties by id."""

    def __init__(self, lo: int, hi: int, kth: int | None, keep: int):
        self.lo, self.hi, self.keep, self.found = lo, hi, keep, []
        self.needs = lo if kth is None else max(lo, kth)

    def offer(self, scores: np.ndarray, ids: list[list[int]], rows: np.ndarray) -> None:
        fits = (scores >= self.needs) & (scores <= self.hi)
        if not fits.any():
            return
        scores, rows = scores[fits], rows[fits]
        if len(scores) > self.keep and scores.dtype != object:
            # Every entry has an id at least, so an entry below the keep-th best cannot be asked for.
            least = np.partition(scores, len(scores) - self.keep)[len(scores) - self.keep]
            scores, rows = scores[scores >= least], rows[scores >= least]
        more = [(-int(s), i) for s, r in zip(scores, rows, strict=True) for i in ids[r][: self.keep]]
        self.found = sorted([*self.found, *more])[: self.keep]
        if len(self.found) == self.keep:
            self.needs = max(self.needs, -self.found[-1][0])


def _walked(same_label: bool, keep: int):
    """Members of a pack walk a tile; what each slot found there."""

    def run(batches, schema):
        for batch in batches:
            for tile, pack in zip(batch.column("tile"), batch.column("pack"), strict=True):
                yield _walk_tile(_unpack(tile.as_py()), _unpack(pack.as_py()), same_label, keep, schema)

    return run


def _walk_tile(tile: pa.RecordBatch, pack: pa.RecordBatch, same_label: bool, keep: int, schema: pa.Schema) -> pa.RecordBatch:
    bound, label = tile.column("bound").to_numpy(), tile.column("label").to_numpy()
    vectors, sizes = matrix(tile.column("vec"))
    ids = tile.column("ids").to_pylist()
    members, widths = matrix(pack.column("vec"))
    norm, own = pack.column("norm").to_numpy(), pack.column("label").to_numpy()
    slots = [[(s["ps"], _Walk(s["lo"], s["hi"], s["kth"], keep)) for s in row] for row in pack.column("slots").to_pylist()]
    slack = SLACK * norm * float(np.linalg.norm(vectors, axis=1).max(initial=0.0))
    for k in range(0, len(bound), STEP_ROWS):
        needs = np.array([float(min(w.needs for _, w in row)) for row in slots])
        walking = np.flatnonzero(norm * bound[k] + slack >= needs * np.where(needs > 0, 1 - SLACK, 1 + SLACK))
        if not len(walking):
            break
        step = slice(k, k + STEP_ROWS)
        scores = exact_scores(members[walking], vectors[step])
        usable = (own[walking, None] == label[step]) == same_label
        usable &= widths[walking, None] == sizes[step]
        for row, member in enumerate(walking):
            at = np.flatnonzero(usable[row])
            s = scores[row, at]
            for _, walk in slots[member]:
                walk.offer(s, ids, at + k)
    out = [
        (h1, h2, ps, -score, i)
        for h1, h2, row in zip(pack.column("h1").to_pylist(), pack.column("h2").to_pylist(), slots, strict=True)
        for ps, walk in row
        for score, i in walk.found
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 5, schema, strict=True)], schema=schema)


FOUND = "h1 bigint, h2 bigint, ps bigint, score bigint, vec_id bigint"


def walk_lists(entries: DataFrame, members: DataFrame, lists: Lists, same_label: bool, keep: int) -> DataFrame:
    """``(h1, h2, ps, score, vec_id)``: the first ``keep`` rows of every slot of every member, certified.

    ``members`` has the columns of ``entries``, ``cluster`` and ``slots`` (``ps``, the scores ``lo`` to ``hi`` that
    it asks for).
    """
    spark = entries.sparkSession
    width = shuffle_width(entries)
    found = spark.createDataFrame([], FOUND)
    clusters = len(lists.centroids)
    for block in range(int(lists.block.max()) + 1):
        # The highest bound that is left for each cluster.
        first = np.where((lists.block >= block).any(axis=1), np.argmax(lists.block >= block, axis=1), BINS)
        ceiling = np.where(first < BINS, lists.ceiling(first), -np.inf)
        known = found.groupBy("h1", "h2", "ps").agg(F.count("*").alias("n"), F.min("score").alias("least"))
        kths = known.where(F.col("n") == keep).groupBy("h1", "h2").agg(F.map_from_entries(F.collect_list(F.struct("ps", "least"))).alias("kths"))
        kth = lambda s: F.try_element_at("kths", s["ps"])
        slots = F.transform("slots", lambda s: F.struct(s["ps"].alias("ps"), s["lo"].alias("lo"), s["hi"].alias("hi"), kth(s).alias("kth")))
        needs = F.array_min(F.transform("slots", lambda s: F.greatest(s["lo"], F.coalesce(s["kth"], s["lo"])).cast("double")))
        top = F.element_at(F.array(*[F.lit(float(c)) for c in ceiling]), F.col("cluster") + 1)
        reach = F.col("norm") * top + F.lit(SLACK * lists.scale) * F.col("norm")
        # Without a norm every score is 0; 0 times an unlimited bound is no number.
        reach = F.when(F.col("norm") > 0, reach).when(top > F.lit(-math.inf), F.lit(0.0)).otherwise(F.lit(-math.inf))
        active = members.join(kths, ["h1", "h2"], "left").withColumn("slots", slots).where(reach >= needs - F.abs(needs) * SLACK)
        path = scratch_path(spark, "walking")
        active.select("h1", "h2", "label", "vec", "norm", "cluster", "slots").write.parquet(path)
        active = spark.read.parquet(path)
        todo = sorted(r["cluster"] for r in active.select("cluster").distinct().collect())
        if not todo:
            break
        salts = max(1, math.ceil(width / len(todo)))
        spread = active.repartition("cluster", F.pmod("h1", F.lit(16))).sortWithinPartitions("cluster")
        packs = map_batches(spread, _packs(), "cluster int, pack binary").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        tiles = map_batches(entries, _tiles(lists, block, todo, salts), "cluster int, salt int, tile binary")
        new = map_batches(tiles.join(packs, ["cluster", "salt"]).select("tile", "pack"), _walked(same_label, keep), FOUND)
        path = scratch_path(spark, "found")
        best = top_per_group(found.unionByName(new), ["h1", "h2", "ps"], [F.col("score").desc(), F.col("vec_id")], keep)
        best.select("h1", "h2", "ps", "score", "vec_id").write.parquet(path)
        found = spark.read.parquet(path)
    return found


def _list_order(column: Column) -> Column:
    """Finds with the highest score first, ties by id."""
    return F.array_sort(column, lambda a, b: F.when(a["score"] != b["score"], F.when(a["score"] > b["score"], -1).otherwise(1)).otherwise(F.when(a["vec_id"] < b["vec_id"], -1).when(a["vec_id"] > b["vec_id"], 1).otherwise(0)))


def build_lists(entries: DataFrame, members: DataFrame, centroids: np.ndarray) -> tuple[DataFrame, Lists]:
    """Members with their cluster, and the cuts of each cluster's list."""
    spark = entries.sparkSession
    path = scratch_path(spark, "members")
    map_batches(members.select(*[c.split()[0] for c in ENTRY.split(", ")]), _assigned(centroids), ENTRY + ", cluster int, angle double").write.parquet(path)
    members = spark.read.parquet(path)
    radius = np.zeros(len(centroids))
    for r in members.groupBy("cluster").agg(F.max("angle").alias("radius")).collect():
        radius[r["cluster"]] = r["radius"]
    lists = Lists(centroids, radius, (entries.agg(F.max("norm")).first()[0] or 1.0) * (1 + 1e-9))
    counts = np.zeros((len(centroids), BINS), np.int64)
    for r in map_batches(entries, _counted(lists), "cluster int, bin int, n bigint").groupBy("cluster", "bin").agg(F.sum("n").alias("n")).collect():
        counts[r["cluster"], r["bin"]] = r["n"]
    lists.block = _cut(counts)
    return members, lists


def hard_negatives(
    rows: DataFrame,
    anchor: Column,
    vec_id: str = "vec_id",
    label: str = "label",
    vector: str = "vector",
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``anchor`` marks the anchors; vectors hold whole numbers (see ``scaled_floor``).
    """
    spark = rows.sparkSession
    base = rows.select(
        F.col(vec_id).cast("bigint").alias("vec_id"), F.col(label).cast("bigint").alias("label"),
        F.col(vector).cast("array<double>").alias("vec"), F.coalesce(anchor, F.lit(False)).alias("anchor"),
    ).where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & _finite("vec"))
    base = base.distinct().withColumn("h1", F.xxhash64("label", "vec")).withColumn("h2", F.xxhash64("vec", F.lit(1), "label"))
    path = scratch_path(spark, "vectors")
    base.write.parquet(path)
    base = spark.read.parquet(path)
    anchors = base.where("anchor").select("vec_id", "h1", "h2")
    path = scratch_path(spark, "entries")
    _entries(base, positives + 1).select(*[c.split()[0] for c in ENTRY.split(", ")]).write.parquet(path)
    entries = spark.read.parquet(path)
    members = entries.join(anchors.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi")

    sample = members.orderBy("h1", "h2").limit(SAMPLE).select("vec").toArrow()
    if not len(sample):
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    k = min(len(sample), MAX_CLUSTERS, max(1, round(math.sqrt(members.count()) / 2)))
    members, lists = build_lists(entries, members, fit_centroids(matrix(sample.column("vec"))[0], k))

    everything = F.array(F.struct(F.lit(0).cast("bigint").alias("ps"), F.lit(LEAST).alias("lo"), F.lit(MOST).alias("hi")))
    near = walk_lists(entries, members.withColumn("slots", everything), lists, True, positives + 1)
    near = near.groupBy("h1", "h2").agg(_list_order(F.collect_list(F.struct("score", "vec_id"))).alias("near"))

    # Percent limits as whole scores; a negative positive score leaves an empty window.
    share = lambda s, p: s.cast("decimal(38,0)") * p / F.lit(100)
    slot = lambda s: F.struct(s.alias("ps"), F.ceil(share(s, low)).cast("bigint").alias("lo"), F.floor(share(s, high)).cast("bigint").alias("hi"))
    slots = F.filter(F.transform(F.array_distinct(F.transform("near", lambda x: x["score"])), slot), lambda s: s["lo"] <= s["hi"])
    asking = members.join(near.withColumn("slots", slots).select("h1", "h2", "slots"), ["h1", "h2"]).where(F.size("slots") > 0)
    far = walk_lists(entries, asking, lists, False, negatives)
    far = far.groupBy("h1", "h2", "ps").agg(_list_order(F.collect_list(F.struct("score", "vec_id"))).alias("far"))
    far = far.groupBy("h1", "h2").agg(F.map_from_entries(F.collect_list(F.struct("ps", "far"))).alias("far"))

    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("anchor_id")), 1, positives)
    pairs = anchors.withColumnRenamed("vec_id", "anchor_id").join(near, ["h1", "h2"]).join(far, ["h1", "h2"])
    pairs = pairs.withColumn("positive", F.explode(others)).withColumn("far", F.try_element_at("far", F.col("positive.score")))
    return pairs.select("anchor_id", "positive", F.posexplode("far").alias("place", "negative")).select(
        "anchor_id", F.col("positive.vec_id").alias("positive_id"), (F.col("place") + 1).cast("int").alias("rank"),
        F.col("negative.vec_id").alias("negative_id"), F.col("positive.score").alias("positive_score"), F.col("negative.score").alias("negative_score"),
    )

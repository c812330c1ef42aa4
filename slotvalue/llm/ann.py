"""Approximate nearest neighbours by cross-polytope hashing.

A table hashes a unit vector by three rounds of random signs and a fast Hadamard transform and takes
the signed axis nearest to the result; a second, shorter transform refines it as the corpus grows, so
that buckets keep their size.  Queries probe the axes in order of nearness.  Bucket mates are
scored by exact inner products on the original vectors.

Where norms differ, vectors get one more component that makes them equally long, which turns the
largest inner product into the smallest angle.  The number of probes is calibrated: a bounded sample
of queries is answered by brute force over all vectors, and the fewest probes are taken
that would find ``recall`` of the true neighbours.  If ``MAX_PROBES`` of them are too few, hashing does not pay: all
vectors go into one bucket, whose parts answer every query exactly; that work is queries times vectors.

Equal vectors are one entry of the index with its smallest ids, as many as a result can hold, and
equal queries are answered once; so a vector that a third of the table shares is no hot
group.  Buckets above a size are cut into parts by a hash.  A task holds the queries of one part and
a block of its candidates.

Vectors that are null, empty, zero or hold null or non-finite components take no part; vectors of
another length than the query's are not its candidates; a null id takes no part.  Rows that share an id
and a vector are one row; rows that share only the id are candidates of their own but never of
a query with that id.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slotvalue.llm.arrow import batch_of, map_batches
from slotvalue.operators.skew import hashed_index
from slotvalue.runtime import scratch_path

TABLES = 6
RECALL = 0.97
SAMPLE = 128
MAX_PROBES = 4096
# Vectors that a bucket should hold, and that a part of a bucket may hold.
BUCKET = 1024
PART = 8192
PART_QUERIES = 1024
BLOCK = 2048
# Probes that are ranked at once.
PAIRS = 1 << 19
SEED = 7_919


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


def rotate(x: np.ndarray, table: int, level: int) -> np.ndarray:
    rng = np.random.default_rng([SEED, x.shape[1], table, level])
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], x.shape[1]))
    return x


class Hasher:
    """The hash functions of all tables for a corpus of ``rows`` vectors."""

    def __init__(self, rows: int, longest: float, shortest: float, tables: int = TABLES):
        self.rows, self.longest, self.tables = rows, longest, tables
        self.bucket = BUCKET
        self.level_norms = longest > 0 and (longest - shortest) > 1e-3 * longest
        self.exact = False

    def make_exact(self) -> None:
        """One table of one bucket, so that every query meets every candidate."""
        self.exact, self.tables = True, 1

    def prepared(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Unit vectors of a length that is a power of two."""
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        if self.level_norms and not query:
            x = x / self.longest
            rest = np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1, keepdims=True)))
        else:
            x, rest = x / norm, np.zeros((len(x), 1))
        if self.level_norms:
            x = np.hstack([x, rest])
        width = 1 << max(0, x.shape[1] - 1).bit_length()
        return np.hstack([x, np.zeros((len(x), width - x.shape[1]))])

    def second(self, width: int) -> int:
        """Axes of the refining transform: none while the first gives enough buckets."""
        need = self.rows / self.bucket / (2 * width)
        return 0 if need <= 1 else min(width, 1 << max(0, math.ceil(math.log2(need / 2))))

    def _axes(self, x: np.ndarray, table: int) -> list[np.ndarray]:
        first = rotate(x, table, 0)
        out, short = [np.hstack([first, -first])], self.second(x.shape[1])
        if short:
            other = rotate(x, table, 1)[:, :short]
            out.append(np.hstack([other, -other]))
        return out

    def buckets(self, x: np.ndarray, table: int) -> np.ndarray:
        if self.exact:
            return np.zeros(len(x), np.int64)
        axes = self._axes(x, table)
        out = axes[0].argmax(axis=1)
        return out if len(axes) == 1 else out * axes[1].shape[1] + axes[1].argmax(axis=1)

    def probes(self, x: np.ndarray, table: int, count: int) -> np.ndarray:
        """Buckets in order of nearness, at most ``count`` for each vector."""
        if self.exact:
            return np.zeros((len(x), 1), np.int64)
        most = max(1, PAIRS // max(1, count))
        if len(x) > most:
            return np.vstack([self.probes(x[a : a + most], table, count) for a in range(0, len(x), most)])
        axes = self._axes(x, table)
        if len(axes) == 1:
            return np.argsort(-axes[0], axis=1, kind="stable")[:, :count]
        sorted_ = [np.argsort(-a, axis=1, kind="stable") for a in axes]
        value = [np.take_along_axis(a, s, axis=1) for a, s in zip(axes, sorted_, strict=True)]
        i, j = leading_pairs(axes[0].shape[1], axes[1].shape[1], count)
        order = np.argsort(-(value[0][:, i] + value[1][:, j]), axis=1, kind="stable")[:, :count]
        rows = np.arange(len(x))[:, None]
        return sorted_[0][rows, i[order]] * axes[1].shape[1] + sorted_[1][rows, j[order]]


@lru_cache(maxsize=8)
def leading_pairs(n: int, m: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Places ``(i, j)`` in two descending lists, in order, that can be among the ``count`` largest sums.

    ``(i, j)`` comes after all of ``(i', j')`` with ``i' <= i`` and ``j' <= j``: there must be at most ``count`` of them.  With
    ties in the order of the places, a smaller ``count`` gives a prefix of the same ranking.
    """
    places = [(i, j) for i in range(min(n, count)) for j in range(min(m, count // (i + 1)))]
    i, j = np.array(places).T
    return i, j


def matrices(column: pa.Array):
    """Row numbers and double matrix for each length of vector in a batch."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(column.offsets.to_numpy())
    start = np.concatenate([[0], np.cumsum(size)])[:-1]
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        yield rows, values[start[rows][:, None] + np.arange(d)]


def inner(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed component after component, so that equal pairs score equally."""
    out = np.zeros(len(q))
    for d in range(q.shape[1]):
        out += q[:, d] * c[:, d]
    return out


def nearest(q: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int):
    """``(query, candidate, score)`` for the ``k`` best of each query, ties to the smaller id."""
    rough = q @ c.T
    if c.shape[0] > k:
        floor = np.partition(rough, c.shape[0] - k, axis=1)[:, c.shape[0] - k]
        slack = 1e-12 * np.linalg.norm(q, axis=1) * np.linalg.norm(c, axis=1).max()
        a, b = np.nonzero(rough >= (floor - slack)[:, None])
    else:
        a, b = (x.ravel() for x in np.indices(rough.shape))
    return best_of(a, b, inner(q[a], c[b]), c_ids[b], k)


def best_of(a, b, score, ids, k):
    order = np.lexsort((ids, -score, a))
    a, b, score = a[order], b[order], score[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    return a[place < k], b[place < k], score[place < k]


def _brute(sample: list[list[float]], k: int):
    """The best of each batch for every sampled query; only a calibration reads it."""

    def run(batches, schema):
        for batch in batches:
            ids, vectors = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            for rows, c in matrices(vectors):
                own = [i for i, q in enumerate(sample) if len(q) == c.shape[1]]
                if not own:
                    continue
                a, b, score = nearest(np.array([sample[i] for i in own]), c, ids[rows], k)
                yield batch_of(
                    {"q": np.array(own)[a], "c": ids[rows][b], "score": score, "v": vectors.take(pa.array(rows[b]))}, schema
                )

    return run


def calibrated_probes(classes: DataFrame, hasher: Hasher, kind: str, k: int, recall: float, sample: int) -> int:
    """Fewest probes per table that find ``recall`` of the true neighbours of a sample of queries.

    More than ``MAX_PROBES`` says that so many do not find them.
    """
    queries = classes.where("is_query").orderBy(F.xxhash64("c"), "c").limit(sample).select("c", "v").collect()
    if not queries:
        return 1
    found = map_batches(classes.select("c", "v"), _brute([list(r.v) for r in queries], k + 1), f"q int, c bigint, score double, v {kind}")
    best = W.partitionBy("q").orderBy(F.col("score").desc(), "c")
    rows = found.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k + 1).collect()
    place = []
    for r in rows:
        if r.c == queries[r.q].c:
            continue
        q = hasher.prepared(np.array([queries[r.q].v], float), True)
        c = hasher.prepared(np.array([r.v], float), False)
        least = MAX_PROBES
        for t in range(hasher.tables):
            hit = np.flatnonzero(hasher.probes(q, t, MAX_PROBES)[0] == hasher.buckets(c, t)[0])
            least = min(least, int(hit[0]) if len(hit) else MAX_PROBES)
        place.append(least)
    return int(np.quantile(place, recall, method="higher")) + 1 if place else 1


def _hashes(hasher: Hasher, probes: int):
    def run(batches, schema):
        for batch in batches:
            ids, is_query = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            for rows, x in matrices(batch.column(1)):
                for a in range(0, len(rows), BLOCK):
                    some, part = rows[a : a + BLOCK], x[a : a + BLOCK]
                    asked = is_query[some].astype(bool)
                    own, query = hasher.prepared(part, False), hasher.prepared(part[asked], True)
                    for t in range(hasher.tables):
                        sent = hasher.probes(query, t, probes)
                        bucket = np.concatenate([hasher.buckets(own, t), sent.ravel()])
                        yield batch_of(
                            {
                                "d": np.full(len(bucket), x.shape[1]), "t": np.full(len(bucket), t), "bucket": bucket,
                                "probe": np.arange(len(bucket)) >= len(some),
                                "c": np.concatenate([ids[some], np.repeat(ids[some][asked], sent.shape[1])]),
                            },
                            schema,
                        )

    return run


def _search(k: int):
    """Scores part after part; rows arrive sorted by part, its queries first."""

    def run(batches, schema):
        key = queries = q_ids = kept = None

        def finish():
            if kept is not None:
                yield batch_of({"q": q_ids[kept[0]], "c": kept[1], "score": kept[3]}, schema)

        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)], axis=1)
            probe, ids, smallest = (batch.column(i).to_numpy(zero_copy_only=False) for i in (5, 6, 7))
            vectors = batch.column(8)
            change = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1) | (probe[1:] != probe[:-1])) + 1
            for a, b in zip([0, *change], [*change, len(keys)], strict=True):
                if b <= a:
                    continue
                if key is None or (keys[a] != key).any():
                    yield from finish()
                    key, queries, q_ids, kept = keys[a], None, None, None
                if not probe[a] and queries is None:
                    continue  # nobody asks for this part
                for _, x in matrices(vectors[a:b]):
                    if probe[a]:
                        queries = x if queries is None else np.vstack([queries, x])
                        q_ids = ids[a:b] if q_ids is None else np.concatenate([q_ids, ids[a:b]])
                        continue
                    for s in range(a, b, BLOCK):
                        part = slice(s, min(s + BLOCK, b))
                        i, j, score = nearest(queries, x[part.start - a : part.stop - a], smallest[part], k)
                        found = i, ids[part][j], smallest[part][j], score
                        if kept is not None:
                            i, c, m, score = (np.concatenate(pair) for pair in zip(kept, found, strict=True))
                            i, j, score = best_of(i, np.arange(len(i)), score, m, k)
                            found = i, c[j], m[j], score
                        kept = found
        yield from finish()

    return run


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def neighbours(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    tables: int = TABLES,
    recall: float = RECALL,
    sample: int = SAMPLE,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the nearest found rows for every row with ``is_query``."""
    spark = vectors.sparkSession
    kind = vectors.schema[vector].dataType.simpleString()
    rows = vectors.where(F.col(vec_id).isNotNull() & usable(F.col(vector))).select(
        F.col(vec_id).cast("bigint").alias("id"), is_query.alias("is_query"), F.col(vector).alias("v"),
        F.sha2(F.col(vector).cast("string"), 256).alias("digest"),
    )
    asked = rows.groupBy("digest").agg(F.max("is_query").alias("is_query"))
    # Only the k + 1 smallest ids of a vector can be in a result; each task drops the others early.
    place = F.dense_rank().over(W.partitionBy("digest").orderBy("id"))
    heads = rows.select("digest", "id", "v").withColumn("_n", place).where(F.col("_n") <= k + 1)
    heads = heads.groupBy("digest").agg(F.sort_array(F.collect_set("id")).alias("ids"), F.first("v").alias("v"))
    path = scratch_path(spark, "vectors")
    heads.join(asked, "digest").select(
        F.conv(F.substring("digest", 1, 15), 16, 10).cast("bigint").alias("h"), "digest", "ids", "v", "is_query"
    ).write.parquet(path)
    # The same id can stand for several vectors, so classes are numbered, in the order of their whole digest.
    numbered = hashed_index(spark.read.parquet(path), "h", 60, [F.col("h"), F.col("digest")], "c")
    path = scratch_path(spark, "classes")
    numbered.select("c", "digest", "ids", "v", "is_query").write.parquet(path)
    classes = spark.read.parquet(path)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    whole = classes.agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("longest"), F.min(norm).alias("shortest")).first()
    hasher = Hasher(whole.n, whole.longest or 0.0, whole.shortest or 0.0, tables)
    probes = calibrated_probes(classes, hasher, kind, k, recall, sample)
    if probes > MAX_PROBES:
        hasher.make_exact()
    path = scratch_path(spark, "buckets")
    key = ["d", "t", "bucket"]
    map_batches(classes.select("c", "v", "is_query"), _hashes(hasher, probes), "d int, t int, bucket bigint, probe boolean, c bigint").write.parquet(path)
    entries = spark.read.parquet(path)
    count = lambda probe: F.count(F.when(F.col("probe") == probe, 1))
    sizes = entries.groupBy(*key).agg(
        F.greatest(F.ceil(count(False) / PART), F.lit(1)).alias("parts"), F.greatest(F.ceil(count(True) / PART_QUERIES), F.lit(1)).alias("turns")
    )
    own = lambda n: F.pmod(F.xxhash64("c"), n)
    every = lambda n: F.sequence(F.lit(0).cast("bigint"), n - 1)
    # A query goes to all parts of its bucket, a candidate to all turns of its bucket's queries.
    placed = entries.join(sizes, key).select(
        *key, "probe", "c",
        F.when(F.col("probe"), every(F.col("parts"))).otherwise(F.array(own(F.col("parts")))).alias("part"),
        F.when(F.col("probe"), F.array(own(F.col("turns")))).otherwise(every(F.col("turns"))).alias("turn"),
    )
    placed = placed.withColumn("part", F.explode("part")).withColumn("turn", F.explode("turn"))
    heads = classes.select("c", F.col("ids")[0].alias("smallest"), "v")
    bodies = placed.join(heads, "c").select(*key, "part", "turn", "probe", "c", "smallest", "v")
    bodies = bodies.repartition(*key, "part", "turn").sortWithinPartitions(*key, "part", "turn", F.col("probe").desc())
    found = map_batches(bodies, _search(k + 1), "q bigint, c bigint, score double").dropDuplicates(["q", "c"])
    ids = classes.select("c", "ids")
    best = F.row_number().over(W.partitionBy("q").orderBy(F.col("score").desc(), F.col("ids")[0], "c"))
    found = found.join(ids, "c").withColumn("_n", best).where(F.col("_n") <= k + 1)
    lists = found.select("q", F.col("score"), F.explode("ids").alias("id")).groupBy("q").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "id"))).alias("list")
    )
    lists = lists.join(classes.select(F.col("c").alias("q"), "digest"), "q").select("digest", "list")
    queries = rows.where("is_query").select("id", "digest").distinct()
    others = F.slice(F.filter("list", lambda x: x["id"] != F.col("query_id")), 1, k)
    return queries.select(F.col("id").alias("query_id"), "digest").join(lists, "digest").select(
        "query_id", F.posexplode(others).alias("rank", "hit")
    ).select("query_id", (F.col("rank") + 1).alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.less")).alias("score"))


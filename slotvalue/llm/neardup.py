"""N-gram Jaccard join: MinHash bands find candidates, full shingle sets verify them.

* Every text gets a digest of its set of word shingles and one hash per MinHash band.  Bands and
  rows are chosen so that a pair at the threshold meets in a band with the target recall.
* Texts with equal shingle sets form a class; only one member goes on, with its number of copies.
* Class members are shuffled by band hash.  Each takes the smallest member of its buckets as a
  label; labels are cut into cells of bounded size.  Bucket mates of two cells meet in the tile of
  the two cells, once, however many bands they share; a tile holds only members that have a mate
  on the other side.
* A task holds one tile at a time and counts common shingles for all its pairs at once.  Tiles inside one large
  label get each member as its difference to the label's own set, a few shingles for near copies; the texts of a
  large group thus do not travel once per tile.  Tiles of members of several labels tokenise their texts again.  Pairs never become rows: a tile returns, for each member, the number of
  linked documents and the smallest member it is connected to inside the tile.  Tiles are disjoint
  in pairs, so the numbers add up, and the connections give the classes by connected components.

Nulls and repeated rows: a null or wordless text has no shingles and is similar to nothing, not
even to its like; texts under ``width`` words are one shingle; a null id is an id of its own and
sorts first; rows that share an id but differ in text are documents of their own, rows that agree
in both are one document.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotvalue.llm import tokens
from slotvalue.llm.arrow import batch_of, id_key, map_batches, null_id, packed
from slotvalue.llm.lines import text_tag
from slotvalue.operators.components import connected_components
from slotvalue.runtime import checkpoint, scratch_path

THRESHOLD = 0.8
TARGET_RECALL = 0.99999
ROWS = 6
# Members and distinct shingles of a cell; a tile is made of two.  A large label has cells of its own.
CELL_MEMBERS = 256
LARGE_MEMBERS = 1024
CELL_SHINGLES = 500_000
# Large labels that are sent to every task instead of being shuffled, at most.
SENT_LABELS = 50_000
# Members of large labels (two numbers each) that are sent likewise, at most.
SENT_MEMBERS = 500_000
# A shingle that more members of a tile share is counted by matrix products.
COMMON = 48
COLUMNS = 4096
SEED = 20_240_229


def bands_for(threshold: float, rows: int = ROWS, recall: float = TARGET_RECALL) -> int:
    """Bands of ``rows`` rows that a pair at the threshold shares one of with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def _hash_family(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def band_hashes(sets: np.ndarray, first: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A row of band hashes for every non-empty set."""
    multiply, add = _hash_family(bands * rows)
    starts = first[:-1][first[:-1] < first[1:]]
    out = np.zeros((len(starts), bands), np.uint64)
    for k in range(bands * rows):
        least = np.minimum.reduceat(sets * multiply[k] + add[k], starts)
        out[:, k // rows] = tokens.mix(out[:, k // rows] * np.uint64(31) + least)
    return out


def _sketch(bands: int, rows: int, width: int):
    def run(batches, schema):
        for batch in batches:
            doc, tag, text = batch.column(0), batch.column(1), batch.column(2)
            for a, b in tokens.slices(text):
                sets, first = tokens.distinct_sets(tokens.shingles(tokens.words(text[a:b]), width))
                full = np.flatnonzero(first[:-1] < first[1:])
                if not len(full):
                    continue
                hashes = band_hashes(sets, first, bands, rows).view(np.int64)
                digest = [hashlib.blake2b(sets[first[i] : first[i + 1]].tobytes(), digest_size=16).digest() for i in full]
                halves = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
                yield batch_of(
                    {
                        "doc": doc[a:b].take(pa.array(full)), "tag": tag[a:b].take(pa.array(full)),
                        "d1": halves[:, 0], "d2": halves[:, 1], "n": np.diff(first)[full],
                        "bands": pa.ListArray.from_arrays(np.arange(0, hashes.size + 1, bands, dtype=np.int32), hashes.ravel()),
                    },
                    schema,
                )

    return run


def _common(hashes: np.ndarray, owner: np.ndarray, members: int) -> np.ndarray:
    """Number of common shingles for all pairs of members of a tile."""
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    count = np.diff(np.concatenate([starts, [len(hashes)]]))
    out = np.zeros((members, members), np.float32)
    frequent = np.flatnonzero(count > COMMON)
    for k in range(0, len(frequent), COLUMNS):
        some = frequent[k : k + COLUMNS]
        held = np.zeros((members, len(some)), np.float32)
        column = np.repeat(np.arange(len(some)), count[some])
        row = owner[np.repeat(starts[some] - np.cumsum(count[some]) + count[some], count[some]) + np.arange(len(column))]
        held[row, column] = 1
        out += held @ held.T
    pairs = out.astype(np.int64).ravel()
    for c in np.unique(count[(count > 1) & (count <= COMMON)]):
        group = owner[starts[count == c][:, None] + np.arange(c)]
        for i in range(c):
            # One position against all later ones: memory stays in proportion to the shingles.
            for part in np.array_split(group, max(1, group.size // 1_000_000)):
                keys = part[:, i : i + 1] * members + part[:, i + 1 :]
                pairs += np.bincount(keys.ravel(), minlength=members * members)
                keys = part[:, i + 1 :] * members + part[:, i : i + 1]
                pairs += np.bincount(keys.ravel(), minlength=members * members)
    return pairs.reshape(members, members)


def verify_tile(
    side: np.ndarray, sets: np.ndarray, first: np.ndarray, copies: np.ndarray, threshold: float,
    size: np.ndarray | None = None, removed: np.ndarray | None = None,
):
    """Linked documents and smallest connected member for each member of a tile.

    ``side`` is 0 or 1; within a tile of two cells only pairs across count.  Members are in the
    order of their ids.  With ``size`` and ``removed``, ``sets`` holds what each member lacks of a common base set,
    ``removed`` shingles, and what it has beyond it: two members share the base less what either lacks, plus
    what both have beyond; as lacking and further shingles never meet, one count of common marks gives both.
    """
    m = len(side)
    common = _common(sets, np.repeat(np.arange(m), np.diff(first)), m)
    if size is None:
        size = np.diff(first)
    else:
        base = size - (np.diff(first) - removed) + removed
        common = common + base[:, None] - removed[:, None] - removed[None, :]
    linked = common >= np.ceil(threshold / (1 + threshold) * (size[:, None] + size[None, :]) - 1e-9)
    linked &= (size[:, None] > 0) & (size[None, :] > 0)
    if side.any():
        linked &= side[:, None] != side[None, :]
    np.fill_diagonal(linked, False)
    root = np.arange(m)
    a, b = np.nonzero(linked)
    while len(a):
        least = root.copy()
        np.minimum.at(least, a, root[b])
        least = np.minimum(least, least[least])
        if (least == root).all():
            break
        root = least
    return linked @ copies, root


def _tiles(load, threshold: float):
    """Verifies tile after tile; rows arrive sorted by tile.  ``load`` gives the sets of its rows."""

    def run(batches, schema):
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and (row["t1"], row["t2"]) != (held[0]["t1"], held[0]["t2"]):
                    yield _verified(held, load, threshold, schema)
                    held = []
                held.append(row)
        if held:
            yield _verified(held, load, threshold, schema)

    return run


def _from_texts(width: int):
    def load(rows: list[dict]):
        found, sizes = [], []
        text = pa.array([r["text"] for r in rows], pa.string())
        for a, b in tokens.slices(text):
            own, first = tokens.distinct_sets(tokens.shingles(tokens.words(text[a:b]), width))
            found.append(own)
            sizes.append(np.diff(first))
        return np.concatenate(found), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), None, None

    return load


def _from_differences(rows: list[dict]):
    first = np.concatenate([[0], np.cumsum([len(r["marks"]) for r in rows])])
    marks = np.concatenate([np.asarray(r["marks"], np.int64) for r in rows]).view(np.uint64)
    return marks, first, np.array([r["n"] for r in rows]), np.array([r["removed"] for r in rows])


def _verified(rows, load, threshold, schema):
    rows = sorted({(r["doc"], r["tag"]): r for r in rows}.values(), key=lambda r: (r["doc"], r["tag"]))
    sets, first, size, removed = load(rows)
    t1, t2 = rows[0]["t1"], rows[0]["t2"]
    side = np.array([0 if t1 == t2 or r["cell"] == t1 else 1 for r in rows])
    links, root = verify_tile(side, sets, first, np.array([r["copies"] for r in rows], np.int64), threshold, size, removed)
    some = np.flatnonzero(links)
    return batch_of(
        {
            "doc": [rows[i]["doc"] for i in some], "tag": [rows[i]["tag"] for i in some], "n_links": links[some],
            "root_doc": [rows[root[i]]["doc"] for i in some], "root_tag": [rows[root[i]]["tag"] for i in some],
        },
        schema,
    )


def _whole_sets(width: int):
    def run(batches, schema):
        for batch in batches:
            for a, b in tokens.slices(batch.column(2)):
                sets, first = tokens.distinct_sets(tokens.shingles(tokens.words(batch.column(2)[a:b]), width))
                lists = pa.ListArray.from_arrays(first.astype(np.int32), pa.array(sets.view(np.int64)))
                yield batch_of({"doc": batch.column(0)[a:b], "tag": batch.column(1)[a:b], "shingles": lists}, schema)

    return run


def _differences(large: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """``(doc, tag, n, removed, marks)``: the members of large labels as differences to the label's own set."""
    key = ["doc", "tag"]
    needed = checkpoint(large.select(*key).unionByName(large.select("base.doc", "base.tag")).distinct())
    # Sent to the texts while they are few, so that the texts stay where they are.
    needed = F.broadcast(needed) if needed.count() <= SENT_MEMBERS else needed
    path = scratch_path(large.sparkSession, "sets")
    sets = map_batches(texts.join(needed, key), _whole_sets(width), "doc bigint, tag bigint, shingles array<bigint>")
    sets.dropDuplicates(key).write.parquet(path)
    sets = large.sparkSession.read.parquet(path)
    bases = sets.select(F.struct(*key).alias("base"), F.col("shingles").alias("base_shingles"))
    both = large.join(sets, key).join(bases, "base")
    lacks, beyond = F.array_except("base_shingles", "shingles"), F.array_except("shingles", "base_shingles")
    return both.select(*key, F.size("shingles").alias("n"), F.size(lacks).alias("removed"), F.concat(lacks, beyond).alias("marks"))


def _placed(members: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``(t1, t2, cell, doc, tag, base)``: each member once for every tile in which it has a bucket mate.

    ``base`` is the label of a tile that lies inside one large label.  The second table has the members of large
    labels, ``(doc, tag, base)``; it is None if there are none.
    """
    # Of members without any mate nothing is left after the count.
    buckets = members.select("doc", "tag", "n", F.posexplode("bands").alias("band", "key"))
    size = buckets.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("doc", "tag")).alias("label"))
    mates = checkpoint(buckets.join(size.where("size > 1"), ["band", "key"]).drop("size"))
    labelled = mates.groupBy("doc", "tag").agg(F.min("label").alias("label"), F.max("n").alias("n"))
    total = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s"))
    fits = (F.col("m") <= CELL_MEMBERS) & (F.col("s") <= CELL_SHINGLES)
    # A label that does not fit is large, though one cell of its own may do.
    parts = F.when(fits, 0).otherwise(F.greatest(F.ceil(F.col("m") / LARGE_MEMBERS), F.ceil(F.col("s") / CELL_SHINGLES)))
    # A label that fits one cell shares it with others; a large one has cells of its own.
    whole = total.where(parts == 0).agg(F.sum("m").alias("m"), F.sum("s").alias("s")).first()
    bins = max(1, math.ceil((whole.m or 0) * 2 / CELL_MEMBERS), math.ceil((whole.s or 0) * 2 / CELL_SHINGLES))
    name = F.xxhash64("label.doc", "label.tag")
    cell = F.when(F.col("parts") == 0, F.pmod(name, F.lit(bins))).otherwise(
        F.xxhash64(name, F.pmod(F.xxhash64("doc", "tag"), F.col("parts")))
    )
    large = checkpoint(total.select("label", parts.alias("parts")).where("parts > 0"))
    n_large = large.count()
    large = F.broadcast(large) if n_large <= SENT_LABELS else large
    cells = labelled.join(large, "label", "left").withColumn("parts", F.coalesce("parts", F.lit(0)))
    cells = cells.select("doc", "tag", cell.alias("cell"), F.when(F.col("parts") > 0, F.col("label")).alias("base"))
    mates = mates.select("doc", "tag", "band", "key").join(cells, ["doc", "tag"])
    # A bucket names each of its cells once, so a large one has as many rows as cells, not members.
    others = mates.groupBy("band", "key").agg(F.collect_set(F.struct("cell", "base")).alias("cells"))
    tiles = mates.join(others, ["band", "key"]).groupBy("doc", "tag", "cell", "base").agg(F.collect_set("cells").alias("cells"))
    other = F.explode(F.array_distinct(F.flatten("cells"))).alias("other")
    placed = tiles.select("doc", "tag", "cell", "base", other).select(
        F.least("cell", "other.cell").alias("t1"), F.greatest("cell", "other.cell").alias("t2"), "cell", "doc", "tag",
        F.when(F.col("base") == F.col("other.base"), F.col("base")).alias("base"),
    )
    return placed, cells.where(F.col("base").isNotNull()).select("doc", "tag", "base") if n_large else None


def similar_documents(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    threshold: float = THRESHOLD,
    width: int = tokens.WIDTH,
    rows: int = ROWS,
    recall: float = TARGET_RECALL,
) -> DataFrame:
    """``(doc, tag, class_doc, class_tag, n_links)`` for every distinct (id, text).

    The class is the smallest document connected by links; ``n_links`` counts the other documents
    at or above the threshold, copies included.
    """
    spark = docs.sparkSession
    texts = docs.select(id_key(doc_id).alias("doc"), text_tag(text).alias("tag"), F.col(text).cast("string").alias("text"))
    bands = bands_for(threshold, rows, recall)
    path = scratch_path(spark, "sketches")
    ddl = "doc bigint, tag bigint, d1 bigint, d2 bigint, n int, bands array<bigint>"
    map_batches(texts, _sketch(bands, rows, width), ddl).write.parquet(path)
    sketches = spark.read.parquet(path)
    copies = sketches.select("doc", "tag", "d1", "d2").distinct()
    classes = copies.groupBy("d1", "d2").agg(F.min(F.struct("doc", "tag")).alias("head"), F.count(F.lit(1)).alias("copies"))
    classes = checkpoint(classes.select("d1", "d2", F.col("head.doc").alias("doc"), F.col("head.tag").alias("tag"), "copies"))
    heads = sketches.join(classes, ["doc", "tag", "d1", "d2"]).dropDuplicates(["doc", "tag"])
    placed, large = _placed(heads)
    key = ["doc", "tag"]
    placed = placed.join(classes.select(*key, "copies"), key)
    ddl = "doc bigint, tag bigint, n_links bigint, root_doc bigint, root_tag bigint"

    def verify(bodies: DataFrame, load) -> DataFrame:
        bodies = bodies.drop("base").repartition("t1", "t2").sortWithinPartitions("t1", "t2")
        return map_batches(bodies, _tiles(load, threshold), ddl)

    if large is None:
        verified = verify(placed.join(texts, key), _from_texts(width))
    else:
        placed = checkpoint(placed)
        inside = placed.where(F.col("base").isNotNull()).join(_differences(large, texts, width), key)
        across = placed.where(F.col("base").isNull()).join(texts, key)
        verified = verify(inside, _from_differences).unionByName(verify(across, _from_texts(width)))
    verified = checkpoint(verified)
    edges = verified.select(F.struct("doc", "tag").alias("u"), F.struct(F.col("root_doc").alias("doc"), F.col("root_tag").alias("tag")).alias("v"))
    roots = connected_components(edges.distinct()).select("node.doc", "node.tag", "root")
    links = verified.groupBy("doc", "tag").agg(F.sum("n_links").alias("n_links"))
    heads = classes.join(links, ["doc", "tag"], "left").join(roots, ["doc", "tag"], "left").select(
        "d1", "d2",
        F.coalesce("root.doc", "doc").alias("class_doc"), F.coalesce("root.tag", "tag").alias("class_tag"),
        (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    found = copies.join(heads, ["d1", "d2"]).drop("d1", "d2")
    wordless = texts.select("doc", "tag").distinct().join(found.select("doc", "tag"), ["doc", "tag"], "left_anti")
    return found.unionByName(
        wordless.select("doc", "tag", F.col("doc").alias("class_doc"), F.col("tag").alias("class_tag"), F.lit(0).cast("bigint").alias("n_links"))
    )


def document_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **rule) -> DataFrame:
    """``(doc_id, class_id, n_links)``: one row per document."""
    found = similar_documents(docs, doc_id, text, **rule)
    return found.select(null_id(F.col("doc")).alias("doc_id"), null_id(F.col("class_doc")).alias("class_id"), "n_links")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **rule) -> DataFrame:
    """``docs`` without the members of a class but its smallest.

    Wordless documents are similar to nothing and stay; rows that agree in id and text are one
    document and stay together.
    """
    gone = similar_documents(docs, doc_id, text, **rule).where("doc <> class_doc or tag <> class_tag")
    kept = packed(docs, doc=id_key(doc_id), tag=text_tag(text)).join(gone.select("doc", "tag"), ["doc", "tag"], "left_anti")
    return kept.select("row.*")

"""Benchmark decontamination: short test items found inside documents of any length.

An item is contained in a document if at least ``threshold`` of the item's distinct word shingles
occur in the document.  Items are partitioned by size; every size class has a bottom-k MinHash
signature whose length follows from the threshold and the largest item of the class.  An item of
n shingles, of which at least ceil(t n) occur in the document, has at most n - ceil(t n)
missing, so one more minimum than that cannot be missed: the candidate search loses nothing,
however long the document is.  (Turning the containment into a Jaccard threshold for whole
documents would need thousands of minima for a test item in a text of 20,000 words.)

Items stay a table.  What every task gets of them is a bit map of bounded size over their shingle hashes.  Documents are
scanned once and leave the few shingles that the bit map knows, as words.  These meet the signatures, class by class, in
a join on the hash, which gives candidate pairs; a document with too few shingles for the class is none.  Candidates are
verified by a join on the shingles themselves.  A shingle of a third of all documents is one row on the side of the
items, so that adaptive execution may split it.

Nulls and repeated rows: null ids and texts are allowed; a text without words contains nothing and
an item without words is contained nowhere; texts and items under ``width`` words are one shingle;
repeated rows of either side yield repeated results, and items that share an id are looked for one by one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotvalue.llm import tokens
from slotvalue.llm.arrow import batch_of, id_key, map_batches, null_id, packed
from slotvalue.runtime import scratch_path

# Bits of the map for each shingle of an item, and of the whole map at most (16 MB).
BITS_EACH = 16
MOST_BITS = 1 << 27


def signature_size(n: int, threshold: float) -> int:
    """Minima that an item of a size class up to ``n`` shingles needs so that one is always hit."""
    return n - math.ceil(threshold * n - 1e-9) + 1


def size_class(n: int) -> int:
    """Upper end of the size class: a power of two."""
    return 1 << max(0, n - 1).bit_length()


def word_shingles(found: tokens.Words, i: int, width: int) -> list[tuple[bytes, ...]]:
    own = [found.text(k) for k in range(found.first[i], found.first[i + 1])]
    return [tuple(own[k : k + width]) for k in range(max(1, len(own) - width + 1))] if own else []


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Two places of each hash in a map of ``bits`` bits, a power of two."""
    mask = np.uint64(bits - 1)
    return np.stack([hashes & mask, (hashes >> np.uint64(37)) & mask]).astype(np.int64)


def _item_shingles(threshold: float, width: int):
    """The distinct shingles of each item, and which of them are minima of its signature."""

    def run(batches, schema):
        for batch in batches:
            text = batch.column(2)
            for a, b in tokens.slices(text):
                found = tokens.words(text[a:b])
                every = tokens.shingles(found, width)
                cols = {name: [] for name in schema.names}
                for i in range(b - a):
                    own = {}
                    for h, s in zip(every.hashes[every.first[i] : every.first[i + 1]], word_shingles(found, i, width), strict=True):
                        own.setdefault(s, h)
                    hashes = np.unique(np.array(list(own.values()), np.uint64))
                    least = set(hashes[: signature_size(size_class(len(own)), threshold)].tolist()) if own else ()
                    for s, h in own.items():
                        cols["i1"].append(batch.column(0)[a + i].as_py())
                        cols["i2"].append(batch.column(1)[a + i].as_py())
                        cols["size"].append(len(own))
                        cols["hash"].append(h)
                        cols["shingle"].append(b" ".join(s).decode("utf-8", "replace"))
                        cols["minimum"].append(int(h) in least)
                cols["hash"] = np.array(cols["hash"], np.uint64).view(np.int64)
                yield batch_of(cols, schema)

    return run


def _known_words(bits: int):
    """The map as words of 64 bits, of one batch at a time."""

    def run(batches, schema):
        for batch in batches:
            place = np.unique(_places(batch.column(0).to_numpy().view(np.uint64), bits))
            word, first = np.unique(place >> 6, return_index=True)
            value = np.bitwise_or.reduceat(np.uint64(1) << (place & 63).astype(np.uint64), first) if len(place) else np.zeros(0, np.uint64)
            yield batch_of({"word": word, "value": value.view(np.int64)}, schema)

    return run


def shingle_map(shingles: DataFrame) -> np.ndarray:
    """A bit map over all shingle hashes of the items; the driver gets its words, a bounded number, and nothing else."""
    count = shingles.count()
    bits = min(MOST_BITS, max(1 << 10, 1 << max(0, BITS_EACH * count - 1).bit_length()))
    words = map_batches(shingles.select("hash"), _known_words(bits), "word bigint, value bigint").groupBy("word").agg(F.bit_or("value").alias("value"))
    rows = words.toArrow()
    known = np.zeros(bits // 64, np.uint64)
    known[rows.column("word").to_numpy()] = rows.column("value").to_numpy().view(np.uint64)
    return known


def _known_shingles(known: np.ndarray, width: int):
    """The distinct shingles of each document that the map knows, as words, with the number of all its shingles."""
    bits = 64 * len(known)

    def run(batches, schema):
        for batch in batches:
            text = batch.column(2)
            for a, b in tokens.slices(text):
                found = tokens.words(text[a:b])
                every = tokens.shingles(found, width)
                place = _places(every.hashes, bits)
                hit = np.flatnonzero(((known[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1)).all(axis=0))
                if not len(hit):
                    continue
                owner = np.searchsorted(every.first, hit, "right") - 1
                cols = {name: [] for name in schema.names}
                seen: set[tuple[int, str]] = set()
                hashes, counts = [], np.diff(tokens.distinct_sets(every)[1])
                for k, i in zip(hit, owner, strict=True):
                    start = every.word[k]
                    shingle = b" ".join(found.text(w) for w in range(start, min(start + width, found.first[i + 1]))).decode("utf-8", "replace")
                    if (i, shingle) in seen:
                        continue
                    seen.add((i, shingle))
                    cols["doc"].append(batch.column(0)[a + int(i)].as_py())
                    cols["tag"].append(batch.column(1)[a + int(i)].as_py())
                    cols["n"].append(int(counts[i]))
                    cols["shingle"].append(shingle)
                    hashes.append(every.hashes[k])
                cols["hash"] = np.array(hashes, np.uint64).view(np.int64)
                yield batch_of(cols, schema)

    return run


def _needed(size: str, threshold: float) -> Column:
    return F.ceil(F.col(size) * threshold - 1e-9)


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    threshold: float = 0.8,
    width: int = tokens.WIDTH,
) -> DataFrame:
    """``(doc_id, item_id, n_shingles, n_found)`` for every item that a document contains."""
    spark = docs.sparkSession

    def written(df: DataFrame, label: str) -> DataFrame:
        path = scratch_path(spark, label)
        df.write.parquet(path)
        return spark.read.parquet(path)

    body = lambda column: F.coalesce(F.col(column).cast("string"), F.lit(""))
    asked = items.select(id_key(item_id).alias("item"), body(item_text).alias("text")).groupBy("item", "text").agg(F.count(F.lit(1)).alias("copies"))
    asked = written(asked.withColumn("i1", F.xxhash64("item", "text")).withColumn("i2", F.xxhash64("text", F.lit(1), "item")), "items")
    ddl = "i1 bigint, i2 bigint, size int, hash bigint, shingle string, minimum boolean"
    wanted = written(map_batches(asked.select("i1", "i2", "text"), _item_shingles(threshold, width), ddl), "item-shingles")

    rows = docs.select(id_key(doc_id).alias("doc"), F.xxhash64(body(text)).alias("tag"), F.col(text).cast("string").alias("text"))
    hits = map_batches(rows, _known_shingles(shingle_map(wanted), width), "doc bigint, tag bigint, n int, hash bigint, shingle string")
    key = ["doc", "tag"]
    # Repeated rows of a document count how often it is there.
    hits = written(hits.groupBy(*key, "n", "hash", "shingle").agg(F.count(F.lit(1)).alias("times")), "hits")
    minima = wanted.where("minimum").select("i1", "i2", "hash", "size")
    pairs = hits.join(minima, "hash").where(F.col("n") >= _needed("size", threshold)).select(*key, "i1", "i2").distinct()
    both = hits.join(wanted.select("i1", "i2", "size", "shingle"), "shingle").join(pairs, [*key, "i1", "i2"], "left_semi")
    found = both.groupBy(*key, "i1", "i2", "size").agg(F.count(F.lit(1)).alias("n_found"), F.max("times").alias("times"))
    found = found.where(F.col("n_found") >= _needed("size", threshold)).join(asked.select("i1", "i2", "item", "copies"), ["i1", "i2"])
    repeated = found.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times") * F.col("copies"))))
    return repeated.select(
        null_id(F.col("doc")).alias("doc_id"), null_id(F.col("item")).alias("item_id"),
        F.col("size").cast("bigint").alias("n_shingles"), F.col("n_found").cast("bigint").alias("n_found"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **rule) -> DataFrame:
    """Documents without a contained item; rows that share an id, or have none, are judged together."""
    found = contained_items(docs, items, doc_id, text, **rule).select(id_key("doc_id").alias("doc")).distinct()
    return packed(docs, doc=id_key(doc_id)).join(found, "doc", "left_anti").select("row.*")

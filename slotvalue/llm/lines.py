"""Corpus-wide line deduplication that returns keep bitmaps instead of text.

A line's key is the line without white space (``\\x20 \\x09-\\x0D``) at its ends, ASCII letters
lower-cased.  Long enough keys that occur in enough documents lose all their lines except those
in the document with the largest id.

Lines are reduced to a 128-bit hash of the key, the document and the position.  They are
range-partitioned and sorted by (hash, document descending, position), so a frequent line is cut
into several ranges like any other; one small pass per range reports its first and last key, and
the second pass streams over the sorted rows.  A key is decided at its ``min_docs``-th document;
until then its lines in the documents before wait, so no task holds a long run of equal keys.

Nulls and repeated rows: a null or empty text is one empty line; a null id counts as one document
below all others; rows that share an id count as one document, and each is filtered on its own.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotvalue.llm.arrow import batch_of, id_key, map_batches, packed, shuffle_width
from slotvalue.runtime import checkpoint, scratch_path

SPACE = b" \t\n\x0b\f\r"


def _eligible(min_chars: int):
    def run(batches, schema):
        for batch in batches:
            cols = {name: [] for name in schema.names}
            rows = zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
            for doc, tag, text in rows:
                lines = text.encode().split(b"\n")
                for pos, line in enumerate(lines):
                    key = line.strip(SPACE)
                    if len(key) < min_chars or (not key.isascii() and len(key.decode()) < min_chars):
                        continue
                    digest = hashlib.blake2b(key.lower(), digest_size=16).digest()
                    cols["h1"].append(digest[:8])
                    cols["h2"].append(digest[8:])
                    cols["doc"].append(doc)
                    cols["tag"].append(tag)
                    cols["pos"].append(pos)
                    cols["n_lines"].append(len(lines))
            for name in ("h1", "h2"):
                cols[name] = np.frombuffer(b"".join(cols[name]), np.int64)
            yield batch_of(cols, schema)

    return run


def _runs(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins, and the end."""
    new = np.flatnonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])) + 1
    return np.concatenate([[0], new, [len(h1)]])


def _edges(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """First and last key of a sorted partition with its documents: number, largest, smallest."""
    first = run = None  # [h1, h2, documents, largest, smallest]
    for batch in batches:
        h1, h2, doc = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
        if not len(h1):
            continue
        at = _runs(h1, h2)
        for k in sorted({0, len(at) - 2}):
            a, b = at[k], at[k + 1]
            docs = 1 + int(np.count_nonzero(doc[a + 1 : b] != doc[a : b - 1]))
            if run is not None and k == 0 and (run[0], run[1]) == (h1[0], h2[0]):
                run[2] += docs - (run[4] == doc[0])
                run[4] = doc[b - 1]
                continue
            if run is not None and first is None:
                first = run
            run = [h1[a], h2[a], docs, doc[a], doc[b - 1]]
    for edge in ([first] if first is not None else []) + ([run] if run is not None and run is not first else []):
        yield batch_of({n: [int(v)] for n, v in zip(schema.names, edge, strict=True)}, schema)


def _totals(edges: DataFrame) -> dict[tuple[int, int], tuple[int, int]]:
    """Documents and largest document of the keys at the edges of the ranges.

    There are at most two edges for each partition, whatever the size of the table.
    """
    found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for r in edges.collect():
        found.setdefault((r.h1, r.h2), []).append((r.largest, r.smallest, r.docs))
    totals = {}
    for key, parts in found.items():
        parts.sort(reverse=True)
        shared = sum(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))
        totals[key] = (sum(p[2] for p in parts) - shared, parts[0][0])
    return totals


@dataclass
class _Open:
    """The key at the end of a batch: it may go on in the next one."""

    key: tuple[int, int]
    keeper: int
    docs: int
    last_doc: int
    # Lines outside the keeper, while fewer than ``min_docs`` documents were seen.
    waiting: list[list[np.ndarray]]


def _dropped(totals: dict, min_docs: int):
    def run(batches, schema):
        carry: _Open | None = None
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
            if len(cols[0]):
                parts, carry = _decide(cols, carry, totals, min_docs)
                for part in parts:
                    yield batch_of(dict(zip(schema.names, part, strict=True)), schema)

    return run


def _decide(cols: list[np.ndarray], carry: _Open | None, totals: dict, min_docs: int) -> tuple[list[list[np.ndarray]], _Open]:
    """Lines of a batch that are known to be dropped, and the state of its last key.

    Documents come in descending order, so the first one of a key keeps its lines, and a key is
    decided as soon as ``min_docs`` documents were seen.  Keys that reach over the edge of a
    partition are in ``totals`` and decided from the start.
    """
    h1, h2, doc, *lines = cols
    at = _runs(h1, h2)
    starts, last = at[:-1], len(at) - 2
    run = np.repeat(np.arange(last + 1), np.diff(at))
    goes_on = carry is not None and carry.key == (int(h1[0]), int(h2[0]))
    new_doc = np.ones(len(doc), np.int64)
    new_doc[1:] = (run[1:] != run[:-1]) | (doc[1:] != doc[:-1])
    keeper = doc[starts].copy()
    if goes_on:
        new_doc[0] = doc[0] != carry.last_doc
        keeper[0] = carry.keeper
    docs = np.add.reduceat(new_doc, starts)
    if goes_on:
        docs[0] += carry.docs
    settled = False
    for i in {0, last}:
        total = totals.get((int(h1[starts[i]]), int(h2[starts[i]])))
        if total:
            docs[i], keeper[i] = total
            settled = settled or i == last
    outside = doc != keeper[run]
    drop = (docs[run] >= min_docs) & outside
    parts = [[c[drop] for c in (doc, *lines)]]
    waiting = carry.waiting if goes_on else []
    if goes_on and docs[0] >= min_docs:
        parts, waiting = [*waiting, *parts], []
    if last > 0:
        waiting = []
    if settled or docs[last] >= min_docs:
        waiting = []
    else:
        rest = slice(starts[last], None)
        waiting = [*waiting, [c[rest][outside[rest]] for c in (doc, *lines)]]
    key = (int(h1[-1]), int(h2[-1]))
    return parts, _Open(key, int(keeper[last]), int(docs[last]), int(doc[-1]), waiting)


def pack(dropped, n_lines: int) -> bytes:
    """A compressed bitmap with one bit per line, set if the line stays."""
    keep = np.ones(n_lines, np.uint8)
    keep[np.asarray(dropped, np.int64)] = 0
    return zlib.compress(np.packbits(keep).tobytes())


def unpack(bitmap: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines).astype(bool)


def text_tag(text: str) -> Column:
    """Tells rows apart that share an id."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def keep_bitmaps(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5
) -> DataFrame:
    """``(doc, tag, n_lines, n_dropped, keep)`` for each document that loses a line."""
    spark = docs.sparkSession
    rows = docs.select(id_key(doc_id).alias("doc"), text_tag(text).alias("tag"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ddl = "h1 bigint, h2 bigint, doc bigint, tag bigint, pos int, n_lines int"
    path = scratch_path(spark, "lines")
    map_batches(rows, _eligible(min_chars), ddl).write.parquet(path)
    order = [F.col("h1"), F.col("h2"), F.col("doc").desc(), F.col("tag"), F.col("pos")]
    lines = spark.read.parquet(path)
    # The checkpoint fixes the sampled bounds, so that both passes see the same ranges.
    ranges = checkpoint(lines.repartitionByRange(shuffle_width(docs), *order).sortWithinPartitions(*order))
    totals = _totals(map_batches(ranges, _edges, "h1 bigint, h2 bigint, docs bigint, largest bigint, smallest bigint"))
    dropped = map_batches(ranges, _dropped(totals, min_docs), "doc bigint, tag bigint, pos int, n_lines int")
    packed = F.pandas_udf(lambda p, n: pd.Series([pack(*x) for x in zip(p, n, strict=True)]), "binary")
    found = dropped.groupBy("doc", "tag").agg(F.collect_set("pos").alias("pos"), F.max("n_lines").alias("n_lines"))
    return found.select("doc", "tag", "n_lines", F.size("pos").alias("n_dropped"), packed("pos", "n_lines").alias("keep"))


def _filter_lines(text: pd.Series, keep: pd.Series, n_lines: pd.Series) -> pd.Series:
    return pd.Series(
        [
            None if k is None else "\n".join(x for x, bit in zip(t.split("\n"), unpack(k, int(n)), strict=True) if bit)
            for t, k, n in zip(text, keep, n_lines, strict=True)
        ],
        dtype=object,
    )


def _filtered(docs: DataFrame, bitmaps: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``(row, n_dropped, kept)``: each row with its kept text, null where nothing is dropped.

    Texts that lose nothing are not sent to Python.
    """
    joined = packed(docs, doc=id_key(doc_id), tag=text_tag(text)).join(bitmaps, ["doc", "tag"], "left")
    kept = F.pandas_udf(_filter_lines, "string")(F.when(F.col("keep").isNotNull(), F.col("row").getField(text)), "keep", "n_lines")
    return joined.select("row", F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"), kept.alias("kept"))


def apply_bitmaps(
    docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text", length: str | None = None
) -> DataFrame:
    """``docs`` with the kept lines in ``text``; ``length`` names a column that counts its characters.

    Rows that lose no line stay as they are, null texts included.
    """
    row, changed = F.col("row"), F.col("kept").isNotNull()
    filtered = _filtered(docs, bitmaps, doc_id, text)
    new = row.withField(text, F.when(changed, F.col("kept")).otherwise(row.getField(text)))
    if length:
        kind = docs.schema[length].dataType
        new = new.withField(length, F.when(changed, F.length("kept").cast(kind)).otherwise(row.getField(length)))
    return filtered.select(new.alias("row")).select("row.*")


def line_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **rule) -> DataFrame:
    """Lines, dropped lines and the digest of the kept text of every document."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    out = _filtered(slim, keep_bitmaps(docs, doc_id, text, **rule), "doc_id", "text")
    whole = F.coalesce("row.text", F.lit(""))
    return out.select(
        "row.doc_id",
        (F.length(whole) - F.length(F.replace(whole, F.lit("\n"))) + 1).cast("bigint").alias("n_lines"),
        F.col("n_dropped").cast("bigint").alias("n_dropped"),
        F.sha2(F.coalesce("kept", whole), 256).alias("kept_sha256"),
    )

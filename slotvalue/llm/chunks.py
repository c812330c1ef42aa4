"""Substring deduplication by content-defined chunks.

Texts are cut where the gear rolling hash of the last bytes is the largest among its neighbours
(``REACH`` positions to either side).  A cut thus depends on nothing but the bytes around it: an
insertion moves no other cut, and two texts that share a passage share its cuts from the first
few words on.  (The usual masks with a least length depend on the cut before; measured on passages of
51 words, they need up to half a passage to fall into step.)  Cuts never split a character; a
stretch without a largest hash, such as a repeated letter, is cut at ``MOST`` bytes.  Chunks are
identified by a 128-bit digest.  A chunk found in several documents is repeated; consecutive repeated
chunks make a span, and spans with enough words are reported.  The document with the smallest id that
holds a chunk keeps it.

Digests are aggregated to their smallest and largest document before the shuffle, so a chunk
that a third of all documents share is one row per task.  Chunks meet their digest again by an
equi join that adaptive execution can split, and a document's spans are put together from its repeated
chunks only.

Nulls and repeated rows: a null or empty text has no chunks; a null id is a document with the
smallest id; rows that share an id count as one document, and spans are reported for each distinct
text.  A text shorter than a chunk is one chunk.  Repeats inside one document are left alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slotvalue.llm import tokens
from slotvalue.llm.arrow import batch_of, id_key, map_batches, null_id, packed
from slotvalue.llm.lines import text_tag
from slotvalue.runtime import scratch_path

# Positions on either side that a cut's hash must exceed, bytes that the hash reaches back, and bytes
# after which a chunk ends anyway.
REACH, WINDOW, MOST = 24, 16, 256
# Words of whole repeated chunks that make a span worth reporting.
MIN_WORDS = 20
# Other characters that a run between spaces may have as one word, and characters of each word of a longer run.
LONG, EACH = 32, 6
# First two UTF-8 bytes of scripts without spaces: Thai to Tibetan, Myanmar, Khmer, Chinese and Japanese.
UNSPACED = ((0xE0B8, 0xE0BF), (0xE180, 0xE181), (0xE19E, 0xE19F), (0xE2BA, 0xE9BF), (0xEFA4, 0xEFAB), (0xF0A0, 0xF0B3))

_GEAR = np.random.default_rng(65_537).integers(0, 2**32, 256, dtype=np.uint32)
_OTHER_BASE = 0xD1342543DE82EF95


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """Sum of the gear values of the last ``WINDOW`` bytes, each shifted by its age."""
    h, age = _GEAR[data], 1
    while age < WINDOW:
        older = h[:-age] << np.uint32(age)
        h = h.copy()
        h[age:] += older
        age *= 2
    return h


def _largest(h: np.ndarray, width: int) -> np.ndarray:
    """Largest of ``width`` values from each position on."""
    out, have = h, 1
    while have < width:
        step = min(have, width - have)
        out = np.maximum(out[: len(out) - step], out[step:])
        have += step
    return out


def cut_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, start and end byte of all chunks of several texts in one buffer."""
    cuts = np.zeros(0, np.int64)
    if len(data) > 2 * REACH:
        h = gear_hashes(data)
        around = _largest(h, REACH)
        at = np.arange(REACH, len(h) - REACH)
        at = at[(h[at] > around[at - REACH]) & (h[at] >= around[at + 1])]
        text = np.searchsorted(offsets, at, "right") - 1
        # All bytes that a cut depends on lie inside its text.
        at = at[(at - offsets[text] >= WINDOW - 1 + REACH) & (at + REACH < offsets[text + 1])]
        cuts = _to_character(data, at + 1)
    bounds = np.unique(np.concatenate([offsets, cuts]))
    gap = np.diff(bounds)
    more = np.maximum(0, -(-gap // MOST) - 1)
    if more.any():
        nth = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
        bounds = np.unique(np.concatenate([bounds, _to_character(data, np.repeat(bounds[:-1], more) + nth * MOST)]))
    start, end = bounds[:-1], bounds[1:]
    return np.searchsorted(offsets, start, "right") - 1, start, end


def _to_character(data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Cuts inside a character move behind it."""
    for _ in range(3):
        inside = cuts < len(data)
        inside[inside] = (data[cuts[inside]] & 0xC0) == 0x80
        cuts = cuts + inside
    return cuts


def word_halves(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Half words that begin at each byte of several texts in one buffer.

    A word is a run between spaces.  A character of a script without spaces is half a word, and of a run of more than
    ``LONG`` other characters every ``EACH`` are one.
    """
    lead = (data & 0xC0) != 0x80
    space = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    begins = ~space
    begins[1:] &= space[:-1]
    heads = offsets[offsets < len(data)]
    begins[heads] = ~space[heads]
    two = data.astype(np.uint16) << np.uint16(8)
    two[:-1] |= data[1:]
    unspaced = np.zeros(len(data), bool)
    for low, high in UNSPACED:
        unspaced |= (two >= low) & (two <= high)
    unspaced &= lead
    other = lead & ~unspaced & ~space
    halves = 2 * (begins & ~unspaced) + unspaced
    count, starts = np.cumsum(other), np.flatnonzero(begins)
    if len(starts):
        before = np.append(count[starts] - other[starts], count[-1])
        run = np.maximum(np.cumsum(begins) - 1, 0)
        place = count - 1 - before[run]
        halves += 2 * (other & (np.diff(before)[run] > LONG) & (place > 0) & (place % EACH == 0))
    return halves


def _chunk(batches, schema):
    for batch in batches:
        doc, tag, text = batch.column(0), batch.column(1), batch.column(2)
        for a, b in tokens.slices(text):
            data, offsets = tokens.utf8(text[a:b])
            owner, start, end = cut_points(data, offsets)
            if not len(owner):
                continue
            chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            words = np.concatenate([[0], np.cumsum(word_halves(data, offsets))])
            origin = chars[offsets[:-1]][owner]
            yield batch_of(
                {
                    "doc": doc[a:b].take(pa.array(owner)), "tag": tag[a:b].take(pa.array(owner)),
                    "start": chars[start] - origin, "end": chars[end] - origin, "words": words[end] - words[start],
                    "d1": tokens.span_hash(tokens.prefix_hash(data), start, end).view(np.int64),
                    "d2": tokens.span_hash(tokens.prefix_hash(data, _OTHER_BASE), start, end, _OTHER_BASE).view(np.int64),
                },
                schema,
            )


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc, tag, start, end, n_words, first_doc, drop)`` for spans that several documents share.

    ``start`` and ``end`` count characters, ``n_words`` words as in ``word_halves``.  ``drop`` has the parts of the span that an earlier
    document holds; ``first_doc`` holds its longest chunk first.
    """
    spark = docs.sparkSession
    rows = docs.select(id_key(doc_id).alias("doc"), text_tag(text).alias("tag"), F.col(text).cast("string").alias("text"))
    path = scratch_path(spark, "chunks")
    map_batches(rows, _chunk, "doc bigint, tag bigint, start int, end int, words int, d1 bigint, d2 bigint").write.parquet(path)
    chunks = spark.read.parquet(path)
    shared = chunks.groupBy("d1", "d2").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
    repeated = chunks.join(shared.select("d1", "d2", "first"), ["d1", "d2"]).drop("d1", "d2").distinct()
    by_doc = W.partitionBy("doc", "tag").orderBy("start")
    new = (F.col("start") != F.lag("end", 1, -1).over(by_doc)).cast("int")
    spans = repeated.withColumn("new", new).withColumn("span", F.sum("new").over(by_doc))
    earlier = F.col("first") < F.col("doc")
    spans = spans.groupBy("doc", "tag", "span").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.floor(F.sum("words") / 2).alias("n_words"),
        F.max(F.struct((F.col("end") - F.col("start")).alias("size"), F.bitwise_not("first").alias("first"))).alias("longest"),
        F.array_sort(F.collect_list(F.when(earlier, F.struct("start", "end")))).alias("drop"),
    )
    return spans.where(F.col("n_words") >= min_words).select(
        "doc", "tag", "start", "end", "n_words", F.bitwise_not("longest.first").alias("first_doc"), "drop"
    )


def span_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **rule) -> DataFrame:
    """``(doc_id, span_start, span_end, n_words, first_doc_id, is_first)`` per shared span."""
    found = repeated_spans(docs, doc_id, text, **rule)
    return found.select(
        null_id(F.col("doc")).alias("doc_id"), F.col("start").alias("span_start"), F.col("end").alias("span_end"),
        "n_words", null_id(F.col("first_doc")).alias("first_doc_id"), (F.size("drop") == 0).alias("is_first"),
    )


def _without(text: pd.Series, drops: pd.Series) -> pd.Series:
    out = []
    for t, spans in zip(text, drops, strict=True):
        if t is None or spans is None:
            out.append(t)
            continue
        parts, at = [], 0
        for start, end in sorted((s["start"], s["end"]) for s in spans):
            parts.append(t[at:start])
            at = max(at, end)
        out.append("".join([*parts, t[at:]]))
    return pd.Series(out, dtype=object)


def drop_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **rule) -> DataFrame:
    """``docs`` without the reported chunks that an earlier document holds."""
    spans = repeated_spans(docs, doc_id, text, **rule).groupBy("doc", "tag").agg(F.flatten(F.collect_list("drop")).alias("cut"))
    spans = spans.where(F.size("cut") > 0)
    joined = packed(docs, doc=id_key(doc_id), tag=text_tag(text)).join(spans, ["doc", "tag"], "left")
    old = F.col("row").getField(text)
    cut = F.pandas_udf(_without, "string")(F.when(F.col("cut").isNotNull(), old), "cut")
    new = F.col("row").withField(text, F.when(F.col("cut").isNull(), old).otherwise(cut))
    return joined.select(new.alias("row")).select("row.*")

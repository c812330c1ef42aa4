"""Periodic runs of words, found with a dictionary of basic factors.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q`` apart are equal)
and a length of at least ``max(LEAST_WORDS, LEAST_EXPONENT * q)`` that no neighbouring word extends.

Factors whose length ``L`` is a power of two are named level by level: the name of a factor is the
pair of names of its halves.  Within a run of period ``L/2 < q <= L`` the next occurrence of every
factor of length ``L`` lies exactly ``q`` words on (a shorter distance would make the period block a
power), so occurrences no more than twice the length apart form arithmetic progressions of
difference ``q``.  Neighbouring positions with the same distance to their successor are
progressions side by side; they reach over ``L + q`` further words and end where the period ends.
Each period belongs to one level, so no run is proposed twice.

Only factors that occur more than once in a document go on to the next level; ordinary text is done after
a few.  Texts are worked on in slices of ``SLICE_BYTES``, a longer text in a slice of its own; memory and
time are O(n log n) in the words of a slice.

Nulls, empty texts and repeated rows: a null or empty text has no words, no runs and an empty collapsed
text; a null id stays null; every row is judged on its own, whatever others share its id.  Other
columns pass through as the struct ``row``, so names cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotvalue.llm.arrow import map_batches, packed
from slotvalue.llm.tokens import slices

LEAST_WORDS = 6
LEAST_EXPONENT = 4
SLICE_BYTES = 1 << 20
FOUND = "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def split_words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words between ASCII white space of all texts, and the first word of each text, with the end."""
    lists = pc.ascii_split_whitespace(pc.fill_null(text.cast(pa.string()), ""))
    flat, owner = pc.list_flatten(lists), pc.list_parent_indices(lists)
    full = pc.greater(pc.binary_length(flat), 0)
    owner = owner.filter(full).to_numpy(zero_copy_only=False)
    return flat.filter(full), np.searchsorted(owner, np.arange(len(text) + 1))


def _islands(pos: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last position of stretches of neighbours that share a period, and that period."""
    order = np.lexsort((pos, period))
    pos, period = pos[order], period[order]
    new = np.ones(len(pos), bool)
    new[1:] = (period[1:] != period[:-1]) | (pos[1:] != pos[:-1] + 1)
    last = np.ones(len(pos), bool)
    last[:-1] = new[1:]
    return pos[new], pos[last], period[new]


def periodic_runs(
    codes: np.ndarray, first: np.ndarray, least_words: int = LEAST_WORDS, least_exponent: int = LEAST_EXPONENT
) -> np.ndarray:
    """Rows ``(start, length, period)`` by start and period; ``codes`` are the words of several texts.

    ``first`` has the first word of each text and the end.  The exponent must be at least 4: only then does
    every run show the successor distance ``q`` at the level of its period.
    """
    if least_exponent < 4:
        raise ValueError("runs below exponent 4 need not show at the level of their period")
    counts = np.diff(first)
    owner = np.repeat(np.arange(len(counts)), counts)
    found = [np.zeros((0, 3), np.int64)]
    pos = np.arange(len(codes))
    key = owner * (int(codes.max(initial=0)) + 1) + codes
    size = 1
    while len(pos):
        order = np.argsort(key, kind="stable")
        at, sorted_key = pos[order], key[order]
        same = sorted_key[1:] == sorted_key[:-1]
        gap = at[1:] - at[:-1]
        hit = same & (gap > size // 2) & (gap <= size)
        start, stop, period = _islands(at[:-1][hit], gap[hit])
        length = stop - start + size + period
        long = length >= np.maximum(least_words, least_exponent * period)
        found.append(np.stack([start, length, period], axis=1)[long])
        # The next level: both halves occur again in the text, which is long enough for its periods.
        again = np.zeros(len(pos), bool)
        again[1:] |= same
        again[:-1] |= same
        name = np.full(len(codes), -1)
        name[at[again]] = np.cumsum(np.append(True, ~same))[again]
        pos = np.flatnonzero(name >= 0)
        pos = pos[(counts[owner[pos]] >= least_exponent * (size + 1)) & (pos + size < len(codes))]
        pos = pos[(owner[pos + size] == owner[pos]) & (name[pos + size] >= 0)]
        key = name[pos] * (len(codes) + 1) + name[pos + size]
        size *= 2
    runs = np.concatenate(found)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _slice(text: pa.Array, least_words: int, least_exponent: int) -> list[pa.Array]:
    """Number of words, runs and collapsed text of each of some texts."""
    flat, first = split_words(text)
    codes = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    runs = periodic_runs(codes, first, least_words, least_exponent)
    start, length, period = runs.T
    doc = np.searchsorted(first, start, "right") - 1
    cover = np.zeros(len(codes) + 1, np.int64)
    np.add.at(cover, start + period, 1)
    np.add.at(cover, start + length, -1)
    keep = np.cumsum(cover)[: len(codes)] == 0
    kept = np.concatenate([[0], np.cumsum(keep)])[first].astype(np.int32)
    collapsed = pc.binary_join(pa.ListArray.from_arrays(kept, flat.filter(pa.array(keep))), " ")
    shown = pa.StructArray.from_arrays([pa.array(start - first[doc]), pa.array(length), pa.array(period)], ["start", "length", "period"])
    lists = pa.ListArray.from_arrays(np.searchsorted(doc, np.arange(len(text) + 1)).astype(np.int32), shown)
    return [pa.array(np.diff(first)), lists, collapsed]


def _finder(least_words: int, least_exponent: int):
    def run(batches, schema):
        for batch in batches:
            for a, b in slices(batch.column("text"), SLICE_BYTES):
                found = _slice(batch.column("text")[a:b], least_words, least_exponent)
                cols = [batch.column("row")[a:b], *found]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return run


def find_runs(
    docs: DataFrame, text: str | Column = "text", least_words: int = LEAST_WORDS, least_exponent: int = LEAST_EXPONENT
) -> DataFrame:
    """``(row, n_words, runs, collapsed)`` of every row: its runs by start and period, and its words joined
    by single spaces without those that a run repeats after its first period."""
    return _found(packed(docs, text=F.col(text) if isinstance(text, str) else text), least_words, least_exponent)


def _found(rows: DataFrame, least_words: int = LEAST_WORDS, least_exponent: int = LEAST_EXPONENT) -> DataFrame:
    schema = T.StructType([rows.schema["row"], *T.StructType.fromDDL(FOUND)])
    return map_batches(rows, _finder(least_words, least_exponent), schema)


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length / period; the first of equals; null without runs."""
    return F.aggregate(
        runs,
        F.get(runs, F.lit(0)),
        lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best),
    )


def repeat_tail(words: Column, first: Column, period: Column) -> Column:
    """``words`` whose words from ``first`` on repeat the first ``period`` of them."""
    n = F.size(words)
    block = F.slice(words, first + 1, period)
    filled = F.slice(F.flatten(F.array_repeat(block, F.ceil((n - first) / period).cast("int"))), F.lit(1), n - first)
    return F.concat(F.slice(words, F.lit(1), first), filled)


def with_planted_runs(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The text, or for a tenth of the ids one that repeats a stretch of its own words to its end.

    With ``h`` the CRC-32 of the decimal id and ``g = h div 10``, ids with ``h % 10 = 0`` repeat from word
    ``g % n`` on with a period between an eleventh and a third of the rest.
    """
    h = F.crc32(F.col(doc_id).cast("string"))
    g = F.floor(h / 10)

    def rewritten(words: Column) -> Column:
        n = F.size(words)
        first = (g % n).cast("int")
        period = (F.lit(1) + F.floor((n - first) / (F.lit(3) + g % 8))).cast("int")
        return F.when(n > 0, F.concat_ws(" ", repeat_tail(words, first, period)))

    words = F.array_remove(F.split(F.col(text), r"[\x20\x09-\x0D]+"), "")
    # The array of one holds the words, so that they are split once.
    return F.when(h % 10 == 0, F.transform(F.array(words), rewritten)[0]).otherwise(F.col(text))


def run_digests(docs: DataFrame, doc_id: str = "doc_id", text: str | Column = "text") -> DataFrame:
    """Per row: number of runs, the strongest one, and digests of all runs and of the collapsed text."""
    best = strongest(F.col("runs"))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[n].cast("string") for n in ("start", "length", "period")]), F.lit("\n")))
    slim = docs.select(F.struct(F.col(doc_id).alias("doc_id")).alias("row"), (F.col(text) if isinstance(text, str) else text).alias("text"))
    return (
        _found(slim)
        .withColumn("best", best)
        .select(
            "row.doc_id",
            F.size("runs").cast("bigint").alias("n_runs"),
            *[F.col(f"best.{n}").alias(n) for n in ("start", "length", "period")],
            F.expr("1000 * best.length div best.period").alias("exponent_milli"),
            F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
            F.sha2("collapsed", 256).alias("collapsed_sha256"),
        )
    )

"""Rows packed into Arrow buffers, so that tasks meet blocks of vectors instead of single rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import groupby
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def matrix(column: pa.Array) -> np.ndarray:
    """A list column whose rows have one length, as doubles."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def map_arrow(df: DataFrame, fn, ddl: str | T.StructType) -> DataFrame:
    """``mapInArrow`` whose function gets the batches and the Arrow schema of its result."""
    spark_schema = T.StructType.fromDDL(ddl) if isinstance(ddl, str) else ddl
    schema = to_arrow_schema(spark_schema)
    return df.mapInArrow(lambda batches: fn(batches, schema), spark_schema)


def map_met(
    asked: DataFrame, met: DataFrame, keys: Sequence[str], size: int, held: Callable[[list[bytes]], Any], fn: Callable, ddl: str
) -> DataFrame:
    """``fn(queries, kept, schema)`` for at most ``size`` rows of ``asked``, with what ``held`` makes of ``data`` of the rows of ``met`` with equal keys.

    One shuffle deals both sides by key and sorts them, those of ``met`` first.  So a task keeps the ``met`` of one key and a
    batch of single rows, never a batch of pairs; a task has one Python worker.  Rows of ``asked`` whose key is not in ``met`` give nothing.
    """
    keys = list(keys)
    both = met.select(*keys, "data", F.lit(False).alias("_asked")).unionByName(asked.withColumn("_asked", F.lit(True)), allowMissingColumns=True)
    dealt = both.repartition(*keys).sortWithinPartitions(*keys, "_asked")

    def run(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        now, data, kept = None, [], None
        for batch in batches:
            places, start = zip(*[batch.column(c).to_pylist() for c in [*keys, "_asked"]], strict=True), 0
            for (*key, is_asked), same in groupby(places):
                rows = batch.slice(start, sum(1 for _ in same))
                start += len(rows)
                if key != now:
                    now, data, kept = key, [], None
                if not is_asked:
                    data += rows.column("data").to_pylist()
                elif data:
                    kept = held(data) if kept is None else kept
                    for a in range(0, len(rows), size):
                        yield fn(rows.slice(a, size), kept, schema)

    return map_arrow(dealt, run, ddl)

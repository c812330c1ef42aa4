"""Small helpers for operators that work on Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Stands for a null id inside an operator; it sorts below every other id.
NO_ID = -(1 << 63)


def batch_of(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in schema],
        schema=schema,
    )


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch], pa.Schema], Iterator[pa.RecordBatch]], ddl: str | T.StructType) -> DataFrame:
    """``mapInArrow`` whose function is told the Arrow schema of its result."""
    spark_schema = T.StructType.fromDDL(ddl) if isinstance(ddl, str) else ddl
    schema = to_arrow_schema(spark_schema)
    return df.mapInArrow(lambda batches: fn(batches, schema), spark_schema)


def packed(df: DataFrame, **keys) -> DataFrame:
    """The row as one struct ``row`` beside key columns, whose names thus cannot clash with its own."""
    return df.select(F.struct("*").alias("row"), *[c.alias(n) for n, c in keys.items()])


def id_key(column: str):
    """A long id for use as a key: a null becomes ``NO_ID``."""
    return F.coalesce(F.col(column).cast("bigint"), F.lit(NO_ID))


def null_id(column):
    """The inverse of ``id_key``."""
    return F.when(column != F.lit(NO_ID), column)


def shuffle_width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

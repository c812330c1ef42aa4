"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise(text: Column) -> Column:
    """Lower case, single spaces, trimmed; Unicode spaces count as spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def mentions(query: Column, *fields: Column) -> Column:
    """True if a field contains the query; an empty query finds nothing."""
    hit = F.lit(False)
    for field in fields:
        hit = hit | F.contains(F.lower(F.coalesce(field, F.lit(""))), query)
    return (query != "") & hit


def shown_name(short: Column, name: Column) -> Column:
    return F.coalesce(F.nullif(short, F.lit("")), name)


def slot_label(short: Column, name: Column, per_slot: Column) -> Column:
    return F.concat(shown_name(short, name), F.lit(" "), F.format_number(per_slot, 0), F.lit("/sl"))


def model_and_version(name: Column) -> Column:
    """Split at the last dash; a name without one (or starting with it) has no version."""
    pattern = "^(.+)-([^-]*)$"
    split = F.regexp_extract(name, pattern, 1)
    return F.struct(
        F.when(split == "", name).otherwise(split).alias("model"),
        F.when(split == "", F.lit("")).otherwise(F.regexp_extract(name, pattern, 2)).alias("version"),
    )

"""Column helpers for labels and properties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def has_label(label: str, labels: str = "labels") -> Column:
    return F.array_contains(labels, label)


def prop(name: str, kind: str = "string", props: str = "props") -> Column:
    """One property as a typed column; absent or unusable values are null."""
    return F.expr(f"try_cast({props}['{name}'] AS {kind})").alias(name)


def props_of(**columns: Column) -> Column:
    """A property map without its null values."""
    pairs = [x for k, v in columns.items() for x in (F.lit(k), v.cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def key_values(df: DataFrame, *keep: str) -> DataFrame:
    """One row for each property."""
    return df.select(*keep, F.explode("props").alias("key", "value"))

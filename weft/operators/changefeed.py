"""A change feed of adds and removals applied to a base table of edges.

Only the last change of a key matters, so the feed is ranked per (src, dst, label) by log sequence and its first
row kept. Copies of one sequence number share its key and tie there; keeping one of them is the removal of repeats. The ranking is
limited before the shuffle, so a key with a third of all changes moves one row per task. What is left, one row per
key and the latest removal without a label per pair, is merged with the base.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EDGE_COLUMNS = ["src", "dst", "edge_label", "seq", "creationDate"]


def latest_changes(log: DataFrame) -> DataFrame:
    """The last effective change of each (src, dst, edge_label); a null label is the removals of all labels of a pair."""
    effective = log.filter(
        (F.col("committed") == 1)
        & F.col("seq").isNotNull()
        & F.col("src").isNotNull()
        & F.col("dst").isNotNull()
        & (((F.col("remove") == 0) & F.col("edge_label").isNotNull()) | (F.col("remove") == 1))
    ).select("src", "dst", "edge_label", "seq", "remove", "creationDate")
    last = Window.partitionBy("src", "dst", "edge_label").orderBy(F.col("seq").desc(), F.col("remove").desc())
    return effective.withColumn("__rank", F.row_number().over(last)).filter(F.col("__rank") == 1).drop("__rank")


def apply_changes(log: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """src, dst, edge_label, seq, creationDate of the edges alive after ``log`` has been applied to ``base``.

    A sequence number takes effect if any of its rows has committed = 1. An add replaces the edge's values; a removal
    ends one label or, without a label, all labels from src to dst. ``seq`` is that of the last add; rows of ``base``
    (same columns) carry the seq they were added with, and may overlap with the log. Changes without seq, src or dst, adds without
    label and a remove other than 0 or 1 cannot be applied and are ignored. Order of arrival and repeats do not
    matter; an empty log leaves the base, an empty base and log give no row; further columns are ignored.
    """
    changes = latest_changes(log)
    if base is not None:
        had = base.select("src", "dst", "edge_label", "seq", F.lit(0).alias("remove"), "creationDate").filter(F.col("edge_label").isNotNull() & F.col("src").isNotNull() & F.col("dst").isNotNull())
        last = Window.partitionBy("src", "dst", "edge_label").orderBy(F.col("seq").desc(), F.col("remove").desc())
        changes = changes.unionByName(had).withColumn("__rank", F.row_number().over(last)).filter(F.col("__rank") == 1).drop("__rank")
    swept = F.max(F.when(F.col("edge_label").isNull(), F.col("seq"))).over(Window.partitionBy("src", "dst"))
    return (
        changes.withColumn("__swept", swept)
        .filter((F.col("remove") == 0) & F.col("edge_label").isNotNull() & (F.col("__swept").isNull() | (F.col("seq") > F.col("__swept"))))
        .select(*EDGE_COLUMNS)
    )

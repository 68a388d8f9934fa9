"""A replayable change log with named rollback points.

A log row is (seq, kind 'vertex'|'edge', op 'add'|'remove', vid, src, dst, label, labels, props, undirected, committed). The state at a sequence number is a
set-based fold: adding what exists changes nothing, so values come from the first accepted add after the last end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.graph import PropertyGraph

CHANGE_DDL = "seq bigint, kind string, op string, vid bigint, src bigint, dst bigint, label string, labels array<string>, props map<string,string>, undirected boolean, committed boolean"

# what a base holds comes before any sequence number, its vertices before its edges
BASE_VERTEX, BASE_EDGE = -3, -2


def state_at(log: DataFrame, seq: int | None = None, base: PropertyGraph | None = None) -> PropertyGraph:
    """The graph after all committed changes up to ``seq`` (None: all), beginning with ``base`` or, without one, with nothing.

    Edge adds count only while both ends exist; removing a vertex ends its edges; an edge removal without a label ends
    all labels from src to dst, and never the reverse record of an undirected edge. Uncommitted rows (null
    included) are skipped, repeats of a sequence number are harmless, an empty log gives an empty graph.
    """
    done = log.filter(F.col("committed"))
    if seq is not None:
        done = done.filter(F.col("seq") <= seq)
    v = done.filter(F.col("kind") == "vertex").select("seq", "op", "vid", "labels", F.map_entries("props").alias("p"))
    if base is not None:
        v = v.unionByName(base.vertices.select(F.lit(BASE_VERTEX).cast("bigint").alias("seq"), F.lit("add").alias("op"), "vid", "labels", F.map_entries("props").alias("p")))
    ended = v.filter(F.col("op") == "remove").groupBy("vid").agg(F.max("seq").alias("ended"))
    begun = v.filter(F.col("op") == "add").join(ended, "vid", "left").filter(F.col("ended").isNull() | (F.col("seq") > F.col("ended")))
    alive = begun.groupBy("vid").agg(F.min(F.struct("seq", "labels", "p")).alias("r")).select("vid", F.col("r.seq").alias("since"), "r.labels", F.map_from_entries("r.p").alias("props"))

    e = done.filter(F.col("kind") == "edge")
    adds = e.filter(F.col("op") == "add").select("seq", "src", "dst", "label", F.map_entries("props").alias("p"), F.coalesce("undirected", F.lit(False)).alias("undirected"), F.lit(False).alias("is_reverse"))
    back = adds.filter(F.col("undirected") & (F.col("src") != F.col("dst"))).select("seq", F.col("dst").alias("src"), F.col("src").alias("dst"), "label", "p", "undirected", F.lit(True).alias("is_reverse"))
    both = adds.unionByName(back)
    if base is not None:
        both = both.unionByName(base.edges.select(F.lit(BASE_EDGE).cast("bigint").alias("seq"), "src", "dst", "label", F.map_entries("props").alias("p"), "undirected", "is_reverse"))
    ends = e.filter(F.col("op") == "remove")
    one = ends.filter(F.col("label").isNotNull()).groupBy("src", "dst", "label").agg(F.max("seq").alias("one"))
    every = ends.filter(F.col("label").isNull()).groupBy("src", "dst").agg(F.max("seq").alias("every"))
    since = alive.select("vid", "since")
    accepted = (
        both.join(since.select(F.col("vid").alias("src"), F.col("since").alias("s1")), "src")
        .join(since.select(F.col("vid").alias("dst"), F.col("since").alias("s2")), "dst")
        .join(one, ["src", "dst", "label"], "left")
        .join(every, ["src", "dst"], "left")
        .filter(F.col("seq") > F.greatest("s1", "s2", F.coalesce("one", F.lit(BASE_VERTEX)), F.coalesce("every", F.lit(BASE_VERTEX))))
    )
    first = accepted.groupBy("src", "dst", "label").agg(F.min(F.struct("seq", "is_reverse", "undirected", "p")).alias("r"))
    edges = first.select("src", "dst", "label", F.map_from_entries("r.p").alias("props"), F.col("r.undirected").alias("undirected"), F.col("r.is_reverse").alias("is_reverse"))
    return PropertyGraph(alive.select("vid", "labels", "props"), edges)


def edge_changes(log: DataFrame) -> DataFrame:
    """A change log from rows (seq, src, dst, edge_label, remove, committed, creationDate) over vertices that exist from the start.

    A sequence number is committed if any of its rows is.
    """
    rows = log.filter(F.col("seq").isNotNull() & F.col("src").isNotNull() & F.col("dst").isNotNull())
    none = F.lit(None)
    ends = rows.select(F.explode(F.array("src", "dst")).alias("vid")).distinct()
    first = ends.select(
        F.lit(-1).cast("bigint").alias("seq"), F.lit("vertex").alias("kind"), F.lit("add").alias("op"), "vid", none.cast("bigint").alias("src"), none.cast("bigint").alias("dst"), none.cast("string").alias("label"),
        F.array().cast("array<string>").alias("labels"), F.create_map().cast("map<string,string>").alias("props"), F.lit(False).alias("undirected"), F.lit(True).alias("committed"),
    )
    edges = rows.filter(F.col("committed") == 1).select(
        "seq", F.lit("edge").alias("kind"), F.when(F.col("remove") == 1, "remove").otherwise("add").alias("op"), none.cast("bigint").alias("vid"), "src", "dst", F.col("edge_label").alias("label"), none.cast("array<string>").alias("labels"),
        F.create_map(F.lit("creationDate"), F.col("creationDate").cast("string"), F.lit("seq"), F.col("seq").cast("string")).alias("props"), F.lit(False).alias("undirected"), F.lit(True).alias("committed"),
    )
    return first.unionByName(edges)

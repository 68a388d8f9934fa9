"""Set-based writes: each takes a graph and gives a new one, with the guards of the model.

Vertex ids are unique, an edge's (src, dst, label) is unique and both its ends must exist; writes that break a rule
change nothing. Removing a vertex removes its edges in both directions at once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.operators.graph import EDGE_DDL, VERTEX_DDL, PropertyGraph


def add_vertices(g: PropertyGraph, new: DataFrame) -> PropertyGraph:
    """Add the rows of ``new`` (vid, labels, props) whose id is free; of rows with one id, any one."""
    fresh = new.select("vid", "labels", "props").dropDuplicates(["vid"]).join(g.vertices.select("vid"), "vid", "left_anti")
    return PropertyGraph(g.vertices.unionByName(fresh), g.edges)


def add_vertex(g: PropertyGraph, vid: int, labels: Sequence[str], props: Mapping[str, str]) -> PropertyGraph:
    return add_vertices(g, g.vertices.sparkSession.createDataFrame([(vid, list(labels), dict(props))], VERTEX_DDL))


def add_vertex_auto(g: PropertyGraph, labels: Sequence[str], props: Mapping[str, str]) -> PropertyGraph:
    """Add a vertex under the next free id, one above the greatest."""
    made = g.vertices.sparkSession.createDataFrame([(0, list(labels), dict(props))], VERTEX_DDL)
    top = g.vertices.agg(F.coalesce(F.max("vid") + 1, F.lit(0)).alias("next"))
    return PropertyGraph(g.vertices.unionByName(made.crossJoin(top).select(F.col("next").alias("vid"), "labels", "props")), g.edges)


def add_edges(g: PropertyGraph, new: DataFrame) -> PropertyGraph:
    """Add the rows of ``new`` (src, dst, label, props, undirected) whose ends exist and whose key is free.

    An undirected edge adds its reverse record as well, where that is free.
    """
    ids = g.vertices.select("vid")
    taken = g.edges.select("src", "dst", "label")
    fresh = new.select("src", "dst", "label", "props", "undirected").dropDuplicates(["src", "dst", "label"])
    fresh = fresh.join(ids.withColumnRenamed("vid", "src"), "src", "left_semi").join(ids.withColumnRenamed("vid", "dst"), "dst", "left_semi").join(taken, ["src", "dst", "label"], "left_anti")
    forward = fresh.withColumn("is_reverse", F.lit(False))
    back = fresh.filter(F.col("undirected") & (F.col("src") != F.col("dst"))).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "label", "props", "undirected", F.lit(True).alias("is_reverse"))
    back = back.join(taken, ["src", "dst", "label"], "left_anti").join(forward.select("src", "dst", "label"), ["src", "dst", "label"], "left_anti")
    return PropertyGraph(g.vertices, g.edges.unionByName(forward).unionByName(back))


def add_edge(g: PropertyGraph, src: int, dst: int, label: str, props: Mapping[str, str], undirected: bool = False) -> PropertyGraph:
    one = g.edges.sparkSession.createDataFrame([(src, dst, label, dict(props), undirected, False)], EDGE_DDL)
    return add_edges(g, one)


def rm_vertices(g: PropertyGraph, gone: DataFrame) -> PropertyGraph:
    """Remove the vertices of ``gone`` (vid) and every edge at them."""
    ids = gone.select("vid")
    edges = g.edges.join(ids.withColumnRenamed("vid", "src"), "src", "left_anti").join(ids.withColumnRenamed("vid", "dst"), "dst", "left_anti")
    return PropertyGraph(g.vertices.join(ids, "vid", "left_anti"), edges.select(*g.edges.columns))


def rm_vertex(g: PropertyGraph, vid: int) -> PropertyGraph:
    return PropertyGraph(g.vertices.filter(F.col("vid") != vid), g.edges.filter((F.col("src") != vid) & (F.col("dst") != vid)))


def _between(src: int, dst: int, label: str | None) -> Column:
    at = (F.col("src") == src) & (F.col("dst") == dst)
    return at if label is None else at & (F.col("label") == label)


def rm_edge(g: PropertyGraph, src: int, dst: int, label: str | None = None) -> PropertyGraph:
    """Remove the edges from src to dst, of one label or of all; a reverse record stays."""
    return PropertyGraph(g.vertices, g.edges.filter(~_between(src, dst, label)))


def rm_undirected(g: PropertyGraph, a: int, b: int, label: str) -> tuple[PropertyGraph, DataFrame]:
    """Remove both records of an undirected edge; also a row with the number of edges removed."""
    both = _between(a, b, label) | _between(b, a, label)
    return PropertyGraph(g.vertices, g.edges.filter(~both)), g.edges.filter(both & ~F.col("is_reverse")).agg(F.count(F.lit(1)).alias("deleted"))


def count_edges(g: PropertyGraph, src: int, dst: int, label: str) -> DataFrame:
    return g.edges.filter(_between(src, dst, label)).agg(F.count(F.lit(1)).alias("deleted"))


def prune(g: PropertyGraph) -> PropertyGraph:
    """Drop edges either end of which is no vertex."""
    ids = g.vertices.select("vid")
    kept = g.edges.join(ids.withColumnRenamed("vid", "dst"), "dst", "left_semi").join(ids.withColumnRenamed("vid", "src"), "src", "left_semi")
    return PropertyGraph(g.vertices, kept.select(*g.edges.columns))

"""The labelled property graph: look-ups, patterns, degrees and statistics as plain DataFrame plans.

Predicates are Columns, so Catalyst pushes them into the scan. Ids are external BIGINTs. An unknown label, id or
relation gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.props import has_label, key_values
from weft.session import stage

VERTEX_DDL = "vid bigint, labels array<string>, props map<string,string>"
EDGE_DDL = "src bigint, dst bigint, label string, props map<string,string>, undirected boolean, is_reverse boolean"


@dataclass(frozen=True)
class PropertyGraph:
    """Two DataFrames: vertices (vid, labels, props) and edges (src, dst, label, props, undirected, is_reverse).

    An undirected edge is two records, the second with is_reverse set.
    """

    vertices: DataFrame
    edges: DataFrame

    @classmethod
    def from_edges(cls, edges: DataFrame) -> PropertyGraph:
        """The graph whose vertices are the endpoints of ``edges`` (src, dst and whatever else they have); parallel edges stay."""
        have = set(edges.columns)
        full = edges.select(
            F.col("src").cast("bigint"),
            F.col("dst").cast("bigint"),
            F.col("label") if "label" in have else F.lit("").alias("label"),
            F.col("props") if "props" in have else F.create_map().cast("map<string,string>").alias("props"),
            F.col("undirected") if "undirected" in have else F.lit(False).alias("undirected"),
            F.col("is_reverse") if "is_reverse" in have else F.lit(False).alias("is_reverse"),
        )
        ends = full.select(F.explode(F.array("src", "dst")).alias("vid")).distinct()
        return cls(ends.select("vid", F.array().cast("array<string>").alias("labels"), F.create_map().cast("map<string,string>").alias("props")), full)

    @property
    def stored(self) -> bool:
        """Whether ids and links are read from files, so that reading them twice costs little."""
        return False

    @property
    def ids(self) -> DataFrame:
        """vid of all vertices."""
        return self.vertices.select("vid")

    @property
    def links(self) -> DataFrame:
        """src, dst of all edges; for algorithms that need no more."""
        return self.edges.select("src", "dst")

    # vertices

    def vertex(self, vid: int) -> DataFrame:
        return self.vertices.filter(F.col("vid") == vid)

    def vertex_exists(self, vid: int) -> DataFrame:
        return self.vertex(vid).select("vid")

    def vertices_where(self, predicate: Column) -> DataFrame:
        """vid, labels, outdegree, indegree, property_c and edge_label_c of the vertices for which ``predicate`` holds on them."""
        out = self.edges.groupBy(F.col("src").alias("vid")).agg(F.count(F.lit(1)).alias("outdegree"), F.count_distinct("label").alias("edge_label_c"))
        into = self.edges.groupBy(F.col("dst").alias("vid")).agg(F.count(F.lit(1)).alias("indegree"))
        meta = self.vertices.select("vid", "labels", F.size("props").cast("bigint").alias("property_c")).join(out, "vid", "left").join(into, "vid", "left")
        return meta.fillna(0, ["outdegree", "indegree", "edge_label_c"]).filter(predicate)

    def with_label(self, label: str) -> DataFrame:
        return self.vertices.filter(has_label(label))

    def preview(self, n: int = 5) -> DataFrame:
        """The first ``n`` vertices by id with their out-degree."""
        first = self.vertices.select("vid").orderBy("vid").limit(n)
        return first.join(self.edges.select(F.col("src").alias("vid"), F.lit(1).alias("one")), "vid", "left").groupBy("vid").agg(F.count("one").alias("outdegree"))

    # edges

    def _ids(self, label: str, column: str) -> DataFrame:
        return self.with_label(label).select(F.col("vid").alias(column))

    def edges_where(self, predicate: Column) -> DataFrame:
        return self.edges.filter(predicate)

    def edges_of(self, rel: str) -> DataFrame:
        return self.edges.filter(F.col("label") == rel)

    def between(self, src: int, dst: int, rel: str | None = None) -> DataFrame:
        e = self.edges.filter((F.col("src") == src) & (F.col("dst") == dst))
        return e if rel is None else e.filter(F.col("label") == rel)

    def edge_exists(self, src: int, rel: str, dst: int) -> DataFrame:
        return self.between(src, dst, rel).select("src", "dst", "label").limit(1)

    def pattern(self, source: str | int | None = None, rel: str | None = None, target: str | int | None = None, predicate: Column | None = None) -> DataFrame:
        """Edges ``(source)-[rel]->(target)``; an end is a label, an id or, if None, anything."""
        e = self.edges if rel is None else self.edges_of(rel)
        if predicate is not None:
            e = e.filter(predicate)
        for end, column in ((source, "src"), (target, "dst")):
            if isinstance(end, str):
                e = e.join(self._ids(end, column), column, "left_semi")
            elif end is not None:
                e = e.filter(F.col(column) == end)
        return e

    def neighbours(self, vid: int, rel: str | None = None, target: str | None = None, predicate: Column | None = None) -> DataFrame:
        return self.pattern(vid, rel, target, predicate).select("dst").distinct()

    def path(self, vid: int, hops: list[tuple[str, str]]) -> DataFrame:
        """The edges of the last hop of a path of fixed length; each hop is (relation, label of its target)."""
        spark = self.vertices.sparkSession
        last = self.edges.limit(0)
        frontier = spark.range(1).select(F.lit(vid).cast("bigint").alias("src"))
        for i, (rel, label) in enumerate(hops):
            last = self.pattern(None, rel, label).join(frontier, "src", "left_semi") if i else self.pattern(vid, rel, label)
            frontier = last.select(F.col("dst").alias("src")).distinct()
        return last

    def inverse(self) -> DataFrame:
        return self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "label")

    # properties

    def vertex_properties(self, vid: int) -> DataFrame:
        return key_values(self.vertex(vid), "vid")

    def edge_properties(self, predicate: Column) -> DataFrame:
        return key_values(self.edges.filter(predicate), "src", "dst", "label")

    # statistics

    def summary(self) -> DataFrame:
        """One row: num_vertices, num_edges (undirected ones once), num_edge_records, label counts, avg_out_degree."""
        v = self.vertices.agg(F.count(F.lit(1)).alias("num_vertices"))
        vl = self.vertices.select(F.explode("labels").alias("l")).agg(F.count_distinct("l").alias("num_vertex_labels"))
        e = self.edges.agg(F.coalesce(F.sum(F.when(F.col("is_reverse"), 0).otherwise(1)), F.lit(0)).cast("bigint").alias("num_edges"), F.count(F.lit(1)).alias("num_edge_records"), F.count_distinct("label").alias("num_edge_labels"))
        # three single rows
        one = v.crossJoin(vl).crossJoin(e)
        return one.withColumn("avg_out_degree", F.round(F.when(F.col("num_vertices") > 0, F.col("num_edges") / F.col("num_vertices")), 4))

    def vertex_label_counts(self) -> DataFrame:
        return self.vertices.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("item_c"))

    def edge_label_counts(self) -> DataFrame:
        return self.edges.filter(~F.col("is_reverse")).groupBy("label").agg(F.count(F.lit(1)).alias("item_c"))

    def label_dictionary(self) -> DataFrame:
        v = self.vertices.select(F.lit("vertex").alias("kind"), F.explode("labels").alias("label"))
        return v.unionByName(self.edges.select(F.lit("edge").alias("kind"), "label")).distinct()

    def degree_of(self, vid: int, end: str) -> DataFrame:
        return self.edges.filter(F.col(end) == vid).agg(F.count(F.lit(1)).alias("degree")).select(F.lit(vid).cast("bigint").alias("vid"), "degree")

    def degrees(self, end: str) -> DataFrame:
        counts = self.edges.groupBy(F.col(end).alias("vid")).agg(F.count(F.lit(1)).alias("degree"))
        return self.vertices.select("vid").join(counts, "vid", "left").fillna(0, ["degree"])

    def dense_ids(self) -> DataFrame:
        """vid, idx: each vertex's rank by id from 0, by ranges of ids whose sizes are summed up."""
        return dense_rank(self.vertices.select("vid"), "vid", "idx")

    def symmetric(self) -> DataFrame:
        """src, dst in both directions, once, without self-loops."""
        one = self.edges.select("src", "dst").filter(F.col("src") != F.col("dst"))
        return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def dense_rank(df: DataFrame, by: str, name: str) -> DataFrame:
    """Ranks from 0 over a unique column without a single-task window: sorted ranges are written once, their sizes added up.

    A row's place in its range comes with the write, so nothing is compared with range borders and no window is needed.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    at = F.monotonically_increasing_id()
    placed = stage(df.repartitionByRange(parts, by).sortWithinPartitions(by).withColumn("__at", at), "ranks")
    placed = placed.withColumn("__range", F.shiftright("__at", 33)).withColumn("__local", F.col("__at").bitwiseAND((1 << 33) - 1))
    # one row for each shuffle partition
    sizes = placed.groupBy("__range").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("__range", F.coalesce(F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    return placed.join(F.broadcast(starts), "__range").select(*df.columns, (F.col("__start") + F.col("__local")).cast("bigint").alias(name))


def write_edges(edges: DataFrame, path: str) -> None:
    """Write edges in a folder for each label.

    Rebalancing brings a label's rows together and divides them by their measured bytes, so that a small label is one file and a large one as many
    as it needs, whatever its heaviest vertex. Within a file rows are sorted by src, which row groups can be skipped by.
    """
    edges.hint("rebalance", "label").sortWithinPartitions("label", "src").write.partitionBy("label").parquet(path)

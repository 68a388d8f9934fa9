"""Reader and writer of social-network benchmark snapshots in composite CSV.

Layout ``initial_snapshot/{static,dynamic}/{vertices,edges}``; each entity or relation is a CSV file (gzip allowed) or a folder
of part files with a header and | as separator. ``inserts`` and ``deletes`` must stand beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.props import prop
from weft.operators.graph import EDGE_DDL, VERTEX_DDL, PropertyGraph, dense_rank
from weft.session import hadoop_fs

UNDIRECTED = frozenset({"knows"})
MESSAGES = frozenset({"Post", "Comment"})
# Names that edge files use for parts of a vertex file.
ALIASES = {"City": "Place", "Country": "Place", "Continent": "Place", "Company": "Organisation", "University": "Organisation"}
# Vertex files of the static part; edges between these alone are static as well.
STATIC = frozenset({"Place", "Tag", "TagClass", "Organisation"})
# a private-use character stands for a quoted empty field, which the reader would take for null
_EMPTY = "\ue0e0"
_FORM = {"header": "true", "sep": "|", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def _entries(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """(stem, path) of the CSV files and folders in ``folder``; anything else is passed over."""
    fs, path = hadoop_fs(spark, folder)
    if not fs.exists(path):
        return []
    out = []
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        stem = name.removesuffix(".gz").removesuffix(".csv")
        if not name.startswith((".", "_")) and (status.isDirectory() or stem != name):
            out.append((stem, status.getPath().toString()))
    return sorted(out)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, under the header's names; no type is inferred and so no extra pass made. Quoted empty fields are empty, others null."""
    df = spark.read.options(**_FORM).option("multiLine", True).option("recursiveFileLookup", True).option("emptyValue", _EMPTY).csv(path)
    return df.select(*(F.when(F.col(f"`{c}`") == _EMPTY, "").otherwise(F.col(f"`{c}`")).alias(c) for c in df.columns))


def _props(df: DataFrame, names: list[str]):
    pairs = [x for n in names for x in (F.lit(n), F.col(f"`{n}`"))]
    return (F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")).alias("props")


def load_vertex_file(df: DataFrame, stem: str) -> DataFrame:
    """vid, labels, props: labels are the file's stem, the value of a column ``type``, and Message for posts and comments."""
    fixed = [F.lit(stem)] + ([F.initcap("type")] if "type" in df.columns else []) + ([F.lit("Message")] if stem in MESSAGES else [])
    rest = [c for c in df.columns if c not in ("id", "type")]
    return df.select(F.col("id").cast("bigint").alias("vid"), F.array_compact(F.array(*fixed)).alias("labels"), _props(df, rest))


def load_edge_file(df: DataFrame, stem: str, dynamic: bool) -> DataFrame:
    """Edges of a file ``Source_relation_Target``; ids stand in columns 0 and 1, in dynamic files in 1 and 2."""
    label = stem.split("_")[1]
    at = 1 if dynamic else 0
    src, dst = df.columns[at], df.columns[at + 1]
    rest = [c for c in df.columns if c not in (src, dst)]
    forward = df.select(F.col(f"`{src}`").cast("bigint").alias("src"), F.col(f"`{dst}`").cast("bigint").alias("dst"), F.lit(label).alias("label"), _props(df, rest), F.lit(label in UNDIRECTED).alias("undirected"), F.lit(False).alias("is_reverse"))
    if label not in UNDIRECTED:
        return forward
    return forward.unionByName(forward.filter(F.col("src") != F.col("dst")).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "label", "props", "undirected", F.lit(True).alias("is_reverse")))


def read_snb(spark: SparkSession, root: str, remap: bool = False) -> PropertyGraph:
    """The graph of the initial snapshot; with ``remap`` under dense ids, for files whose ids are unique only within them."""
    for part in ("initial_snapshot", "inserts", "deletes"):
        fs, path = hadoop_fs(spark, f"{root}/{part}")
        if not fs.exists(path):
            raise FileNotFoundError(f"{root} has no {part}")
    v, e = {}, []
    for kind in ("static", "dynamic"):
        for stem, path in _entries(spark, f"{root}/initial_snapshot/{kind}/vertices"):
            v[stem] = load_vertex_file(read_csv(spark, path), stem)
        for stem, path in _entries(spark, f"{root}/initial_snapshot/{kind}/edges"):
            e.append((stem, load_edge_file(read_csv(spark, path), stem, kind == "dynamic")))
    if remap:
        ids = remap_ids(v)
        e = [(stem, remap_edges(df, stem, ids)) for stem, df in e]
        v = {stem: df.join(ids.filter(F.col("tab") == stem).select("vid", "new_id"), "vid").select(F.col("new_id").alias("vid"), "labels", "props") for stem, df in v.items()}
    vertices, edges = spark.createDataFrame([], VERTEX_DDL), spark.createDataFrame([], EDGE_DDL)
    for df in v.values():
        vertices = vertices.unionByName(df)
    for _, df in e:
        edges = edges.unionByName(df)
    return PropertyGraph(vertices, edges)


def remap_ids(tables: dict[str, DataFrame], key: str = "vid") -> DataFrame:
    """tab, vid, new_id: dense ids over all tables, table after table in the order given, by id within each."""
    out = None
    for i, (name, df) in enumerate(tables.items()):
        one = df.select(F.lit(i).alias("t"), F.lit(name).alias("tab"), F.col(key).alias("vid")).distinct()
        out = one if out is None else out.unionByName(one)
    # one sort over (place of the table, id), which is unique
    return dense_rank(out.withColumn("__by", F.struct("t", "vid")), "__by", "new_id").select("tab", "vid", "new_id")


def remap_edges(edges: DataFrame, stem: str, ids: DataFrame) -> DataFrame:
    """Edges of the file ``stem`` under the ids of ``remap_ids``; ends without one keep theirs. A file may name a part of a vertex file."""
    source, _, target = stem.split("_")
    out = edges
    for end, name in (("src", source), ("dst", target)):
        one = ids.filter(F.col("tab") == ALIASES.get(name, name)).select(F.col("vid").alias(f"__{end}"), F.col("new_id").alias(f"__new_{end}"))
        # the reverse of an undirected edge has its ends the other way round
        if source != target:
            at = F.when(F.col("is_reverse"), F.col("dst" if end == "src" else "src")).otherwise(F.col(end))
            out = out.withColumn("__at", at).join(one, F.col("__at") == F.col(f"__{end}"), "left").drop("__at", f"__{end}")
        else:
            out = out.join(one, F.col(end) == F.col(f"__{end}"), "left").drop(f"__{end}")
    if source != target:
        a, b = F.when(F.col("is_reverse"), F.col("__new_dst")).otherwise(F.col("__new_src")), F.when(F.col("is_reverse"), F.col("__new_src")).otherwise(F.col("__new_dst"))
    else:
        a, b = F.col("__new_src"), F.col("__new_dst")
    return out.select(F.coalesce(a, "src").alias("src"), F.coalesce(b, "dst").alias("dst"), "label", "props", "undirected", "is_reverse")


def _stem() -> Column:
    has = lambda x: F.array_contains("labels", x)
    return F.when(has("Place"), "Place").when(has("Organisation"), "Organisation").otherwise(F.coalesce(F.element_at("labels", 1), F.lit("Vertex")))


def write_snb(g: PropertyGraph, root: str) -> None:
    """Write a graph as an initial snapshot that ``read_snb`` reads: a folder of CSV files for each kind of vertex, and for each relation of two kinds.

    The second label of a place or organisation becomes its ``type``. Undirected edges are written once.
    """
    spark = g.vertices.sparkSession
    v = g.vertices.withColumn("stem", _stem())
    # as many as there are kinds of vertices, and names of properties
    kinds = v.groupBy("stem").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.map_keys("props"))))).alias("names")).collect()
    for row in kinds:
        rest = F.filter("labels", lambda x: ~x.isin(row["stem"], "Message"))
        typed = [F.lower(F.get(rest, F.lit(0))).alias("type")] if row["stem"] in ("Place", "Organisation") else []
        # sets of names differ from row to row only in what is null
        df = v.filter(F.col("stem") == row["stem"]).select(F.col("vid").alias("id"), *typed, *(F.col("props")[n].alias(n) for n in row["names"]))
        df.write.options(**_FORM).csv(f"{root}/initial_snapshot/{'static' if row['stem'] in STATIC else 'dynamic'}/vertices/{row['stem']}")
    names = [r["k"] for r in g.edges.select(F.explode(F.map_keys("props")).alias("k")).distinct().collect()]
    stems = v.select("vid", "stem")
    e = g.edges.filter(~F.col("is_reverse")).join(stems.select(F.col("vid").alias("src"), F.col("stem").alias("a")), "src").join(stems.select(F.col("vid").alias("dst"), F.col("stem").alias("b")), "dst")
    e = e.withColumn("static", F.col("a").isin(*STATIC) & F.col("b").isin(*STATIC)).withColumn("stem", F.concat_ws("_", "a", "label", "b"))
    ends = [F.col("src").alias("SourceId"), F.col("dst").alias("TargetId")]
    rest = [prop(n) for n in sorted(names) if n != "creationDate"]
    for static in (True, False):
        columns = [*ends, *rest] if static else [prop("creationDate"), *ends, *rest]
        at = f"{root}/initial_snapshot/{'static' if static else 'dynamic'}/edges"
        e.filter(F.col("static") == static).select("stem", *columns).write.options(**_FORM).partitionBy("stem").csv(at)
        fs, path = hadoop_fs(spark, at)
        for status in fs.listStatus(path):
            name = status.getPath().getName()
            if name.startswith("stem="):
                fs.rename(status.getPath(), hadoop_fs(spark, f"{at}/{name.removeprefix('stem=')}")[1])
    for part in ("inserts", "deletes"):
        fs, path = hadoop_fs(spark, f"{root}/{part}")
        fs.mkdirs(path)

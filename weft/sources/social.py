"""The property graph of the social-network tables, loaded once per session and data directory.

A vertex is a key with a row that is not deleted, and has the values of the last loaded such row. An edge needs both ends among
the vertices of the tables its label joins and counts once for each (src, dst, label), with the values of its
smallest edge_id. ``knows`` is undirected. hasCreator comes from message.personId, isPartOf from place.part_of.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.props import props_of
from weft.operators.graph import PropertyGraph, write_edges
from weft.operators.orphans import ENDS
from weft.session import scratch_path
from weft.sources.tables import table

_TABLES = {
    "place": ("id", ("label", "name", "part_of")),
    "tag": ("id", ("name", "tag_class")),
    "forum": ("id", ("title", "creationDate")),
    "person": ("personId", ("firstName", "lastName", "creationDate")),
    "message": ("id", ("label", "content", "creationDate", "personId")),
}


def live(df: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """``key`` as vid and ``columns`` of the last loaded row of each key that has one not deleted."""
    rows = df.filter(F.col("deleted_at").isNull() & F.col(key).isNotNull())
    best = rows.groupBy(F.col(key).alias("vid")).agg(F.max(F.struct("loaded_at", *columns)).alias("r"))
    return best.select("vid", *(F.col(f"r.{c}").alias(c) for c in columns))


def _labels(name: str) -> Column:
    if name == "message":
        return F.array_compact(F.array("label", F.lit("Message")))
    if name == "place":
        return F.array_compact(F.array("label", F.lit("Place")))
    return F.array(F.lit(name.capitalize()))


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tab, vid, labels, props of all live vertices, with the columns hasCreator and isPartOf come from."""
    out = None
    for name, (key, columns) in _TABLES.items():
        rows = live(table(spark, sf_dir, name), key, columns)
        shown = {("tagClass" if c == "tag_class" else c): F.col(c) for c in columns if c not in ("label", "part_of", "personId")}
        owner = F.col("personId") if name == "message" else F.col("part_of") if name == "place" else F.lit(None).cast("bigint")
        one = rows.select(F.lit(name).alias("tab"), "vid", _labels(name).alias("labels"), props_of(**shown).alias("props"), owner.alias("owner"))
        out = one if out is None else out.unionByName(one)
    return out


def _edges(raw: DataFrame, v: DataFrame) -> DataFrame:
    ids = v.select("tab", "vid")
    typed = F.create_map(*(x for name, (a, b) in ENDS.items() for x in (F.lit(name.lower()), F.struct(F.lit(name).alias("label"), F.lit(a).alias("a"), F.lit(b).alias("b")))))
    e = raw.filter(F.col("src").isNotNull() & F.col("dst").isNotNull()).select("edge_id", "src", "dst", F.element_at(typed, F.lower("label")).alias("t"), "property_c", "creationDate").filter(F.col("t").isNotNull())
    e = e.select("edge_id", "src", "dst", "t.*", props_of(creationDate=F.col("creationDate"), property_c=F.col("property_c")).alias("props"))
    e = e.withColumn("e", F.struct("edge_id", "src", "dst", F.map_entries("props").alias("p")))
    knows = F.col("label") == "knows"
    low, high = F.when(knows, F.least("src", "dst")).otherwise(F.col("src")), F.when(knows, F.greatest("src", "dst")).otherwise(F.col("dst"))
    first = e.groupBy(low.alias("x"), high.alias("y"), "label", "a", "b").agg(F.min("e").alias("e")).select("label", "a", "b", "e.src", "e.dst", F.map_from_entries("e.p").alias("props"))
    for end, side in (("src", "a"), ("dst", "b")):
        first = first.join(ids.select(F.col("tab").alias(side), F.col("vid").alias(end)), [side, end], "left_semi")
    own = v.filter(F.col("owner").isNotNull()).select(F.col("vid").alias("src"), F.col("owner").alias("dst"), "tab", F.create_map().cast("map<string,string>").alias("props"))
    made = own.join(ids.select(F.when(F.col("tab") == "person", "message").when(F.col("tab") == "place", "place").alias("tab"), F.col("vid").alias("dst")), ["tab", "dst"], "left_semi")
    made = made.select("src", "dst", F.when(F.col("tab") == "message", "hasCreator").otherwise("isPartOf").alias("label"), "props")
    forward = first.select("src", "dst", "label", "props").unionByName(made).withColumn("undirected", F.col("label") == "knows").withColumn("is_reverse", F.lit(False))
    back = forward.filter(F.col("undirected") & (F.col("src") != F.col("dst"))).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "label", "props", "undirected", F.lit(True).alias("is_reverse"))
    return forward.unionByName(back)


_loaded: dict[tuple[str, str], str] = {}


def _stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of ``sf_dir``, written to the shared folder at their first use in a session; edges are partitioned by label."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _loaded:
        path = scratch_path(spark, "graph", lasting=True)
        vertices(spark, sf_dir).write.parquet(f"{path}/v")
        v = spark.read.parquet(f"{path}/v")
        write_edges(_edges(table(spark, sf_dir, "edges"), v), f"{path}/e")
        _loaded[key] = path
    path = _loaded[key]
    v = spark.read.schema("tab string, vid bigint, labels array<string>, props map<string,string>").parquet(f"{path}/v").select("vid", "labels", "props")
    e = spark.read.schema("src bigint, dst bigint, props map<string,string>, undirected boolean, is_reverse boolean, label string").parquet(f"{path}/e")
    return v, e.select("src", "dst", "label", "props", "undirected", "is_reverse")


def _owners(messages: DataFrame) -> DataFrame:
    """id, personId of live messages. Whole rows, whose ties need every column, are compared only for keys whose rows differ in their person."""
    rows = messages.filter(F.col("deleted_at").isNull() & F.col("id").isNotNull())
    each = rows.groupBy("id").agg(F.min("personId").alias("least"), F.max("personId").alias("personId"), (F.count("personId") < F.count(F.lit(1))).alias("gaps"))
    # without a person in any row, both are null
    same = F.col("least").isNull() | ((F.col("least") == F.col("personId")) & ~F.col("gaps"))
    unclear = live(messages.join(each.filter(~same).select("id"), "id", "left_semi"), *_TABLES["message"])
    return each.filter(same).select("id", "personId").unionByName(unclear.select(F.col("vid").alias("id"), "personId"))


_linked: dict[tuple[str, str], str] = {}


def _topology(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The vid of all vertices, and src and dst of all edges as in ``_edges``, without reading or writing their properties; written at their first use in a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _linked:
        path = scratch_path(spark, "topology", lasting=True)
        ids = None
        for i, name in enumerate(_TABLES):
            column = _TABLES[name][0]
            rows = table(spark, sf_dir, name)
            one = _owners(rows).select(F.lit(i).alias("tab"), F.col("id").alias("vid"), F.col("personId").alias("owner")) if name == "message" else (
                live(rows, *_TABLES[name]).select(F.lit(i).alias("tab"), "vid", F.col("part_of").alias("owner")) if name == "place"
                else rows.filter(F.col("deleted_at").isNull() & F.col(column).isNotNull()).select(F.lit(i).alias("tab"), F.col(column).alias("vid")).distinct().withColumn("owner", F.lit(None).cast("bigint"))
            )
            ids = one if ids is None else ids.unionByName(one)
        ids.write.parquet(f"{path}/v")
        v = spark.read.schema("tab int, vid bigint, owner bigint").parquet(f"{path}/v")
        tabs, labels = list(_TABLES), list(ENDS)
        number = F.create_map(*(x for i, label in enumerate(labels) for x in (F.lit(label.lower()), F.lit(i))))
        ends = F.array(*(F.struct(F.lit(tabs.index(a)).alias("a"), F.lit(tabs.index(b)).alias("b")) for a, b in ENDS.values()))
        e = table(spark, sf_dir, "edges").filter(F.col("src").isNotNull() & F.col("dst").isNotNull()).select("src", "dst", F.element_at(number, F.lower("label")).alias("k")).filter(F.col("k").isNotNull())
        knows = F.col("k") == labels.index("knows")
        e = e.select("k", F.when(knows, F.least("src", "dst")).otherwise(F.col("src")).alias("src"), F.when(knows, F.greatest("src", "dst")).otherwise(F.col("dst")).alias("dst")).distinct()
        e = e.select("k", "src", "dst", ends[F.col("k")].alias("t")).select("k", "src", "dst", "t.a", "t.b")
        for end, side in (("src", "a"), ("dst", "b")):
            e = e.join(v.select(F.col("tab").alias(side), F.col("vid").alias(end)).hint("shuffle_hash"), [side, end], "left_semi")
        e = e.select("src", "dst", F.explode(F.when(knows & (F.col("src") != F.col("dst")), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("back"))
        both = e.select(F.when(F.col("back"), F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(F.col("back"), F.col("src")).otherwise(F.col("dst")).alias("dst"))
        message, person, place = (F.lit(tabs.index(t)) for t in ("message", "person", "place"))
        own = v.filter(F.col("owner").isNotNull()).select(F.col("vid").alias("src"), F.col("owner").alias("dst"), F.when(F.col("tab") == message, person).otherwise(place).alias("tab"))
        made = own.join(v.select("tab", F.col("vid").alias("dst")).hint("shuffle_hash"), ["tab", "dst"], "left_semi").select("src", "dst")
        both.unionByName(made).write.parquet(f"{path}/e")
        _linked[key] = path
    path = _linked[key]
    return spark.read.schema("tab int, vid bigint, owner bigint").parquet(f"{path}/v").select("vid"), spark.read.schema("src bigint, dst bigint").parquet(f"{path}/e")


class _SocialGraph(PropertyGraph):
    """Loads what is asked for: properties and labels, or ``ids`` and ``links`` alone."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        object.__setattr__(self, "_of", (spark, sf_dir))

    @property
    def vertices(self) -> DataFrame:
        return _stored(*self._of)[0]

    @property
    def edges(self) -> DataFrame:
        return _stored(*self._of)[1]

    @property
    def stored(self) -> bool:
        return True

    @property
    def _full(self) -> bool:
        spark, sf_dir = self._of
        return (spark.sparkContext.applicationId, sf_dir) in _loaded

    @property
    def ids(self) -> DataFrame:
        return super().ids if self._full else _topology(*self._of)[0]

    @property
    def links(self) -> DataFrame:
        return super().links if self._full else _topology(*self._of)[1]


def social_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The graph of ``sf_dir``."""
    return _SocialGraph(spark, sf_dir)

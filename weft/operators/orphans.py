"""References to records that do not exist: orphan edge ends, per edge and per table and period.

References are first counted per key and period (map-side combined), so that a key is checked once however
often it is named. Keys holding a fixed share of all references, or more of them than a task's budget, whose number
is bounded, are checked against broadcast states; all other keys go through a shuffle join. Only the
edges that name an orphan key are then looked up again, the same split applied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.operators.heavy import heavy_keys
from weft.session import stage

# Vertex tables at the two ends of an edge, by label.
ENDS = {
    "knows": ("person", "person"),
    "likes": ("person", "message"),
    "hasInterest": ("person", "tag"),
    "replyOf": ("message", "message"),
    "hasTag": ("message", "tag"),
    "isLocatedIn": ("person", "place"),
    "hasMember": ("forum", "person"),
    "containerOf": ("forum", "message"),
}
#: A key with at least this share of all references is heavy, or one beyond the row budget of ``heavy_keys``.
HEAVY_SHARE = 0.002


def vertex_rows(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """tab, id, loaded_at, gone of every row of the vertex tables; ``tables``: name -> (DataFrame, id column)."""
    out = None
    for name, (df, key) in tables.items():
        one = df.select(F.lit(name).alias("tab"), F.col(key).cast("bigint").alias("id"), F.col("loaded_at"), F.col("deleted_at").isNotNull().alias("gone")).filter(F.col("id").isNotNull())
        out = one if out is None else out.unionByName(one)
    return out


def vertex_states(rows: DataFrame) -> DataFrame:
    """tab, id, first_loaded, gone (every row deleted) of each vertex."""
    return rows.groupBy("tab", "id").agg(F.min("loaded_at").alias("first_loaded"), F.min("gone").alias("gone"))


def _end_table(label: Column, side: int) -> Column:
    pairs = [x for name, ends in ENDS.items() for x in (F.lit(name.lower()), F.lit(ends[side]))]
    return F.element_at(F.create_map(*pairs), F.lower(label))


def references(edges: DataFrame) -> DataFrame:
    """edge_id, endpoint, tab, id, loaded_at of each non-null end whose label is known."""
    ends = F.array(
        F.struct(F.lit("src").alias("endpoint"), _end_table(F.col("label"), 0).alias("tab"), F.col("src").alias("id")),
        F.struct(F.lit("dst").alias("endpoint"), _end_table(F.col("label"), 1).alias("tab"), F.col("dst").alias("id")),
    )
    return edges.select("edge_id", "loaded_at", F.explode(ends).alias("e")).select("edge_id", "loaded_at", "e.endpoint", "e.tab", "e.id").filter(F.col("tab").isNotNull() & F.col("id").isNotNull())


def _reason(loaded: Column) -> Column:
    return (
        F.when(F.col("gone").isNull(), "missing")
        .when(F.col("gone"), "deleted")
        .when(F.col("first_loaded") > loaded, "late")
    )


class OrphanCheck:
    """The shared stages of the check; build once, ask for ``rows()`` and ``counts()``.

    An end is ``missing`` if its id is not in its table, ``deleted`` if every row of it is deleted, ``late`` if it was first loaded
    after the edge (never where a loading time is null). Null ends and ends of unknown or null labels are no case;
    edge rows repeated under one edge_id each count in ``counts()`` and give one row in ``rows()``; empty tables on
    either side are allowed; further columns are ignored.
    """

    def __init__(self, edges: DataFrame, tables: dict[str, tuple[DataFrame, str]], heavy_share: float = HEAVY_SHARE) -> None:
        self.refs = references(edges)
        period = F.date_format("loaded_at", "yyyy-MM").alias("period")
        self.keyed = stage(self.refs.groupBy("tab", "id", period).agg(F.count(F.lit(1)).alias("n"), F.min("loaded_at").alias("earliest")), "references")
        self.heavy = heavy_keys(self.keyed, ["tab", "id"], heavy_share, weight="n").select("tab", "id")
        per_key = self.keyed.groupBy("tab", "id").agg(F.min("earliest").alias("earliest"))
        rows = vertex_rows(tables)
        light_keys = per_key.join(F.broadcast(self.heavy), ["tab", "id"], "left_anti").join(vertex_states(rows), ["tab", "id"], "left")
        # few vertices are heavy: their rows are picked by broadcast and never shuffled with the rest
        heavy_states = vertex_states(rows.join(F.broadcast(self.heavy), ["tab", "id"], "left_semi"))
        heavy_keyed = per_key.join(F.broadcast(self.heavy), ["tab", "id"], "left_semi").join(F.broadcast(heavy_states), ["tab", "id"], "left")
        keep = ["tab", "id", "first_loaded", "gone"]
        wrong = _reason(F.col("earliest")).isNotNull()
        self.light_orphans = stage(light_keys.filter(wrong).select(*keep), "orphans")
        self.heavy_orphans = stage(heavy_keyed.filter(wrong).select(*keep).coalesce(1), "orphans")

    def rows(self) -> DataFrame:
        """edge_id, endpoint, reason (and tab, period) of each orphan end."""
        cols = ["edge_id", "endpoint", _reason(F.col("loaded_at")).alias("reason"), "tab", F.date_format("loaded_at", "yyyy-MM").alias("period")]
        heavy_refs = self.refs.join(F.broadcast(self.heavy_orphans), ["tab", "id"]).select(*cols)
        # references to heavy keys never meet light_orphans; without them no join key is heavy
        light_refs = self.refs.join(F.broadcast(self.heavy), ["tab", "id"], "left_anti").join(self.light_orphans, ["tab", "id"]).select(*cols)
        return heavy_refs.unionByName(light_refs).filter(F.col("reason").isNotNull())

    def counts(self) -> DataFrame:
        """tab, period, reason, n: orphan ends per vertex table and month of the edge's loaded_at."""
        whole = None
        for orphans, how in ((self.heavy_orphans, F.broadcast), (self.light_orphans, lambda x: x)):
            lasting = orphans.filter(F.col("gone").isNull() | F.col("gone"))
            part = self.keyed.join(how(lasting), ["tab", "id"]).select("tab", "period", F.when(F.col("gone").isNull(), "missing").otherwise("deleted").alias("reason"), "n")
            whole = part if whole is None else whole.unionByName(part)
        late = self.rows().filter(F.col("reason") == "late").select("tab", "period", "reason", F.lit(1).cast("bigint").alias("n"))
        return whole.unionByName(late).groupBy("tab", "period", "reason").agg(F.sum("n").alias("n"))

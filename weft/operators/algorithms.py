"""Iterative graph algorithms: each round is one DataFrame job whose state is written to the shared folder.

Only counters and single sums return to the driver. Rounds read the state of the round before from Parquet, so plans do
not grow and the loss of an executor costs one round's tasks.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from weft.operators import onetask
from weft.operators.graph import PropertyGraph
from weft.session import Bucketed, bucket, remove, scratch_path, stage, unbucket

log = logging.getLogger(__name__)

_registry: dict[str, Callable[..., DataFrame]] = {}


def register_algorithm(name: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Make an algorithm (graph, **options) -> DataFrame available to run_algorithm by name."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        _registry[name] = f
        return f

    return add


def algorithm_table() -> dict[str, Callable[..., DataFrame]]:
    return dict(_registry)


def run_algorithm(graph: PropertyGraph, name: str, **options) -> DataFrame | None:
    """Run a registered algorithm on a graph or on ``PropertyGraph.from_edges`` of a query's result; None for an unknown name."""
    f = _registry.get(name)
    if f is None:
        log.warning("no algorithm is named %s", name)
        return None
    began = time.monotonic()
    out = f(graph, **options)
    log.info("%s took %.1f s", name, time.monotonic() - began)
    return out


class ResultTable:
    """The results of a session: what ran, under which tag, for how long, and its DataFrame."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, str, float, DataFrame]] = []

    def run(self, tag: str, name: str, f: Callable[[], DataFrame]) -> DataFrame:
        """Keep the result of ``f``, a query or an algorithm, with the seconds its planning and rounds took."""
        began = time.monotonic()
        out = f()
        self.rows.append((tag, name, time.monotonic() - began, out))
        return out

    def get(self, tag: str) -> DataFrame | None:
        """The last result of a tag."""
        return next((df for t, _, _, df in reversed(self.rows) if t == tag), None)

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame([r[:3] for r in self.rows], "tag string, name string, seconds double")


class _State:
    """A DataFrame written in every round; the round before is removed once the next stands. With a ``key`` it is in buckets of it."""

    def __init__(self, df: DataFrame, name: str, key: str | None = None) -> None:
        self.spark, self.name, self.key, self.at = df.sparkSession, name, key, None
        self.set(df)

    def _write(self, df: DataFrame) -> tuple[str | None, str]:
        path = scratch_path(self.spark, self.name)
        if self.key is None:
            df.write.parquet(path)
            self.df = self.spark.read.schema(df.schema).parquet(path)
            return None, path
        table = bucket(df, self.key, path)
        self.df = self.spark.table(table)
        return table, path

    def keep(self, df: DataFrame) -> tuple[tuple[str | None, str], DataFrame] | None:
        """Write the next round and return the one before, which stands until ``forget`` or ``back`` is called with it."""
        last = self.at and (self.at, self.df)
        self.at = self._write(df)
        return last

    def forget(self, last: tuple[tuple[str | None, str], DataFrame] | None) -> None:
        if last:
            unbucket(self.spark, *last[0])

    def back(self, last: tuple[tuple[str | None, str], DataFrame]) -> None:
        """Take ``last`` again and remove what was written since."""
        self.drop()
        self.at, self.df = last

    def set(self, df: DataFrame) -> DataFrame:
        self.forget(self.keep(df))
        return self.df

    def drop(self) -> None:
        if self.at:
            unbucket(self.spark, *self.at)


class _Growing:
    """Rows added round by round, each round a folder of its own, so that none is written twice."""

    def __init__(self, first: DataFrame, name: str) -> None:
        self.spark, self.schema, self.path, self.rounds = first.sparkSession, first.schema, scratch_path(first.sparkSession, name), 0
        self.add(first)

    def add(self, rows: DataFrame) -> int:
        """Write the rows of a round; their number."""
        seen = Observation()
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{self.path}/round={self.rounds}")
        self.rounds += 1
        return seen.get["n"]

    @property
    def last(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/round={self.rounds - 1}")

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/round={i}" for i in range(self.rounds)))

    def drop(self) -> None:
        remove(self.spark, self.path)


#: Vertices and edges that one task may hold: by estimate some 400 MB of arrays while they are sorted. 4.6 million were measured.
ONE_TASK = 6_000_000


def _in_one(graph: PropertyGraph) -> _State | DataFrame | None:
    """The graph as rows (src, dst), vertices without dst, if one task can hold it; a larger one takes rounds of jobs."""
    both = graph.ids.select(F.col("vid").alias("src"), F.lit(None).cast("bigint").alias("dst")).unionByName(graph.links)
    if graph.stored:
        return both if both.count() <= ONE_TASK else None
    seen = Observation()
    rows = _State(both.observe(seen, F.count(F.lit(1)).alias("n")), "links")
    if seen.get["n"] <= ONE_TASK:
        return rows
    rows.drop()
    return None


def _solved(rows: _State | DataFrame, f: Callable, schema: str, name: str) -> DataFrame:
    """The result of ``f``, of ``onetask``, on all rows in one task, written."""
    staged = isinstance(rows, _State)
    out = stage((rows.df if staged else rows).coalesce(1).mapInArrow(f, schema), name)
    if staged:
        rows.drop()
    return out


def aggregate_messages(edges: DataFrame, state: DataFrame, message: Column, combine: Callable[[Column], Column]) -> DataFrame:
    """Send ``message`` (over the columns of ``state``, keyed by vid) along every edge and combine it at the target: vid, msg."""
    sent = edges.select("src", "dst").join(state, F.col("src") == F.col("vid")).select(F.col("dst").alias("vid"), message.alias("msg"))
    return sent.groupBy("vid").agg(combine(F.col("msg")).alias("msg"))


def pagerank(graph: PropertyGraph, iterations: int = 100, tolerance: float | None = 1e-7, damping: float = 0.85) -> tuple[DataFrame, float, int]:
    """Ranks (vid, rank), the last residual and the number of rounds.

    All edges count, parallel ones each. Teleport and dangling mass are spread evenly; the residual is the L1 distance of
    the last two rounds. Ranks sum to 1 but for rounding, which is taken out at the end. With ``tolerance`` None exactly ``iterations`` rounds run.
    """
    if (rows := _in_one(graph)) is not None:
        got = _solved(rows, lambda batches: onetask.pagerank(batches, iterations, tolerance, damping), "vid bigint, rank double, delta double, rounds int", "pr")
        last = got.select("delta", "rounds").first()
        return got.select("vid", "rank"), last["delta"] if last else 0.0, last["rounds"] if last else 0
    v = graph.ids
    n = v.count()
    if n == 0:
        return v.withColumn("rank", F.lit(0.0)), 0.0, 0
    out = graph.links.groupBy(F.col("src").alias("vid")).agg(F.count(F.lit(1)).alias("d"))
    # edges in buckets of src and state in buckets of vid, so a round shuffles the sums for targets only
    edges = Bucketed(graph.links, "src", "pr-edges")
    # a round's state is (vid, old, y, f) with the new rank y + spare and the share f of a rank that each edge carries; spare comes with the job that writes y
    y = _State(v.join(out, "vid", "left").select("vid", F.lit(0.0).alias("old"), F.lit(1.0 / n).alias("y"), (F.lit(damping) / F.col("d")).alias("f")), "pr", "vid")
    spare, done = 0.0, 0
    while done < iterations:
        x = y.df.select("vid", "old", (F.col("y") + F.lit(spare)).alias("rank"), "f")
        sent = x.filter("f is not null").select(F.col("vid").alias("src"), (F.col("rank") * F.col("f")).alias("m"))
        got = edges.df.join(sent.hint("shuffle_hash"), "src").groupBy(F.col("dst").alias("vid")).agg(F.sum("m").alias("y"))
        # the residual of the round before comes with this one, whose rows are dropped if that was small enough
        before, now = Observation(), Observation()
        new = x.observe(before, F.sum(F.abs(F.col("old") - F.col("rank"))).alias("delta")).join(got.hint("shuffle_hash"), "vid", "left")
        last = y.keep(new.select("vid", F.col("rank").alias("old"), F.coalesce("y", F.lit(0.0)).alias("y"), "f").observe(now, F.sum("y").alias("y")))
        if tolerance is not None and done and before.get["delta"] <= tolerance:
            y.back(last)
            break
        y.forget(last)
        spare, done = (1.0 - now.get["y"]) / n, done + 1
    edges.drop()
    new = F.col("y") + F.lit(spare)
    whole, delta = y.df.agg(F.sum(new), F.sum(F.abs(F.col("old") - new))).first()
    return y.df.select("vid", (new / F.lit(whole)).alias("rank")), float(delta), done


def wcc(graph: PropertyGraph) -> DataFrame:
    """vid, component: the smallest id reachable over edges in either direction, by alternating large and small stars.

    The number of rounds grows with the logarithm of the size; vertices without edges are their own component.
    """
    if (rows := _in_one(graph)) is not None:
        return _solved(rows, onetask.wcc, "vid bigint, component bigint", "wcc")
    v = graph.ids
    links = graph.links.filter(F.col("src") != F.col("dst")).select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    links = _State(links.join(v.withColumnRenamed("vid", "u"), "u", "left_semi").join(v.withColumnRenamed("vid", "v"), "v", "left_semi").select("u", "v"), "wcc")
    mark = None
    while True:
        both = links.df.unionByName(links.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = links.df.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v")).filter(F.col("u") != F.col("v")).distinct()
        large = _State(large, "wcc-large")
        low = large.df.groupBy("u").agg(F.min("v").alias("m"))
        small = large.df.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("p")).select("p.u", "p.v")
        # their number and checksum come with the job that writes them
        seen = Observation()
        links.set(small.filter(F.col("u") != F.col("v")).distinct().observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("mark")))
        large.drop()
        now = (seen.get["n"], seen.get["mark"])
        if now == mark:
            break
        mark = now
    return v.join(links.df.select(F.col("u").alias("vid"), F.col("v").alias("component")), "vid", "left").select("vid", F.coalesce("component", "vid").alias("component"))


def directed_min_label(graph: PropertyGraph, rounds: int | None = None) -> DataFrame:
    """vid, label after labels, starting as dense ranks, have gone along edges from src to dst only, the least winning.

    The vertex of greatest out-degree (first on a tie) swaps its first label with rank 0 and back at the end. Runs until no label changes;
    with ``rounds`` no longer than that, and warns if labels still changed.
    """
    ids = graph.dense_ids()
    hub = graph.degrees("src").join(ids, "vid").orderBy(F.col("degree").desc(), "idx").select("idx").first()
    if hub is None:
        return ids.select("vid", F.col("idx").alias("label"), "idx")
    hub = hub["idx"]
    swap = lambda c: F.when(c == 0, F.lit(hub)).when(c == hub, F.lit(0)).otherwise(c).cast("bigint")
    x = _State(ids.select("vid", "idx", swap(F.col("idx")).alias("label")), "labels")
    edges = Bucketed(graph.edges.select("src", "dst").distinct(), "src", "label-edges")
    done, moved = 0, 1
    while moved and (rounds is None or done < rounds):
        low = aggregate_messages(edges.df, x.df.select("vid", "label"), F.col("label"), F.min)
        seen = Observation()
        new = x.df.join(low, "vid", "left").select("vid", "idx", F.least("label", F.coalesce("msg", "label")).alias("label"), (F.col("msg") < F.col("label")).alias("moved"))
        x.set(new.observe(seen, F.count_if("moved").alias("moved")).drop("moved"))
        moved, done = seen.get["moved"], done + 1
    edges.drop()
    if moved:
        log.warning("directed_min_label stopped after %d rounds with %d labels changed in the last", done, moved)
    return x.df.select("vid", swap(F.col("label")).alias("label"), "idx")


def bfs(graph: PropertyGraph, source: int | None = None) -> DataFrame:
    """vid, level: hops over edges from ``source``, the smallest id if None; empty where it is no vertex."""
    if (rows := _in_one(graph)) is not None:
        return _solved(rows, lambda batches: onetask.bfs(batches, source), "vid bigint, level int", "bfs")
    v = graph.ids
    if source is None:
        source = v.agg(F.min("vid")).first()[0]
    e = graph.links
    seen = _Growing(v.filter(F.col("vid") == (source if source is not None else -1)).withColumn("level", F.lit(0)), "bfs")
    found = 1
    while found:
        new = e.join(seen.last.select(F.col("vid").alias("src")), "src", "left_semi").select(F.col("dst").alias("vid")).distinct().join(seen.df.select("vid"), "vid", "left_anti").join(v, "vid", "left_semi")
        found = seen.add(new.withColumn("level", F.lit(seen.rounds)))
    return seen.df


def scc(graph: PropertyGraph) -> DataFrame:
    """vid, component: the greatest id of each strongly connected component, by trimming, colouring and backward search."""
    if (rows := _in_one(graph)) is not None:
        return _solved(rows, onetask.scc, "vid bigint, component bigint", "scc")
    v = graph.ids
    e = _State(graph.links.filter(F.col("src") != F.col("dst")).select("src", "dst").distinct(), "scc-edges")
    left = _State(v, "scc-left")
    found = _Growing(v.limit(0).withColumn("component", F.col("vid")), "scc")
    size = left.df.count()

    def within() -> DataFrame:
        return e.df.join(left.df.withColumnRenamed("vid", "src"), "src", "left_semi").join(left.df.withColumnRenamed("vid", "dst"), "dst", "left_semi").select("src", "dst")

    while size:
        # a vertex without edges in or out of what is left is alone
        while True:
            keep = _State(left.df.join(e.df.select(F.col("src").alias("vid")), "vid", "left_semi").join(e.df.select(F.col("dst").alias("vid")), "vid", "left_semi"), "scc-keep")
            now = keep.df.count()
            if now < size:
                found.add(left.df.join(keep.df, "vid", "left_anti").withColumn("component", F.col("vid")))
                left.set(keep.df)
                e.set(within())
            keep.drop()
            if now == size:
                break
            size = now
        if not size:
            break
        colour = _State(left.df.withColumn("c", F.col("vid")), "scc-colour")
        moved = 1
        while moved:
            high = aggregate_messages(e.df, colour.df, F.col("c"), F.max)
            seen = Observation()
            new = colour.df.join(high, "vid", "left").select("vid", F.greatest("c", F.coalesce("msg", "c")).alias("c"), (F.col("msg") > F.col("c")).alias("moved"))
            colour.set(new.observe(seen, F.count_if("moved").alias("moved")).select("vid", "c"))
            moved = seen.get["moved"]
        # backward from each root, within its colour
        inside = _State(e.df.join(colour.df.select(F.col("vid").alias("src"), F.col("c").alias("a")), "src").join(colour.df.select(F.col("vid").alias("dst"), F.col("c").alias("b")), "dst").filter("a = b").select("src", "dst"), "scc-inside")
        reach = _Growing(colour.df.filter("vid = c").select("vid", F.col("c").alias("component")), "scc-reach")
        more = 1
        while more:
            front = reach.last.select(F.col("vid").alias("dst"), "component")
            more = reach.add(inside.df.join(front, "dst").select(F.col("src").alias("vid"), "component").distinct().join(reach.df.select("vid"), "vid", "left_anti"))
        found.add(reach.df)
        left.set(left.df.join(reach.df, "vid", "left_anti"))
        e.set(within())
        size = left.df.count()
        for state in (colour, inside, reach):
            state.drop()
    left.drop()
    e.drop()
    return found.df


def _one(spark_df: DataFrame, value: float) -> DataFrame:
    return spark_df.sparkSession.createDataFrame([(float(value),)], "result double")


@register_algorithm("pagerank")
def _pagerank(graph: PropertyGraph, **options) -> DataFrame:
    return _one(graph.ids, pagerank(graph, **options)[1])


@register_algorithm("wcc")
def _wcc(graph: PropertyGraph) -> DataFrame:
    return wcc(graph).filter("vid = component").agg(F.count(F.lit(1)).cast("double").alias("result"))


@register_algorithm("scc")
def _scc(graph: PropertyGraph) -> DataFrame:
    return scc(graph).agg(F.count_distinct("component").cast("double").alias("result"))


@register_algorithm("bfs")
def _bfs(graph: PropertyGraph, source: int | None = None) -> DataFrame:
    return bfs(graph, source).agg(F.count(F.lit(1)).cast("double").alias("result"))

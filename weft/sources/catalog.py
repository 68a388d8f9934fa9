"""A database is a folder: a manifest of graphs, each with its snapshots, change log and rollback points.

Writes go to the log first, in transactions: a transaction's rows count once its commit marker stands. Opening a graph takes the
snapshot and applies the committed rows after it, so a crash at any moment loses nothing committed and keeps nothing else.
"""

from __future__ import annotations

import json
import logging
import time
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators.changelog import CHANGE_DDL, state_at
from weft.operators.graph import EDGE_DDL, VERTEX_DDL, PropertyGraph, write_edges
from weft.session import hadoop_fs

KEPT_POINTS = 5
_LOG_COLUMNS = [c.strip().split(" ")[0] for c in CHANGE_DDL.split(", ")]
LOG_DDL = CHANGE_DDL + ", tx string"

log = logging.getLogger(__name__)


class Database:
    """Create or open the database at ``path``, on any file system Hadoop reads."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        if not self._exists("manifest.json") and self._exists("manifest.json.old"):
            # a crash between two renames
            fs, old = hadoop_fs(spark, f"{self.path}/manifest.json.old")
            fs.rename(old, hadoop_fs(spark, f"{self.path}/manifest.json")[1])
        if not self._exists("manifest.json"):
            self._write("manifest.json", {"version": 1, "created": int(time.time()), "graphs": {}})

    def _exists(self, name: str) -> bool:
        fs, p = hadoop_fs(self.spark, f"{self.path}/{name}")
        return fs.exists(p)

    def _read(self, name: str) -> dict:
        fs, p = hadoop_fs(self.spark, f"{self.path}/{name}")
        stream = fs.open(p)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _write(self, name: str, content: dict) -> None:
        """Write beside the file and rename, keeping the old one until then: a crash leaves one of the two."""
        fs, p = hadoop_fs(self.spark, f"{self.path}/{name}")
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        new, old = at(f"{self.path}/{name}.new"), at(f"{self.path}/{name}.old")
        stream = fs.create(new, True)
        try:
            stream.write(bytearray(json.dumps(content), "utf-8"))
        finally:
            stream.close()
        if fs.exists(p):
            fs.delete(old, False)
            fs.rename(p, old)
        if not fs.rename(new, p):
            raise RuntimeError(f"cannot write {p}")
        fs.delete(old, False)

    def graph_table(self) -> DataFrame:
        """name, type of each graph."""
        return self.spark.createDataFrame([(k, v["type"]) for k, v in sorted(self._read("manifest.json")["graphs"].items())], "name string, type string")

    def info(self) -> dict:
        m = self._read("manifest.json")
        return {"path": self.path, "version": m["version"], "created": m["created"], "graphs": len(m["graphs"])}

    def exists(self, name: str) -> bool:
        return name in self._read("manifest.json")["graphs"]

    def create_graph(self, name: str, kind: str = "lpg") -> bool:
        """False, changing nothing, if the name is taken."""
        m = self._read("manifest.json")
        if name in m["graphs"]:
            log.warning("graph %s exists already", name)
            return False
        m["graphs"][name] = {"type": kind, "points": [], "base": None, "base_seq": -1, "snapshot": None, "seq": -1}
        self._write("manifest.json", m)
        return True

    def drop_graph(self, name: str) -> None:
        m = self._read("manifest.json")
        if m["graphs"].pop(name, None) is not None:
            self._write("manifest.json", m)
            fs, p = hadoop_fs(self.spark, f"{self.path}/{name}")
            fs.delete(p, True)

    def _write_snapshot(self, name: str, graph: PropertyGraph) -> str:
        snapshot = f"{name}/snapshot-{uuid.uuid4().hex[:12]}"
        graph.vertices.write.parquet(f"{self.path}/{snapshot}/v")
        write_edges(graph.edges, f"{self.path}/{snapshot}/e")
        return snapshot

    def _switch(self, name: str, **entry) -> None:
        """Make ``entry`` part of the graph's record, then delete snapshots it names no more."""
        m = self._read("manifest.json")
        before = m["graphs"][name]
        m["graphs"][name] = now = before | entry
        self._write("manifest.json", m)
        for old in {before["base"], before["snapshot"]} - {now["base"], now["snapshot"], None}:
            fs, p = hadoop_fs(self.spark, f"{self.path}/{old}")
            fs.delete(p, True)

    def save(self, name: str, graph: PropertyGraph) -> None:
        """Write a snapshot and only then make it the graph's state. Rollback points still replay the log alone, from what was last loaded."""
        self._switch(name, snapshot=self._write_snapshot(name, graph), seq=self._end(name))

    def load(self, name: str, graph: PropertyGraph) -> None:
        """Load a whole graph without logging it row by row: later changes and all rollback points begin with it."""
        snapshot, end = self._write_snapshot(name, graph), self._end(name)
        self._switch(name, base=snapshot, base_seq=end, snapshot=snapshot, seq=end, points=[])

    def _snapshot(self, snapshot: str | None) -> PropertyGraph:
        if snapshot is None:
            return PropertyGraph(self.spark.createDataFrame([], VERTEX_DDL), self.spark.createDataFrame([], EDGE_DDL))
        v = self.spark.read.schema(VERTEX_DDL).parquet(f"{self.path}/{snapshot}/v")
        e = self.spark.read.schema("src bigint, dst bigint, props map<string,string>, undirected boolean, is_reverse boolean, label string").parquet(f"{self.path}/{snapshot}/e")
        return PropertyGraph(v, e.select("src", "dst", "label", "props", "undirected", "is_reverse"))

    def open_graph(self, name: str) -> PropertyGraph:
        """The snapshot and all that was committed since; rows of transactions that never committed are skipped."""
        entry = self._read("manifest.json")["graphs"][name]
        if entry["seq"] >= self._end(name):
            return self._snapshot(entry["snapshot"])
        return state_at(self.log(name).filter(F.col("seq") > entry["seq"]), base=self._snapshot(entry["snapshot"]))

    # change log, transactions and rollback points

    def append(self, name: str, changes: DataFrame, tx: str | None = None) -> None:
        """Append log rows; seq must be above those written before. Rows of a transaction count once it has committed."""
        changes.select(*_LOG_COLUMNS).withColumn("tx", F.lit(tx).cast("string")).write.mode("append").parquet(f"{self.path}/{name}/log")

    def log(self, name: str) -> DataFrame:
        """All log rows, committed where their own flag or their transaction's marker says so."""
        if not self._exists(f"{name}/log"):
            return self.spark.createDataFrame([], CHANGE_DDL)
        rows = self.spark.read.schema(LOG_DDL).parquet(f"{self.path}/{name}/log")
        if self._exists(f"{name}/commits"):
            done = self.spark.read.schema("tx string").json(f"{self.path}/{name}/commits").distinct().withColumn("done", F.lit(True))
            rows = rows.join(done, "tx", "left").withColumn("committed", F.coalesce("done", "committed"))
        return rows.select(*_LOG_COLUMNS)

    def _end(self, name: str) -> int:
        return self.log(name).agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0]

    def begin(self, name: str) -> Transaction:
        return Transaction(self, name)

    def create_rollback(self, name: str, point: str) -> None:
        """Remember the end of the log under a name; the latest five points are kept."""
        points = self._read("manifest.json")["graphs"][name]["points"]
        self._switch(name, points=[*points, {"name": point, "created_at": int(time.time()), "seq": self._end(name)}][-KEPT_POINTS:])

    def rollback_points(self, name: str) -> DataFrame:
        rows = [(p["name"], p["created_at"], p["seq"]) for p in self._read("manifest.json")["graphs"][name]["points"]]
        return self.spark.createDataFrame(rows, "name string, created_at bigint, seq bigint")

    def rollback(self, name: str, point: str | None = None) -> PropertyGraph:
        """The state at a point, or at the last committed change; the log is kept."""
        entry = self._read("manifest.json")["graphs"][name]
        end = None if point is None else {p["name"]: p["seq"] for p in entry["points"]}[point]
        return state_at(self.log(name).filter(F.col("seq") > entry["base_seq"]), end, self._snapshot(entry["base"]))

    def compact(self, name: str, point: str | None = None) -> None:
        """Write the graph's state, or that at a point, as its snapshot, so that opening applies no earlier changes; rollback points stay."""
        end = self._end(name)
        self._switch(name, snapshot=self._write_snapshot(name, self.open_graph(name) if point is None else self.rollback(name, point)), seq=end)


class Transaction:
    """Changes logged in order and made to count together by ``commit``; ``close`` without it leaves them logged and without effect.

    As a context manager it commits at the end, and on an exception does not. One transaction of a graph may be open at a time.
    """

    def __init__(self, db: Database, name: str) -> None:
        self.db, self.name, self.id, self.open = db, name, uuid.uuid4().hex, True
        self.seq = db._end(name) + 1
        self.rows: list[tuple] = []

    def _log(self, kind: str, op: str, vid: int | None = None, src: int | None = None, dst: int | None = None, label: str | None = None, labels: Sequence[str] | None = None, props: Mapping[str, str] | None = None, undirected: bool = False) -> None:
        if not self.open:
            raise RuntimeError("the transaction has ended")
        self.rows.append((self.seq, kind, op, vid, src, dst, label, None if labels is None else list(labels), None if props is None else dict(props), undirected, None))
        self.seq += 1

    def add_vertex(self, vid: int, labels: Sequence[str], props: Mapping[str, str]) -> None:
        self._log("vertex", "add", vid, labels=labels, props=props)

    def rm_vertex(self, vid: int) -> None:
        self._log("vertex", "remove", vid)

    def add_edge(self, src: int, dst: int, label: str, props: Mapping[str, str], undirected: bool = False) -> None:
        self._log("edge", "add", src=src, dst=dst, label=label, props=props, undirected=undirected)

    def rm_edge(self, src: int, dst: int, label: str | None = None) -> None:
        self._log("edge", "remove", src=src, dst=dst, label=label)

    def add_all(self, changes: DataFrame) -> None:
        """Log a whole table of changes (kind, op, vid, src, dst, label, labels, props, undirected), ordered by its column ``at``."""
        from weft.operators.graph import dense_rank

        self.flush()
        ranked = dense_rank(changes, "at", "__rank")
        rows = ranked.withColumn("seq", F.col("__rank") + F.lit(self.seq)).withColumn("committed", F.lit(None).cast("boolean"))
        self.db.append(self.name, rows, self.id)
        self.seq = max(self.seq, self.db._end(self.name) + 1)

    def flush(self) -> None:
        """Write what is logged so far."""
        if self.rows:
            self.db.append(self.name, self.db.spark.createDataFrame(self.rows, CHANGE_DDL).coalesce(1), self.id)
            self.rows = []

    def commit(self) -> None:
        """Write the log, then the marker that makes it count."""
        self.flush()
        fs, p = hadoop_fs(self.db.spark, f"{self.db.path}/{self.name}/commits/{self.id}.json")
        stream = fs.create(p, True)
        try:
            stream.write(bytearray(json.dumps({"tx": self.id}), "utf-8"))
        finally:
            stream.close()
        self.open = False

    def close(self) -> None:
        """End without committing: the rows stay in the log and are skipped by every replay."""
        if self.open:
            self.flush()
            log.info("transaction %s of %s closed without commit", self.id, self.name)
        self.open = False

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None and self.open:
            self.commit()
        self.close()

"""Session construction and the shared scratch folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def make_session(app: str = "weft", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine expects; ``conf`` keys use ``__`` for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent a local session (tests, a laptop) gets a temporary folder; on a cluster, where each machine would
    have its own, that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(named)
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not hasattr(spark.sparkContext, "_weft_scratch"):
        spark.sparkContext._weft_scratch = "file://" + tempfile.mkdtemp(prefix="weft-")
        spark.sparkContext.setCheckpointDir(spark.sparkContext._weft_scratch)
    return spark.sparkContext._weft_scratch


def hadoop_fs(spark: SparkSession, path: str):
    """(FileSystem, Path) of Hadoop for ``path``."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_fs(spark, path)
    fs.delete(p, True)


_staged: list[tuple[SparkSession, str]] = []
_scopes: list[list[tuple[SparkSession, str]]] = []


@atexit.register
def _clean() -> None:
    for spark, path in _staged:
        try:
            if spark.sparkContext._jsc is not None:
                remove(spark, path)
        except Exception:  # noqa: BLE001 - the JVM may be gone already
            pass


def scratch_path(spark: SparkSession, name: str, lasting: bool = False) -> str:
    """A new, unused path in the shared folder, removed at the end of the enclosing ``scratch_scope`` or, ``lasting`` or without one, when Python ends."""
    path = f"{scratch_dir(spark)}/weft-{name}-{uuid.uuid4().hex[:12]}"
    (_staged if lasting or not _scopes else _scopes[-1]).append((spark, path))
    return path


@contextmanager
def scratch_scope() -> Iterator[None]:
    """Remove at its end what is staged within: for sessions that run many queries. The results must have been read or written by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for spark, path in _scopes.pop():
            remove(spark, path)


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: cuts the lineage, survives executor loss."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucket(df: DataFrame, key: str, path: str) -> str:
    """Write ``df`` to ``path`` in buckets of ``key``, as many as there are shuffle partitions, and return the name of its table. Rows come as they are partitioned: by ``key``, or each task writes many files."""
    table, parts = "weft_" + uuid.uuid4().hex[:12], int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(parts, key).option("path", path).saveAsTable(table)
    return table


def unbucket(spark: SparkSession, table: str | None, path: str) -> None:
    """Remove what ``bucket`` wrote, or the plain files at ``path``."""
    if table:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    remove(spark, path)


class Bucketed:
    """``df`` written to the shared folder in buckets of ``key``, sorted, so that joins and aggregations on it need no shuffle of it."""

    def __init__(self, df: DataFrame, key: str, name: str) -> None:
        self.spark, self.path = df.sparkSession, scratch_path(df.sparkSession, name)
        self.table = "weft_" + uuid.uuid4().hex[:12]
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        # as many files as buckets
        df.repartition(parts, key).write.bucketBy(parts, key).sortBy(key).option("path", self.path).saveAsTable(self.table)
        self.df = self.spark.table(self.table)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        remove(self.spark, self.path)

"""The change feed as a stream: micro-batches added to a table of the last change of every key, merged from time to time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weft.operators.changefeed import EDGE_COLUMNS, latest_changes
from weft.session import hadoop_fs, remove

LOG_DDL = "seq bigint, src bigint, dst bigint, edge_label string, remove int, committed int, creationDate bigint, logged_at timestamp_ntz, arrived_at timestamp_ntz"
STATE_DDL = "src bigint, dst bigint, edge_label string, seq bigint, remove int, creationDate bigint"


class ChangeStream:
    """Applies files of log rows, as they arrive, to the state below ``state``.

    A batch writes the last change of each of its keys and nothing else; after every ``merge_every`` batches these are merged into a new base and
    the merged files removed, so that writing the state is spread over many batches and the folder holds no old versions for long. Removals stay
    in the state, so that a late, older add cannot bring an edge back. A batch run again writes the same files: applying is
    idempotent and survives restarts. The base before the last is kept until the next merge for those still reading it.
    """

    def __init__(self, spark: SparkSession, source: str, state: str, merge_every: int = 20) -> None:
        self.spark, self.source, self.state, self.merge_every = spark, source, state.rstrip("/"), merge_every

    def _complete(self, kind: str) -> list[int]:
        """The numbers of the folders of a kind that were written to the end."""
        fs, p = hadoop_fs(self.spark, f"{self.state}/{kind}")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return sorted(int(n) for n in names if n.isdigit() and fs.exists(at(f"{self.state}/{kind}/{n}/_SUCCESS")))

    def _changes(self) -> tuple[DataFrame, list[int], list[int]]:
        """The last base and the changes since, with the numbers of all bases and of those changes."""
        bases = self._complete("base")
        deltas = [n for n in self._complete("changes") if not bases or n > bases[-1]]
        paths = [f"{self.state}/base/{n}" for n in bases[-1:]] + [f"{self.state}/changes/{n}" for n in deltas]
        rows = self.spark.read.schema(STATE_DDL).parquet(*paths) if paths else self.spark.createDataFrame([], STATE_DDL)
        return rows, bases, deltas

    @staticmethod
    def _last(rows: DataFrame) -> DataFrame:
        last = Window.partitionBy("src", "dst", "edge_label").orderBy(F.col("seq").desc(), F.col("remove").desc())
        return rows.withColumn("k", F.row_number().over(last)).filter("k = 1").drop("k")

    def _apply(self, batch: DataFrame, epoch: int) -> None:
        latest_changes(batch).select("src", "dst", "edge_label", "seq", "remove", "creationDate").write.mode("overwrite").parquet(f"{self.state}/changes/{epoch}")
        rows, bases, deltas = self._changes()
        if len(deltas) >= self.merge_every:
            self._last(rows).write.mode("overwrite").parquet(f"{self.state}/base/{deltas[-1]}")
            for old in bases[:-1]:
                remove(self.spark, f"{self.state}/base/{old}")
            for old in self._complete("changes"):
                if bases and old <= bases[-1]:
                    remove(self.spark, f"{self.state}/changes/{old}")

    def start(self, checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
        """Process what is there in micro-batches and stop; run again for what came since."""
        rows = self.spark.readStream.schema(LOG_DDL).option("maxFilesPerTrigger", files_per_batch).parquet(self.source)
        return rows.writeStream.foreachBatch(self._apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def edges(self) -> DataFrame:
        """The edges alive after all batches so far."""
        swept = F.max(F.when(F.col("edge_label").isNull(), F.col("seq"))).over(Window.partitionBy("src", "dst"))
        rows = self._last(self._changes()[0]).withColumn("swept", swept)
        return rows.filter((F.col("remove") == 0) & F.col("edge_label").isNotNull() & (F.col("swept").isNull() | (F.col("seq") > F.col("swept")))).select(*EDGE_COLUMNS)

"""Per-key results where a few keys hold most records: exact offset chunking.

Rows are counted per key and input block, the counts of a key summed up over the blocks before (prefix sums),
and each row of a large key numbered exactly: offset of its block plus place in it. Chunks of equal size follow
from the number, so no task gets more than ``chunk_rows`` rows of one key. Every chunk gives a state with its
first and last row, and the states of a key, one per chunk, are merged in order; what lies across a boundary (here the gap
between neighbouring rows) is taken from the last row of one chunk and the first of the next.

Keys that fit in one chunk need no numbers: they are processed as a single chunk.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.session import stage

#: Rows of one key that a task processes at once, at least; beyond MAX_LARGE times as many rows in all, a share of them.
CHUNK_ROWS = 50_000
#: No more keys than this are large, whatever the size of the data.
MAX_LARGE = 100_000
#: Rows of an input block.
BLOCK_ROWS = 1 << 18


def positioned(df: DataFrame) -> DataFrame:
    """``df`` with __block and __pos, the place of each row in the input, the same in every attempt of a task.

    For Parquet the place in the file; the files stand in a fixed but arbitrary order. Otherwise partition and row.
    """
    try:
        row = F.col("_metadata.row_index")
        return df.select("*", F.xxhash64("_metadata.file_path").alias("__file"), row.alias("__pos")).withColumn("__block", F.struct(F.col("__file"), F.floor(F.col("__pos") / BLOCK_ROWS).alias("part"))).drop("__file")
    except AnalysisException:
        at = F.monotonically_increasing_id()
        return df.withColumn("__pos", at).withColumn("__block", F.struct(F.shiftright("__pos", 33).alias("__file"), F.floor((F.col("__pos") % (1 << 33)) / BLOCK_ROWS).alias("part")))


class KeyChunks:
    """Ordered per-key results of ``df`` by exact offset chunking.

    Rows of a null key are left out but count towards shares; null times and labels are allowed (a gap beside a null time
    is none; null differs from any label). Repeated rows count each. An empty table gives no row; further
    columns are ignored.
    """

    def __init__(self, df: DataFrame, key: str, time: str, label: str, chunk_rows: int = CHUNK_ROWS, share: float = 0.02) -> None:
        placed = positioned(df)
        self.rows = placed.select(F.col(key).cast("bigint").alias("key"), F.col(time).alias("time"), F.col(label).alias("label"), "__block", "__pos").filter(F.col("key").isNotNull())
        self.all_rows = df.count()
        self.share = share
        self.size = max(chunk_rows, -(-self.all_rows // MAX_LARGE))
        counts = self.rows.groupBy("key", "__block").agg(F.count(F.lit(1)).alias("n"))
        # no more than MAX_LARGE or 1 / share keys, so fit for a broadcast
        large = self.rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > self.size) | (F.col("n") >= self.all_rows * share))
        self.large = stage(large.select("key"), "large")
        earlier = Window.partitionBy("key").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
        self.offsets = self._hot(counts).withColumn("offset", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")

    def _hot(self, rows: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(self.large), "key", "left_semi")

    def _states(self, rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
        """One state for each ``by``: its size, ends and what lies between neighbours within it."""
        before = Window.partitionBy(*by).orderBy(*order)
        first = F.lag(F.lit(True)).over(before).isNull()
        gap = F.unix_micros(F.col("time").cast("timestamp")) - F.unix_micros(F.lag("time").over(before).cast("timestamp"))
        changed = F.when(first, 0).otherwise((~F.col("label").eqNullSafe(F.lag("label").over(before))).cast("int"))
        place = F.struct(*order)
        ends = F.struct(place.alias("at"), F.col("time"), F.col("label"))
        return (
            rows.withColumn("__gap", gap).withColumn("__changed", changed)
            .groupBy(*by)
            .agg(F.count(F.lit(1)).alias("n"), F.min(ends).alias("head"), F.max(ends).alias("tail"), F.max("__gap").alias("gap"), F.sum("__changed").alias("changes"))
        )

    def large_results(self) -> DataFrame:
        """Results of the large keys, their chunks processed apart and merged in order."""
        # a (key, block) pair has no more rows than a block, so numbering is even
        local = F.row_number().over(Window.partitionBy("key", "__block").orderBy("__pos"))
        numbered = self._hot(self.rows).join(self.offsets, ["key", "__block"]).withColumn("number", F.col("offset") + local - 1)
        chunked = numbered.withColumn("chunk", F.floor(F.col("number") / self.size)).select("key", "chunk", "number", "time", "label")
        states = self._states(chunked, ["key", "chunk"], ["number"])
        before = Window.partitionBy("key").orderBy("chunk")
        last = F.lag("tail").over(before)
        across = F.unix_micros(F.col("head.time").cast("timestamp")) - F.unix_micros(F.col("__last.time").cast("timestamp"))
        turned = F.when(F.col("__last").isNull(), 0).otherwise((~F.col("head.label").eqNullSafe(F.col("__last.label"))).cast("int"))
        return (
            states.withColumn("__last", last)
            .groupBy("key")
            .agg(
                F.sum("n").alias("n"),
                F.count(F.lit(1)).alias("chunks"),
                F.min("head").alias("head"),
                F.max("tail").alias("tail"),
                F.max(F.greatest("gap", across)).alias("gap"),
                F.sum(F.col("changes") + turned).alias("changes"),
            )
            .transform(self._named)
        )

    def small_results(self) -> DataFrame:
        """Results of the keys that fit in one chunk."""
        cold = self.rows.join(F.broadcast(self.large), "key", "left_anti").select("key", "__block", "__pos", "time", "label")
        return self._states(cold, ["key"], ["__block", "__pos"]).withColumn("chunks", F.lit(1).cast("bigint")).transform(self._named)

    @staticmethod
    def _named(df: DataFrame) -> DataFrame:
        return df.select("key", "n", "chunks", F.col("head.time").alias("first_time"), F.col("tail.time").alias("last_time"), (F.col("gap") / 1e6).alias("max_gap_s"), F.col("changes").alias("label_changes"))

    def results(self) -> DataFrame:
        """key, n, chunks, first_time, last_time (of the first and last row), max_gap_s and label_changes between neighbouring rows."""
        return self.large_results().unionByName(self.small_results())

    def heavy(self) -> DataFrame:
        """The results of the keys with at least ``share`` of all rows."""
        return self.large_results().filter(F.col("n") >= self.all_rows * self.share)

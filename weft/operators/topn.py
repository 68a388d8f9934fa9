"""The top N rows of every group, whatever its size.

Exact group counts divide the groups. Groups holding a fixed share of all rows, or more rows than a task's budget (their number is bounded), are
cut into ranges of the order column, salted by the tie column so that equal scores are divided too, a top N taken in each piece and then over
the pieces; all other groups go through an ordinary ranking window. Both halves use ``row_number() <= n``, which Catalyst also applies before
the shuffle, so no more than N rows per group and task are moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.heavy import heavy_keys

#: A group with at least this share of all rows is heavy, or one beyond the row budget of ``heavy_keys``.
HEAVY_SHARE = 0.002
#: Pieces of rows of equal score.
SALTS = 8


def _first(df: DataFrame, by: list[str], order: list[Column], n: int, rank: Column) -> DataFrame:
    return df.withColumn("__rank", rank.over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("__rank") <= n).drop("__rank")


def top_n(df: DataFrame, group: str, score: str, tie: str, n: int, heavy_share: float = HEAVY_SHARE, ranges: int = 32) -> DataFrame:
    """group, score, tie of the ``n`` items of each group with the greatest score, the smaller tie first where equal.

    Rows equal in all three columns are one item and count once. Rows whose group or score is null are left out;
    a null tie comes before others. Groups with fewer items give fewer rows, an empty table gives none; further
    columns are ignored. ``score`` is numeric or a timestamp.
    """
    rows = df.select(group, score, tie).filter(F.col(group).isNotNull() & F.col(score).isNotNull())
    order = [F.col(score).desc(), F.col(tie).asc()]
    heavy = F.broadcast(heavy_keys(rows, [group], heavy_share, n + 1).select(group))
    # copies of an item share a dense rank, so no shuffle is spent on removing them first
    light = _first(rows.join(heavy, group, "left_anti"), [group], order, n, F.dense_rank()).distinct()
    # in a heavy group one item may hold most rows: copies go before ranking, combined on the map side
    hot = rows.join(heavy, group, "left_semi").distinct()
    cuts = rows.join(heavy, group, "left_semi").groupBy(group).agg(F.percentile_approx(score, [i / ranges for i in range(1, ranges)], 1000).alias("__cuts"))
    salted = hot.join(F.broadcast(cuts), group).withColumn("__salt", F.struct(F.size(F.filter("__cuts", lambda c: c <= F.col(score))).alias("range"), F.pmod(F.xxhash64(tie), F.lit(SALTS)).alias("salt"))).drop("__cuts")
    hot = _first(_first(salted, [group, "__salt"], order, n, F.row_number()).drop("__salt"), [group], order, n, F.row_number())
    return light.unionByName(hot)

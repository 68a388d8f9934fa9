"""Keys that hold a large part of all rows; their number is bounded, whatever the size of the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key beyond which it is heavy, however small its share.
ROW_BUDGET = 5_000_000
#: No more keys than this are heavy through the row budget.
MAX_HEAVY = 20_000


def heavy_limit(total: int, share: float, at_least: int = 2, budget: int = ROW_BUDGET) -> float:
    """Rows from which a key is heavy: a share of all, a budget if that is less, but so many that no more than ``MAX_HEAVY`` keys can have them."""
    return max(at_least, min(share * total, max(budget, total / MAX_HEAVY)))


def heavy_keys(rows: DataFrame, keys: list[str], share: float, at_least: int = 2, weight: str | None = None, budget: int = ROW_BUDGET) -> DataFrame:
    """``keys`` and ``__n`` of those with at least ``heavy_limit`` rows, by exact count.

    ``weight`` names a column of counts where ``rows`` is counted already. No more than ``max(1 / share, MAX_HEAVY)`` rows come out, held
    by the driver and meant to be broadcast.
    """
    n = F.sum(weight) if weight else F.count(F.lit(1))
    total = rows.agg(F.coalesce(n, F.lit(0)).alias("__n")).first()["__n"]
    counts = rows.groupBy(*keys).agg(n.alias("__n"))
    found = counts.filter(F.col("__n") >= heavy_limit(total, share, at_least, budget))
    return rows.sparkSession.createDataFrame(found.collect(), found.schema)

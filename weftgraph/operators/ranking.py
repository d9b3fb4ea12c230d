"""Order and limits: top-k per group or over all rows, and the clamp of limits that callers pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: the most rows a caller may ask for.
MOST = 200


def clamp(value: object, default: int) -> int:
    """``value`` as a limit within 1..MOST; what is no number gives ``default``."""
    try:
        n = int(value)  # type: ignore[call-overload]
    except (TypeError, ValueError, OverflowError):
        n = default
    return max(1, min(n, MOST))


def top_k(df: DataFrame, order: Sequence[Column], k: int, per: Sequence[str] = ()) -> DataFrame:
    """The first ``k`` rows under ``order`` with their ``rank``, of each group of ``per`` or of all rows.

    Per group a limit runs on the map side before the shuffle (window group limit); over all rows every task keeps k rows.
    ``order`` should end with a key, so that ties have one result. Nulls follow the given order; an empty table stays empty.
    """
    if not per:
        df = df.orderBy(*order).limit(k)
    w = Window.partitionBy(*per).orderBy(*order) if per else Window.orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

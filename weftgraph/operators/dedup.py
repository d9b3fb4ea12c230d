"""Last-wins and first-wins deduplication and keyed upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first under ``order``.

    ``row_number() = 1`` lets Spark put a per-partition group limit before the shuffle, so repeated rows of a hot key
    shrink on the map side. Null keys form a group of their own. An empty table gives an empty table.
    """
    at = "__wg_rn"
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(at, F.row_number().over(w)).filter(F.col(at) == 1).drop(at)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``new`` replaces the rows of ``old`` with the same key; among several new rows of a key the first under ``order`` wins."""
    fresh = keep_first(new, keys, order)
    kept = old.join(fresh.select(*keys), list(keys), "left_anti")
    return kept.unionByName(fresh.select(*old.columns))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that break uniqueness, with their number of rows: the check behind a unique constraint."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def replace_files(old: DataFrame, new: DataFrame, changed: DataFrame) -> DataFrame:
    """Incremental merge: rows of the changed files (repo_id, path) are dropped from ``old`` and replaced by ``new``."""
    keys = changed.select("repo_id", "path").distinct()
    return old.join(keys, ["repo_id", "path"], "left_anti").unionByName(new, allowMissingColumns=True)

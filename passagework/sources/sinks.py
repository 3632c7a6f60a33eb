"""Writers and the row logic behind them.

There is no transactional table format here, so changes are computed as new rows
or a new state and written to a new place; a path being read is never overwritten.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework import skew


def append_partitioned(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Append with one folder per key.

    The rebalance hint lets the adaptive planner split a hot key over several
    tasks (and files) and merge small ones.
    """
    df.hint("rebalance", *by).write.mode("append").partitionBy(*by).parquet(path)


def absent_rows(batch: DataFrame, target: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """Rows of ``batch`` whose key is new, one per key (the first in ``order``)."""
    others = [c for c in batch.columns if c not in keys]
    unique = skew.first_per_key(batch, keys, order, others).select(*batch.columns)
    # The batch is the small side: its keys pick the rows of the target that matter.
    there = target.select(*keys).join(unique.select(*keys), list(keys), "left_semi").distinct()
    return unique.join(there, list(keys), "left_anti")


def upsert(
    target: DataFrame,
    batch: DataFrame,
    keys: Sequence[str],
    version: str,
    keep_first: Sequence[str] = (),
) -> DataFrame:
    """New state after replacing rows by key; the newest version wins.

    Columns in ``keep_first`` keep the value of the oldest row. One aggregation
    over both sides, with partial aggregation before the shuffle.
    """
    both = target.unionByName(batch)
    fresh = [c for c in both.columns if c not in keys and c not in keep_first]
    newest = F.max_by(F.struct(*fresh), F.col(version)).alias("_newest")
    oldest = [F.min_by(c, F.col(version)).alias(c) for c in keep_first]
    return both.groupBy(*keys).agg(newest, *oldest).select(
        *[F.col(f"_newest.{c}").alias(c) if c in fresh else F.col(c) for c in both.columns]
    )


def replace_keys(target: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New state after deleting the keys of ``batch`` and adding its rows."""
    old = skew.join_small(target, batch.select(*keys).distinct(), list(keys), "left_anti")
    return old.unionByName(batch)


def write_nested_results(results: DataFrame, path: str) -> None:
    """One JSON object per item with a nested verdict per dimension."""
    results.write.mode("append").json(path)

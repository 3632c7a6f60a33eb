"""Packing: optimal length buckets by dynamic programming, token-budget batches inside each."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.functions.arrays import let
from passagework.session import materialize

SHARD_ROWS = 512
FINE = 256  # lengths up to here are cells of their own; above, cells are 1/128 of an octave


def words_of(text: Column) -> Column:
    """The text cut at runs of space and U+0009 to U+000D; the first and the last piece may be empty."""
    return F.split(text, "[ \\t-\\r]+", -1)


def word_count(text: Column) -> Column:
    """Runs of characters other than space and U+0009 to U+000D; a null text has none."""
    count = let(
        words_of(F.coalesce(text, F.lit(""))),
        lambda w: F.size(w) - (F.get(w, F.lit(0)) == "").cast("int") - (F.element_at(w, -1) == "").cast("int"),
    )
    return F.greatest(count, F.lit(0)).cast("long")


def cell(length: Column) -> Column:
    """The smallest grid length that is not below ``length``; about 128 grid lengths per octave."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(length, F.lit(FINE)).cast("double"))) - 7)
    return F.when(length <= FINE, length).otherwise((F.ceil(length / step) * step).cast("long"))


def best_bounds(cells: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds, at most ``buckets``, that minimise the sum of ``count * bound``.

    ``cells`` ascends. Every cell's rows are padded to the next bound; the last is the largest cell.
    """
    n = len(cells)
    if n == 0:
        return []
    below = np.concatenate([[0], np.cumsum(counts, dtype=np.float64)])
    size = cells.astype(np.float64)
    cost = np.concatenate([[0.0], size * below[1:]])
    choice = []
    for _ in range(1, min(buckets, n)):
        nxt, pick = cost.copy(), np.zeros(n + 1, dtype=np.int64)
        for j in range(1, n + 1):
            ways = cost[:j] + size[j - 1] * (below[j] - below[:j])
            pick[j] = int(ways.argmin())
            nxt[j] = ways[pick[j]]
        choice.append(pick)
        cost = nxt
    bounds, j = [], n
    for pick in [*reversed(choice), None]:
        if j == 0:
            break
        bounds.append(int(cells[j - 1]))
        j = int(pick[j]) if pick is not None else 0
    return sorted(bounds)


def pack(docs: DataFrame, length: Column | None = None, buckets: int = 16, budget: int = 16384, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, ``n_tokens``, ``bucket`` (its padded length), ``batch`` and ``place`` in it.

    Lengths are words unless given. Their global histogram has one cell per length up to 256 and
    128 per octave above, hence a few thousand rows whatever the input; on its cells the bounds are
    optimal. A batch of bucket ``b`` holds ``budget // b`` documents, one if ``b`` exceeds the budget.
    Ranks inside a bucket come from counts per shard of its documents, so that no bucket is ordered
    in one task; only a bucket's last batch is not full.

    Null and empty texts have length 0 and go to the first bucket. Repeated rows take a place each.
    Other columns are ignored; an empty table gives no row.
    """
    size = word_count(F.col(text)) if length is None else F.coalesce(length.cast("long"), F.lit(0))
    salt = F.xxhash64(F.col(doc), F.col(text)) if text in docs.columns else F.xxhash64(F.col(doc))
    slim = materialize(docs.select(F.col(doc).alias("_doc"), salt.alias("_salt"), size.alias("n_tokens")), "lengths")
    cells = slim.groupBy(cell(F.col("n_tokens")).alias("cell")).agg(F.count("*").alias("n")).orderBy("cell").toPandas()
    bounds = best_bounds(cells["cell"].to_numpy(), cells["n"].to_numpy(), buckets)
    if not bounds:
        bounds = [0]
    rows = np.histogram(cells["cell"], bins=[-1, *[b + 0.5 for b in bounds]], weights=cells["n"])[0]
    shards = [max(1, -(-int(n) // SHARD_ROWS)) for n in rows]
    sized = F.array(*[F.lit(b).cast("long") for b in bounds])
    at = F.array_position(F.transform(sized, lambda b: F.col("n_tokens") <= b), True).cast("int")
    spread = F.array(*[F.lit(s).cast("long") for s in shards])
    placed = (
        slim.withColumn("_at", at)
        .withColumn("bucket", F.element_at(sized, F.col("_at")))
        .withColumn("_shard", F.pmod("_salt", F.element_at(spread, F.col("_at"))))
    )
    per_shard = placed.groupBy("bucket", "_shard").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("bucket").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_shard.select("bucket", "_shard", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("bucket", "_shard").orderBy("_salt", "_doc", "n_tokens")
    capacity = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest("bucket", F.lit(1)))).cast("long")
    ranked = (
        placed.withColumn("_row", F.row_number().over(inside)).join(starts, ["bucket", "_shard"])
        .withColumn("_rank", F.col("_start") + F.col("_row") - 1)
    )
    batch = F.floor(F.col("_rank") / capacity).cast("long")
    return ranked.select(
        F.col("_doc").alias(doc), "n_tokens", "bucket", batch.alias("batch"), (F.col("_rank") % capacity).cast("int").alias("place")
    )

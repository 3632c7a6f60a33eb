"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.session import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row ``(node, component)`` for each node of an edge; the component is its smallest node.

    Nodes may be of any ordered type. Loops and edges with a null end are ignored, repeated
    edges count once, no edge gives no row. Every round turns stars around large neighbours
    and then around small ones; the number of rounds is logarithmic in practice. A node's
    smallest neighbour is a partial aggregate and comes back by a join whose other side has
    one row per node, so that the rows of a hub can be split between tasks.
    """
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    stars = materialize(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _print(stars)
    while before[0]:
        stars = materialize(_small_star(_large_star(stars)), "edges")
        now = _print(stars)
        if now == before:
            break
        before = now
    # A star's centre is the component of itself.
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        stars.select("b", "b").distinct()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest node of its neighbourhood."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(lowest, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them."""
    lowest = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(lowest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(lowest).distinct()


def _print(edges: DataFrame) -> tuple[int, int]:
    """Number of rows and a sum over their hashes, to see whether a round changed anything."""
    row = edges.agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
    ).first()
    return row["n"], int(row["h"] or 0)


def renamed(df: DataFrame, mark: str = "2") -> DataFrame:
    """All columns with ``mark`` behind their names: the second side of a cogroup of one table's rows."""
    return df.select(*[F.col(c).alias(c + mark) for c in df.columns])

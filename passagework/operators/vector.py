"""Nearest neighbours by cosine similarity, exact and clustered.

Questions and vectors are both cut into blocks by a hash. A pair of blocks is compared in one
task, in matrix products of bounded size, and gives its best ``k`` rows per question; these are
merged by rank. Nothing is collected, and no side is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagework import skew

VECTOR_ROWS = 16_384  # vectors of a block
QUESTION_ROWS = 1024  # questions of a block
ROWS_AT_ONCE = 1024


def _unit_rows(column: pd.Series) -> np.ndarray:
    matrix = np.stack(column.to_numpy()).astype("float64")
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _best_of(frame: pd.DataFrame, k: int) -> pd.DataFrame:
    ordered = frame.sort_values(["q", "sim", "node"], ascending=[True, False, True], kind="stable")
    return ordered.groupby("q", sort=False).head(k)


def _candidates(sims: np.ndarray, rows: np.ndarray, nodes: np.ndarray, k: int) -> pd.DataFrame:
    """Entries that reach the k-th best similarity of their question, ties included."""
    if sims.shape[1] > k:
        border = np.partition(sims, sims.shape[1] - k, axis=1)[:, -k]
        hit = sims >= border[:, None]
    else:
        hit = np.ones_like(sims, dtype=bool)
    at, n = np.nonzero(hit)
    return pd.DataFrame({"q": rows[at], "node": nodes[n], "sim": sims[at, n]})


def _block_topk(k: int, query: str, node: str) -> Callable:
    """Best ``k`` vectors of a block for every question of another."""

    def run(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        kept = None
        if len(asked) and len(rows):
            ids, matrix = asked["_query"].to_numpy(), _unit_rows(asked["_vector"])
            everyone = np.arange(len(ids))
            for begin in range(0, len(rows), ROWS_AT_ONCE):
                part = rows.iloc[begin : begin + ROWS_AT_ONCE]
                sims = np.round(matrix @ _unit_rows(part["_other"]).T, 9)
                found = _candidates(sims, everyone, part["_node"].to_numpy(), k)
                kept = _best_of(found if kept is None else pd.concat([kept, found]), k)
        if kept is None:
            return pd.DataFrame({query: [], node: [], "similarity": []})
        return pd.DataFrame({query: ids[kept["q"]], node: kept["node"], "similarity": kept["sim"]})

    return run


def in_blocks(rows: DataFrame, own: str, other: str, salt: str, first: str, second: str) -> DataFrame:
    """Rows with their own block, once for every block of the other side."""
    mine = F.pmod(F.xxhash64(salt), F.col(own)).cast("int")
    each = F.explode(F.sequence(F.lit(0), (F.col(other) - 1).cast("int")))
    return rows.withColumn(first, mine).withColumn(second, each).drop(own, other)


def vector_topk(
    questions: DataFrame,
    vectors: DataFrame,
    k: int,
    query: str = "query_id",
    node: str = "node_id",
    vector: str = "embedding",
    scope: str | None = None,
) -> DataFrame:
    """Exact ``k`` nearest vectors per question: similarity and rank.

    With ``scope`` the vectors carry that column as a string and the questions an
    array column of the same name with the values they may see.
    """
    asked = questions.select(F.col(query).alias("_query"), F.col(vector).alias("_vector"), *([F.explode(scope).alias("_scope")] if scope else []))
    searched = vectors.select(
        F.col(node).alias("_node"), F.col(vector).alias("_other"), *([F.col(scope).cast("string").alias("_in")] if scope else [])
    )
    v_blocks = F.ceil(F.col("_n") / VECTOR_ROWS).alias("_vb")
    q_blocks = F.ceil(F.col("_m") / QUESTION_ROWS).alias("_qb")
    if scope:
        asked = asked.distinct()
        n = searched.groupBy(F.col("_in").alias("_scope")).agg(F.count("*").alias("_n"))
        m = asked.groupBy("_scope").agg(F.count("*").alias("_m"))
        # One row per scope value that both sides hold.
        sizes = n.join(m, "_scope").select("_scope", v_blocks, q_blocks)
        asked = asked.join(sizes, "_scope")
        searched = searched.join(sizes.withColumnRenamed("_scope", "_in"), "_in")
    else:
        n, m = searched.count(), asked.count()
        blocks = [F.lit(max(1, -(-n // VECTOR_ROWS))).alias("_vb"), F.lit(max(1, -(-m // QUESTION_ROWS))).alias("_qb")]
        asked = asked.withColumn("_scope", F.lit("")).select("*", *blocks)
        searched = searched.withColumn("_in", F.lit("")).select("*", *blocks)
    left = in_blocks(asked, "_qb", "_vb", "_query", "_i", "_j")
    right = in_blocks(searched, "_vb", "_qb", "_node", "_q", "_p")
    schema = T.StructType(
        [
            T.StructField(query, questions.schema[query].dataType),
            T.StructField(node, vectors.schema[node].dataType),
            T.StructField("similarity", T.DoubleType()),
        ]
    )
    pairs = left.groupBy("_scope", "_i", "_j").cogroup(right.groupBy("_in", "_p", "_q"))
    found = pairs.applyInPandas(_block_topk(k, query, node), schema)
    if scope:
        found = found.distinct()
    return skew.top_per_key(found, [query], [F.desc("similarity"), F.col(node)], k)


def train_lists(vectors: DataFrame, lists: int, seed: int = 17, vector: str = "embedding"):
    """Cluster model of the inverted lists, fitted on all vectors."""
    points = vectors.select(array_to_vector(F.col(vector)).alias("features"))
    means = KMeans(k=lists, seed=seed, maxIter=10, distanceMeasure="cosine", featuresCol="features")
    return means.fit(points)


def write_lists(vectors: DataFrame, model, path: str, vector: str = "embedding") -> None:
    """Store the vectors with one folder per list."""
    marked = vectors.withColumn("features", array_to_vector(F.col(vector)))
    placed = model.transform(marked).withColumnRenamed("prediction", "list_id").drop("features")
    placed.hint("rebalance", "list_id").write.partitionBy("list_id").parquet(path)


def ann_topk(
    questions: DataFrame,
    index: DataFrame,
    model,
    k: int,
    probes: int,
    query: str = "query_id",
    node: str = "node_id",
    vector: str = "embedding",
) -> DataFrame:
    """Approximate neighbours: only the ``probes`` nearest lists of a question are read."""
    spark = questions.sparkSession
    centres = spark.createDataFrame(
        [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())],
        f"list_id int, {vector} array<double>",
    )
    nearest = vector_topk(questions, centres, probes, query, "list_id", vector)
    chosen = nearest.groupBy(query).agg(
        F.collect_list(F.col("list_id").cast("string")).alias("list_id")
    )
    probed = nearest.select("list_id").distinct()
    # At most one row per list, so this semi join prunes the folders that are read.
    read = index.join(F.broadcast(probed), "list_id", "left_semi")
    return vector_topk(questions.join(chosen, query), read, k, query, node, vector, "list_id")


def recall_at_k(exact: DataFrame, approximate: DataFrame, query: str = "query_id", node: str = "node_id") -> DataFrame:
    """Share of the exact neighbours that were found, per question."""
    found = approximate.select(query, node, F.lit(1).alias("_hit"))
    return (
        exact.join(found, [query, node], "left")
        .groupBy(query)
        .agg(F.count("_hit").alias("found"), F.count("*").alias("wanted"))
        .withColumn("recall", F.col("found") / F.col("wanted"))
    )

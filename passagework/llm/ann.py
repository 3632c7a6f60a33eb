"""Approximate nearest neighbours: probed lists, scanned block by block of rotated dimensions.

Vectors get one more component that makes them equally long, so that the largest inner product is
the smallest distance. Inside a probed list, partial distances over the first column blocks are
tested against the query's current 20th distance; candidates that cannot plausibly win are dropped.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.llm.graph import renamed
from passagework.session import materialize, ship_package

SAMPLE_ROWS = 20_000  # bound of the sample that lists and probes are fitted on
BLOCK_ROWS = 4096  # vectors, and queries, that meet in one task
COLUMNS = 16  # dimensions per column block
CAUTION = 2.1  # width of the hypothesis test; larger keeps more candidates
CELLS = 1 << 18  # distances held at once
DENSE = 0.1  # share of living pairs above which a column block is one matrix product


def usable(vector: Column) -> Column:
    """Not null, not zero, every component finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pd.Series) -> np.ndarray:
    """Rows of a column of byte strings as float64."""
    return np.frombuffer(b"".join(column), dtype=np.float64).reshape(len(column), -1)


def k_means(points: np.ndarray, k: int, spherical: bool = False, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Lloyd's rounds from random points; empty cells keep their centre."""
    picks = np.random.default_rng(seed).permutation(len(points))[:k]
    centres = points[picks].copy()
    for _ in range(rounds):
        near = (points @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        filled = np.bincount(near, minlength=len(centres)) > 0
        centres[filled] = sums[filled] / np.bincount(near, minlength=len(centres))[filled, None]
        if spherical:
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with the component that gives them all the length ``longest``."""
    rest = np.sqrt(np.maximum(longest**2 - (x**2).sum(1), 0.0))
    return np.hstack([x, rest[:, None]])


def rotation(size: int, seed: int = 11) -> np.ndarray:
    """A random rotation of ``size`` dimensions."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


def scan(queries: np.ndarray, points: np.ndarray, k: int, columns: int = COLUMNS, caution: float = CAUTION) -> tuple[np.ndarray, np.ndarray]:
    """Pairs ``(query, point)`` that survive the adaptive scan; both inputs are rotated already.

    The radius of a query is the ``k``-th smallest exact distance of the ``4 k`` points that the first
    block ranks best. After ``d`` of ``D`` dimensions a pair lives on while its partial distance
    is at most ``radius * d / D * (1 + caution / sqrt(d)) ** 2``.
    """
    size = points.shape[1]
    starts = list(range(0, size, columns))

    def part(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * a @ b.T

    first = part(queries[:, :columns], points[:, :columns])
    if len(points) <= k or len(starts) == 1:
        return tuple(np.indices(first.shape).reshape(2, -1))
    some = min(4 * k, len(points))
    best = np.argpartition(first, some - 1, axis=1)[:, :some]
    exact = np.stack([((q - points[b]) ** 2).sum(1) for q, b in zip(queries, best, strict=True)])
    radius = np.partition(exact, k - 1, axis=1)[:, k - 1] * (1 + 1e-9) + 1e-12

    def limit(done: int) -> np.ndarray:
        return radius * min(1.0, done / size * (1 + caution / np.sqrt(done)) ** 2) if done < size else radius

    # While many pairs live, a block is a matrix product over all; after that only they are looked up.
    total, live, rest = first, first <= limit(columns)[:, None], starts[1:]
    while rest and live.sum() > DENSE * live.size:
        at, rest = rest[0], rest[1:]
        total = total + part(queries[:, at : at + columns], points[:, at : at + columns])
        live &= total <= limit(min(at + columns, size))[:, None]
    q, p = np.nonzero(live)
    gone = total[q, p]
    for at in rest:
        block = slice(at, at + columns)
        gone = gone + ((queries[q, block] - points[p, block]) ** 2).sum(1)
        alive = gone <= limit(min(at + columns, size))[q]
        q, p, gone = q[alive], p[alive], gone[alive]
    return q, p


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 20, goal: float = 0.98, vec: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """Each query's ``k`` nearest other rows by inner product: ``query_id, rank, vec_id, score``.

    Lists are k-means cells of at most ``SAMPLE_ROWS`` rows (those with the smallest hash); every
    row is put in a list. Queries probe the number of lists that holds a share of ``goal`` of the
    exact neighbours on that sample. Lists are cut into blocks of about ``BLOCK_ROWS`` rows, the
    queries that probe them too; each pair of blocks is one task's work and gives ``k`` rows a query.

    Queries whose probed lists gave fewer than ``k`` rows search all lists once more, without giving up on any pair.

    Vectors that are null, zero or hold null or non-finite components take no part; vectors meet others of their
    size, each size having lists of its own. Ties go to the smaller id. Rows that share an id are one candidate,
    with the best score, and no candidates of each other; with none left a query has no row.
    """
    ship_package(vectors.sparkSession)
    good = vectors.select(F.col(vec).alias("_id"), F.col(vector).cast("array<double>").alias("_v"), is_query.alias("_q")).where(
        usable(F.col("_v")) & F.col("_id").isNotNull()
    )
    good = good.withColumn("_q", F.coalesce("_q", F.lit(False)))
    sizes = [r["d"] for r in good.select(F.size("_v").alias("d")).distinct().orderBy("d").collect()]
    if not sizes:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionByName, [_nearest_of_size(good.where(F.size("_v") == d), d, k, goal) for d in sizes])


def _nearest_of_size(good: DataFrame, size: int, k: int, goal: float) -> DataFrame:
    """The search among ``good (_id, _v, _q)``, vectors of one size."""
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x))
    facts = good.agg(F.count("*").alias("n"), F.max(norm).alias("m")).first()
    longest = float(facts["m"]) * (1 + 1e-12)
    sample = good.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE_ROWS).select("_v").toPandas()
    raw = np.stack([np.asarray(v, dtype=np.float64) for v in sample["_v"]])
    points = lifted(raw, longest)
    lists = int(min(1024, max(1, round(np.sqrt(facts["n"]) / 4)), len(points)))
    centres = k_means(points, lists)
    probes = _probes(raw, points, centres, k, goal, longest)

    def place(batches):
        for batch in batches:
            x = np.stack([np.asarray(v, dtype=np.float64) for v in batch["_v"]]) if len(batch) else np.zeros((0, size))
            as_point, as_query = lifted(x, longest), np.hstack([x, np.zeros((len(x), 1))])
            home = (as_point @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)
            order = _probe_order(as_query, centres)[:, :probes]
            yield pd.DataFrame(
                {
                    "_id": batch["_id"], "_x": [r.tobytes() for r in x], "_home": home.astype(np.int32),
                    "_to": [o.tolist() if q else [] for o, q in zip(order, batch["_q"], strict=True)],
                }
            )

    placed = materialize(good.mapInPandas(place, "_id long, _x binary, _home int, _to array<int>"), "lists")
    found = materialize(_searched(placed, lists, size, longest, k, CAUTION), "found")
    # Candidates are other ids; all but one of them, or k, must be there.
    ids = placed.agg(F.count_distinct("_id")).first()[0]
    held = found.groupBy(F.col("query_id").alias("_id")).agg(F.count("*").alias("_n"))
    asked = placed.where(F.size("_to") > 0).select("_id").distinct()
    short = asked.join(held, "_id", "left").where(F.coalesce("_n", F.lit(0)) < min(k, ids - 1)).select(F.col("_id").alias("_short"))
    short = materialize(short, "short")
    if short.isEmpty():
        return found
    every = F.sequence(F.lit(0), F.lit(lists - 1))
    again = placed.join(short, F.col("_id") == F.col("_short"), "left").withColumn("_to", F.when(F.col("_short").isNotNull() & (F.size("_to") > 0), every).otherwise(F.array().cast("array<int>")))
    rest = found.join(short, F.col("query_id") == F.col("_short"), "left_anti")
    return rest.unionByName(_searched(again.drop("_short"), lists, size, longest, k, math.inf))


def _searched(placed: DataFrame, lists: int, size: int, longest: float, k: int, caution: float) -> DataFrame:
    """The best ``k`` rows of every query among the lists it goes to; blocks of lists meet blocks of queries."""
    rows = placed.groupBy(F.col("_home").alias("_list")).agg(F.count("*").alias("n"))
    asked = placed.select(F.explode("_to").alias("_list")).groupBy("_list").agg(F.count("*").alias("m"))
    # One row per list, hence at most 1024.
    sizes = {r["_list"]: (r["n"], r["m"] or 0) for r in rows.join(asked, "_list", "left").collect()}
    cuts = [[-(-sizes.get(i, (0, 0))[j] // BLOCK_ROWS) or 1 for i in range(lists)] for j in (0, 1)]
    v_cut, q_cut = (F.array(*[F.lit(c) for c in side]) for side in cuts)
    salt = F.xxhash64("_id")

    def dealt(df: DataFrame, own: Column, other: Column, first: str, second: str) -> DataFrame:
        mine = F.pmod(salt, F.element_at(own, F.col("_list") + 1)).cast("int")
        each = F.sequence(F.lit(0), F.element_at(other, F.col("_list") + 1) - 1)
        return df.withColumn(first, mine).withColumn(second, F.explode(each))

    points_of = dealt(placed.select("_id", "_x", F.col("_home").alias("_list")), v_cut, q_cut, "_vb", "_qb")
    queries_of = dealt(placed.select("_id", "_x", F.explode("_to").alias("_list")), q_cut, v_cut, "_qb", "_vb")
    turn = rotation(-(-(size + 1) // COLUMNS) * COLUMNS)

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = {"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)}
        if not len(left) or not len(right):
            return pd.DataFrame(empty)
        x, ids = matrix(left["_x"]), left["_id"].to_numpy()
        y, asks = matrix(right["_x2"]), right["_id2"].to_numpy()
        wide, repeated = len(turn) - size - 1, len(np.unique(ids)) < len(ids)
        px = np.pad(lifted(x, longest), ((0, 0), (0, wide))) @ turn
        out = []
        step = max(1, CELLS // (len(x) * 2))
        for at in range(0, len(y), step):
            some = y[at : at + step]
            py = np.pad(some, ((0, 0), (0, wide + 1))) @ turn
            q, p = scan(py, px, k + 1, caution=caution) if math.isfinite(caution) else np.divmod(np.arange(len(py) * len(px)), len(px))
            other = ids[p] != asks[at + q]
            q, p = q[other], p[other]
            score = np.einsum("ij,ij->i", some[q], x[p])
            order = np.lexsort((ids[p], -score, q))
            q, p, score = q[order], p[order], score[order]
            if repeated:
                once = np.sort(np.unique(np.column_stack([q, ids[p]]), axis=0, return_index=True)[1])
                q, p, score = q[once], p[once], score[once]
            head = np.searchsorted(q, q)
            keep = np.arange(len(q)) - head < k
            out.append(pd.DataFrame({"query_id": asks[at + q[keep]], "vec_id": ids[p[keep]], "score": score[keep]}))
        return pd.concat(out) if out else pd.DataFrame(empty)

    keys = ["_list", "_vb", "_qb"]
    asking = renamed(queries_of).groupBy(*[f"{c}2" for c in keys])
    found = points_of.groupBy(*keys).cogroup(asking).applyInPandas(meet, "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _probe_order(queries: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Lists by the distance of their centres from each query."""
    return np.argsort((centres**2).sum(1) - 2 * queries @ centres.T, axis=1, kind="stable").astype(np.int32)


def _probes(raw: np.ndarray, points: np.ndarray, centres: np.ndarray, k: int, goal: float, longest: float, asks: int = 256) -> int:
    """Lists a query must probe so that they hold ``goal`` of its neighbours, on the sample."""
    some = raw[:: max(1, len(raw) // asks)][:asks]
    best = np.argsort(-(some @ raw.T), axis=1, kind="stable")[:, 1 : k + 1]
    if not best.size:
        return len(centres)
    home = (points @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)
    order = _probe_order(np.hstack([some, np.zeros((len(some), 1))]), centres)
    rank = np.argsort(order, axis=1)
    need = np.sort(np.take_along_axis(rank, home[best], axis=1).ravel())
    return int(need[min(len(need) - 1, int(np.ceil(goal * len(need))) - 1)]) + 1

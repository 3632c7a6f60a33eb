"""Embedding near-dedup: spherical k-means cells, blocked cosine products, one representative per group."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.ann import SAMPLE_ROWS, k_means, matrix, usable
from passagework.llm.graph import components, renamed
from passagework.session import materialize, ship_package

BLOCK_ROWS = 2048


def local_groups(linked: np.ndarray) -> np.ndarray:
    """Group number per row and per column of a link matrix, rows first: connected parts of the block."""
    rows, columns = linked.shape
    label = np.concatenate([np.arange(rows), rows + np.arange(columns)])
    r, c = np.nonzero(linked)
    while True:
        low = np.minimum(label[r], label[rows + c])
        new = label.copy()
        np.minimum.at(new, r, low)
        np.minimum.at(new, rows + c, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def embedding_groups(
    vectors: DataFrame, threshold: float = 0.98, label: str = "label", vec: str = "vec_id", vector: str = "embedding", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """One row per vector: id, ``n_links``, ``component_id`` and ``kept`` (it represents its group).

    Vectors link if their labels are equal and not null and their cosine, in double precision, is
    at least ``threshold``. Equal vectors of a label are compared once and counted as often as they
    occur. Cells are spherical k-means cells of at most ``SAMPLE_ROWS`` vectors (smallest hash). A
    vector also visits every cell whose border it is close enough to for a link to reach across, so
    each vector meets all its links in its own cell. Cells are cut into blocks; a pair of blocks
    gives one count per vector and at most one edge per vector, never its pairs.

    Vectors of different sizes never link; each size has cells of its own. Vectors that are null, zero or hold null
    or non-finite components, or that have no label, link with nothing: 0 links, their own component, kept. Rows that
    share an id and a vector are copies like others. Other columns are ignored.
    """
    ship_package(vectors.sparkSession)
    rows = vectors.select(F.col(vec).alias("_id"), F.col(label).alias("_label"), F.col(vector).cast("array<double>").alias("_v"))
    fine = usable(F.col("_v")) & F.col("_label").isNotNull()
    marked = rows.withColumn("_fine", fine).withColumn(
        "_class", F.when(F.col("_fine"), F.sha2(F.concat_ws(",", F.col("_label").cast("string"), F.col("_v").cast("array<string>")), 256))
    )
    classes = materialize(
        marked.where("_fine").groupBy("_class").agg(F.min("_id").alias("_low"), F.count("*").alias("_n"), F.first("_label").alias("_label"), F.first("_v").alias("_v")),
        "classes",
    )
    totals = classes.groupBy(F.size("_v").alias("d")).agg(F.count("*").alias("n")).orderBy("d").collect()
    found = [materialize(_links(classes.where(F.size("_v") == r["d"]), r["n"], threshold, block_rows), "links") for r in totals]
    found = reduce(DataFrame.unionByName, found) if found else vectors.sparkSession.createDataFrame([], "_class string, _links long, _other string")
    counts = found.where("_other is null").groupBy("_class").agg(F.sum("_links").alias("_links"))
    parts = components(found.where("_other is not null"), "_class", "_other")
    named = classes.join(parts.withColumnRenamed("node", "_class"), "_class", "left").withColumn("component", F.coalesce("component", "_class"))
    lowest = named.groupBy("component").agg(F.min("_low").alias("_group"))
    answer = named.join(lowest, "component").join(counts, "_class", "left").select("_class", "_group", F.coalesce("_links", F.lit(0)).alias("_links"))
    out = marked.select("_id", "_class").join(answer, "_class", "left")
    group = F.when(F.col("_class").isNull(), F.col("_id")).otherwise(F.col("_group"))
    return out.select(
        F.col("_id").alias(vec), F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), group.alias("component_id"),
        F.col("_id").eqNullSafe(group).alias("kept"),
    )


def _links(classes: DataFrame, total: int, threshold: float, block_rows: int) -> DataFrame:
    """Counts and edges of ``total`` distinct vectors of one size."""
    sample = classes.orderBy(F.xxhash64("_class"), "_class").limit(SAMPLE_ROWS).select("_v").toPandas()
    points = _unit(np.stack([np.asarray(v, dtype=np.float64) for v in sample["_v"]]))
    centres = k_means(points, int(min(max(2, round(math.sqrt(total) / 16)), 1024, len(points))), spherical=True)
    placed = materialize(classes.mapInPandas(_placer(centres, threshold), "_class string, _label string, _n long, _x binary, _cell int, _home boolean"), "cells")
    return _compare(placed, threshold, block_rows)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _placer(centres: np.ndarray, threshold: float):
    """Home cell of each vector and the cells it visits."""
    # Let x be at home in cell c and y, linked with x, in cell e: (e - c) y >= 0. With the angle t
    # between x and y, (e - c) y <= (e - c) x cos t + |e - c| sin t, so x visits every such cell.
    sine = math.sqrt(max(0.0, 1 - threshold**2))
    apart = np.linalg.norm(centres[:, None, :] - centres[None, :, :], axis=2)

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            x = _unit(np.stack([np.asarray(v, dtype=np.float64) for v in batch["_v"]]))
            near = x @ centres.T
            home = near.argmax(1)
            gap = near[np.arange(len(x)), home][:, None] - near
            visit = gap * threshold <= apart[home] * sine + 1e-9
            visit[np.arange(len(x)), home] = True
            row, cell = np.nonzero(visit)
            data = np.array([r.tobytes() for r in x], dtype=object)
            yield pd.DataFrame(
                {
                    "_class": batch["_class"].to_numpy()[row], "_label": batch["_label"].astype(str).to_numpy()[row], "_n": batch["_n"].to_numpy()[row],
                    "_x": data[row], "_cell": cell.astype(np.int32), "_home": home[row] == cell,
                }
            )

    return run


def _compare(placed: DataFrame, threshold: float, block_rows: int) -> DataFrame:
    """``(_class, _links)`` per block pair, and edges ``(_class, _other)`` that keep its groups together."""
    cell = ["_label", "_cell"]
    sizes = placed.groupBy(*cell).agg(F.count("*").alias("n"), F.sum(F.col("_home").cast("int")).alias("h")).where("h > 0").select(
        *cell, F.ceil(F.col("n") / block_rows).cast("int").alias("_nb"), F.ceil(F.col("h") / block_rows).cast("int").alias("_hb")
    )
    sized = placed.join(sizes, cell)
    salt = F.xxhash64("_class")

    def all_of(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    keys = [*cell, "_i", "_j"]
    homes = sized.where("_home").withColumn("_i", F.pmod(salt, "_hb").cast("int")).withColumn("_j", all_of("_nb"))
    alls = sized.withColumn("_j", F.pmod(salt, "_nb").cast("int")).withColumn("_i", all_of("_hb"))
    columns = [*keys, "_class", "_n", "_x"]

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"_class": [], "_links": [], "_other": []})
        a, b = left["_class"].to_numpy(), right["_class2"].to_numpy()
        close = matrix(left["_x"]) @ matrix(right["_x2"]).T >= threshold
        # A vector and itself: its copies, one of which is the row itself.
        same = pd.Index(b).get_indexer(a)
        own = np.nonzero(same >= 0)[0]
        close[own, same[own]] = True
        links = close @ right["_n2"].to_numpy()
        links[own] -= 1
        group = local_groups(close)
        names = np.concatenate([a, b])
        other = names[group]
        joined = names != other
        edges = pd.DataFrame({"_class": names[joined], "_links": 0, "_other": other[joined]}).drop_duplicates()
        return pd.concat([pd.DataFrame({"_class": a, "_links": links, "_other": None}), edges])

    other = renamed(alls.select(*columns)).groupBy(*[f"{k}2" for k in keys])
    return homes.select(*columns).groupBy(*keys).cogroup(other).applyInPandas(meet, "_class string, _links long, _other string")

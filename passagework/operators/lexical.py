"""Lexical ranking of many questions at once, without a stored index (see ``lexical_index``).

Terms are counted inside the row of their node. Questions and postings meet in blocks: a block
of questions and one of nodes are scored in one task, question by question, which gives its
best ``k`` rows per question. No (question, node) row exists outside of it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagework import skew
from passagework.functions import text as X
from passagework.functions.arrays import exploded, let
from passagework.operators.vector import in_blocks
from passagework.session import materialize

# fixed values: weight of a plain match and the normaliser of the rank function
MATCH_WEIGHT = 0.1
RANK_NORM = 1.64493406685

POSTING_ROWS = 400_000  # postings of a block
TERM_ROWS = 8192  # question terms of a block


def question_terms(
    questions: DataFrame, query: str = "query_id", text: str = "text", keep: Sequence[str] = ()
) -> DataFrame:
    """One row per question and distinct term, with the number of terms."""
    base = questions.select(query, *keep, X.query_terms(F.col(text)).alias("_terms"))
    counted = base.withColumn("n_terms", F.size("_terms"))
    return exploded(counted, [query, *keep, "n_terms"], "_terms", "term")


def term_counts(
    nodes: DataFrame,
    node: str = "node_id",
    text: str = "text",
    keep: Sequence[str] = (),
    vocabulary: DataFrame | None = None,
) -> DataFrame:
    """Term frequencies per node, counted inside the row.

    ``vocabulary`` (a ``term`` column) drops other terms.
    """
    # Sorted tokens: a run's length is the term's frequency.
    words = F.array_sort(X.tokens(F.col(text)))

    def counts(rows: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(rows) - 1), lambda i: (i == 0) | (F.get(rows, i) != F.get(rows, i - 1)))

        def cut(starts: Column) -> Column:
            return F.transform(
                starts,
                lambda s, j: F.struct(
                    F.get(rows, s).alias("term"), (F.coalesce(F.get(starts, j + 1), F.size(rows)) - s).cast("long").alias("tf")
                ),
            )

        return F.when(F.size(rows) > 0, let(first, cut)).otherwise(F.array().cast("array<struct<term:string,tf:bigint>>"))

    rows = exploded(nodes, [node, *keep], let(words, counts), "_t").select(node, *keep, "_t.term", "_t.tf")
    if vocabulary is not None:
        rows = skew.join_small(rows, vocabulary.select("term").distinct(), ["term"], "left_semi")
    return rows


_TABLE_SIZE = 64


def match_score(tf: Column) -> Column:
    """Contribution of a matched term: the weights of its occurrences fall with 1/j²."""
    sums, total = [], 0.0
    for j in range(1, _TABLE_SIZE + 1):
        total += 1 / (j * j)
        sums.append(F.lit(total))
    rest = F.aggregate(
        F.sequence(F.lit(_TABLE_SIZE + 1), tf.cast("int")),
        F.lit(total),
        lambda acc, j: acc + 1 / (j.cast("double") * j),
    )
    falling = F.when(tf <= _TABLE_SIZE, F.get(F.array(*sums), (tf - 1).cast("int"))).otherwise(rest)
    return MATCH_WEIGHT * falling / RANK_NORM


def _block_scores(k: int, query: str, node: str) -> Callable:
    """Best ``k`` nodes of a block for every question of another."""

    def run(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({query: [], node: [], "score": []})
        if not len(asked) or not len(rows):
            return empty
        rows = rows.sort_values("_word", kind="stable")
        places, nodes = pd.factorize(rows["_node"], sort=True)
        gains, words = rows["_gain"].to_numpy(float), rows["_word"].to_numpy()
        asked = asked.sort_values("_query", kind="stable")
        who, people = pd.factorize(asked["_query"])
        shares, wanted = asked["_share"].to_numpy(float), asked["_term"].to_numpy()
        low, high = np.searchsorted(words, wanted, side="left"), np.searchsorted(words, wanted, side="right")
        cuts = np.searchsorted(who, np.arange(len(people) + 1))
        out = []
        for q in range(len(people)):
            row = np.zeros(len(nodes))
            for t in range(cuts[q], cuts[q + 1]):
                # A node has one row per term, so no place repeats.
                row[places[low[t] : high[t]]] += gains[low[t] : high[t]] * shares[t]
            row = np.round(row, 9)
            hit = np.flatnonzero(row > 0)
            if len(hit) > k:
                hit = hit[row[hit] >= np.partition(row[hit], len(hit) - k)[len(hit) - k]]
            best = hit[np.lexsort((hit, -row[hit]))][:k]
            out.append(pd.DataFrame({query: people[np.full(len(best), q)], node: nodes[best], "score": row[best]}))
        return pd.concat(out) if out else empty

    return run


def score_topk(
    terms: DataFrame, postings: DataFrame, k: int, query: str = "query_id", node: str = "node_id", scope: Sequence[str] = ()
) -> DataFrame:
    """Best ``k`` nodes per question by the sum of ``gain * share`` over its terms.

    ``terms``: query, term, share; ``postings``: node, term, gain (positive). ``scope`` columns
    exist on both sides and must agree. The score is rounded to 9 digits so that the order of
    additions cannot break ties, which go to the smaller node.
    """
    blank = F.lit("").alias("_scope")
    key = F.to_json(F.struct(*[F.col(c).cast("string") for c in scope])).alias("_scope") if scope else blank
    asked = terms.select(F.col(query).alias("_query"), F.col("term").alias("_term"), F.col("share").alias("_share"), key)
    # Read twice: for the block sizes and for the scores.
    rows = materialize(postings.select(F.col(node).alias("_node"), F.col("term").alias("_word"), F.col("gain").alias("_gain"), key.alias("_in")), "postings")
    if scope:
        v_blocks, q_blocks = F.ceil(F.col("_n") / POSTING_ROWS).alias("_vb"), F.ceil(F.col("_m") / TERM_ROWS).alias("_qb")
        n = rows.groupBy(F.col("_in").alias("_scope")).agg(F.count("*").alias("_n"))
        m = asked.groupBy("_scope").agg(F.count("*").alias("_m"))
        # One row per scope value that both sides hold.
        sizes = materialize(n.join(m, "_scope").select("_scope", v_blocks, q_blocks), "sizes")
        asked, rows = asked.join(sizes, "_scope"), rows.join(sizes.withColumnRenamed("_scope", "_in"), "_in")
    else:
        blocks = [max(1, -(-df.count() // most)) for df, most in ((rows, POSTING_ROWS), (asked, TERM_ROWS))]
        both = [F.lit(n).alias(name) for n, name in zip(blocks, ("_vb", "_qb"), strict=True)]
        asked, rows = asked.select("*", *both), rows.select("*", *both)
    left = in_blocks(asked, "_qb", "_vb", "_query", "_i", "_j")
    right = in_blocks(rows, "_vb", "_qb", "_node", "_q", "_p")
    schema = T.StructType(
        [
            T.StructField(query, terms.schema[query].dataType),
            T.StructField(node, postings.schema[node].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    pairs = left.groupBy("_scope", "_i", "_j").cogroup(right.groupBy("_in", "_p", "_q"))
    found = pairs.applyInPandas(_block_scores(k, query, node), schema)
    return skew.top_per_key(found, [query], [F.desc("score"), F.col(node)], k)


def lexical_topk(
    terms: DataFrame,
    counts: DataFrame,
    k: int,
    query: str = "query_id",
    node: str = "node_id",
    scope: Sequence[str] = (),
) -> DataFrame:
    """Best ``k`` nodes per question; any matching term counts.

    ``scope`` columns exist on both sides and must agree (tenant, document).
    """
    shares = terms.withColumn("share", 1 / F.col("n_terms"))
    return score_topk(shares, counts.withColumn("gain", match_score(F.col("tf"))), k, query, node, scope)

"""Merging, expanding, re-ranking and labelling result lists.

A question has a few dozen result rows at most, so the per-question windows here
are small; no operator pairs results with each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework import constants as K
from passagework import skew
from passagework.functions import text as X
from passagework.functions.arrays import ordered_text


def coarse_k(
    text: Column,
    k: int = K.COARSE_K,
    boost: int = K.SHORT_QUERY_BOOST,
    short: int = K.SHORT_QUERY_CHARS,
) -> Column:
    """Result size of the first stage; short questions get more."""
    return F.when(F.length(text) < short, k + boost).otherwise(k)


def cut_to(ranked: DataFrame, sizes: DataFrame, query: str = "query_id") -> DataFrame:
    """Keep the ``coarse_k`` first rows of every question."""
    return ranked.join(sizes.select(query, "coarse_k"), query).where("rank <= coarse_k").drop("coarse_k")


def rrf_fuse(
    dense: DataFrame, sparse: DataFrame, constant: int = K.RRF_K, query: str = "query_id", node: str = "node_id"
) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (``rank`` counts from 1).

    Equal scores keep the dense order first, then the lexical one.
    """
    left = dense.select(query, node, F.col("rank").alias("dense_rank"), "similarity")
    right = sparse.select(query, node, F.col("rank").alias("sparse_rank"))

    def share(rank: str) -> Column:
        return F.coalesce(1 / (constant + F.col(rank)), F.lit(0.0))

    fused = left.join(right, [query, node], "full").withColumn(
        "score", share("dense_rank") + share("sparse_rank")
    )
    order = Window.partitionBy(query).orderBy(
        F.desc("score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank")
    )
    return fused.withColumn("rank", F.row_number().over(order))


def fuse_recall(
    dense: DataFrame,
    sparse: DataFrame,
    query: str = "query_id",
    node: str = "node_id",
    allow_sparse_only: bool = False,
) -> DataFrame:
    """Fusion with the fallbacks for an empty list, and the best dense similarity.

    No dense hit: no result, unless ``allow_sparse_only``. No lexical hit: the dense
    list with its similarities and without ``max_dense``.
    """
    whole = Window.partitionBy(query)
    joined = (
        rrf_fuse(dense, sparse, K.RRF_K, query, node)
        .withColumn("max_dense", F.max("similarity").over(whole))
        .withColumn("_lexical", F.max(F.col("sparse_rank").isNotNull()).over(whole))
    )
    if not allow_sparse_only:
        joined = joined.where("max_dense is not null")
    return (
        joined.withColumn("score", F.when(F.col("_lexical"), F.col("score")).otherwise(F.col("similarity")))
        .withColumn("max_dense", F.when(F.col("_lexical"), F.col("max_dense")))
        .drop("_lexical")
    )


def overlap_report(dense: DataFrame, sparse: DataFrame, query: str = "query_id", node: str = "node_id") -> DataFrame:
    """Results found by both lists, only dense or only lexical, per question."""
    tagged = rrf_fuse(dense, sparse, K.RRF_K, query, node).withColumn(
        "tag",
        F.when(F.col("dense_rank").isNull(), "S").when(F.col("sparse_rank").isNull(), "D").otherwise("B"),
    )
    return tagged.groupBy(query).agg(
        F.count_if(F.col("tag") == "B").alias("both"),
        F.count_if(F.col("tag") == "D").alias("dense_only"),
        F.count_if(F.col("tag") == "S").alias("sparse_only"),
    )


def expand_parents(
    ranked: DataFrame, parents: DataFrame, query: str = "query_id", node: str = "node_id"
) -> DataFrame:
    """Replace children by their parents; the first child of a parent wins.

    ``ranked`` has ``parent_id`` and ``content``; ``parents`` has ``parent_id`` and
    ``content``. Rows without a parent, or whose parent is missing, stay. A question
    none of whose parents exists keeps all its children. Document, file name and chunk
    index come from the parent where it has them; with a ``tenant_id`` on both sides a
    parent of another tenant counts as missing.
    """
    key = ["parent_id", *(["tenant_id"] if "tenant_id" in parents.columns and "tenant_id" in ranked.columns else [])]
    own = [c for c in ("doc_id", "filename", "chunk_index") if c in parents.columns and c in ranked.columns]
    renamed = [F.col(c).alias(f"_parent_{c}") for c in ("content", *own)]
    joined = ranked.join(parents.select(*key, *renamed), key, "left")
    whole = Window.partitionBy(query)
    siblings = Window.partitionBy(query, "_group").orderBy("rank")
    has_parent = F.col("parent_id").isNotNull()
    marked = (
        joined.withColumn("_any", F.max(F.col("_parent_content").isNotNull()).over(whole))
        .withColumn(
            "_group",
            F.when(has_parent & F.col("_any"), F.concat(F.lit("p"), "parent_id")).otherwise(
                F.concat(F.lit("n"), F.col(node).cast("string"))
            ),
        )
        .withColumn("_first", F.row_number().over(siblings))
        .where("_first = 1")
    )
    expanded = F.col("_parent_content").isNotNull()
    again = Window.partitionBy(query).orderBy("rank")
    for c in own:
        marked = marked.withColumn(c, F.when(expanded, F.col(f"_parent_{c}")).otherwise(F.col(c)))
    return (
        marked.withColumn("content", F.coalesce("_parent_content", "content"))
        .withColumn("expanded", expanded)
        .withColumn("rank", F.row_number().over(again))
        .drop(*[f"_parent_{c}" for c in ("content", *own)], "_any", "_group", "_first")
    )


def first_rows(ranked: DataFrame, k: int) -> DataFrame:
    return ranked.where(F.col("rank") <= k)


def rerank_candidates(
    ranked: DataFrame, limit: int = K.RERANK_CANDIDATES, query: str = "query_id"
) -> DataFrame:
    """The best rows by fused score that are worth the costly scorer."""
    return skew.top_per_key(
        ranked.withColumnRenamed("rank", "_old"), [query], [F.desc("score"), F.col("_old")], limit
    ).drop("_old")


def token_overlap(question: Column, content: Column) -> Column:
    """Default scorer: share of the question's terms that occur in the text."""
    terms = X.query_terms(question)
    both = F.size(F.array_intersect(terms, X.tokens(content)))
    return both / F.greatest(F.size(terms), F.lit(1))


def apply_rerank(
    scored: DataFrame,
    k: int = K.FINE_K,
    min_score: float | None = K.RERANK_MIN_SCORE,
    query: str = "query_id",
) -> DataFrame:
    """Order by ``rerank_score`` and cut at ``k``.

    Scores below ``min_score`` are dropped unless that would drop all. A question
    with a missing score keeps its old order with score 0.
    """
    whole = Window.partitionBy(query)
    value = F.col("rerank_score")
    floor = F.lit(min_score) if min_score is not None else F.lit(float("-inf"))
    checked = (
        scored.withColumn("_failed", F.max(value.isNull()).over(whole))
        .withColumn("rerank_score", F.when(F.col("_failed"), 0.0).otherwise(value))
        .withColumn("_good", F.col("_failed") | (F.col("rerank_score") >= floor))
        .withColumn("_any_good", F.max("_good").over(whole))
        .where(F.col("_good") | ~F.col("_any_good"))
    )
    order = Window.partitionBy(query).orderBy(F.desc("rerank_score"), "rank")
    return (
        checked.withColumn("_new", F.row_number().over(order))
        .where(F.col("_new") <= k)
        .withColumn("rank", F.col("_new"))
        .drop("_failed", "_good", "_any_good", "_new")
    )


def normalize_scores(ranked: DataFrame, score: str = "rerank_score", query: str = "query_id") -> DataFrame:
    """Min-max to [0, 1] per question; equal scores through a sigmoid with 4 digits."""
    whole = Window.partitionBy(query)
    low, high = F.min(score).over(whole), F.max(score).over(whole)
    value = F.col(score)
    return (
        ranked.withColumn("_low", low)
        .withColumn("_high", high)
        .withColumn(
            "score",
            F.when(F.col("_high") > F.col("_low"), (value - F.col("_low")) / (F.col("_high") - F.col("_low")))
            .otherwise(F.round(1 / (1 + F.exp(-value)), 4)),
        )
        .drop("_low", "_high")
    )


def top_score(results: DataFrame, query: str = "query_id") -> DataFrame:
    """Best dense similarity of a question, or the score of its first row."""
    return results.groupBy(query).agg(
        F.coalesce(F.max("max_dense"), F.min_by("score", "rank"), F.lit(0.0)).alias("top_score")
    )


def gate(tops: DataFrame, expansions: DataFrame, threshold: float = K.STAGE1_THRESHOLD, query: str = "query_id") -> DataFrame:
    """Questions with ``deep``: weak first stage and an expanded question text at hand."""
    joined = tops.join(expansions.select(query, "expanded_text"), query, "left")
    text = F.coalesce("expanded_text", F.lit(""))
    return joined.withColumn("deep", (F.col("top_score") <= threshold) & (text != ""))


def confidence(top: Column, deep: Column) -> Column:
    low = F.when(top >= K.CONFIDENCE_HIGH, "high").when(top >= K.CONFIDENCE_MEDIUM, "medium").otherwise("low")
    fast = F.when(top >= K.CONFIDENCE_HIGH, "high").otherwise("medium")
    return F.when(deep, low).otherwise(fast)


def drops_results(label: Column, top: Column) -> Column:
    """Results of hopeless questions are dropped."""
    return (label == "low") & (top < K.CONFIDENCE_FALLBACK)


def assemble_context(results: DataFrame, query: str = "query_id") -> DataFrame:
    """Numbered context blocks and the list of sources, one row per question.

    A question has at most a handful of final results, so the lists are short.
    """
    block = F.concat(
        F.lit("["), F.col("rank").cast("string"), F.lit("] ("), F.coalesce("filename", F.lit("")),
        F.lit(")\n"), F.col("content"),
    )
    source = F.struct(
        F.col("rank").alias("position"),
        F.col("doc_id"),
        F.col("filename"),
        F.col("chunk_index"),
        F.round("score", 4).alias("score"),
        F.substring("content", 1, 300).alias("snippet"),
    )
    rows = F.collect_list(F.struct(F.col("rank").alias("position"), block.alias("text")))
    return results.groupBy(query).agg(
        ordered_text(rows, "\n\n").alias("context"),
        F.sort_array(F.collect_list(source)).alias("sources"),
    )


def clear_sources(answer: Column, sources: Column) -> Column:
    """No sources for answers that say the corpus holds no answer."""
    return F.when(X.contains_any(answer, K.NO_ANSWER), F.slice(sources, 1, 0)).otherwise(sources)


def question_key(tenant: Column, question: Column, k: Column, doc_ids: Column) -> Column:
    """Key of a question: the same key has the same result."""
    base = F.concat_ws(
        ":", F.lit("rag"), F.coalesce(tenant.cast("string"), F.lit("None")), F.md5(question), k.cast("string")
    )
    ids = F.array_join(F.sort_array(doc_ids), ",")
    return F.when(F.coalesce(F.size(doc_ids), F.lit(0)) > 0, F.concat_ws(":", base, ids)).otherwise(base)


def once_per_key(questions: DataFrame, answer, key: str = "question_key") -> DataFrame:
    """Run ``answer`` on distinct keys and give the result to every question.

    A popular question may be a large part of the batch; its rows are spread when
    they get their answer.
    """
    others = [c for c in questions.columns if c != key]
    distinct = skew.first_per_key(questions, [key], F.struct(*others), others)
    sizes = questions.groupBy(key).agg(F.count("*").alias("_n"))
    answers = answer(distinct).join(sizes, key)
    return skew.join_groups(questions, answers, [key], "_n", others, "inner")


def rewrite_accepted(question: Column, rewritten: Column) -> Column:
    """The rewritten question when it is usable, else the original."""
    clean = X.strip(rewritten)
    return F.when((F.length(clean) > 2) & (clean != question), clean).otherwise(question)

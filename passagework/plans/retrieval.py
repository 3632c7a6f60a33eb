"""Retrieval of whole question tables: recall, fusion, expansion, deep search, context."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework import constants as K
from passagework import skew
from passagework.operators import fusion, lexical, lexical_index, vector
from passagework.operators.models import score_pairs
from passagework.session import materialize


TENANT = "tenant_id"


@dataclass(frozen=True)
class Corpus:
    """Index tables.

    ``nodes``: node_id, doc_id, filename, chunk_index, content, parent_id;
    ``vectors``: node_id, embedding; ``parents``: parent_id, content, and, where a parent's own
    metadata replace the child's, doc_id, filename, chunk_index. With tenants every table and the
    questions have a ``tenant_id``: a question then sees rows of its tenant only. ``postings`` is a
    stored term index (``lexical_index``); without it terms are counted for each search.
    ``lists`` is a clustered vector index: (cluster model, table of ``vector.write_lists``).
    """

    nodes: DataFrame
    vectors: DataFrame
    parents: DataFrame
    postings: DataFrame | None = None
    lists: tuple | None = None


def recall(
    corpus: Corpus,
    questions: DataFrame,
    scope: DataFrame | None = None,
    allow_sparse_only: bool = False,
    sizes: tuple[int, int] = (K.COARSE_K, K.SHORT_QUERY_BOOST),
    probes: int | None = None,
) -> DataFrame:
    """Dense and lexical recall fused, cut at each question's ``coarse_k``.

    ``questions``: query_id, question, embedding. ``scope``: (query_id, doc_id)
    pairs; a question listed there only sees those documents. ``sizes``: rows of the
    first stage and the extra rows of short questions. ``probes`` turns the clustered
    vector search on, for questions without document scope or tenant.
    """
    sized = questions.select("query_id", fusion.coarse_k(F.col("question"), *sizes).alias("coarse_k"))
    asked = questions.where("embedding is not null")
    limit = sum(sizes)
    if scope is not None and TENANT in questions.columns:
        # A document of another tenant is never in scope.
        owners = corpus.nodes.select("doc_id", TENANT).distinct()
        scope = scope.join(questions.select("query_id", TENANT), "query_id").join(owners, ["doc_id", TENANT], "left_semi").drop(TENANT)
    dense = _scoped_dense(corpus, asked, scope, limit, probes)
    sparse = _scoped_sparse(corpus, questions, scope, limit)
    fused = fusion.fuse_recall(
        fusion.cut_to(dense, sized), fusion.cut_to(sparse, sized), allow_sparse_only=allow_sparse_only
    )
    # A few dozen rows per question: stored once, so that later steps reuse them.
    return materialize(fusion.cut_to(fused, sized), "recall")


def _open_dense(corpus: Corpus, asked: DataFrame, limit: int, probes: int | None) -> DataFrame:
    if TENANT in asked.columns:
        own = asked.withColumn(TENANT, F.array(F.col(TENANT).cast("string")))
        return vector.vector_topk(own, corpus.vectors, limit, scope=TENANT)
    if probes is not None and corpus.lists is not None:
        model, index = corpus.lists
        return vector.ann_topk(asked, index, model, limit, probes)
    return vector.vector_topk(asked, corpus.vectors, limit)


def _scoped_dense(corpus: Corpus, asked: DataFrame, scope: DataFrame | None, limit: int, probes: int | None) -> DataFrame:
    if scope is None:
        return _open_dense(corpus, asked, limit, probes)
    # A question has a handful of documents in its scope (the summary top-k).
    lists = scope.groupBy("query_id").agg(F.collect_list(F.col("doc_id").cast("string")).alias("doc_id"))
    docs = corpus.vectors.join(corpus.nodes.select("node_id", "doc_id"), "node_id")
    open_rows = _open_dense(corpus, asked.join(lists, "query_id", "left_anti"), limit, probes)
    scoped = vector.vector_topk(asked.join(lists, "query_id"), docs, limit, scope="doc_id")
    return open_rows.unionByName(scoped)


def _scoped_sparse(corpus: Corpus, questions: DataFrame, scope: DataFrame | None, limit: int) -> DataFrame:
    tenant = [TENANT] if TENANT in questions.columns else []
    if corpus.postings is not None:
        return lexical_index.search(corpus.postings, questions, limit, tenant=TENANT if tenant else None, scope=scope)
    terms = lexical.question_terms(questions, text="question", keep=tenant)
    keep = ["doc_id", *tenant]
    counts = lexical.term_counts(corpus.nodes, text="content", keep=keep, vocabulary=terms)
    if scope is None:
        return lexical.lexical_topk(terms, counts, limit, scope=tenant)
    scoped_terms = terms.join(scope, "query_id")
    open_terms = terms.join(scope.select("query_id").distinct(), "query_id", "left_anti")
    return lexical.lexical_topk(open_terms, counts, limit, scope=tenant).unionByName(
        lexical.lexical_topk(scoped_terms, counts, limit, scope=keep)
    )


def _rows_of(table: DataFrame, asked: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """The rows of an index table that stored results name; the table moves only for results too many to broadcast."""
    return table.join(F.broadcast(asked) if skew.small_enough(asked) else asked, key, how)


def attach(ranked: DataFrame, nodes: DataFrame) -> DataFrame:
    """Add the node columns to result rows; the results are the small side, and nodes are keyed by id."""
    return materialize(_rows_of(nodes, materialize(ranked, "ranked"), "node_id"), "results")


def expand(ranked: DataFrame, corpus: Corpus) -> DataFrame:
    """Result rows with their node columns, replaced by their parents."""
    rows = attach(ranked, corpus.nodes)
    asked = materialize(rows.select("parent_id").distinct(), "asked")
    return fusion.expand_parents(rows, _rows_of(corpus.parents, asked, "parent_id", "left_semi"))


def retrieve_fast(fused: DataFrame, corpus: Corpus, k: int = K.FINE_K) -> DataFrame:
    """Expand to parents and keep the first rows."""
    return fusion.first_rows(expand(fused, corpus), k)


def retrieve_deep(
    fused: DataFrame,
    questions: DataFrame,
    corpus: Corpus,
    k: int = K.FINE_K,
    scorer: Callable | None = None,
) -> DataFrame:
    """Expand, keep the candidates worth scoring, re-rank and normalise.

    ``scorer`` takes (question, text) pairs; the default is the share of the
    question's terms found in the text.
    """
    expanded = expand(fused, corpus)
    pairs = fusion.rerank_candidates(expanded).join(questions.select("query_id", "question"), "query_id")
    if scorer is None:
        overlap = fusion.token_overlap(F.col("question"), F.col("content"))
        scored = pairs.withColumn("rerank_score", overlap)
    else:
        scored = score_pairs(pairs, scorer)
    return fusion.normalize_scores(fusion.apply_rerank(scored, k)).drop("question")


def two_level_scope(
    questions: DataFrame,
    summaries: DataFrame,
    documents: DataFrame,
    k: int = K.SUMMARY_TOP_K,
    min_docs: int = K.SUMMARY_MIN_DOCS,
) -> DataFrame:
    """Documents a question is restricted to: (query_id, doc_id).

    Only questions of tenants with at least ``min_docs`` documents are restricted;
    questions without any matching summary stay unrestricted.
    ``questions``: query_id, tenant_id, embedding; ``summaries``: doc_id,
    tenant_id, embedding; ``documents``: one row per document with tenant_id.
    """
    large = documents.groupBy("tenant_id").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_docs)
    asked = questions.join(large.select("tenant_id"), "tenant_id", "left_semi")
    scoped = asked.withColumn("tenant_id", F.array(F.col("tenant_id").cast("string")))
    found = vector.vector_topk(scoped, summaries, k, node="doc_id", scope="tenant_id")
    return found.select("query_id", "doc_id", "similarity", "rank")


def answer_questions(
    questions: DataFrame,
    corpus: Corpus,
    expansions: DataFrame | None = None,
    scope: DataFrame | None = None,
    k: int = K.FINE_K,
    scorer: Callable | None = None,
) -> DataFrame:
    """Context, sources and confidence for every question.

    ``expansions`` (query_id, expanded_text, embedding and, with tenants, tenant_id) feeds
    the deep search of questions whose first stage was weak. Returns one row per question; questions
    without results have an empty context.
    """
    fast = retrieve_fast(recall(corpus, questions, scope), corpus, k).withColumn("deep", F.lit(False))
    fast = materialize(fast, "fast")
    tops = fusion.top_score(fast)
    if expansions is None:
        gated = tops.withColumn("deep", F.lit(False))
        results = fast
    else:
        gated = fusion.gate(tops, expansions)
        weak = gated.where("deep").select("query_id")
        tenant = [TENANT] if TENANT in questions.columns else []
        again = expansions.select("query_id", F.col("expanded_text").alias("question"), "embedding", *tenant)
        deep_questions = again.join(weak, "query_id", "left_semi")
        deep = retrieve_deep(recall(corpus, deep_questions, scope), deep_questions, corpus, k, scorer)
        deep = deep.withColumn("deep", F.lit(True)).select(*fast.columns)
        results = fast.join(weak, "query_id", "left_anti").unionByName(deep)
    label = fusion.confidence(F.col("top_score"), F.col("deep"))
    labelled = gated.select("query_id", "top_score", "deep", label.alias("confidence"))
    kept = labelled.where(~fusion.drops_results(F.col("confidence"), F.col("top_score")))
    context = fusion.assemble_context(results.join(kept.select("query_id"), "query_id", "left_semi"))
    return (
        questions.select("query_id", "question")
        .join(labelled, "query_id", "left")
        .join(context, "query_id", "left")
        .withColumn("context", F.coalesce("context", F.lit("")))
        .withColumn(
            "confidence",
            F.when(F.col("deep") & F.col("sources").isNull(), "low").otherwise(F.col("confidence")),
        )
    )

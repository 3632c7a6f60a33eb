"""Answer quality: retrieval statistics, claims, judge replies, verdicts, interventions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagework import constants as K
from passagework.functions import text as X
from passagework.functions.arrays import exploded
from passagework.session import materialize

VERDICT_COLUMNS = ["item_id", "dimension", "passed", "score", "details"]


# --- retrieval quality ---------------------------------------------------------------
def retrieval_stats(queries: DataFrame, scores: DataFrame, query: str = "query_id") -> DataFrame:
    """Average, best, worst, dispersion and share of relevant scores per question.

    Questions without scores fail with 0. The pass mark is an average of 0.1.
    """
    stats = scores.groupBy(query).agg(
        F.avg("score").alias("avg_score"),
        F.max("score").alias("max_score"),
        F.min("score").alias("min_score"),
        F.avg((F.col("score") > K.RETRIEVAL_BASELINE).cast("double")).alias("pass_rate"),
        F.count("score").alias("results"),
    )
    joined = queries.select(query).join(stats, query, "left")
    average = F.col("avg_score")
    # fixed format of the report
    report = F.format_string(
        "平均分=%.4f, 最高分=%.4f, 最低分=%.4f, 分数离散度=%.4f, 阈值通过率=%.2f%%, 共 %d 条检索结果",
        average, "max_score", "min_score", F.col("max_score") - F.col("min_score"),
        F.col("pass_rate") * 100, "results",
    )
    borderline = (average >= K.RETRIEVAL_FAIL) & (average < K.RETRIEVAL_BORDERLINE)
    note = F.when(borderline, F.lit(" （检索质量处于边界线，建议检查查询或知识库索引）")).otherwise(F.lit(""))
    empty = F.coalesce("results", F.lit(0)) == 0
    return joined.select(
        query,
        F.when(empty, False).otherwise(average >= K.RETRIEVAL_FAIL).alias("passed"),
        F.when(empty, 0.0).otherwise(F.round(average, 4)).alias("score"),
        F.coalesce(borderline, F.lit(False)).alias("borderline"),
        "max_score",
        "min_score",
        (F.col("max_score") - F.col("min_score")).alias("dispersion"),
        "pass_rate",
        F.coalesce("results", F.lit(0)).alias("results"),
        F.when(empty, F.lit("检索结果为空，无法评估检索质量")).otherwise(F.concat(report, note)).alias("details"),
    )


def skip_generation(scores: Column, threshold: float = K.STAGE1_THRESHOLD) -> Column:
    """True when no score reaches the threshold."""
    return F.coalesce(F.array_max(scores) < threshold, F.lit(True))


def extract_scores(sources: Column, field: str = "score") -> Column:
    """Numeric scores of a sources array; missing and non-numeric ones are left out."""
    numbers = F.transform(sources, lambda s: s[field].try_cast("double"))
    return F.filter(numbers, lambda x: x.isNotNull())


def source_doc_ids(sources: Column) -> Column:
    """Distinct document ids of a sources array: ``doc_id``, else ``source``."""

    def some(x: Column) -> Column:
        return F.when(x != "", x)

    ids = F.transform(sources, lambda s: F.coalesce(some(s["doc_id"]), some(s["source"])))
    return F.array_distinct(F.filter(ids, lambda x: x.isNotNull()))


# --- claims ------------------------------------------------------------------------------
def claims(answer: Column) -> Column:
    """Claims of an answer: source marks removed, short and template sentences dropped."""
    clean = F.regexp_replace(answer, r"(?U)\[来源:\d+\]", "")
    parts = X.non_blank(F.split(clean, r"[。；\n]", -1))
    return F.filter(
        parts, lambda c: (F.length(c) >= 4) & ~c.rlike("|".join(K.TEMPLATE_SENTENCES))
    )


def fallback_claims(text: Column) -> Column:
    """Sentences of more than three characters."""
    parts = X.non_blank(F.split(text, r"[。！？\n;；]", -1))
    return F.filter(parts, lambda c: F.length(c) > 3)


def line_claims(reply: Column) -> Column:
    """Claims of a model reply, one per line, without its echoed headings."""
    lines = X.non_blank(F.split(reply, "\n", -1))
    return F.filter(
        lines, lambda c: ~(F.startswith(c, F.lit("文本")) | F.startswith(c, F.lit("事实")))
    )


def decomposed_claims(reply: Column, text: Column) -> Column:
    """Model claims when there are any, else the fallback."""
    found = F.coalesce(line_claims(reply), F.array().cast("array<string>"))
    return F.when(F.size(found) > 0, found).otherwise(fallback_claims(text))


def claim_rows(items: DataFrame, expression: Column, keep: Sequence[str]) -> DataFrame:
    return exploded(items, keep, expression, "claim", "position")


def nearest_source(
    claims: DataFrame, vectors: DataFrame, keys: Sequence[str] = ("item_id", "position"), scope: str = "doc_ids", block_rows: int = 4096
) -> DataFrame:
    """``claims`` with ``similarity`` and ``parent_id`` of the nearest node among the answer's sources.

    ``claims``: keys, embedding, an array of document ids; ``vectors``: node_id, doc_id, parent_id,
    embedding. The claims and the nodes of a document meet in blocks of at most about ``block_rows`` rows on either
    side, many small documents to a task; a block gives one best row per claim, never its pairs. A
    claim without sources has similarity 0.
    """
    keys = list(keys)
    asked = claims.select(*keys, F.col("embedding").alias("_claim"), F.explode(scope).alias("doc_id"))
    m = asked.groupBy("doc_id").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("_qb"), F.count("*").alias("_m"))
    n = vectors.groupBy("doc_id").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("_vb"), F.count("*").alias("_n"))
    # One row per document that an answer names.
    sizes = materialize(m.join(n, "doc_id"), "sizes")
    rows = sizes.agg(F.sum(F.col("_m") * F.col("_vb") + F.col("_n") * F.col("_qb"))).first()[0] or 0
    tasks = int(rows // block_rows) + 1
    blocks = sizes.select("doc_id", "_qb", "_vb")

    def dealt(df: DataFrame, own: str, other: str, salt: Sequence[str], names: tuple[str, str]) -> DataFrame:
        spread = df.join(blocks, "doc_id").withColumn(names[0], F.pmod(F.xxhash64(*salt), own).cast("int"))
        spread = spread.withColumn(names[1], F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        return spread.withColumn("_task", F.pmod(F.xxhash64("doc_id", "_i", "_j"), F.lit(tasks))).drop(own, other)

    left = dealt(asked, "_qb", "_vb", keys, ("_i", "_j"))
    right = dealt(vectors.select("doc_id", "node_id", "parent_id", F.col("embedding").alias("_node")), "_vb", "_qb", ["node_id"], ("_j", "_i"))
    fields = [claims.schema[k] for k in keys] + [vectors.schema["node_id"], vectors.schema["parent_id"], T.StructField("_sim", T.DoubleType())]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields])
    found = left.groupBy("_task").cogroup(right.groupBy("_task")).applyInPandas(_nearest_of_block(keys), schema)
    best = F.min_by(F.struct("_sim", "parent_id"), F.struct((-F.col("_sim")).alias("s"), "node_id"))
    joined = claims.join(found.groupBy(*keys).agg(best.alias("_best")), keys, "left")
    return joined.withColumn("similarity", F.coalesce("_best._sim", F.lit(0.0))).withColumn("parent_id", F.col("_best.parent_id")).drop("_best")


def _nearest_of_block(keys: list[str]):
    """The nearest node of each claim, document by document."""

    def run(asked: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        out = []
        sides = {k: part for k, part in nodes.groupby(["doc_id", "_i", "_j"], sort=False)}
        for key, part in asked.groupby(["doc_id", "_i", "_j"], sort=False):
            if key not in sides:
                continue
            side = sides[key].sort_values("node_id")
            a, b = (np.stack(x.to_numpy()).astype(np.float64) for x in (part["_claim"], side["_node"]))
            size = np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))
            sims = np.round(np.divide(a @ b.T, size, out=np.zeros(size.shape), where=size > 0), 9)
            at = sims.argmax(1)  # the first of equals, hence the smallest node
            out.append(part[keys].assign(
                node_id=side["node_id"].to_numpy()[at], parent_id=side["parent_id"].to_numpy()[at], _sim=sims[np.arange(len(at)), at]
            ))
        return pd.concat(out) if out else pd.DataFrame(columns=[*keys, "node_id", "parent_id", "_sim"])

    return run


def claim_status(similarity: Column) -> Column:
    return (
        F.when(similarity >= K.CLAIM_SUPPORTED, "supported")
        .when(similarity >= K.CLAIM_PARTIAL, "partial")
        .otherwise("hallucination")
    )


def whitespace_terms(text: Column) -> Column:
    return F.array_distinct(X.non_blank(F.split(text, r"(?U)[\s\x1c-\x1f]+", -1)))


def parent_recheck(rows: DataFrame, claim: str = "claim", parent: str = "parent_text") -> DataFrame:
    """Accept weak claims whose words occur in the parent text (share above 0.30)."""
    words = whitespace_terms(F.col(claim))
    shared = F.size(F.array_intersect(words, whitespace_terms(F.col(parent))))
    overlap = shared / F.greatest(F.size(words), F.lit(1))
    status = claim_status(F.col("similarity"))
    accepted = F.coalesce((status != "supported") & (overlap > K.PARENT_OVERLAP), F.lit(False))
    return rows.withColumn("_accepted", accepted).select(
        *[c for c in rows.columns if c not in ("similarity", "status")],
        F.when(F.col("_accepted"), F.greatest(F.col("similarity"), F.lit(K.CLAIM_SUPPORTED)))
        .otherwise(F.col("similarity"))
        .alias("similarity"),
        F.when(F.col("_accepted"), "supported").otherwise(status).alias("status"),
    )


def vector_factuality(items: DataFrame, checked: DataFrame, item: str = "item_id") -> DataFrame:
    """Verdict per answer from its claims.

    ``items``: item_id, answer, has_sources; ``checked``: item_id, similarity, status.
    """
    totals = checked.groupBy(item).agg(
        F.count("*").alias("claims"),
        F.count_if(F.col("status") == "hallucination").alias("bad"),
        F.count_if(F.col("status") == "partial").alias("weak"),
        F.avg("similarity").alias("mean"),
    )
    joined = items.join(totals, item, "left")
    unknown = X.contains_any(F.col("answer"), K.DONT_KNOW)
    no_claims = F.coalesce("claims", F.lit(0)) == 0
    failed = (F.col("bad") / F.col("claims") > K.HALLUCINATION_RATE) | (
        F.col("weak") / F.col("claims") > K.PARTIAL_RATE
    )
    return joined.select(
        item,
        F.lit("factuality").alias("dimension"),
        F.when(unknown | ~F.col("has_sources") | no_claims, True).otherwise(~failed).alias("passed"),
        F.when(unknown, 1.0)
        .when(~F.col("has_sources"), 0.0)
        .when(no_claims, 1.0)
        .when(failed, 0.0)
        .otherwise(F.round("mean", 4))
        .alias("score"),
    )


def token_support(claim: Column, reference: Column, reference_tokens: Column | None = None) -> Column:
    """A claim is supported when enough of its tokens, or one longer word, occur."""
    tokens = X.long_tokens(claim)
    shared = F.size(F.array_intersect(tokens, X.long_tokens(reference) if reference_tokens is None else reference_tokens))
    enough = shared >= F.greatest(F.lit(1.0), F.size(tokens) * 0.3)
    words = F.filter(whitespace_terms(claim), lambda w: F.length(w) > 2)
    literal = F.exists(words, lambda w: F.contains(reference, w))
    return F.coalesce((F.size(tokens) == 0) | enough | literal, F.lit(False))


def faithfulness(items: DataFrame, supported: DataFrame, item: str = "item_id") -> DataFrame:
    """Share of supported claims per answer.

    ``items``: answer, context, is_refusal, context_has_answer, similarity (answer
    against context); ``supported``: item_id, supported.
    """
    totals = supported.groupBy(item).agg(F.avg(F.col("supported").cast("double")).alias("share"))
    joined = items.join(totals, item, "left")
    no_answer = F.coalesce("answer", F.lit("")) == ""
    no_context = F.coalesce("context", F.lit("")) == ""
    refused = F.coalesce("is_refusal", F.lit(False))
    known = F.coalesce("context_has_answer", F.lit(False))
    value = F.coalesce("share", "similarity")
    return joined.select(
        item,
        F.lit("factuality").alias("dimension"),
        F.when(no_answer | no_context, True)
        .when(refused, ~known)
        .when(F.col("share").isNotNull(), F.col("share") >= 0.5)
        .otherwise(F.col("similarity") >= 0.4)
        .alias("passed"),
        F.when(no_answer, 1.0)
        .when(no_context, 0.5)
        .when(refused, F.when(known, 0.0).otherwise(1.0))
        .otherwise(F.round(value, 4))
        .alias("score"),
    )


# --- relevance and correctness ------------------------------------------------------------
def term_coverage(question: Column, answer: Column) -> Column:
    """Share of the question's longer tokens that the answer uses, case kept; 1 when it has none."""
    stop = F.array(*[F.lit(w) for w in K.STOP_WORDS])
    wanted = F.array_except(X.long_tokens(question, fold=False), stop)
    used = F.size(F.array_intersect(wanted, X.tokens(answer, fold=False)))
    return F.when(F.size(wanted) == 0, 1.0).otherwise(used / F.size(wanted))


def answer_relevancy(question: Column, answer: Column, similarity: Column) -> Column:
    """Mix of similarity, term coverage and answer length."""
    empty = (F.coalesce(question, F.lit("")) == "") | (F.coalesce(answer, F.lit("")) == "")
    length = F.least(F.lit(1.0), F.length(answer) / 20)
    mixed = F.round(similarity * 0.5 + term_coverage(question, answer) * 0.3 + length * 0.2, 4)
    score = F.when(empty, 1.0).otherwise(mixed)
    return F.struct((empty | (score >= 0.4)).alias("passed"), score.alias("score"))


def answer_correctness(
    answer: Column, truth: Column, judge_error: Column, judge_passed: Column, judge_score: Column, similarity: Column
) -> Column:
    """The judge's result, or the similarity to the true answer when the judge failed."""
    no_answer = F.coalesce(answer, F.lit("")) == ""
    no_truth = F.coalesce(truth, F.lit("")) == ""
    passed = (
        F.when(no_answer | no_truth, True)
        .when(judge_error, similarity >= 0.4)
        .otherwise(F.coalesce(judge_passed, F.lit(False)))
    )
    score = (
        F.when(no_answer, 1.0)
        .when(no_truth, 0.5)
        .when(judge_error, F.round(similarity, 4))
        .otherwise(F.coalesce(judge_score, F.lit(0.5)))
    )
    return F.struct(passed.alias("passed"), score.alias("score"))


# --- judge replies ----------------------------------------------------------------------------
def parse_judge(raw: Column) -> Column:
    """Fields of a judge's JSON reply, or the kind of failure.

    Code fences and prose around the object are dropped; a reply that does not
    parse is tried again without trailing commas and with double quotes.
    """
    blank = X.is_blank(raw)
    text = F.regexp_replace(X.strip(raw), r"(?m)^```(?:json)?\s*", "")
    text = X.strip(F.regexp_replace(text, r"(?m)\s*```\s*$", ""))
    body = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    options = {"allowSingleQuotes": "false"}
    direct = F.from_json(body, "map<string,string>", options)
    mended = F.regexp_replace(F.regexp_replace(body, r",\s*\}", "}"), r",\s*\]", "]")
    repaired = F.from_json(F.replace(mended, F.lit("'"), F.lit('"')), "map<string,string>", options)
    fields = F.coalesce(direct, repaired)
    kind = (
        F.when(blank, "empty").when(body == "", "no_json").when(fields.isNull(), "parse_error")
    )
    return F.struct(F.when(kind.isNull(), fields).alias("fields"), kind.alias("error_type"))


STANDARD_FIELDS = ["passed", "score", "reasoning", "dimension", "details"]


def judge_verdict(fields: Column) -> Column:
    """Standard fields as columns, everything else as metadata."""
    known = F.array(*[F.lit(f) for f in STANDARD_FIELDS])
    truthy = ~F.coalesce(F.lower(fields["passed"]), F.lit("")).isin("false", "0", "0.0", "", "null", "[]", "{}")
    return F.struct(
        truthy.alias("passed"),
        F.coalesce(fields["score"].try_cast("double"), F.lit(0.0)).alias("score"),
        F.coalesce(fields["reasoning"], F.lit("")).alias("reasoning"),
        fields["dimension"].alias("dimension"),
        fields["details"].alias("details"),
        F.map_filter(fields, lambda k, _: ~F.array_contains(known, k)).alias("metadata"),
    )


def apply_error_policy(verdicts: DataFrame, fail_closed: bool = True, error: str = "judge_error") -> DataFrame:
    """Verdicts for failed judges.

    Safety blocks (or passes when not ``fail_closed``), factuality passes with 0,
    relevance passes with 0.7; other dimensions lose the verdict.
    """
    failed = F.coalesce(F.col(error), F.lit(False))
    dimension = F.col("dimension")
    covered = dimension.isin("safety", "factuality", "relevance")
    on_error_pass = F.when(dimension == "safety", F.lit(not fail_closed)).otherwise(True)
    on_error_score = (
        F.when(dimension == "safety", F.lit(0.0 if fail_closed else 1.0))
        .when(dimension == "factuality", 0.0)
        .otherwise(0.7)
    )
    return (
        verdicts.where(~failed | covered)
        .withColumn("passed", F.when(failed, on_error_pass).otherwise(F.col("passed")))
        .withColumn("score", F.when(failed, on_error_score).otherwise(F.col("score")))
    )


def safety_verdict(
    answer: Column, passed: Column, score: Column, violations: Column, reasoning: Column, judge_error: Column,
    fail_closed: bool = True,
) -> Column:
    """Refusals pass; judge errors follow the policy; violations name the first five."""
    refused = X.contains_any(answer, K.REFUSAL)
    error = F.coalesce(judge_error.isNotNull(), F.lit(False))
    ok, value = F.coalesce(passed, F.lit(True)), F.coalesce(score, F.lit(1.0))
    listed = F.array_join(
        F.transform(
            F.slice(violations, 1, 5),
            lambda v: F.concat(
                F.lit("["), F.coalesce(v["type"], F.lit("unknown")), F.lit("] "),
                F.coalesce(v["detail"], F.lit("")), F.lit(" (严重度: "),
                F.coalesce(v["severity"], F.lit("unknown")), F.lit(")"),
            ),
        ),
        "; ",
    )
    has_violations = ~ok & (F.coalesce(F.size(violations), F.lit(0)) > 0)
    return F.struct(
        F.when(refused, True).when(error, F.lit(not fail_closed)).otherwise(ok).alias("passed"),
        F.when(refused, 1.0).when(error, F.lit(0.0 if fail_closed else 1.0)).otherwise(value).alias("score"),
        F.when(refused, F.lit("模型正确拒绝回答不安全问题，通过安全检查"))
        .when(error, F.concat(F.lit(f"安全审查异常（fail-{'closed' if fail_closed else 'open'}）: "), judge_error))
        .when(has_violations, listed)
        .otherwise(F.coalesce(reasoning, F.lit("")))
        .alias("details"),
    )


def factuality_verdict(answer: Column, context: Column, passed: Column, score: Column, judge_error: Column) -> Column:
    """Don't-know answers pass, a blank context passes with 0, else the judge decides."""
    unknown = X.contains_any(answer, K.DONT_KNOW)
    blank = X.is_blank(context)
    error = judge_error.isNotNull()
    return F.struct(
        F.when(unknown | blank | error, True).otherwise(F.coalesce(passed, F.lit(False))).alias("passed"),
        F.when(unknown, 1.0).when(blank | error, 0.0).otherwise(F.coalesce(score, F.lit(0.0))).alias("score"),
    )


# --- verdict tables ------------------------------------------------------------------------------
def verdict_union(frames: Sequence[DataFrame]) -> DataFrame:
    """All dimensions as one long table; missing columns are filled with null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def dimension_gate(verdicts: DataFrame, items: DataFrame, item: str = "item_id") -> DataFrame:
    """Leave out correctness without a truth and retrieval quality with fewer than 2 sources.

    ``items``: item_id, has_truth, n_sources.
    """
    joined = verdicts.join(items.select(item, "has_truth", "n_sources"), item)
    dimension = F.col("dimension")
    kept = ~((dimension == "answer_correctness") & ~F.col("has_truth")) & ~(
        (dimension == "retrieval_quality") & (F.col("n_sources") < 2)
    )
    return joined.where(kept).drop("has_truth", "n_sources")


def winning_rules(rules: Sequence[tuple] = K.INTERVENTION_RULES) -> list[tuple[str, int, str, str]]:
    """For every dimension: its priority and the rule that fires when it fails."""
    ordered = sorted(rules, key=lambda r: r[3])
    out = []
    for dimension, prefix, priority in K.DIMENSIONS:
        rule = next((r for r in ordered if r[0].startswith(prefix)), None)
        if rule is not None:
            out.append((dimension, priority, rule[1], rule[2]))
    return out


def decide(verdicts: DataFrame, rules: Sequence[tuple] = K.INTERVENTION_RULES, item: str = "item_id") -> DataFrame:
    """One intervention per item: the rule of its most important failed dimension.

    A partial aggregate over the verdicts; items without a failure get no action.
    """
    spark = verdicts.sparkSession
    table = spark.createDataFrame(
        winning_rules(rules), "dimension string, _priority int, _action string, _reason string"
    )
    # The table has one row per dimension.
    joined = verdicts.join(F.broadcast(table), "dimension", "left")
    hit = ~F.col("passed") & F.col("_priority").isNotNull()
    best = F.min_by(F.when(hit, F.struct("_action", "_reason")), F.when(hit, F.col("_priority")))
    grouped = joined.groupBy(item).agg(
        best.alias("_best"), F.count_if(~F.col("passed")).alias("failed_dimensions")
    )
    return grouped.select(
        item,
        F.col("_best").isNotNull().alias("intervened"),
        F.coalesce("_best._action", F.lit("none")).alias("action"),
        F.coalesce(
            "_best._reason",
            F.when(F.col("failed_dimensions") > 0, F.lit(K.NO_RULE_REASON)).otherwise(F.lit("")),
        ).alias("reason"),
        "failed_dimensions",
    )


def guard_answers(items: DataFrame, checkers: dict, rules: Sequence[tuple] = K.INTERVENTION_RULES) -> DataFrame:
    """All checkers, the decision and the changed answer, one row per item.

    ``items``: item_id, answer, sources. A checker takes the items and returns verdicts
    (item_id, passed, score); its name is the dimension. Items without a verdict stay as they are.
    """
    frames = [
        check(items).select("item_id", F.lit(name).alias("dimension"), "passed", "score") for name, check in checkers.items()
    ]
    decided = decide(verdict_union(frames), rules)
    joined = items.select("item_id", "answer", "sources").join(decided, "item_id", "left").withColumn("action", F.coalesce("action", F.lit("none")))
    done = apply_intervention(F.col("action"), F.col("answer"), F.col("sources"))
    return joined.withColumn("_done", done).select(
        "item_id", "action", F.coalesce("reason", F.lit("")).alias("reason"), F.coalesce("failed_dimensions", F.lit(0)).alias("failed_dimensions"),
        "_done.answer", "_done.sources",
    )


def apply_intervention(action: Column, answer: Column, sources: Column) -> Column:
    """Answer and sources after the intervention."""
    text = F.coalesce(answer, F.lit(""))
    return F.struct(
        F.when(action == "block", F.lit(K.BLOCK_MESSAGE))
        .when(action == "degrade", F.lit(""))
        .when(action == "warn", F.concat(text, F.lit(K.WARN_SUFFIX)))
        .otherwise(text)
        .alias("answer"),
        F.when(action == "block", F.slice(sources, 1, 0)).otherwise(sources).alias("sources"),
    )


def input_block(items: DataFrame, passed: str = "input_passed") -> tuple[DataFrame, DataFrame]:
    """Items that may be answered, and blocked items with their verdict and action."""
    ok = F.coalesce(F.col(passed), F.lit(True))
    blocked = items.where(~ok).select(
        "item_id",
        F.lit("").alias("answer"),
        F.lit("safety").alias("dimension"),
        F.lit(False).alias("passed"),
        F.lit(0.0).alias("score"),
        F.lit(K.INPUT_BLOCK_DETAIL).alias("details"),
        F.lit("block").alias("action"),
        F.lit(K.INPUT_BLOCK_REASON).alias("reason"),
    )
    return items.where(ok), blocked


def support_of_answers(items: DataFrame, keep: Sequence[str] = ("item_id",)) -> DataFrame:
    """Token support of every claim of the answers against their own context."""
    # A context is cut into tokens once, whatever the number of claims.
    read = items.withColumn("_tokens", X.long_tokens(F.col("context")))
    rows = claim_rows(read, fallback_claims(F.col("answer")), [*keep, "context", "_tokens"])
    return rows.select(*keep, "position", "claim", token_support(F.col("claim"), F.col("context"), F.col("_tokens")).alias("supported"))

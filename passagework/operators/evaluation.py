"""Evaluation sets: validation, roll-ups, run comparison, integrity checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework import constants as K
from passagework import skew
from passagework.functions import text as X


def validate_items(items: DataFrame) -> DataFrame:
    """Add ``error``: null for a usable item. Bad items stay in the table."""
    blank = X.is_blank(F.col("question")) & X.is_blank(F.col("query"))
    return items.withColumn(
        "error", F.when(F.col("id").isNull(), "missing id").when(blank, "missing question")
    )


def first_text(*columns: str) -> Column:
    """First non-blank of several columns, stripped, else an empty string."""
    cleaned = [F.when(X.strip(F.col(c)) != "", X.strip(F.col(c))) for c in columns]
    return F.coalesce(*cleaned, F.lit(""))


def normalize_items(items: DataFrame, context_chars: int = 300) -> DataFrame:
    """One spelling for question, context and answer; a missing answer is made up
    from the context or a fixed sentence."""
    named = items.select(
        "*", first_text("question", "query").alias("_q"), first_text("reference_context", "context").alias("_c"),
        first_text("answer").alias("_a"),
    )
    # fixed text of the stand-in answer
    stand_in = F.concat(F.lit("关于「"), F.substring("_q", 1, 50), F.lit("」的问题，根据相关资料..."))
    answer = (
        F.when(F.col("_a") != "", F.col("_a"))
        .when(F.col("_c") != "", F.substring("_c", 1, context_chars))
        .otherwise(stand_in)
    )
    return named.select(
        F.coalesce("id", F.lit("unknown")).alias("id"),
        F.col("_q").alias("question"),
        F.col("_c").alias("context"),
        answer.alias("answer"),
    )


def fill_dimensions(verdicts: DataFrame, names: Sequence[str], item: str = "item_id", order: str = "position") -> DataFrame:
    """Give verdicts without a dimension the next free judge name, in order."""
    blank = F.coalesce(F.col("dimension"), F.lit("")) == ""
    # An item has one verdict per judge, so these windows hold a handful of rows.
    whole = Window.partitionBy(item)
    numbered = Window.partitionBy(item, "_blank").orderBy(order)
    used = F.collect_set(F.when(~blank, F.col("dimension"))).over(whole)
    free = F.array_except(F.array(*[F.lit(n) for n in names]), F.col("_used"))
    return (
        verdicts.withColumn("_used", used)
        .withColumn("_blank", blank)
        .withColumn("_n", F.row_number().over(numbered))
        .withColumn(
            "dimension",
            F.when(F.col("_blank"), F.coalesce(F.get(free, F.col("_n") - 1), F.lit("unknown"))).otherwise(
                F.col("dimension")
            ),
        )
        .drop("_used", "_blank", "_n")
    )


def dimension_stats(verdicts: DataFrame) -> DataFrame:
    """Average, extremes, pass rate and counts per dimension."""
    return verdicts.groupBy("dimension").agg(
        F.round(F.avg("score"), 4).alias("avg_score"),
        F.round(F.avg(F.col("passed").cast("double")), 4).alias("pass_rate"),
        F.count("*").alias("items"),
        F.round(F.min("score"), 4).alias("min_score"),
        F.round(F.max("score"), 4).alias("max_score"),
        F.count_if(~F.col("passed")).alias("failed"),
    )


def exact_mean(column: str, digits: int = 4) -> Column:
    """Mean of values that have ``digits`` digits, rounded half up to as many; the order of addition cannot change it."""
    whole = F.sum(F.round(F.col(column) * 10**digits).cast("long"))
    n = F.count(column)
    return F.floor((2 * whole + n) / (2 * n)) / F.lit(float(10**digits))


def overall(items: DataFrame, verdicts: DataFrame, item: str = "item_id") -> DataFrame:
    """Headline numbers of a run in one row.

    ``items`` has an ``error`` column. An item without verdicts counts as fully
    passed but not in the macro average; the micro average is the mean of the
    rounded dimension averages.
    """
    per_item = verdicts.groupBy(item).agg(
        F.avg("score").alias("_mean"), F.bool_and("passed").alias("_passed")
    )
    joined = items.select(item, F.col("error").isNull().alias("_valid")).join(per_item, item, "left")
    passed = F.count_if(F.col("_valid") & F.coalesce("_passed", F.lit(True)))
    heads = joined.agg(
        F.count("*").alias("total"),
        F.count_if("_valid").alias("valid"),
        passed.alias("fully_passed"),
        F.round(F.coalesce(F.avg(F.when(F.col("_valid"), F.col("_mean"))), F.lit(0.0)), 4).alias("macro_avg"),
    )
    micro = dimension_stats(verdicts).agg(F.coalesce(exact_mean("avg_score"), F.lit(0.0)).alias("micro_avg"))
    both = heads.unionByName(micro, allowMissingColumns=True)
    joined = both.agg(*[F.first(c, ignorenulls=True).alias(c) for c in both.columns])
    rate = F.when(F.col("valid") > 0, F.round(F.col("fully_passed") / F.col("valid"), 4)).otherwise(0.0)
    return joined.withColumn("overall_pass_rate", rate)


def failure_summary(summary: DataFrame, verdicts: DataFrame, actions: DataFrame) -> DataFrame:
    """Failed items, failure rate per dimension and number of items per action, long form.

    ``failed_items`` counts items with an error too.
    """
    failed = summary.select(
        F.lit("failed_items").alias("kind"),
        F.lit("").alias("name"),
        (F.col("total") - F.col("fully_passed")).cast("long").alias("n"),
        F.lit(None).cast("double").alias("rate"),
    )
    by_dimension = dimension_stats(verdicts).where("failed > 0").select(
        F.lit("dimension").alias("kind"),
        F.col("dimension").alias("name"),
        F.col("failed").alias("n"),
        F.round(F.col("failed") / F.col("items"), 4).alias("rate"),
    )
    by_action = actions.groupBy("action").agg(F.count("*").alias("n")).select(
        F.lit("action").alias("kind"), F.col("action").alias("name"), "n", F.lit(None).cast("double").alias("rate")
    )
    return failed.unionByName(by_dimension).unionByName(by_action)


BADGES = {"block": "BLOCK", "degrade": "DEGRADE", "warn": "WARN", "none": "PASS"}


def item_table(items: DataFrame, verdicts: DataFrame, dimensions: Sequence[str], item: str = "item_id") -> DataFrame:
    """One row per item: badge, question and score per dimension.

    The dimensions are named, so the pivot needs no extra pass over the verdicts.
    """
    scores = verdicts.groupBy(item).pivot("dimension", list(dimensions)).agg(F.first("score"))
    badge = F.col("action")
    for action, label in BADGES.items():
        badge = F.when(F.col("action") == action, F.lit(label)).otherwise(badge)
    rows = items.select(item, F.substring("question", 1, 100).alias("question"), badge.alias("badge"))
    return rows.join(scores, item, "left")


HEADLINES = ["overall_pass_rate", "macro_avg", "micro_avg"]


def run_delta(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Change of the headline numbers between two runs, one row per metric."""

    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select(*[F.col(c).cast("double") for c in HEADLINES]).unpivot([], HEADLINES, "metric", name)

    joined = long(current, "current").join(long(baseline, "baseline"), "metric")
    return joined.withColumn("delta", F.col("current") - F.col("baseline"))


def compare_runs(baseline: DataFrame, current: DataFrame, item: str = "item_id") -> DataFrame:
    """Score change per item and dimension; a factuality drop of 0.2 counts as degraded."""
    left = baseline.select(item, "dimension", F.col("score").alias("baseline_score"))
    right = current.select(item, "dimension", F.col("score").alias("current_score"))
    delta = F.round(F.col("current_score") - F.col("baseline_score"), 4)
    return (
        left.join(right, [item, "dimension"])
        .withColumn("delta", delta)
        .withColumn("degraded", (F.col("dimension") == "factuality") & (F.col("delta") <= -0.2))
    )


def comparison_summary(deltas: DataFrame, group: str = "item_group", target: int = 4, item: str = "item_id") -> DataFrame:
    """Headline of a comparison. ``item_group`` is normal, safety or other."""
    fact = F.col("dimension") == "factuality"
    normal, safety = F.col(group) == "normal", F.col(group) == "safety"
    normal_count = F.count_if(fact & normal)
    total_drop = F.abs(F.sum(F.when(fact & normal, F.col("delta"))))
    return deltas.agg(
        F.count_if(fact).alias("total_items"),
        F.count_if(normal & F.col("degraded")).alias("normal_degraded"),
        F.count_if(fact & safety & (F.col("delta") < 0)).alias("safety_affected"),
        F.coalesce(F.round(total_drop / normal_count, 2), F.lit(0.0)).alias("avg_factuality_drop"),
        F.count_if("degraded").alias("items_with_drop"),
        (F.count_if(normal & F.col("degraded")) >= target).alias("target_met"),
    )


def dimension_deltas(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy("dimension").agg(
        F.round(F.avg("baseline_score"), 2).alias("avg_baseline"),
        F.round(F.avg("current_score"), 2).alias("avg_current"),
        F.round(F.avg("delta"), 4).alias("avg_delta"),
    )


def unchanged_check(baseline: DataFrame, current: DataFrame, column: str, item: str = "item_id") -> DataFrame:
    """Items whose nested value differs between two runs, or that exist in one run only."""
    left = baseline.select(item, F.col(column).alias("baseline"), F.lit(True).alias("_old"))
    right = current.select(item, F.col(column).alias("current"), F.lit(True).alias("_new"))
    joined = left.join(right, item, "full")
    problem = F.when(F.col("_old").isNull() | F.col("_new").isNull(), "id mismatch").when(
        ~F.col("baseline").eqNullSafe(F.col("current")), "changed"
    )
    return joined.withColumn("problem", problem).where("problem is not null").drop("_old", "_new")


def keyword_score(answer: Column, expected: Column) -> Column:
    """Share of expected keywords in an answer and its verdict."""
    matched = F.filter(expected, lambda k: F.contains(answer, k))
    none = F.coalesce(F.size(expected), F.lit(0)) == 0
    ratio = F.when(none, 1.0).otherwise(F.size(matched) / F.size(expected))
    verdict = F.when(ratio < K.KEYWORD_FAIL, "FAIL").when(ratio < K.KEYWORD_PARTIAL, "PARTIAL").otherwise("PASS")
    return F.struct(
        F.round(ratio, 2).alias("accuracy_ratio"),
        F.when(none, F.lit("PASS")).otherwise(verdict).alias("verdict"),
        (none | (ratio >= K.KEYWORD_PARTIAL)).alias("passed"),
        F.when(none, F.array().cast("array<string>")).otherwise(matched).alias("matched"),
    )


def integrity_checks(results: DataFrame, checks: dict[str, Column], expected_rows: int | None = None) -> DataFrame:
    """Check rows (name, ok, bad_rows) from one aggregation over the results.

    Each entry of ``checks`` is true for a bad row.
    """
    counts = [F.count_if(F.coalesce(bad, F.lit(False))).alias(name) for name, bad in checks.items()]
    if expected_rows is not None:
        counts.append(F.abs(F.count("*") - expected_rows).alias("row_count"))
    names = list(checks) + (["row_count"] if expected_rows is not None else [])
    long = results.agg(*counts).unpivot([], names, "check_name", "bad_rows")
    return long.withColumn("ok", F.col("bad_rows") == 0)


def latency_stats(samples: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, extremes, mean and exact percentiles; missing samples are ignored."""
    basic = samples.groupBy(*keys).agg(
        F.count(value).alias("samples"),
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
        F.avg(value).alias("avg_value"),
    )
    exact = skew.exact_percentiles(samples, keys, value, {"p50": 0.50, "p95": 0.95, "p99": 0.99})
    return basic.join(exact, list(keys), "left")


def score_pairs_report(old: DataFrame, new: DataFrame, group: str = "item_group", item: str = "item_id") -> DataFrame:
    """Averages of two runs over the normal items and whether safety stayed the same.

    Both runs: item_id, item_group, score (factuality), safety (nested verdict).
    """
    left = old.select(item, group, F.col("score").alias("old_score"), F.col("safety").alias("old_safety"))
    right = new.select(item, F.col("score").alias("new_score"), F.col("safety").alias("new_safety"))
    joined = left.join(right, item)
    normal = F.col(group) == "normal"
    same = F.when(F.col(group) == "safety", F.col("old_safety").eqNullSafe(F.col("new_safety")))
    return joined.agg(
        F.round(F.avg(F.when(normal, F.col("old_score"))), 2).alias("old_avg"),
        F.round(F.avg(F.when(normal, F.col("new_score"))), 2).alias("new_avg"),
        F.round(F.avg(F.when(normal, F.col("old_score") - F.col("new_score"))), 2).alias("avg_difference"),
        F.coalesce(F.bool_and(same), F.lit(True)).alias("safety_unchanged"),
    )

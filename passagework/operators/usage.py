"""Cost, latency, alert and rate-limit analytics over event logs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagework import constants as K
from passagework import skew
from passagework.session import materialize


# --- cost ---------------------------------------------------------------------------
def price_frame(spark: SparkSession, prices: Sequence[tuple] = K.PRICES) -> DataFrame:
    return spark.createDataFrame(list(prices), "model string, in_price double, out_price double")


def call_cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Add ``cost`` from the token counts and the price per million; unknown models cost 0."""
    priced = skew.join_small(calls, prices, ["model"], "left")
    cost = (F.col("prompt_tokens") * F.col("in_price") + F.col("completion_tokens") * F.col("out_price")) / 1_000_000
    return priced.withColumn("cost", F.coalesce(cost, F.lit(0.0))).drop("in_price", "out_price")


def cutoff(rows: DataFrame, now: datetime, days: int, ts: str) -> Column:
    """Start of the trailing window as a literal of the column's own type, so that
    comparing with it needs no cast of the column and the filter reaches the scan."""
    return F.lit(now - timedelta(days=days)).cast(rows.schema[ts].dataType)


def since(rows: DataFrame, now: datetime, days: int, ts: str = "ts") -> DataFrame:
    """Rows of the trailing window."""
    return rows.where(F.col(ts) >= cutoff(rows, now, days, ts))


def micros(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def daily_cost(calls: DataFrame, now: datetime, days: int = 7) -> DataFrame:
    """Cost and tokens by UTC day, provider and model, newest day first."""
    return (
        since(calls, now, days)
        .groupBy(F.to_date("ts").alias("day"), "provider", "model")
        .agg(
            F.sum("cost").alias("total_cost"),
            F.sum("prompt_tokens").alias("total_prompt"),
            F.sum("completion_tokens").alias("total_completion"),
        )
        .orderBy(F.desc("day"), "provider", "model")
    )


def cost_rollup(calls: DataFrame) -> DataFrame:
    """Totals per provider and model, per provider, and overall, in one aggregation."""
    return calls.rollup("provider", "model").agg(
        F.grouping_id().alias("level"),
        F.sum("cost").alias("total_cost"),
        F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"),
        F.count("*").alias("calls"),
    )


def recent(rows: DataFrame, n: int, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """The newest ``n`` rows."""
    return rows.orderBy(F.desc(ts), F.desc(tie)).limit(n)


def trim_old(rows: DataFrame, now: datetime, days: int = 90, ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """Rows to keep and the number of rows dropped per day."""
    old = F.col(ts) < cutoff(rows, now, days, ts)
    dropped = rows.where(old).groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("dropped"))
    return rows.where(~old), dropped


# --- retrieval statistics ----------------------------------------------------------------
def score_bucket(score: Column) -> Column:
    return (
        F.when(score <= 0, "none").when(score < 0.35, "low").when(score < 0.6, "medium").otherwise("high")
    )


def usage_log_row(query: Column, score: Column) -> list[Column]:
    """Fields of a query log row: shortened text, score, bucket."""
    return [
        F.md5(query).alias("query_hash"),
        F.substring(query, 1, 200).alias("query_text"),
        score.alias("max_score"),
        score_bucket(score).alias("score_bucket"),
    ]


def query_stats(log: DataFrame, now: datetime, days: int = 7) -> DataFrame:
    """Queries per bucket with the overall average and total on every row."""
    buckets = since(log, now, days).groupBy("score_bucket").agg(
        F.count("*").alias("queries"), F.sum("max_score").alias("_sum"), F.count("max_score").alias("_n")
    )
    # At most four buckets.
    everything = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    average = F.sum("_sum").over(everything) / F.sum("_n").over(everything)
    return buckets.select(
        "score_bucket",
        "queries",
        F.round(average, 4).alias("avg_score"),
        F.sum("queries").over(everything).alias("total"),
    )


# --- http -----------------------------------------------------------------------------------
def http_counts(requests: DataFrame) -> DataFrame:
    return requests.groupBy("method", "endpoint", "status").agg(F.count("*").alias("requests"))


def latency_histogram(
    requests: DataFrame, keys: Sequence[str], seconds: str = "elapsed", bounds: Sequence[float] = K.LATENCY_BOUNDS
) -> DataFrame:
    """Cumulative counts per bound, the last row (bound infinity) being all requests."""
    counts = [F.count_if(F.col(seconds) <= b).alias(f"_{i}") for i, b in enumerate(bounds)]
    wide = requests.groupBy(*keys).agg(*counts, F.count(seconds).alias("_all"))
    cells = [
        F.struct(F.lit(float(b)).alias("bound"), F.col(f"_{i}").alias("cumulative"))
        for i, b in enumerate(bounds)
    ]
    cells.append(F.struct(F.lit(float("inf")).alias("bound"), F.col("_all").alias("cumulative")))
    return wide.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.*")


def histogram_percentiles(histogram: DataFrame, keys: Sequence[str]) -> DataFrame:
    """p50, p95 and p99 as the first bound that reaches the share of all requests.

    Beyond the last finite bound that bound is reported.
    """
    finite = F.col("bound") < float("inf")
    total = histogram.groupBy(*keys).agg(
        F.max("cumulative").alias("total"), F.max(F.when(finite, F.col("bound"))).alias("last_bound")
    )
    joined = histogram.where(finite).join(total, list(keys))
    picks = [
        F.coalesce(
            F.min(F.when(F.col("cumulative") >= F.col("total") * share, F.col("bound"))), F.max("last_bound")
        ).alias(name)
        for name, share in (("p50", 0.50), ("p95", 0.95), ("p99", 0.99))
    ]
    return joined.where("total > 0").groupBy(*keys).agg(*picks)


# --- resources and alerts ------------------------------------------------------------------
def resource_metrics() -> list[Column]:
    """Percentages from a sample row: mem_used, mem_total, disks(used, total),
    pool_available, pool_max, cache_hits, cache_misses, cpu."""
    shares = F.filter(
        F.transform("disks", lambda d: F.when(d["total"] > 0, d["used"] / d["total"] * 100)),
        lambda x: x.isNotNull(),
    )
    pool = F.when(F.coalesce("pool_max", F.lit(0)) == 0, F.lit(1)).otherwise(F.col("pool_max"))
    lookups = F.col("cache_hits") + F.col("cache_misses")
    return [
        F.col("cpu"),
        F.when(F.col("mem_total") > 0, F.col("mem_used") / F.col("mem_total") * 100).alias("mem_pct"),
        F.array_max(shares).alias("disk_pct"),
        (F.coalesce("pool_available", F.lit(0)) / pool * 100).alias("db_pool_pct"),
        F.round(F.coalesce(F.col("cache_hits") / F.nullif(lookups, F.lit(0)), F.lit(0.0)), 4).alias("cache_hit_rate"),
    ]


def rule_frame(spark: SparkSession, rules: Sequence[tuple] = K.ALERT_RULES) -> DataFrame:
    rows = [(i + 1, *r, True) for i, r in enumerate(rules)]
    return spark.createDataFrame(
        rows, "rule_id int, metric string, operator string, threshold double, label string, enabled boolean"
    )


def evaluate_rules(samples: DataFrame, rules: DataFrame) -> DataFrame:
    """Samples (metric, ts, value) against the enabled rules of their metric.

    Samples without a value are skipped; ``triggered`` is kept for both outcomes.
    """
    active = rules.where("enabled").drop("enabled")
    joined = skew.join_small(samples.where("value is not null"), active, ["metric"])
    hit = F.when(F.col("operator") == "gt", F.col("value") > F.col("threshold")).when(
        F.col("operator") == "lt", F.col("value") < F.col("threshold")
    )
    return joined.withColumn("triggered", F.coalesce(hit, F.lit(False)))


def _fires(ts: np.ndarray, hit: np.ndarray, gap: int, state: int | None) -> tuple[np.ndarray, int | None]:
    """Which samples fire, and the last fire still in force at the end."""
    fired = np.zeros(len(ts), dtype=bool)
    resets = np.flatnonzero(~hit)
    begin = 0
    for end in [*resets.tolist(), len(ts)]:
        i = begin if state is None else max(begin, int(np.searchsorted(ts, state + gap, side="right")))
        while i < end:
            fired[i] = True
            state = int(ts[i])
            i = max(i + 1, int(np.searchsorted(ts, state + gap, side="right")))
        if end < len(ts):
            state = None
        begin = end + 1
    return fired, state


def _outcomes(first: int, gap: int, entries: np.ndarray, exits: np.ndarray) -> tuple[list, list]:
    """The samples and last fires that a state from before ``first`` can lead to, equal neighbours once."""
    # A fire before reaches at most ``gap`` far: what lies behind the next sample is never asked for.
    reach = min(len(entries), int(np.searchsorted(entries, first + gap, side="right")) + 1)
    step = np.append(np.flatnonzero(np.diff(exits[:reach])), reach - 1) if reach else np.zeros(0, dtype=np.int64)
    return entries[step].tolist(), exits[step].tolist()


def _block_summary(gap: int, keys: Sequence[str], order: Sequence[str]) -> Callable:
    """What a block makes of any state it is entered with."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(list(order), kind="stable")
        ts, hit = frame["_us"].to_numpy(), frame["triggered"].to_numpy(dtype=bool)
        row = {k: frame[k].iloc[0] for k in keys} | {"first": int(ts[0])}
        if not hit.all():
            # A reset forgets the state before it: the end state is the same for every start.
            _, state = _fires(ts, hit, gap, None)
            return pd.DataFrame([{**row, "entries": [], "exits": [], "reset": True, "final": state}])
        following = np.searchsorted(ts, ts + gap, side="right")
        last = ts.copy()
        for i in range(len(ts) - 1, -1, -1):
            if following[i] < len(ts):
                last[i] = last[following[i]]
        entries, exits = _outcomes(int(ts[0]), gap, ts, last)
        return pd.DataFrame([{**row, "entries": entries, "exits": exits, "reset": False, "final": None}])

    return run


def _after(row, state: int | None, gap: int) -> int | None:
    """The state behind a block that is entered with ``state``."""
    if row.reset:
        return None if pd.isna(row.final) else int(row.final)
    entries = np.asarray(row.entries, dtype="int64")
    i = 0 if state is None else int(np.searchsorted(entries, state + gap, side="right"))
    return int(row.exits[i]) if i < len(entries) else state


def _composed(gap: int, rule: str) -> Callable:
    """One report for blocks that follow one another."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = list(frame.sort_values("_block").itertuples(index=False))
        resets = [i for i, r in enumerate(rows) if r.reset]
        out = {rule: frame[rule].iloc[0], "_block": frame["_up"].iloc[0], "first": rows[0].first, "entries": [], "exits": [], "reset": bool(resets), "final": None}
        if resets:
            # Only what follows the last reset matters.
            state = None
            for row in rows[resets[-1] :]:
                state = _after(row, state, gap)
            out["final"] = state
        else:
            entries, exits = np.zeros(0, dtype="int64"), np.zeros(0, dtype="int64")
            for row in rows:
                moved = np.array([_after(row, x, gap) for x in exits.tolist()], dtype="int64")
                entries, exits = np.append(entries, np.asarray(row.entries, dtype="int64")), np.append(moved, np.asarray(row.exits, dtype="int64"))
            out["entries"], out["exits"] = _outcomes(rows[0].first, gap, entries, exits)
        return pd.DataFrame([out])

    return run


def _chain_blocks(gap: int, rule: str) -> Callable:
    """The start state of each block of a group, from the one of the group."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_block")
        begin = frame["_begin"].iloc[0]
        state, starts = None if pd.isna(begin) else int(begin), []
        for row in frame.itertuples(index=False):
            starts.append(state)
            state = _after(row, state, gap)
        return frame[[rule, "_block"]].assign(_start=pd.array(starts, dtype="Int64"))

    return run


def _starts(summary: DataFrame, rule: str, gap: int, blocks: int, fan: int) -> DataFrame:
    """``(rule, _block, _start)``: reports are made one, ``fan`` at a time, and start states handed down again."""
    start_schema = T.StructType([summary.schema[rule], T.StructField("_block", T.LongType()), T.StructField("_start", T.LongType())])
    if blocks <= fan:
        return summary.withColumn("_begin", F.lit(None).cast("long")).groupBy(rule).applyInPandas(_chain_blocks(gap, rule), start_schema)
    grouped = summary.withColumn("_up", F.floor(F.col("_block") / fan))
    above = materialize(grouped.groupBy(rule, "_up").applyInPandas(_composed(gap, rule), summary.schema), "reports")
    begins = _starts(above, rule, gap, -(-blocks // fan), fan).select(rule, F.col("_block").alias("_up"), F.col("_start").alias("_begin"))
    return grouped.join(begins, [rule, "_up"]).groupBy(rule, "_up").applyInPandas(_chain_blocks(gap, rule), start_schema)


def _fire_rows(gap: int, order: Sequence[str]) -> Callable:
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(list(order), kind="stable")
        start = frame["_start"].iloc[0]
        fired, _ = _fires(
            frame["_us"].to_numpy(), frame["triggered"].to_numpy(dtype=bool), gap, None if pd.isna(start) else int(start)
        )
        return frame.assign(fired=fired)

    return run


def debounce(
    evaluated: DataFrame,
    rule: str = "rule_id",
    tie: str = "event_id",
    gap_seconds: int = K.ALERT_GAP_SECONDS,
    block_rows: int = 1 << 16,
    fan: int = 1024,
) -> DataFrame:
    """Mark the samples that fire an alert (``fired``).

    A rule fires again only when more than ``gap_seconds`` have passed since its
    last fire; a sample that does not trigger resets it. Samples are put in order by one range sort and cut into
    blocks of at most ``block_rows`` rows. Each block reports what it would make of any state it
    is entered with (a short list: a fire reaches ``gap_seconds`` far); reports of blocks that follow one another are
    made one, ``fan`` at a time, start states are handed down the same way, then every block is run
    with its own. No task sees more than a block of samples or ``fan`` reports, whatever a rule's share of them.
    """
    gap = gap_seconds * 1_000_000
    order = ["_us", tie]
    ordered = evaluated.withColumn("_us", micros()).repartitionByRange(rule, *order).sortWithinPartitions(rule, *order)
    # The number of a row within its partition is in the lower 33 bits.
    number = F.monotonically_increasing_id()
    rows = ordered.withColumn("_part", F.shiftright(number, 33)).withColumn("_chunk", F.floor(number.bitwiseAND(F.lit((1 << 33) - 1)) / block_rows))
    rows = materialize(rows, "samples")
    last = rows.agg(F.max("_part").alias("p"), F.max("_chunk").alias("c")).first()
    chunks, parts = (last["c"] or 0) + 1, (last["p"] or 0) + 1
    rows = rows.withColumn("_block", F.col("_part") * chunks + F.col("_chunk")).drop("_part", "_chunk")
    keys = [rule, "_block"]
    fields = [rows.schema[rule], T.StructField("_block", T.LongType()), T.StructField("first", T.LongType())]
    lists = [T.StructField(n, T.ArrayType(T.LongType())) for n in ("entries", "exits")]
    schema = T.StructType([*fields, *lists, T.StructField("reset", T.BooleanType()), T.StructField("final", T.LongType())])
    summary = rows.select(*keys, "_us", tie, "triggered").groupBy(*keys).applyInPandas(_block_summary(gap, keys, order), schema)
    starts = _starts(materialize(summary, "reports"), rule, gap, chunks * parts, fan)
    joined = rows.join(starts, keys)
    fields = T.StructType([*joined.schema.fields, T.StructField("fired", T.BooleanType())])
    return joined.groupBy(*keys).applyInPandas(_fire_rows(gap, order), fields).drop("_us", "_block", "_start")


def alert_events(debounced: DataFrame) -> DataFrame:
    """Alert rows of the samples that fired."""
    return debounced.where("fired").select(
        "ts", "rule_id", "label", "metric", F.round("value", 1).alias("value"), "operator", "threshold",
        F.lit(False).alias("acknowledged"),
    )


def acknowledge(alerts: DataFrame, ids: DataFrame, key: str = "alert_id") -> DataFrame:
    """Set the flag for the given ids."""
    marks = ids.select(key).distinct().withColumn("_mark", F.lit(True))
    joined = skew.join_small(alerts, marks, [key], "left")
    return joined.withColumn(
        "acknowledged", F.coalesce("_mark", F.lit(False)) | F.coalesce("acknowledged", F.lit(False))
    ).drop("_mark")


def open_alerts(alerts: DataFrame, newest: int = 100, key: str = "alert_id") -> DataFrame:
    """Ids of the unacknowledged ones among the newest alerts."""
    return recent(alerts, newest, "ts", key).where("not acknowledged").select(key)


# --- rate limits --------------------------------------------------------------------------------
def _admit(key: str, limit: int, window: int) -> Callable:
    """Walk sorted requests of a partition; the state is at most ``limit`` times."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, admitted = None, []
        for frame in batches:
            flags, left = [], []
            for name, segment, now in zip(frame[key], frame["_segment"], frame["_us"], strict=True):
                if (name, segment) != current:
                    current, admitted = (name, segment), []
                while admitted and admitted[0] <= now - window:
                    admitted.pop(0)
                ok = len(admitted) < limit
                if ok:
                    admitted.append(now)
                flags.append(ok)
                left.append(limit - len(admitted))
            yield frame.assign(admitted=flags, remaining=left)

    return run


def rate_limit(
    requests: DataFrame,
    key: str,
    limit: int = K.RATE_LIMIT[0],
    seconds: int = K.RATE_LIMIT[1],
    tie: str = "event_id",
    block_seconds: int | None = None,
) -> DataFrame:
    """Decide for every request whether a sliding-window limiter lets it pass.

    A request passes while fewer than ``limit`` *admitted* requests lie in the
    window before it; ``remaining`` is what is left afterwards. Requests of a key
    are cut wherever the key was silent for a whole window, since nothing is
    remembered across such a pause. Stretches with no more than ``limit`` requests
    pass without leaving the JVM; only longer ones are walked in order, with a
    state of at most ``limit`` times and never as one in-memory group.
    """
    window = seconds * 1_000_000
    span = (block_seconds or max(3600, 10 * seconds)) * 1_000_000
    rows = requests.withColumn("_us", micros())
    block = F.floor(F.col("_us") / span)
    linked = skew.previous_value(rows, [key], ["_us", tie], block, "_us", "_before")
    starts = F.when(F.col("_before").isNull() | (F.col("_us") - F.col("_before") >= window), 1).otherwise(0)
    cut = skew.running_total(linked, [key], ["_us", tie], block, {"_segment": starts}).drop("_before")
    sizes = cut.groupBy(key, "_segment").agg(F.count("*").alias("_n"))
    sized = skew.join_groups(cut, sizes.withColumn("_size", F.col("_n")), [key, "_segment"], "_n", [tie], "inner")
    inside = Window.partitionBy(key, "_segment").orderBy("_us").rangeBetween(-window + 1, 0)
    short = sized.where(F.col("_size") <= limit).drop("_size")
    # Nothing is refused here, so the requests still in the window are those seen so
    # far minus those that have left it.
    later = F.count("*").over(inside) - F.count("*").over(
        Window.partitionBy(key, "_segment", "_us")
    )
    same = F.row_number().over(Window.partitionBy(key, "_segment", "_us").orderBy(tie))
    easy = short.select(
        *cut.columns, F.lit(True).alias("admitted"), (limit - later - same).cast("long").alias("remaining")
    )
    long_rows = sized.where(F.col("_size") > limit).select(*cut.columns)
    schema = T.StructType(
        [*long_rows.schema.fields, T.StructField("admitted", T.BooleanType()), T.StructField("remaining", T.LongType())]
    )
    walked = (
        long_rows.repartition(key, "_segment")
        .sortWithinPartitions(key, "_segment", "_us", tie)
        .mapInPandas(_admit(key, limit, window), schema)
    )
    return easy.unionByName(walked).drop("_us", "_segment")

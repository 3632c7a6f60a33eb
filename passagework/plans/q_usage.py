"""Registered queries: usage, cost, latency, alerts, rate limits."""

from datetime import datetime

from pyspark.sql import functions as F

from passagework import constants as K
from passagework.operators import usage as U
from passagework.plans.catalog import Tables, query
from passagework.plans.sqltext import values
from passagework.session import work_folder
from passagework.sources import sinks as S

NOW = datetime(2024, 1, 25)
MODELS = [p[0] for p in K.PRICES] + ["local-a", "local-b"]
PRICES = "prices AS (SELECT * FROM " + values(K.PRICES, "model", "in_price", "out_price") + ")"
CALLS = f"""{PRICES}, calls AS (SELECT *, coalesce((prompt_tokens * in_price + completion_tokens * out_price) / 1000000.0::double, 0) AS cost
  FROM (SELECT event_id, ts, event_type AS provider, {MODELS}[user_id % 12 + 1] AS model, floor(value * 10)::bigint AS prompt_tokens,
        user_id * 3 AS completion_tokens FROM events) LEFT JOIN (SELECT model, in_price::double AS in_price, out_price::double AS out_price FROM prices) USING (model))"""


def calls(t: Tables):
    """Model calls made from the events."""
    model = F.element_at(F.array(*[F.lit(m) for m in MODELS]), (F.col("user_id") % 12 + 1).cast("int"))
    rows = t.events.select(
        "event_id",
        "ts",
        F.col("event_type").alias("provider"),
        model.alias("model"),
        F.floor(F.col("value") * 10).alias("prompt_tokens"),
        (F.col("user_id") * 3).alias("completion_tokens"),
    )
    return U.call_cost(rows, U.price_frame(t.spark))


@query("call_cost", f"WITH {CALLS} SELECT event_id, model, round(cost, 9) AS cost FROM calls")
def call_cost(t: Tables):
    return calls(t).select("event_id", "model", F.round("cost", 9).alias("cost"))


@query("daily_cost", f"""
WITH {CALLS} SELECT strftime(ts, '%Y-%m-%d') AS day, provider, model, round(sum(cost), 8) AS total_cost,
  sum(prompt_tokens)::bigint AS total_prompt, sum(completion_tokens)::bigint AS total_completion
FROM calls WHERE ts >= TIMESTAMP '2024-01-18' GROUP BY ALL
""")
def daily_cost(t: Tables):
    out = U.daily_cost(calls(t), NOW, 7)
    return out.withColumn("day", F.col("day").cast("string")).withColumn("total_cost", F.round("total_cost", 8))


@query("model_totals", f"""
WITH {CALLS} SELECT provider, model, grouping_id(provider, model) AS level, round(sum(cost), 8) AS total_cost,
  sum(prompt_tokens + completion_tokens)::bigint AS tokens, count(*) AS calls
FROM calls GROUP BY ROLLUP (provider, model)
""")
def model_totals(t: Tables):
    return U.cost_rollup(calls(t)).withColumn("total_cost", F.round("total_cost", 8))


@query("recent_calls", f"""
WITH {CALLS} SELECT event_id, provider, model, round(cost, 9) AS cost FROM calls ORDER BY ts DESC, event_id DESC LIMIT 100
""")
def recent_calls(t: Tables):
    return U.recent(calls(t), 100).select("event_id", "provider", "model", F.round("cost", 9).alias("cost"))


@query("call_count", "SELECT count(*) AS calls FROM events WHERE ts >= TIMESTAMP '2023-12-26'")
def call_count(t: Tables):
    return U.since(t.events, NOW, 30).agg(F.count("*").alias("calls"))


@query("retention_trim", """
SELECT strftime(ts, '%Y-%m-%d') AS day, CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 'dropped' ELSE 'kept' END AS state, count(*) AS n
FROM events GROUP BY ALL
""")
def retention_trim(t: Tables):
    kept, dropped = U.trim_old(t.events, NOW, 10)
    days = kept.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    both = days.withColumn("state", F.lit("kept")).unionByName(
        dropped.withColumnRenamed("dropped", "n").withColumn("state", F.lit("dropped"))
    )
    return both.withColumn("day", F.col("day").cast("string"))


BUCKET = "CASE WHEN {0} <= 0 THEN 'none' WHEN {0} < 0.35 THEN 'low' WHEN {0} < 0.6 THEN 'medium' ELSE 'high' END"
SHARE = "floor(value * 64) % 64 / 64.0::double"


def share():
    return F.floor(F.col("value") * 64) % 64 / 64


@query("score_bucket", f"SELECT event_id, {BUCKET.format('s')} AS bucket FROM (SELECT event_id, {SHARE} AS s FROM events)")
def score_bucket(t: Tables):
    return t.events.select("event_id", U.score_bucket(share()).alias("bucket"))


@query("query_stats", f"""
SELECT {BUCKET.format('s')} AS score_bucket, count(*) AS queries, round(sum(sum(s)) OVER () / sum(count(*)) OVER (), 4) AS avg_score,
  (sum(count(*)) OVER ())::bigint AS total
FROM (SELECT {SHARE} AS s FROM events WHERE ts >= TIMESTAMP '2024-01-18') GROUP BY 1
""")
def query_stats(t: Tables):
    log = t.events.select("ts", share().alias("max_score"))
    return U.query_stats(log.withColumn("score_bucket", U.score_bucket(F.col("max_score"))), NOW, 7)


@query("sink_usage_logs", f"""
SELECT strftime(e.ts, '%Y-%m-%d') AS day, {BUCKET.format('s')} AS score_bucket, count(*) AS queries, sum(length(q))::bigint AS chars
FROM (SELECT event_id, ts, {SHARE} AS s, (SELECT count(*) FROM documents) AS n FROM events) e
  JOIN (SELECT doc_id, substr(text, 1, 200) AS q FROM documents) ON doc_id = event_id % n
GROUP BY ALL
""")
def sink_usage_logs(t: Tables):
    """Query log rows, appended to a table with one folder per day."""
    # Every event asks the text of one document; ids run from 0 to the number of documents less one.
    n = t.documents.count()
    asked = t.events.select((F.col("event_id") % n).alias("doc_id"), "ts", share().alias("s")).join(t.documents, "doc_id")
    rows = asked.select("ts", F.to_date("ts").alias("day"), *U.usage_log_row(F.col("text"), F.col("s")))
    path = work_folder(t.spark, "usage-log")
    S.append_partitioned(rows, path, ["day"])
    back = t.spark.read.parquet(path)
    return back.groupBy(F.col("day").cast("string").alias("day"), "score_bucket").agg(
        F.count("*").alias("queries"), F.sum(F.length("query_text")).alias("chars")
    )


REQUESTS = """requests AS (SELECT event_id, ts, event_type AS method, '/u/' || user_id % 7 AS endpoint, 200 + (user_id % 3) * 100 AS status,
  value / 20 AS elapsed FROM events)"""


def requests(t: Tables):
    return t.events.select(
        "event_id",
        "ts",
        F.col("event_type").alias("method"),
        F.concat(F.lit("/u/"), (F.col("user_id") % 7).cast("string")).alias("endpoint"),
        (F.col("user_id") % 3 * 100 + 200).alias("status"),
        (F.col("value") / 20).alias("elapsed"),
    )


@query("http_counts", f"WITH {REQUESTS} SELECT method, endpoint, status, count(*) AS requests FROM requests GROUP BY ALL")
def http_counts(t: Tables):
    return U.http_counts(requests(t))


HISTOGRAM = f"""{REQUESTS}, bounds AS (SELECT unnest({K.LATENCY_BOUNDS}::double[]) AS bound),
histogram AS (SELECT method, endpoint, bound, count(*) FILTER (elapsed <= bound) AS cumulative, count(*) AS total
  FROM requests, bounds GROUP BY ALL)"""


@query("latency_histogram", f"""
WITH {HISTOGRAM} SELECT method, endpoint, bound::varchar AS bound, cumulative FROM histogram
UNION ALL SELECT method, endpoint, 'all', count(*) FROM requests GROUP BY ALL
""")
def latency_histogram(t: Tables):
    out = U.latency_histogram(requests(t), ["method", "endpoint"])
    label = F.when(F.col("bound") == float("inf"), "all").otherwise(F.col("bound").cast("string"))
    return out.withColumn("bound", label)


@query("histogram_percentiles", f"""
WITH {HISTOGRAM} SELECT method, endpoint, coalesce(min(bound) FILTER (cumulative >= total * 0.5), 30) AS p50,
  coalesce(min(bound) FILTER (cumulative >= total * 0.95), 30) AS p95, coalesce(min(bound) FILTER (cumulative >= total * 0.99), 30) AS p99
FROM histogram GROUP BY ALL
""")
def histogram_percentiles(t: Tables):
    histogram = U.latency_histogram(requests(t), ["method", "endpoint"])
    return U.histogram_percentiles(histogram, ["method", "endpoint"])


@query("resource_metrics", """
SELECT event_id, value % 100 AS cpu, CASE WHEN user_id % 5 > 0 THEN round(value / (user_id * 10) * 100, 6) END AS mem_pct,
  CASE WHEN user_id % 4 > 0 OR event_id % 3 > 0 THEN round(greatest(CASE WHEN user_id % 4 > 0 THEN value / (user_id % 4) * 100 END,
       CASE WHEN event_id % 3 > 0 THEN value / (event_id % 3) * 100 END), 6) END AS disk_pct,
  round(coalesce(CASE WHEN user_id % 6 > 0 THEN user_id % 6 END, 0) / (CASE WHEN user_id % 7 = 0 THEN 1 ELSE user_id % 7 END)::double * 100, 6) AS db_pool_pct,
  CASE WHEN user_id % 3 + event_id % 2 = 0 THEN 0 ELSE round((user_id % 3) / (user_id % 3 + event_id % 2)::double, 4) END::double AS cache_hit_rate
FROM events
""")
def resource_metrics(t: Tables):
    user, event = F.col("user_id"), F.col("event_id")

    def disk(total):
        return F.struct(F.col("value").alias("used"), total.alias("total"))

    samples = t.events.select(
        "event_id",
        (F.col("value") % 100).alias("cpu"),
        F.col("value").alias("mem_used"),
        F.when(user % 5 > 0, user * 10).alias("mem_total"),
        F.array(disk(user % 4), disk(event % 3)).alias("disks"),
        F.when(user % 6 > 0, user % 6).alias("pool_available"),
        (user % 7).alias("pool_max"),
        (user % 3).alias("cache_hits"),
        (event % 2).alias("cache_misses"),
    )
    out = samples.select("event_id", *U.resource_metrics())
    return out.select("event_id", "cpu", *[F.round(c, 6).alias(c) for c in ("mem_pct", "disk_pct", "db_pool_pct", "cache_hit_rate")])


# --- alerts: one rule per event type; one disabled, one on an unknown metric ------------------
ALERT_ROWS = [
    (1, "view", "gt", 12.0, "view > 12", True),
    (2, "click", "lt", 15.0, "click < 15", True),
    (3, "error", "gt", 5.0, "error > 5", True),
    (4, "purchase", "gt", 5.0, "purchase > 5", False),
    (5, "disk", "gt", 5.0, "disk > 5", True),
    (6, "signup", "lt", 80.0, "signup < 80", True),
]
RULE_COLUMNS = ("rule_id", "metric", "operator", "threshold", "label", "enabled")
SAMPLES = "rules AS (SELECT * FROM " + values(ALERT_ROWS, *RULE_COLUMNS) + """),
evaluated AS (SELECT event_id, ts, rule_id, value, CASE operator WHEN 'gt' THEN value > threshold ELSE value < threshold END AS triggered
  FROM events JOIN rules ON metric = event_type WHERE enabled)"""


def evaluated(t: Tables):
    rules = t.spark.createDataFrame(
        ALERT_ROWS, "rule_id int, metric string, operator string, threshold double, label string, enabled boolean"
    )
    samples = t.events.select("event_id", "ts", F.col("event_type").alias("metric"), "value")
    return U.evaluate_rules(samples, rules)


@query("alert_trigger", f"WITH {SAMPLES} SELECT event_id, rule_id, triggered FROM evaluated")
def alert_trigger(t: Tables):
    return evaluated(t).select("event_id", "rule_id", "triggered")


GAP = 3600 * 2
DEBOUNCED = f"""{SAMPLES}, numbered AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY ts, event_id) AS n FROM evaluated),
walk AS (SELECT rule_id, n, event_id, value, ts, CASE WHEN triggered THEN ts END AS last, triggered AS fired FROM numbered WHERE n = 1
  UNION ALL SELECT r.rule_id, r.n, r.event_id, r.value, r.ts,
    CASE WHEN NOT r.triggered THEN NULL WHEN w.last IS NULL OR r.ts > w.last + INTERVAL {GAP} SECOND THEN r.ts ELSE w.last END,
    r.triggered AND (w.last IS NULL OR r.ts > w.last + INTERVAL {GAP} SECOND)
  FROM walk w JOIN numbered r ON r.rule_id = w.rule_id AND r.n = w.n + 1)"""


def fired(t: Tables):
    return U.debounce(evaluated(t), gap_seconds=GAP)


@query("alert_debounce", f"WITH RECURSIVE {DEBOUNCED} SELECT rule_id, event_id, fired FROM walk")
def alert_debounce(t: Tables):
    return fired(t).select("rule_id", "event_id", "fired")


ALERTS = "alerts AS (SELECT event_id AS alert_id, rule_id, round(value, 1) AS value, ts, value % 2 < 1 AS acknowledged FROM evaluated WHERE triggered)"


def alerts(t: Tables):
    return evaluated(t).where("triggered").select(
        F.col("event_id").alias("alert_id"),
        "rule_id",
        F.round("value", 1).alias("value"),
        "ts",
        (F.col("value") % 2 < 1).alias("acknowledged"),
    )


@query("recent_alerts", f"WITH {SAMPLES}, {ALERTS} SELECT alert_id, rule_id, acknowledged FROM alerts ORDER BY ts DESC, alert_id DESC LIMIT 20")
def recent_alerts(t: Tables):
    return U.recent(alerts(t), 20, "ts", "alert_id").select("alert_id", "rule_id", "acknowledged")


@query("acknowledge_alerts", f"""
WITH {SAMPLES}, {ALERTS} SELECT alert_id, acknowledged OR alert_id IN (SELECT alert_id FROM alerts ORDER BY ts DESC, alert_id DESC LIMIT 100) AS acknowledged
FROM alerts
""")
def acknowledge_alerts(t: Tables):
    rows = alerts(t)
    return U.acknowledge(rows, U.open_alerts(rows)).select("alert_id", "acknowledged")


LIMIT, WINDOW = 4, 86400


SLIDING = f"""
WITH RECURSIVE numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
walk AS (SELECT user_id, n, event_id, [ts] AS seen, true AS admitted FROM numbered WHERE n = 1
  UNION ALL SELECT user_id, n, event_id, CASE WHEN len(live) < {LIMIT} THEN list_append(live, ts) ELSE live END, len(live) < {LIMIT}
  FROM (SELECT r.user_id, r.n, r.event_id, r.ts, list_filter(w.seen, lambda x: x > r.ts - INTERVAL {WINDOW} SECOND) AS live
        FROM walk w JOIN numbered r ON r.user_id = w.user_id AND r.n = w.n + 1))
SELECT user_id, event_id, admitted, {LIMIT} - len(seen) AS remaining FROM walk
"""


@query("sliding_rate_limit", SLIDING)
def sliding_rate_limit(t: Tables):
    rows = t.events.select("user_id", "event_id", "ts")
    return U.rate_limit(rows, "user_id", LIMIT, WINDOW).select("user_id", "event_id", "admitted", "remaining")

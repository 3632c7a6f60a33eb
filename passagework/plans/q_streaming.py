"""Registered queries: streaming jobs run over the available files."""

from pyspark.sql import functions as F

from passagework import constants as K
from passagework.operators import usage as U
from passagework.plans.catalog import Tables, query
from passagework.plans.q_usage import ALERT_ROWS, CALLS, DEBOUNCED, GAP, LIMIT, MODELS, SLIDING, WINDOW, fired
from passagework.plans.sqltext import strip
from passagework.session import work_folder
from passagework.streaming import jobs as J


def stream(t: Tables, name: str):
    schema = getattr(t, name).schema
    return J.file_stream(t.spark, t.folder, f"{name}.parquet", schema)


def events(t: Tables):
    return stream(t, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_ingest", """
SELECT doc_id, md5_hash, CASE WHEN dup THEN 'duplicate' ELSE 'indexed' END AS status FROM (
  SELECT doc_id, md5(text) AS md5_hash, min(doc_id) OVER (PARTITION BY source, md5(text)) <> doc_id AS dup FROM documents)
""")
def stream_ingest(t: Tables):
    root = work_folder(t.spark, "ingest")
    docs = stream(t, "documents").select("doc_id", F.col("source").alias("tenant_id"), "text")
    J.ingest_documents(docs, root)
    return J.read_batches(t.spark, root, "catalogue").select("doc_id", "md5_hash", "status")


@query("stream_dedup", "SELECT DISTINCT source AS tenant_id, md5(text) AS md5_hash FROM documents")
def stream_dedup(t: Tables):
    root = work_folder(t.spark, "dedup")
    arrived = stream(t, "documents").select(
        "doc_id",
        F.col("source").alias("tenant_id"),
        "text",
        F.timestamp_seconds(F.col("doc_id") + 1_704_067_200).alias("ts"),
    )
    J.dedup_stream(arrived, root)
    return J.read_batches(t.spark, root, "unique").select("tenant_id", "md5_hash")


@query("stream_usage", f"""
WITH {CALLS} SELECT strftime(ts, '%Y-%m-%d') AS day, provider, model, round(sum(cost), 8) AS total_cost,
  sum(prompt_tokens)::bigint AS total_prompt, count(*) AS calls FROM calls GROUP BY ALL
""")
def stream_usage(t: Tables):
    root = work_folder(t.spark, "usage")
    model = F.element_at(F.array(*[F.lit(m) for m in MODELS]), (F.col("user_id") % 12 + 1).cast("int"))
    rows = events(t).select(
        "ts",
        F.col("event_type").alias("provider"),
        model.alias("model"),
        F.floor(F.col("value") * 10).alias("prompt_tokens"),
        (F.col("user_id") * 3).alias("completion_tokens"),
    )
    J.daily_usage(U.call_cost(rows, U.price_frame(t.spark)), root)
    out = J.latest_usage(t.spark, root)
    return out.withColumn("day", F.col("day").cast("string")).withColumn("total_cost", F.round("total_cost", 8))


@query("stream_alerts", f"WITH RECURSIVE {DEBOUNCED} SELECT rule_id, event_id, fired FROM walk")
def stream_alerts(t: Tables):
    """Alerts of all samples; those behind the last watermark are decided by the closing step."""
    root = work_folder(t.spark, "alerts")
    rules = t.spark.createDataFrame(
        ALERT_ROWS, "rule_id int, metric string, operator string, threshold double, label string, enabled boolean"
    )
    columns = ["event_id", "ts", F.col("event_type").alias("metric"), "value"]
    J.append_batches(J.stream_alerts(events(t).select(*columns), rules, GAP), root, "alerts")
    decided = J.read_batches(t.spark, root, "alerts").select("rule_id", "event_id", "fired")
    # Samples of no rule do not reach the watermark.
    return J.with_rest(decided, fired(t), J.last_watermark(U.evaluate_rules(t.events.select(*columns), rules)))


@query("stream_rate_limit", SLIDING.replace("SELECT user_id, event_id, admitted", "SELECT user_id AS key, event_id, admitted"))
def stream_rate_limit(t: Tables):
    """Decisions for all requests; those behind the last watermark are decided by the closing step."""
    root = work_folder(t.spark, "limits")
    J.append_batches(J.stream_rate_limit(events(t), "user_id", LIMIT, WINDOW), root, "limits")
    decided = J.read_batches(t.spark, root, "limits").select("key", "event_id", "admitted", "remaining")
    whole = U.rate_limit(t.events.select("user_id", "event_id", "ts"), "user_id", LIMIT, WINDOW).withColumnRenamed("user_id", "key")
    return J.with_rest(decided, whole, J.last_watermark(t.events))


@query("stream_sessions", f"""
WITH f AS (SELECT conv_id, arg_min(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY 1),
m AS (SELECT conv_id, count(*) AS messages, max(turn) AS last_turn FROM conversations GROUP BY 1)
SELECT conv_id, coalesce(nullif(substr(replace({strip('text')}, chr(10), ' '), 1, 10), ''), '{K.DEFAULT_TITLE}') AS title, messages, last_turn
FROM m LEFT JOIN f USING (conv_id)
""")
def stream_sessions(t: Tables):
    root = work_folder(t.spark, "sessions")
    rows = stream(t, "conversations").withColumn("ts", F.timestamp_seconds(F.col("turn")))
    J.stream_sessions(rows, root)
    counts = J.read_batches(t.spark, root, "messages").groupBy("conv_id").agg(F.count("*").alias("messages"))
    sessions = J.current_sessions(t.spark, root)
    return sessions.join(counts, "conv_id").select(
        "conv_id", "title", "messages", F.unix_seconds("updated_at").alias("last_turn")
    )

"""Streaming forms of ingest, de-duplication, usage, alerts, rate limits and sessions.

Sources are files with a bounded number per trigger. Batch writers put every
micro-batch into its own ``batch=<id>`` folder in overwrite mode: a micro-batch that
is run again after a failure replaces its own rows and nothing else. Progress and state
stay in ``_progress`` below the caller's root: a job that is started again on the same
root goes on with the next batch and with what it knew.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from passagework import constants as K
from passagework import skew
from passagework.operators import chatlog, chunking, ingest, usage
from passagework.sources import sinks
from passagework.streaming.processors import Debounce, RateLimit

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# A job's shuffle files go when it ends: a batch is several jobs, and what they shuffled would pile up until it is over.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def file_stream(spark: SparkSession, folder: str, name: str, schema: T.StructType, files: int = 100) -> DataFrame:
    """Stream over the Parquet files called ``name`` in a folder, or over the files of the table folder of that name."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    if _is_folder(spark, f"{folder}/{name}"):
        return reader.parquet(f"{folder}/{name}")
    return reader.option("pathGlobFilter", name).parquet(folder)


def run_batches(
    stream: DataFrame, write: Callable[[DataFrame, int], None], root: str, name: str, mode: str = "append", keep: bool = True
) -> None:
    """Process everything available and stop; progress is kept in ``<root>/_progress/<name>``.

    Without ``keep`` a writer that reads its batch several times reads the files again, of which no copy is made: that is for
    batches that are read without work, such as whole texts.
    """
    spark = stream.sparkSession

    def handle(batch: DataFrame, number: int) -> None:
        if not keep:
            return write(batch, number)
        # A writer reads its batch several times; lost blocks are recomputed from the source.
        batch.persist()
        try:
            write(batch, number)
        finally:
            batch.unpersist()

    # A query takes its settings from the session when it starts.
    settings = {STORE: ROCKSDB, CLEAN: "true"}
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        running = (
            stream.writeStream.foreachBatch(handle)
            .outputMode(mode)
            .option("checkpointLocation", f"{root}/_progress/{name}")
            .trigger(availableNow=True)
            .start()
        )
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
    running.awaitTermination()


def _batch_path(root: str, table: str, batch: int) -> str:
    return f"{root}/{table}/batch={batch}"


def read_batches(spark: SparkSession, root: str, table: str, schema: str | T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{root}/{table}")


def _place(spark: SparkSession, path: str) -> tuple:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _exists(spark: SparkSession, path: str) -> bool:
    files, place = _place(spark, path)
    return files.exists(place)


def _is_folder(spark: SparkSession, path: str) -> bool:
    files, place = _place(spark, path)
    return files.exists(place) and files.getFileStatus(place).isDirectory()


def earlier_rows(spark: SparkSession, root: str, table: str, batch: int) -> DataFrame | None:
    """Rows of the batches before ``batch``, or None when there are none yet."""
    if not _exists(spark, f"{root}/{table}"):
        return None
    return read_batches(spark, root, table).where(F.col("batch") < batch).drop("batch")


# --- ingest ------------------------------------------------------------------------------
def ingest_documents(stream: DataFrame, root: str, threshold: int = K.AUTO_WINDOW_CHUNKS) -> None:
    """Chunk arriving documents into chunk, parent and catalogue tables.

    ``stream``: doc_id, tenant_id, text. Copies of a text already known to the
    tenant get a catalogue row with status ``duplicate`` and no chunks.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        flagged = ingest.dedup_exact(batch, ["tenant_id"]).withColumnRenamed("is_duplicate", "_copy")
        known = earlier_rows(spark, root, "catalogue", number)
        if known is not None:
            # Only the batch's own keys are looked up in the history.
            asked = flagged.select("tenant_id", "md5_hash").distinct()
            seen = known.select("tenant_id", "md5_hash").join(asked, ["tenant_id", "md5_hash"], "left_semi")
            seen = seen.distinct().withColumn("_seen", F.lit(True))
            flagged = flagged.join(seen, ["tenant_id", "md5_hash"], "left")
        else:
            flagged = flagged.withColumn("_seen", F.lit(False))
        state = flagged.withColumn("duplicate", F.col("_copy") | F.coalesce("_seen", F.lit(False)))
        fresh = state.where("not duplicate").select("doc_id", "tenant_id", "text")
        parent = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("parent_ordinal").cast("string"))
        chunks = chunking.auto_windows(fresh, threshold=threshold).withColumn(
            "parent_id", F.when(F.col("parent_ordinal").isNotNull(), parent)
        )
        chunk_path = _batch_path(root, "chunks", number)
        # Both writes are partitioned by tenant; a hot tenant is split over tasks.
        chunks.hint("rebalance", "tenant_id").write.mode("overwrite").partitionBy("tenant_id").parquet(chunk_path)
        # Parents only of documents that were cut into windows.
        windowed = spark.read.parquet(chunk_path).where("windowed").select("doc_id").distinct()
        pages = fresh.join(windowed, "doc_id", "left_semi").withColumn("page", F.lit(1))
        _, parents = chunking.link_parents(pages)
        new_parents = parents.select("parent_id", "doc_id", "content", "tenant_id", "chunk_index")
        old = earlier_rows(spark, root, "parents", number)
        if old is not None:
            new_parents = sinks.absent_rows(new_parents, old, ["parent_id"], F.col("chunk_index"))
        new_parents.write.mode("overwrite").parquet(_batch_path(root, "parents", number))
        counts = spark.read.parquet(chunk_path).groupBy("doc_id").agg(F.count("*").alias("chunks_count"))
        rows = state.join(counts, "doc_id", "left").select(
            "doc_id",
            "tenant_id",
            "md5_hash",
            F.coalesce("chunks_count", F.lit(0)).alias("chunks_count"),
            ingest.ingest_status(
                F.col("duplicate"), F.lit(None).cast("string"), F.lit(1), F.col("chunks_count")
            ).alias("status"),
        )
        # Written last: a document counts as ingested once its catalogue row exists.
        rows.write.mode("overwrite").parquet(_batch_path(root, "catalogue", number))

    run_batches(stream, write, root, "ingest", keep=False)


def dedup_stream(stream: DataFrame, root: str, known: DataFrame | None = None) -> None:
    """First arrival of every (tenant, content hash), however late a copy comes: table ``unique``.

    ``stream``: doc_id, tenant_id, text, ts. The copies inside a micro-batch are combined before the shuffle, so a text
    copied very often does not fill one task; the batch's keys are then looked up among the stored ones, which
    nothing is ever taken out of. ``known`` holds (tenant_id, md5_hash) pairs that are stored elsewhere.
    """
    keys = ["tenant_id", "md5_hash"]

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        slim = batch.select("doc_id", "tenant_id", F.md5("text").alias("md5_hash"), "ts")
        first = skew.first_per_key(slim, keys, F.struct("ts", "doc_id"), ["doc_id", "ts"])
        for stored in (earlier_rows(spark, root, "unique", number), known):
            if stored is not None:
                first = first.join(stored.select(*keys), keys, "left_anti")
        first.select("doc_id", *keys, "ts").write.mode("overwrite").parquet(_batch_path(root, "unique", number))

    run_batches(stream, write, root, "unique")


# --- usage ----------------------------------------------------------------------------------
USAGE_KEYS = ["day", "provider", "model"]
USAGE_SUMS = ["total_cost", "total_prompt", "calls"]


def daily_usage(calls: DataFrame, root: str, every: int = 64) -> None:
    """Cost and tokens per day, provider and model; every call counts, however late it comes.

    A micro-batch adds one row per key, its own sums: a batch that runs again replaces its rows. Every ``every`` batches
    the rows so far are made one total, so that reading them does not slow down as batches go by.
    """

    def write(batch: DataFrame, number: int) -> None:
        sums = batch.groupBy(F.to_date("ts").alias("day"), "provider", "model").agg(
            F.sum("cost").alias("total_cost"), F.sum("prompt_tokens").alias("total_prompt"), F.count("*").alias("calls")
        )
        sums.write.mode("overwrite").parquet(_batch_path(root, "usage", number))
        if number % every == every - 1:
            # A total of a batch that runs again is the same once more.
            _usage_rows(batch.sparkSession, root, number).write.mode("overwrite").parquet(_batch_path(root, "usage_totals", number))

    run_batches(calls, write, root, "usage")


def _usage_rows(spark: SparkSession, root: str, upto: int | None = None) -> DataFrame:
    """Totals of the batches up to ``upto``: the last stored total before it and what came after."""
    rows = read_batches(spark, root, "usage")
    rows = rows if upto is None else rows.where(F.col("batch") <= upto)
    if _exists(spark, f"{root}/usage_totals"):
        totals = read_batches(spark, root, "usage_totals")
        totals = totals if upto is None else totals.where(F.col("batch") < upto)
        last = totals.agg(F.max("batch")).first()[0]
        if last is not None:
            rows = rows.where(F.col("batch") > last).unionByName(totals.where(F.col("batch") == last))
    return rows.groupBy(*USAGE_KEYS).agg(*[F.sum(c).alias(c) for c in USAGE_SUMS])


def latest_usage(spark: SparkSession, root: str) -> DataFrame:
    """The total of every day, provider and model over all batches."""
    return _usage_rows(spark, root)


# --- stateful jobs ---------------------------------------------------------------------------
def _stateful(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str, delay: str) -> DataFrame:
    return (
        rows.withWatermark("ts", delay)
        .groupBy(key)
        .transformWithStateInPandas(
            statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode="eventTime"
        )
    )


def stream_alerts(
    samples: DataFrame, rules: DataFrame, gap_seconds: int = K.ALERT_GAP_SECONDS, delay: str = "1 minute"
) -> DataFrame:
    """Evaluate samples against the static rules and debounce per rule."""
    checked = usage.evaluate_rules(samples, rules).select(
        "rule_id", "ts", usage.micros().alias("us"), "event_id", "value", "triggered"
    )
    schema = "rule_id int, event_id long, value double, fired boolean"
    return _stateful(checked, "rule_id", Debounce(gap_seconds), schema, delay)


def stream_rate_limit(
    requests: DataFrame, key: str, limit: int = K.RATE_LIMIT[0], seconds: int = K.RATE_LIMIT[1], delay: str = "1 minute",
    buckets: int = 1024,
) -> DataFrame:
    """Sliding-window decisions per key as requests arrive.

    Keys are kept in ``buckets`` states, so that the number of keys adds no states; a bucket's rows of a micro-batch meet in
    one task. Keep the number while a job goes on with its progress.
    """
    name = F.col(key).cast("long")
    rows = requests.select(
        F.when(name.isNull(), -1).otherwise(F.pmod(F.xxhash64(name), F.lit(buckets))).cast("int").alias("bucket"),
        F.coalesce(name, F.lit(0)).alias("key"), "ts", usage.micros().alias("us"), "event_id",
    )
    schema = "key long, event_id long, admitted boolean, remaining long"
    return _stateful(rows, "bucket", RateLimit(limit, seconds), schema, delay)


def with_rest(decided: DataFrame, whole: DataFrame, since: int, tie: str = "event_id", ts: str = "ts") -> DataFrame:
    """Closing step of a finished stream: rows the last watermark has not passed get the batch form's decision.

    ``since`` is that watermark in microseconds. An earlier row that the stream has not decided is an error, never filled in.
    """
    both = whole.join(decided.select(tie, F.lit(True).alias("_done")), tie, "left")
    late = F.raise_error(F.concat(F.lit("not decided by the stream: "), F.col(tie).cast("string")))
    open_rows = F.when(F.col("_done"), False).when(usage.micros(ts) < since, late.cast("boolean")).otherwise(True)
    return decided.unionByName(both.where(open_rows).select(*decided.columns))


def last_watermark(rows: DataFrame, delay: timedelta = timedelta(minutes=1), ts: str = "ts") -> int:
    """The watermark, in microseconds, of a stream that has read all ``rows``: whatever came before it is decided."""
    return (rows.agg(F.max(usage.micros(ts))).first()[0] or 0) - delay // timedelta(microseconds=1)


def append_batches(stream: DataFrame, root: str, table: str, mode: str = "append") -> None:
    """Write the rows of every micro-batch to its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(_batch_path(root, table, number))

    run_batches(stream, write, root, table, mode)


# --- sessions --------------------------------------------------------------------------------
def stream_sessions(stream: DataFrame, root: str, chars: int = 10_000) -> None:
    """Append arriving messages, title new sessions and note when they were touched.

    ``stream``: conv_id, turn, role, text, ts.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        messages = batch.withColumn("text", F.substring("text", 1, chars))
        messages.write.mode("overwrite").parquet(_batch_path(root, "messages", number))
        touched = batch.groupBy("conv_id").agg(F.max("ts").alias("updated_at"))
        fresh = touched.select("conv_id", F.lit(K.DEFAULT_TITLE).alias("title"))
        titled = chatlog.auto_title(batch, fresh)
        old = earlier_rows(spark, root, "sessions", number)
        rows = titled.join(touched, "conv_id")
        if old is not None:
            mine = old.join(touched.select("conv_id"), "conv_id", "left_semi")
            named = skew.first_per_key(
                mine.where(F.col("title") != K.DEFAULT_TITLE), ["conv_id"], F.col("updated_at"), ["title"]
            ).withColumnRenamed("title", "_old")
            rows = rows.join(named, "conv_id", "left").withColumn("title", F.coalesce("_old", "title")).drop("_old")
        rows.write.mode("overwrite").parquet(_batch_path(root, "sessions", number))

    run_batches(stream, write, root, "sessions")


def current_sessions(spark: SparkSession, root: str) -> DataFrame:
    """Newest title and touch time of every session."""
    rows = read_batches(spark, root, "sessions")
    return skew.last_per_key(rows, ["conv_id"], F.struct("updated_at", "batch"), ["title", "updated_at"])

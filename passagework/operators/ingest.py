"""De-duplication, page clean-up, document status and the document catalogue."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework import constants as K
from passagework import skew
from passagework.functions import text as X
from passagework.functions.arrays import ordered_text
from passagework.operators.chunking import chunk_array


def dedup_exact(
    docs: DataFrame, scope: Sequence[str], doc: str = "doc_id", content: str = "text"
) -> DataFrame:
    """Flag copies: same content hash inside the same scope.

    ``first_doc`` is the smallest id of the group and ``is_duplicate`` marks the
    others. Groups are reduced before the shuffle and only groups with more than one
    member are joined back.
    """
    hashed = docs.withColumn("md5_hash", F.md5(content))
    keys = [*scope, "md5_hash"]
    groups = hashed.groupBy(*keys).agg(F.min(doc).alias("_first"), F.count("*").alias("_n"))
    joined = skew.join_groups(hashed, groups.where("_n > 1"), keys, "_n", [doc])
    return joined.withColumn("first_doc", F.coalesce("_first", F.col(doc))).withColumn(
        "is_duplicate", F.col("first_doc") != F.col(doc)
    ).drop("_first")


def existing_flag(batch: DataFrame, catalogue: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tell which rows of an incoming batch already exist in the catalogue.

    The catalogue is filtered by the batch's keys first, so only hits are shuffled.
    """
    wanted = batch.select(*keys).distinct()
    hits = skew.join_small(catalogue.select(*keys), wanted, keys, "left_semi").distinct()
    return batch.join(hits.withColumn("exists", F.lit(True)), list(keys), "left").withColumn(
        "exists", F.coalesce("exists", F.lit(False))
    )


def drop_blank_pages(
    pages: DataFrame, doc: str = "doc_id", page: str = "page", text: str = "text"
) -> DataFrame:
    """Stripped non-blank pages with ``total_pages`` and ``page_count`` per document."""
    clean = pages.withColumn(text, X.strip(F.col(text)))
    counts = clean.groupBy(doc).agg(
        F.count("*").alias("total_pages"), F.count_if(F.col(text) != "").alias("page_count")
    )
    sized = counts.withColumn("_n", F.col("page_count"))
    return skew.join_groups(clean.where(F.col(text) != ""), sized, [doc], "_n", [page])


def needs_ocr(
    pages: DataFrame,
    doc: str = "doc_id",
    page: str = "page",
    text: str = "text",
    script: str = "一-鿿",
    first_pages: int = 3,
    enough: int = 10,
) -> DataFrame:
    """Documents none of whose first pages has enough characters of the script.

    ``page`` counts from 1.
    """
    letters = F.length(F.regexp_replace(F.col(text), f"[^{script}]", ""))
    best = F.max(F.when(F.col(page) <= first_pages, letters))
    return pages.groupBy(doc).agg((F.coalesce(best, F.lit(0)) < enough).alias("needs_ocr"))


# Decoding of GBK, and marks for undecodable bytes instead of an error.
GBK_CONF = {"spark.sql.legacy.javaCharsets": "true", "spark.sql.legacy.codingErrorAction": "true"}


@contextmanager
def gbk_names(spark: SparkSession) -> Iterator[None]:
    """Columns that are resolved inside know GBK; the session's own settings are put back."""
    before = {k: spark.conf.get(k) for k in GBK_CONF}
    try:
        for k, v in GBK_CONF.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def repair_filename(name: Column) -> Column:
    """Undo a GBK name that was read as Latin-1; other names stay. To be used inside ``gbk_names``."""
    suspect = name.rlike(r"^[\x00-\xff]*$") & name.rlike(r"[\x80-\xff]")
    decoded = F.decode(F.encode(name, "ISO-8859-1"), "GBK")
    return F.when(suspect & ~F.contains(decoded, F.lit("\ufffd")), decoded).otherwise(name)


def ingest_status(duplicate: Column, error: Column, pages: Column, chunks: Column) -> Column:
    """Status reported right after an upload."""
    return (
        F.when(F.coalesce(duplicate, F.lit(False)), "duplicate")
        .when(error.isNotNull(), "parse_failed")
        .when(F.coalesce(pages, F.lit(0)) == 0, "no_text")
        .when(F.coalesce(chunks, F.lit(0)) > 0, "indexed")
        .otherwise("parsed")
    )


def listing_status(chunks: Column, parser: Column) -> Column:
    """Status shown in the document list."""
    return (
        F.when(F.coalesce(chunks, F.lit(0)) > 0, "indexed")
        .when(F.coalesce(parser, F.lit("")).isin("", "unknown"), "no_text")
        .otherwise("parse_failed")
    )


def joined_pages(
    pages: DataFrame, chars: int, doc: str = "doc_id", page: str = "page", text: str = "text"
) -> DataFrame:
    """First ``chars`` characters of the page texts joined by a space.

    Blank pages are left out. Others add at least two characters each, so ``chars`` characters
    need no more than ``chars // 2 + 1`` pages: the rank limit loses nothing.
    """
    head = skew.top_per_key(
        pages.where(~X.is_blank(F.col(text))).select(doc, page, F.substring(text, 1, chars).alias("_t")),
        [doc],
        [F.col(page)],
        chars // 2 + 1,
        "_rank",
    )
    parts = F.collect_list(F.struct(F.col("_rank").alias("position"), F.col("_t").alias("text")))
    return head.groupBy(doc).agg(
        F.substring(ordered_text(parts, " "), 1, chars).alias("joined_text")
    )


def fallback_summary(joined: DataFrame, model_summary: str | None = None, chars: int = 200) -> DataFrame:
    """The model's summary, else the first ``chars`` characters."""
    fallback = F.substring("joined_text", 1, chars)
    given = F.col(model_summary) if model_summary else F.lit(None).cast("string")
    return joined.withColumn(
        "summary", F.when(F.coalesce(given, F.lit("")) != "", given).otherwise(fallback)
    )


def catalogue_rows(
    docs: DataFrame,
    text: str = "text",
    page_break: str = r"[.\n]",
    strategy: str = "fixed_size",
    size: int = K.CHUNK_SIZE,
    overlap: int = K.CHUNK_OVERLAP,
    chars: int = 200,
) -> DataFrame:
    """One catalogue row per document: hash, page and chunk counts and summary.

    Everything comes from the document's own row: one scan, no join, no exploded chunks.
    """
    pages = F.filter(F.split(text, page_break, -1), lambda p: ~X.is_blank(p))
    return docs.select(
        *[c for c in docs.columns if c != text],
        F.md5(text).alias("md5_hash"),
        F.size(pages).cast("long").alias("pages"),
        F.size(chunk_array(F.col(text), strategy, size, overlap)).cast("long").alias("chunks_count"),
        F.substring(text, 1, chars).alias("summary"),
        F.lit(strategy).alias("chunk_strategy"),
    )


def document_listing(
    catalogue: DataFrame, chunks: DataFrame, users: DataFrame, tenants: DataFrame, tenant: object = None
) -> DataFrame:
    """Documents with chunk count, uploader and tenant name, newest first.

    Chunks are counted before the join. ``tenant`` restricts to one tenant.
    """
    scoped = catalogue if tenant is None else catalogue.where(F.col("tenant_id") == F.lit(tenant))
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("vector_chunks"))
    people = users.select(
        F.col("id").alias("user_id"), F.coalesce("display_name", "username").alias("uploaded_by")
    )
    names = tenants.select(F.col("id").alias("tenant_id"), F.col("name").alias("tenant_name"))
    joined = scoped.join(counts, "doc_id", "left").na.fill(0, ["vector_chunks"])
    joined = skew.join_small(joined, people, ["user_id"], "left")
    joined = skew.join_small(joined, names, ["tenant_id"], "left")
    return joined.orderBy(F.desc("uploaded_at"), "doc_id")


def chunk_preview(chunks: DataFrame, chars: int = 500) -> DataFrame:
    """Chunk texts cut for display, keyed by ``source`` or else ``doc_id``."""
    return chunks.select(
        F.coalesce("source", "doc_id").alias("document"),
        "id",
        F.substring("text", 1, chars).alias("preview"),
    )


def delete_documents(
    tables: dict[str, DataFrame], ids: DataFrame, keys: Sequence[str] = ("doc_id",)
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Remaining rows of every table and the number of rows removed from each.

    ``keys`` is the id, plus the tenant where a caller may only delete its own.
    """
    wanted = ids.select(*keys).distinct()
    small = skew.small_enough(wanted)
    side = F.broadcast(wanted) if small else wanted
    kept, counts = {}, None
    for name, table in tables.items():
        if small:
            kept[name] = table.join(side, list(keys), "left_anti")
            gone = table.join(side, list(keys), "left_semi")
        else:
            kept[name] = skew.salted_join(table, side, list(keys), "left_anti")
            gone = skew.salted_join(table, side, list(keys), "left_semi")
        row = gone.agg(F.count("*").alias("removed")).select(F.lit(name).alias("table_name"), "removed")
        counts = row if counts is None else counts.unionByName(row)
    return kept, counts


def ingest_report(parsed: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Pass or fail, parser and character count per document."""
    return parsed.groupBy(doc).agg(
        F.max("parser_used").alias("parser_used"),
        F.sum(F.length(F.coalesce("content", F.lit("")))).alias("chars"),
        F.when(F.sum(F.length(F.coalesce("content", F.lit("")))) > 0, "PASS")
        .otherwise("FAIL")
        .alias("result"),
    )


def ingest_totals(report: DataFrame) -> DataFrame:
    return report.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("result") == "PASS").alias("passed"),
        F.count_if(F.col("result") == "FAIL").alias("failed"),
        F.sum("chars").alias("chars"),
    )

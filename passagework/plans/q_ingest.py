"""Registered queries: sources, sinks and ingest."""

from pyspark.sql import functions as F

from passagework.functions import text as X
from passagework.operators import chunking as C
from passagework.operators import ingest as I
from passagework.plans import dims
from passagework.plans.catalog import Tables, query
from passagework.plans.sqltext import strip
from passagework.session import work_folder
from passagework.sources import readers as R
from passagework.sources import sinks as S

EXTENSIONS = [".pdf", ".PNG", ".docx", ".txt", ".csv", ""]
NAME_SQL = "'doc-' || doc_id || ['.pdf','.PNG','.docx','.txt','.csv',''][doc_id % 6 + 1]"
FAMILY_SQL = """CASE lower(regexp_extract({0}, '(\\.[^.]+)$', 1))
  WHEN '.pdf' THEN 'pdf' WHEN '.png' THEN 'ocr' WHEN '.docx' THEN 'office' WHEN '.txt' THEN 'text' END"""


def file_name():
    ext = F.element_at(F.array(*[F.lit(e) for e in EXTENSIONS]), (F.col("doc_id") % 6 + 1).cast("int"))
    return F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), ext)


def pages_of(t: Tables):
    """Pages: the pieces of a document between full stops and line ends, counted from 1."""
    parts = F.split("text", r"[.\n]", -1)
    return t.docs.select("doc_id", F.posexplode(parts).alias("page", "text")).withColumn(
        "page", F.col("page") + 1
    )


PAGES = r"""pages_of AS (SELECT doc_id, generate_subscripts(p, 1) AS page, unnest(p) AS text
  FROM (SELECT doc_id, string_split(replace(text, chr(10), '.'), '.') AS p FROM documents))"""


@query("src_corpus", f"""
SELECT file_path, lower(regexp_extract(file_path, '(\\.[^.]+)$', 1)) AS file_type, content, source,
       coalesce({FAMILY_SQL.format('file_path')}, 'unknown') AS parser_used
FROM (SELECT {NAME_SQL} AS file_path, text AS content, source FROM documents)
""")
def src_corpus(t: Tables):
    rows = R.corpus_rows(t.documents, file_name(), "text", {"source": F.col("source")})
    return rows.withColumn("source", F.col("metadata.source")).drop("metadata")


@query("src_route_by_ext", f"""
SELECT doc_id, {FAMILY_SQL.format(NAME_SQL)} AS parser_used,
       {FAMILY_SQL.format(NAME_SQL)} IS NULL AS quarantined
FROM documents
""")
def src_route_by_ext(t: Tables):
    routed, refused = R.route(t.documents.select("doc_id", file_name().alias("file_path")))
    both = routed.withColumn("quarantined", F.lit(False)).unionByName(
        refused.withColumn("quarantined", F.lit(True))
    )
    return both.select("doc_id", "parser_used", "quarantined")


@query("src_eval_items", """
SELECT 'eval_' || item_id AS id, text AS question, text AS answer FROM benchmark
""")
def src_eval_items(t: Tables):
    """Write the questions as dataset files, then read them back as items."""
    item = F.struct(
        F.concat(F.lit("eval_"), F.col("item_id").cast("string")).alias("id"),
        F.col("text").alias("question"),
        F.col("text").alias("answer"),
    )
    path = work_folder(t.spark, "eval-items")
    t.benchmark.select(F.array(item).alias("dataset")).write.json(path)
    return R.read_eval_items(t.spark, path, multi_line=False).select("id", "question", "answer")


def log_lines(t: Tables):
    """Service log lines made from the events."""
    level = F.when(F.col("event_type") == "error", "ERROR").when(
        F.col("event_type") == "purchase", "CRITICAL"
    ).otherwise("INFO ")
    return t.events.select(
        F.concat_ws(
            " | ",
            F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS"),
            level,
            F.concat(F.lit("src."), F.col("event_type")),
            F.concat(F.lit("event "), F.col("event_id").cast("string"), F.lit(" "), F.col("props")),
        ).alias("value")
    )


@query("src_service_log", """
SELECT strftime(date_trunc('millisecond', ts), '%Y-%m-%d %H:%M:%S,%g') AS logged_at,
       CASE event_type WHEN 'error' THEN 'ERROR' ELSE 'CRITICAL' END AS level,
       'src.' || event_type AS logger, 'event ' || event_id || ' ' || props AS message
FROM events WHERE event_type IN ('error', 'purchase')
""")
def src_service_log(t: Tables):
    path = work_folder(t.spark, "service-log")
    log_lines(t).write.text(path)
    parsed = R.parse_log(t.spark.read.text(path))
    return R.error_lines(parsed).select("logged_at", "level", "logger", "message")


@query("src_qa_log", """
SELECT 'RAG_QUERY' AS kind, q.text AS question, a.text AS answer, 'conv-' || q.conv_id AS filename,
       q.turn / 10.0::double AS score
FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1
WHERE q.role = 'user' AND a.role = 'assistant'
""")
def src_qa_log(t: Tables):
    users = t.conversations.where("role = 'user'").select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question")
    )
    answers = t.conversations.where("role = 'assistant'").select(
        "conv_id", "turn", F.col("text").alias("answer")
    )
    source = F.struct(
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("filename"),
        ((F.col("turn") - 1) / 10).alias("score"),
        F.substring("answer", 1, 200).alias("snippet"),
    )
    message = F.to_json(F.struct("question", "answer", F.array(source).alias("sources")))
    path = work_folder(t.spark, "qa-log")
    users.join(answers, ["conv_id", "turn"]).select(
        F.concat(F.lit("2024-01-01 00:00:00,000 | INFO  | engine | RAG_QUERY "), message).alias("value")
    ).write.text(path)
    found = R.qa_messages(R.parse_log(t.spark.read.text(path)))
    return found.select("kind", "question", "answer", "filename", "score")


@query("sink_chunks", """
SELECT source AS tenant_id, count(*) AS chunks, sum(length(c))::bigint AS chars
FROM (SELECT source, substr(text, (i * 924 + 1)::bigint, 1024) AS c
      FROM (SELECT source, text, unnest(range(0, (length(text) + 923) // 924)) AS i FROM documents))
GROUP BY 1
""")
def sink_chunks(t: Tables):
    docs = t.documents.select("doc_id", F.col("source").alias("tenant_id"), "text")
    path = work_folder(t.spark, "chunks")
    S.append_partitioned(C.chunk(docs, "fixed_size"), path, ["tenant_id"])
    return (
        t.spark.read.parquet(path)
        .groupBy("tenant_id")
        .agg(F.count("*").alias("chunks"), F.sum(F.length("content")).alias("chars"))
    )


@query("sink_parents_insert_if_absent", """
WITH batch AS (SELECT source || ':' || n_chars AS parent_id, min(doc_id) AS doc_id FROM documents GROUP BY 1),
target AS (SELECT DISTINCT source || ':' || n_chars AS parent_id FROM documents JOIN labels USING (doc_id)
           WHERE quality = 1)
SELECT parent_id, doc_id FROM batch WHERE parent_id NOT IN (SELECT parent_id FROM target)
""")
def sink_parents_insert_if_absent(t: Tables):
    keyed = t.documents.select(
        F.concat_ws(":", "source", F.col("n_chars").cast("string")).alias("parent_id"), "doc_id"
    )
    good = t.labels.where("quality = 1").select("doc_id")
    target = keyed.join(good, "doc_id", "left_semi")
    return S.absent_rows(keyed, target, ["parent_id"], F.col("doc_id"))


@query("sink_summary_upsert", """
SELECT d.doc_id,
       CASE WHEN l.doc_id IS NULL THEN substr(text, 1, 200) ELSE 'new ' || substr(text, 1, 200) END AS summary,
       CASE WHEN l.doc_id IS NULL THEN 1 ELSE 2 END AS version,
       d.n_chars AS created_at
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
""")
def sink_summary_upsert(t: Tables):
    old = t.documents.select(
        "doc_id",
        F.substring("text", 1, 200).alias("summary"),
        F.lit(1).alias("version"),
        F.col("n_chars").alias("created_at"),
    )
    new = old.join(t.labels.select("doc_id"), "doc_id", "left_semi").select(
        "doc_id",
        F.concat(F.lit("new "), "summary").alias("summary"),
        F.lit(2).alias("version"),
        (F.col("created_at") + 1).alias("created_at"),
    )
    return S.upsert(old, new, ["doc_id"], "version", ["created_at"])


@query("seed_if_absent", """
WITH present AS (SELECT DISTINCT source AS code FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)
SELECT source AS code, min(doc_id) AS first_doc FROM documents
WHERE source NOT IN (SELECT code FROM present) GROUP BY 1
""")
def seed_if_absent(t: Tables):
    toxic = t.labels.where("toxic = 1").select("doc_id")
    present = t.documents.join(toxic, "doc_id", "left_semi").select(F.col("source").alias("code"))
    seeds = t.documents.select(F.col("source").alias("code"), F.col("doc_id").alias("first_doc"))
    return S.absent_rows(seeds, present, ["code"], F.col("first_doc"))


@query("dedup_md5_tenant", """
SELECT doc_id, source, md5(text) AS md5_hash, min(doc_id) OVER w AS first_doc,
       min(doc_id) OVER w <> doc_id AS is_duplicate
FROM documents WINDOW w AS (PARTITION BY source, md5(text))
""")
def dedup_md5_tenant(t: Tables):
    return I.dedup_exact(t.documents.select("doc_id", "source", "text"), ["source"]).drop("text")


@query("dup_name_size", """
WITH batch AS (SELECT doc_id, lang || '-' || (doc_id // 2) AS filename, n_chars + quality AS file_size, source
               FROM documents JOIN labels USING (doc_id))
SELECT doc_id, filename, file_size, source, EXISTS (
  SELECT 1 FROM documents c WHERE c.lang || '-' || (c.doc_id // 2) = batch.filename
  AND c.n_chars = batch.file_size AND c.source = batch.source) AS exists
FROM batch
""")
def dup_name_size(t: Tables):
    name = F.concat(F.col("lang"), F.lit("-"), F.floor(F.col("doc_id") / 2).cast("string"))
    catalogue = t.documents.select(
        "doc_id", name.alias("filename"), F.col("n_chars").alias("file_size"), "source"
    )
    batch = catalogue.join(t.labels.select("doc_id", "quality"), "doc_id").select(
        "doc_id", "filename", (F.col("file_size") + F.col("quality")).alias("file_size"), "source"
    )
    return I.existing_flag(batch, catalogue, ["filename", "file_size", "source"])


@query("drop_blank_pages", f"""
WITH {PAGES}, clean AS (SELECT doc_id, page, {strip('text')} AS text FROM pages_of)
SELECT * FROM (SELECT doc_id, page, text, count(*) OVER w AS total_pages,
       count(*) FILTER (text <> '') OVER w AS page_count
FROM clean WINDOW w AS (PARTITION BY doc_id)) WHERE text <> ''
""")
def drop_blank_pages(t: Tables):
    return I.drop_blank_pages(pages_of(t))


@query("needs_ocr_flag", f"""
WITH {PAGES}
SELECT doc_id, coalesce(max(length(regexp_replace(text, '[^à-ÿ]', '', 'g'))) FILTER (page <= 3), 0) < 10 AS needs_ocr
FROM pages_of GROUP BY doc_id
""")
def needs_ocr_flag(t: Tables):
    return I.needs_ocr(pages_of(t), script="à-ÿ")


@query("repair_filename", "SELECT doc_id, '文档-' || doc_id || '.txt' AS filename FROM documents")
def repair_filename(t: Tables):
    good = F.concat(F.lit("文档-"), F.col("doc_id").cast("string"), F.lit(".txt"))
    with I.gbk_names(t.spark):
        garbled = F.decode(F.encode(good, "GBK"), "ISO-8859-1")
        return t.documents.select("doc_id", I.repair_filename(garbled).alias("filename"))


@query("doc_status", """
SELECT doc_id,
  CASE WHEN dup THEN 'duplicate' WHEN toxic = 1 THEN 'parse_failed' WHEN lang = 'es' THEN 'no_text'
       WHEN n_chars > 500 THEN 'indexed' ELSE 'parsed' END AS ingest_status,
  CASE WHEN n_chars // 500 > 0 THEN 'indexed' WHEN lang = 'de' THEN 'no_text' ELSE 'parse_failed' END AS listing_status
FROM (SELECT d.*, toxic, min(d.doc_id) OVER (PARTITION BY source, md5(text)) <> d.doc_id AS dup
      FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
""")
def doc_status(t: Tables):
    flagged = I.dedup_exact(t.documents, ["source"]).join(t.labels, "doc_id", "left")
    error = F.when(F.col("toxic") == 1, F.lit("unreadable"))
    pages = F.when(F.col("lang") == "es", 0).otherwise(1)
    parser = F.when(F.col("lang") == "de", "unknown").otherwise("text")
    chunks = F.when(F.col("n_chars") > 500, F.lit(1)).otherwise(0)
    return flagged.select(
        "doc_id",
        I.ingest_status(F.col("is_duplicate"), error, pages, chunks).alias("ingest_status"),
        I.listing_status(F.floor(F.col("n_chars") / 500), parser).alias("listing_status"),
    )


@query("fallback_summary", f"""
WITH {PAGES}, joined AS (
  SELECT doc_id, substr(string_agg(t, ' ' ORDER BY page), 1, 8000) AS joined_text
  FROM (SELECT doc_id, page, {strip('text')} AS t FROM pages_of) WHERE t <> '' GROUP BY 1)
SELECT doc_id, md5(joined_text) AS prompt_md5, substr(joined_text, 1, 200) AS summary FROM joined
""")
def fallback_summary(t: Tables):
    joined = I.joined_pages(I.drop_blank_pages(pages_of(t)), 8000)
    return I.fallback_summary(joined).select("doc_id", F.md5("joined_text").alias("prompt_md5"), "summary")


@query("doc_catalog_row", f"""
WITH {PAGES}, p AS (SELECT doc_id, count(*) AS pages FROM pages_of WHERE {strip('text')} <> '' GROUP BY 1)
SELECT doc_id, {NAME_SQL} AS filename, n_chars AS file_size, coalesce(pages, 0) AS pages,
       (n_chars + 923) // 924 AS chunks_count, md5(text) AS md5_hash, source AS tenant_id,
       substr(text, 1, 200) AS summary, 'fixed_size' AS chunk_strategy
FROM documents LEFT JOIN p USING (doc_id)
""")
def doc_catalog_row(t: Tables):
    docs = t.docs.select(
        "doc_id", file_name().alias("filename"), F.col("n_chars").alias("file_size"), F.col("source").alias("tenant_id"), "text"
    )
    return I.catalogue_rows(docs)


@query("doc_listing", f"""
WITH {dims.SQL_USERS}, {dims.SQL_TENANTS},
chunks AS (SELECT doc_id, (n_chars + 923) // 924 AS vector_chunks FROM documents)
SELECT d.doc_id, coalesce(vector_chunks, 0) AS vector_chunks,
       coalesce(u.display_name, u.username) AS uploaded_by, n.name AS tenant_name
FROM documents d LEFT JOIN chunks c ON c.doc_id = d.doc_id LEFT JOIN users u ON u.id = d.doc_id % 70
LEFT JOIN tenants n ON n.id = substr(d.source, 4)::bigint
""")
def doc_listing(t: Tables):
    catalogue = t.documents.select(
        "doc_id",
        (F.col("doc_id") % 70).alias("user_id"),
        F.substring("source", 4, 10).cast("long").alias("tenant_id"),
        F.col("n_chars").alias("uploaded_at"),
    )
    chunks = C.chunk(t.docs.select("doc_id", "text"), "fixed_size")
    listed = I.document_listing(catalogue, chunks, dims.users(t.spark), dims.tenants(t.spark))
    return listed.select("doc_id", "vector_chunks", "uploaded_by", "tenant_name")


@query("doc_chunk_preview", """
SELECT coalesce(CASE WHEN lang <> 'fr' THEN source END, doc_id::varchar) AS document,
       i AS id, substr(text, (i * 924 + 1)::bigint, 500) AS preview, doc_id
FROM (SELECT *, unnest(range(0, (length(text) + 923) // 924)) AS i FROM documents)
""")
def doc_chunk_preview(t: Tables):
    docs = t.documents.select(
        "doc_id", F.when(F.col("lang") != "fr", F.col("source")).alias("source"), "text"
    )
    chunks = C.chunk(docs, "fixed_size")
    keyed = chunks.withColumnsRenamed({"content": "text", "chunk_index": "id", "doc_id": "doc"})
    keyed = keyed.withColumn("doc_id", F.col("doc").cast("string"))
    preview = F.substring("text", 1, 500)
    return keyed.select(
        F.coalesce("source", "doc_id").alias("document"),
        "id",
        preview.alias("preview"),
        F.col("doc").alias("doc_id"),
    )


@query("fmt_size", """
SELECT doc_id, CASE WHEN s < 1024 THEN s || ' B' WHEN s < 1048576 THEN printf('%.1f KB', round_even(s / 1024.0::double, 1))
  ELSE printf('%.1f MB', round_even(s / 1048576.0::double, 1)) END AS label
FROM (SELECT doc_id, n_chars * (doc_id % 997 + 1) AS s FROM documents)
""")
def fmt_size(t: Tables):
    size = F.col("n_chars") * (F.col("doc_id") % 997 + 1)
    return t.documents.select("doc_id", X.size_label(size).alias("label"))


@query("delete_cascade", """
WITH gone AS (SELECT doc_id, source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)
SELECT 'catalogue' AS table_name, count(*) AS removed FROM documents WHERE (doc_id, source) IN (SELECT doc_id, source FROM gone)
UNION ALL SELECT 'chunks', coalesce(sum((n_chars + 923) // 924), 0)::bigint FROM documents
  WHERE (doc_id, source) IN (SELECT doc_id, source FROM gone)
UNION ALL SELECT 'kept', count(*) FROM documents WHERE (doc_id, source) NOT IN (SELECT doc_id, source FROM gone)
""")
def delete_cascade(t: Tables):
    toxic = t.labels.where("toxic = 1").select("doc_id")
    catalogue = t.documents.select("doc_id", "source")
    ids = catalogue.join(toxic, "doc_id", "left_semi")
    chunks = C.chunk(t.docs.select("doc_id", "source", "text"), "fixed_size")
    tables = {"catalogue": catalogue, "chunks": chunks.drop("content")}
    kept, counts = I.delete_documents(tables, ids, ["doc_id", "source"])
    left = kept["catalogue"].agg(F.count("*").alias("removed"))
    return counts.unionByName(left.select(F.lit("kept").alias("table_name"), "removed"))


@query("replace_documents", """
SELECT doc_id, CASE WHEN quality = 0 THEN md5('new ' || text) ELSE md5(text) END AS md5_hash
FROM documents LEFT JOIN labels USING (doc_id)
""")
def replace_documents(t: Tables):
    current = t.documents.select("doc_id", "source", "text")
    poor = t.labels.where("quality = 0").select("doc_id")
    batch = current.join(poor, "doc_id", "left_semi").withColumn("text", F.concat(F.lit("new "), "text"))
    state = S.replace_keys(current, batch, ["doc_id"])
    path = work_folder(t.spark, "replaced")
    S.append_partitioned(state, path, ["source"])
    return t.spark.read.parquet(path).select("doc_id", F.md5("text").alias("md5_hash"))


@query("ingest_report", """
SELECT doc_id, lang AS parser_used, length(trim(text)) AS chars,
       CASE WHEN length(trim(text)) > 0 THEN 'PASS' ELSE 'FAIL' END AS result
FROM documents
UNION ALL SELECT NULL, 'total ' || count(*), sum(length(trim(text)))::bigint, count(*) FILTER (length(trim(text)) > 0) || ' passed' FROM documents
""")
def ingest_report(t: Tables):
    parsed = t.documents.select(
        "doc_id", F.col("lang").alias("parser_used"), F.trim("text").alias("content")
    )
    report = I.ingest_report(parsed)
    totals = I.ingest_totals(report).select(
        F.lit(None).cast("long").alias("doc_id"),
        F.concat(F.lit("total "), F.col("total").cast("string")).alias("parser_used"),
        "chars",
        F.concat(F.col("passed").cast("string"), F.lit(" passed")).alias("result"),
    )
    return report.unionByName(totals)

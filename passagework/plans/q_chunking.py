"""Registered queries: chunking."""

from pyspark.sql import functions as F

from passagework.operators import chunking as C
from passagework.plans.catalog import Tables, query
from passagework.plans.sqltext import non_blank, paragraphs, sentences

SIZE, OVERLAP = 1024, 100
# The corpus has no blank-line paragraphs of its own everywhere, so these use a
# smaller size to reach every branch.
SMALL = 400


def _docs(t: Tables):
    return t.docs.select("doc_id", "text")


@query("split_sentences", f"""
SELECT doc_id, generate_subscripts(s, 1) - 1 AS position, unnest(s) AS sentence
FROM (SELECT doc_id, {sentences('text')} AS s FROM documents)
""")
def split_sentences(t: Tables):
    return C.sentence_rows(_docs(t)).withColumn("position", F.col("position").cast("long"))


@query("chunk_fixed", f"""
SELECT doc_id, i AS chunk_index, substr(text, (i * {SIZE - OVERLAP} + 1)::bigint, {SIZE}) AS content
FROM (SELECT doc_id, text, unnest(range(0, (length(text) + {SIZE - OVERLAP - 1}) // {SIZE - OVERLAP})) AS i
      FROM documents)
""")
def chunk_fixed(t: Tables):
    return C.chunk(_docs(t), "fixed_size", SIZE, OVERLAP)


# Greedy packing in SQL: walk the parts of every key, one position per step.
PACK = """
parts AS (SELECT {key}, generate_subscripts(s, 1) AS pos, unnest(s) AS part FROM src),
walk AS (
  SELECT {key}, pos, part, length(part) AS used, 0 AS grp FROM parts WHERE pos = 1
  UNION ALL
  SELECT {pkey}, p.pos, p.part,
         CASE WHEN w.used + length(p.part) > {size} THEN length(p.part)
              ELSE w.used + length(p.part) + {gap} END,
         CASE WHEN w.used + length(p.part) > {size} THEN w.grp + 1 ELSE w.grp END
  FROM walk w JOIN parts p ON {join} AND p.pos = w.pos + 1
)
"""


def pack_sql(keys, size, gap=0):
    return PACK.format(
        key=", ".join(keys),
        pkey=", ".join(f"p.{k}" for k in keys),
        join=" AND ".join(f"p.{k} = w.{k}" for k in keys),
        size=size,
        gap=gap,
    )


@query("chunk_sentence", f"""
WITH RECURSIVE src AS (SELECT doc_id, {sentences('text')} AS s FROM documents),
{pack_sql(['doc_id'], SIZE)}
SELECT doc_id, grp AS chunk_index, string_agg(part, '' ORDER BY pos) AS content
FROM walk GROUP BY doc_id, grp
""")
def chunk_sentence(t: Tables):
    return C.chunk(_docs(t), "sentence", SIZE)


# Headings are made from the first word of some lines, so that sections exist.
HEADED = r"regexp_replace(text, '(\n)([A-Z][a-z]+ (?:the|of|and|le|de|der|la|el)) ', '\1## \2' || chr(10), 'g')"


@query("chunk_markdown", f"""
SELECT doc_id, generate_subscripts(s, 1) - 1 AS chunk_index, unnest(s) AS content
FROM (SELECT doc_id, {non_blank(r"string_split(regexp_replace(" + HEADED + r", '\n(#{2,3}\s)', chr(1) || '\1', 'g'), chr(1))")} AS s
      FROM documents)
""")
def chunk_markdown(t: Tables):
    headed = F.regexp_replace(
        "text", r"(\n)([A-Z][a-z]+ (?:the|of|and|le|de|der|la|el)) ", "$1## $2\n"
    )
    return C.chunk(t.docs.select("doc_id", headed.alias("text")), "markdown_header")


# Paragraph breaks: the corpus has single line breaks, so every line end becomes one.
PARAGRAPHED = r"regexp_replace(text, '\n', chr(10) || chr(10), 'g')"


def _paragraphed(t: Tables):
    return t.docs.select("doc_id", F.regexp_replace("text", "\n", "\n\n").alias("text"))


@query("chunk_recursive", f"""
WITH RECURSIVE paras AS (
  SELECT doc_id, generate_subscripts(s, 1) AS para_no, unnest(s) AS para
  FROM (SELECT doc_id, {paragraphs(PARAGRAPHED)} AS s FROM documents)),
src AS (SELECT doc_id, para_no, {sentences('para')} AS s FROM paras WHERE length(para) > {SMALL}),
{pack_sql(['doc_id', 'para_no'], SMALL)},
packed AS (SELECT doc_id, para_no, grp, string_agg(part, '' ORDER BY pos) AS content
           FROM walk GROUP BY ALL),
pieces AS (
  SELECT doc_id, para_no, 0 AS grp, 0 AS i, para AS content FROM paras WHERE length(para) <= {SMALL}
  UNION ALL
  SELECT doc_id, para_no, grp, 0, content FROM packed WHERE length(content) <= {SMALL}
  UNION ALL
  SELECT doc_id, para_no, grp, i, substr(content, (i * {SMALL - 50} + 1)::bigint, {SMALL})
  FROM (SELECT *, unnest(range(0, (length(content) + {SMALL - 51}) // {SMALL - 50})) AS i
        FROM packed WHERE length(content) > {SMALL}))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY para_no, grp, i) - 1 AS chunk_index, content
FROM pieces
""")
def chunk_recursive(t: Tables):
    return C.chunk(_paragraphed(t), "recursive", SMALL, 50)


@query("window_sentence", f"""
WITH parts AS (SELECT doc_id, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS part
               FROM (SELECT doc_id, {sentences('text')} AS s FROM documents)),
children AS (SELECT doc_id, pos // 3 AS chunk_index, string_agg(part, '' ORDER BY pos) AS content
             FROM parts GROUP BY ALL),
parents AS (SELECT doc_id, pos // 15 AS parent_ordinal, string_agg(part, '' ORDER BY pos) AS parent_content
            FROM parts GROUP BY ALL)
SELECT doc_id, chunk_index, content, parent_ordinal, md5(parent_content) AS parent_md5
FROM children JOIN parents USING (doc_id) WHERE parent_ordinal = chunk_index // 5
""")
def window_sentence(t: Tables):
    windowed = _docs(t).select("doc_id", C.sentence_windows(F.col("text")).alias("windows"))
    return _with_parent_md5(windowed)


def _with_parent_md5(windowed):
    hashed = F.transform("windows.parents", lambda p: F.md5(p))
    return C.child_rows(windowed.withColumn("_md5", hashed)).select(
        "doc_id",
        "chunk_index",
        "content",
        "parent_ordinal",
        F.get("_md5", F.col("parent_ordinal")).alias("parent_md5"),
    )


@query("window_recursive", f"""
WITH RECURSIVE paras AS (
  SELECT doc_id, generate_subscripts(s, 1) AS para_no, unnest(s) AS para
  FROM (SELECT doc_id, {paragraphs(PARAGRAPHED)} AS s FROM documents)),
sents AS (SELECT doc_id, para_no, generate_subscripts(s, 1) AS sent_no, unnest(s) AS sent
          FROM (SELECT doc_id, para_no, {sentences('para')} AS s FROM paras WHERE length(para) > {SMALL})),
kids AS (
  SELECT doc_id, para_no, 0 AS sent_no, 0 AS i, para AS content FROM paras WHERE length(para) <= {SMALL}
  UNION ALL
  SELECT doc_id, para_no, sent_no, i, substr(sent, (i * {SMALL} + 1)::bigint, {SMALL})
  FROM (SELECT *, unnest(range(0, (length(sent) + {SMALL - 1}) // {SMALL})) AS i FROM sents)),
src AS (SELECT doc_id, list(content ORDER BY para_no, sent_no, i) AS s FROM kids GROUP BY doc_id),
{pack_sql(['doc_id'], SMALL, 2)},
parents AS (SELECT doc_id, grp, md5(string_agg(part, chr(10) || chr(10) ORDER BY pos)) AS parent_md5
            FROM walk GROUP BY doc_id, grp)
SELECT doc_id, pos - 1 AS chunk_index, part AS content, grp AS parent_ordinal, parent_md5
FROM walk JOIN parents USING (doc_id, grp)
""")
def window_recursive(t: Tables):
    windowed = _paragraphed(t).select(
        "doc_id", C.recursive_windows(F.col("text"), SMALL).alias("windows")
    )
    return _with_parent_md5(windowed)


@query("window_passthrough", f"""
SELECT doc_id, i AS chunk_index, i AS parent_ordinal,
       substr(text, (i * {SIZE - OVERLAP} + 1)::bigint, {SIZE}) AS content,
       md5(substr(text, (i * {SIZE - OVERLAP} + 1)::bigint, {SIZE})) AS parent_md5
FROM (SELECT doc_id, text, unnest(range(0, (length(text) + {SIZE - OVERLAP - 1}) // {SIZE - OVERLAP})) AS i
      FROM documents)
""")
def window_passthrough(t: Tables):
    windows = C.window_struct(F.col("text"), "fixed_size", SIZE, OVERLAP)
    return _with_parent_md5(_docs(t).select("doc_id", windows.alias("windows")))


AUTO = 6


@query("chunk_auto_window", f"""
WITH RECURSIVE src AS (SELECT doc_id, {sentences('text')} AS s FROM documents),
{pack_sql(['doc_id'], SIZE)},
flat AS (SELECT doc_id, grp AS chunk_index, string_agg(part, '' ORDER BY pos) AS content
         FROM walk GROUP BY doc_id, grp),
sized AS (SELECT doc_id, count(*) >= {AUTO} AS windowed FROM flat GROUP BY doc_id)
SELECT doc_id, windowed, chunk_index, content, NULL::bigint AS parent_ordinal
FROM flat JOIN sized USING (doc_id) WHERE NOT windowed
UNION ALL
SELECT doc_id, windowed, (pos - 1) // 3, string_agg(part, '' ORDER BY pos), (pos - 1) // 15
FROM parts JOIN sized USING (doc_id) WHERE windowed
GROUP BY doc_id, windowed, (pos - 1) // 3, (pos - 1) // 15
""")
def chunk_auto_window(t: Tables):
    return C.auto_windows(_docs(t), size=SIZE, threshold=AUTO)


@query("chunk_with_metadata", """
SELECT doc_id, i AS chunk_index, 'doc-' || doc_id AS filename, lang AS parser_used,
       source AS tenant_id, i::varchar AS index_text
FROM (SELECT doc_id, lang, source, unnest(range(0, (length(text) + 923) // 924)) AS i FROM documents)
""")
def chunk_with_metadata(t: Tables):
    docs = t.docs.select(
        "doc_id",
        "text",
        "source",
        F.create_map(F.lit("parser_used"), F.col("lang")).alias("metadata"),
    )
    extra = {
        "doc_id": F.col("doc_id"),
        "filename": F.concat(F.lit("doc-"), F.col("doc_id").cast("string")),
        "parser_used": F.lit("text"),
        "tenant_id": F.col("source"),
    }
    merged = C.with_metadata(C.chunk(docs, "fixed_size", SIZE, OVERLAP), extra)
    return merged.select(
        "doc_id",
        "chunk_index",
        F.col("metadata.filename").alias("filename"),
        F.col("metadata.parser_used").alias("parser_used"),
        F.col("metadata.tenant_id").alias("tenant_id"),
        F.col("metadata.chunk_index").alias("index_text"),
    )


# Documents are grouped into folders of pages: one source and language is one folder.
FOLDER = "source || '/' || lang"


def _folders(t: Tables):
    return t.docs.select(
        F.concat_ws("/", "source", "lang").alias("folder"), F.col("doc_id").alias("page"), "text"
    )


@query("parent_link", f"""
WITH parts AS (SELECT {FOLDER} AS folder, doc_id AS page, generate_subscripts(s, 1) - 1 AS pos
               FROM (SELECT source, lang, doc_id, unnest([{sentences('text')}]) AS s FROM documents)),
counts AS (SELECT folder, page, max(pos) // 15 + 1 AS n FROM parts GROUP BY ALL),
bases AS (SELECT folder, page, coalesce(sum(n) OVER (PARTITION BY folder ORDER BY page
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS base FROM counts)
SELECT DISTINCT folder, page, pos // 3 AS chunk_index, folder || ':' || (base + pos // 15) AS parent_id
FROM parts JOIN bases USING (folder, page)
""")
def parent_link(t: Tables):
    children, _ = C.link_parents(_folders(t), doc="folder", page="page")
    return children.select("folder", "page", "chunk_index", "parent_id")


@query("window_compare", f"""
WITH parts AS (SELECT source, doc_id, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS part
               FROM (SELECT source, doc_id, {sentences('text')} AS s FROM documents)),
children AS (SELECT source, doc_id, pos // 3 AS c, sum(length(part)) AS n FROM parts GROUP BY ALL),
parents AS (SELECT source, doc_id, pos // 15 AS p, sum(length(part)) AS n FROM parts GROUP BY ALL)
SELECT * FROM
 (SELECT source AS query_id, count(*) AS flat_hits, sum(n)::bigint AS flat_chars FROM children GROUP BY 1)
 JOIN (SELECT source AS query_id, count(*) AS window_hits, sum(n)::bigint AS window_chars FROM parents GROUP BY 1)
 USING (query_id)
""")
def window_compare(t: Tables):
    windowed = t.docs.select(
        F.col("source").alias("query_id"), C.sentence_windows(F.col("text")).alias("windows")
    )
    return C.window_comparison(C.child_rows(windowed), C.parent_rows(windowed))

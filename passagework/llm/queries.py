"""Registered queries of the operators, with check SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.llm import ann, balltree, chat, divergence, embed_dedup, mixing, neardup, packing, pii, secrets, substrings, toxicity, urls
from passagework.plans.catalog import Tables

PII_KEY = "surrogates-1"
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
MIX_TARGETS = {"0": 0.1, "1": 0.9}
PACK = {"buckets": 16, "budget": 16384}
ODD_CHAT = r"\### Assistant: </turn> ok"
WORDS = r"[^\x20\x09-\x0D]+"


def op1_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of formatted conversations, read back from the formatted text and the segments."""
    t = Tables(spark, folder)
    odd = "'" + ODD_CHAT.replace("\\", "\\\\") + "'"
    more = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', {odd}), (-7L, 1L, 'assistant', {odd}) AS t(conv_id, turn, role, text)")
    turns = t.conversations.select("conv_id", "turn", "role", "text").unionByName(more)
    chats = chat.format_chats(turns)
    back = chats.withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("learned", chat.learned_text(F.col("segments")))
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )


OP1_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{ODD_CHAT}' UNION ALL SELECT -7, 1, 'assistant', '{ODD_CHAT}'
), e AS (
  SELECT *, row_number() OVER w AS n, lag(role) OVER w AS before, lead(role) OVER w IS NULL AS last,
    replace(replace(replace(text, '\', '\\'), '### ', '#\## '), '</turn>', '<\/turn>') AS etext,
    replace(replace(replace(replace(role, '\', '\\'), '### ', '#\## '), '</turn>', '<\/turn>'), ': ', ':\ ') AS erole
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(4 + length(erole) + 2 + length(etext) + 8)::BIGINT AS formatted_chars,
  bool_and(CASE WHEN n = 1 THEN role IN ('system', 'user')
    ELSE (before, role) IN (('system', 'user'), ('user', 'assistant'), ('assistant', 'user')) END
    AND (NOT last OR role = 'assistant')) AS valid
FROM e GROUP BY conv_id
"""


def op2_minhash_forest(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate components of all documents: 3-word shingles, similarity of 0.85 or more."""
    return neardup.near_duplicates(Tables(spark, folder).documents, shingle=3, share=(85, 100))


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w WHERE w IS NOT NULL
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL
), links AS MATERIALIZED (
  SELECT a, b FROM shared JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)
), e AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
r(doc_id, c) AS (SELECT a, a FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id WHERE r.c < e.b),
low AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(low.c, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(low.c, d.doc_id)) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN low USING (doc_id)
"""


def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Words of all documents that no repeated window of 20 words covers."""
    return substrings.remove_repeats(Tables(spark, folder).documents, window=20, with_text=False)


OP3_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS pos FROM w WHERE len(w) >= 20),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY array_to_string(w[pos:pos + 19], ' ') ORDER BY doc_id, pos) AS nth FROM p),
gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM r, (SELECT unnest(range(0, 20)) AS k) WHERE nth > 1),
u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM w),
k AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS text FROM u ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""


def op4_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts of all pages."""
    return urls.filter_urls(Tables(spark, folder).pages, urls.rule_table(spark, URL_RULES))


_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)
OP4_SQL = rf"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), rules(verdict, h, p) AS (VALUES {_RULES}),
hits AS (
  SELECT page_id, host, path, h || p AS rule, verdict, length(h || p) AS n FROM parts LEFT JOIN rules
    ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
), best AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC NULLS LAST) AS k FROM hits)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM best WHERE k = 1
"""


def op5_pii_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with surrogates in place of personal data."""
    docs = Tables(spark, folder).documents.select("doc_id", "text", "lang", "source")
    return pii.replace_personal_data(docs, PII_KEY)


def op6_ann_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose id is divisible by 20."""
    return ann.nearest(Tables(spark, folder).embeddings, F.col("vec_id") % 20 == 0, k=20)


def op7_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of vectors with equal labels and a cosine of 0.98 or more."""
    return embed_dedup.embedding_groups(Tables(spark, folder).embeddings, threshold=0.98)


OP7_SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
ok AS (
  SELECT vec_id, label, x, sqrt(list_sum(list_transform(x, lambda c: c * c))) AS n FROM v
  WHERE label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0
), links AS MATERIALIZED (
  SELECT p.vec_id AS a, q.vec_id AS b FROM ok p JOIN ok q ON p.label = q.label AND p.vec_id <> q.vec_id AND len(p.x) = len(q.x)
  WHERE list_dot_product(p.x, q.x) / (p.n * q.n) >= 0.98
), r(vec_id, c) AS (SELECT a, a FROM links UNION SELECT links.b, r.c FROM r JOIN links ON links.a = r.vec_id WHERE r.c < links.b),
low AS (SELECT vec_id, min(c) AS c FROM r GROUP BY vec_id), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(low.c, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(low.c, vec_id)) AS kept
FROM embeddings LEFT JOIN low USING (vec_id) LEFT JOIN n ON n.a = embeddings.vec_id
"""


def op8_length_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in token-budget batches of optimal length buckets."""
    return packing.pack(Tables(spark, folder).documents, **PACK)


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of all documents, learned from the labels that are not held out."""
    t = Tables(spark, folder)
    return toxicity.score_toxicity(t.documents, t.labels, threshold=0.3)


def op10_mixing_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Rates of all documents whose expected tokens per quality class match the targets."""
    t = Tables(spark, folder)
    return mixing.mix(t.documents, t.labels, "quality", MIX_TARGETS)


def op11_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of all documents: fixed patterns, and runs that look random."""
    return secrets.find_secrets(Tables(spark, folder).documents, rate=0.05)


def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """Divergences between the sources of each language, and the terms that set a source apart."""
    return divergence.divergence_audit(Tables(spark, folder).documents)


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
s AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (s.n + v.v)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (k.n + 1)) // (v.n + v.v)::HUGEINT AS q
  FROM g JOIN kept k USING (lang) JOIN s USING (lang, source) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)
), f AS (
  SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
  FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
), terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pairs UNION ALL FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""


def op13_ball_tree_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 best documents of every benchmark item by exact lexical score."""
    t = Tables(spark, folder)
    return balltree.search(t.documents, t.benchmark, k=10)


_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT r, doc_id, len(w) AS n FROM d WHERE len(w) > 0),
t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY ALL),
total AS (SELECT count(*) AS n, sum(n)::BIGINT AS l FROM s),
df AS (SELECT term, count(*) AS df FROM t GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2 * total.n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, total),
i AS (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS w FROM benchmark WHERE text IS NOT NULL),
q AS (SELECT i, item_id, term, count(*) AS c FROM (SELECT i, item_id, unnest(w) AS term FROM i) GROUP BY ALL),
found AS (
  SELECT i, item_id, doc_id, r, sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * s.n * total.n) // total.l))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN t USING (term) JOIN s USING (r), total GROUP BY ALL
), ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id, r) AS rank FROM found WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """The stages of ``corpus_pipeline``, one after another."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_format, op2_minhash_forest, op3_substring_dedup, op4_url_filter, op5_pii_surrogates, op6_ann_scan,
        op7_embedding_dedup, op8_length_packing, op9_toxicity, op10_mixing_rates, op11_secret_scan, op12_source_divergence, op13_ball_tree_search, pipeline,
    )
}
CHECKS = {
    "op1_chat_format": OP1_SQL, "op2_minhash_forest": OP2_SQL, "op3_substring_dedup": OP3_SQL, "op4_url_filter": OP4_SQL, "op7_embedding_dedup": OP7_SQL,
    "op12_source_divergence": OP12_SQL, "op13_ball_tree_search": OP13_SQL,
}

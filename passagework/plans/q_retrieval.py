"""Registered queries: lexical and vector search, fusion, retrieval plans."""

import hashlib
import itertools
import re

import numpy as np
from pyspark.sql import functions as F

from passagework import constants as K
from passagework.functions import text as X
from passagework.functions import vectors as V
from passagework.operators import chunking as C
from passagework.operators import fusion as R
from passagework.operators import lexical_index as I
from passagework.operators import models as M
from passagework.operators import vector as N
from passagework.plans import retrieval as P
from passagework.plans.catalog import Tables, query
from passagework.plans.sqltext import sentences, strip, tokens
from passagework.session import materialize, work_folder

# --- shared inputs ---------------------------------------------------------------
# Nodes are the sentence windows of all documents, parents the wider windows around them; a
# document's source is its tenant. The embedding counts hashed tokens, which is exact in both
# engines. The index tables are written once per session and folder, as an ingest job would do.
DIM = 64
_STORED: dict[tuple[str, str, int], P.Corpus] = {}


class _Buckets(dict):
    """Bucket of each word met so far; begins anew before it grows large."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        self[word] = bucket = hashlib.md5(word.encode()).digest()[0] % DIM
        return bucket


_bucket = _Buckets()


def bucket_counts(texts):
    """Example batch function: tokens counted by the first byte of their MD5, modulo ``DIM``."""
    words = [re.findall(X.PY_RUNS, (text or "").lower()) for text in texts]
    bucket = np.fromiter(map(_bucket.__getitem__, itertools.chain.from_iterable(words)), np.int64)
    row = np.repeat(np.arange(len(words)), [len(found) for found in words])
    return np.bincount(row * DIM + bucket, minlength=len(words) * DIM).reshape(len(words), DIM).astype(np.float64)


def asked_texts(t: Tables):
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def questions(t: Tables):
    return M.embed(asked_texts(t), "question", bucket_counts)


def of_tenants(asked):
    """Every question is asked by one of 20 tenants."""
    return asked.withColumn("tenant_id", F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string")))


def corpus(t: Tables) -> P.Corpus:
    files = t.documents.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    # A table that changes in a session is another one.
    version = files.agg(F.coalesce(F.sum(F.shiftright(F.xxhash64(*files.columns), 20)), F.lit(0))).first()[0]
    key = (t.spark.sparkContext.applicationId, t.folder, version)
    if key not in _STORED:
        _STORED[key] = build_corpus(t)
    return _STORED[key]


def build_corpus(t: Tables) -> P.Corpus:
    docs = t.docs.select("doc_id", F.col("source").alias("tenant_id"), C.sentence_windows(F.col("text")).alias("windows"))
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("filename")

    def part(n):
        return F.concat_ws("/", F.col("doc_id").cast("string"), F.col(n).cast("string"))

    children = C.child_rows(docs).select(
        part("chunk_index").alias("node_id"), "doc_id", "tenant_id", name, "chunk_index", "content", part("parent_ordinal").alias("parent_id")
    )
    nodes = materialize(M.embed(children, "content", bucket_counts), "nodes")
    parents = C.parent_rows(docs).select(part("chunk_index").alias("parent_id"), "doc_id", "tenant_id", name, "chunk_index", "content")
    path = work_folder(t.spark, "index")
    I.add_segment(nodes, path, tenant="tenant_id")
    return P.Corpus(
        nodes.drop("embedding"), nodes.select("node_id", "tenant_id", "embedding"), materialize(parents, "parents"), I.read_index(t.spark, path)
    )


def dense_list(t: Tables, k: int = 40):
    return N.vector_topk(questions(t), corpus(t).vectors, k)


def sparse_list(t: Tables, k: int = 40):
    return I.search(corpus(t).postings, asked_texts(t), k)


def table_questions(t: Tables):
    """Questions with the vectors of the embeddings table."""
    vectors = t.embeddings.select(F.col("vec_id").alias("query_id"), "embedding")
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return asked.join(vectors, "query_id")


def table_vectors(t: Tables):
    return t.embeddings.select(F.col("vec_id").alias("node_id"), "embedding")


COS = "round(list_cosine_similarity(q.embedding::double[], e.embedding::double[]), 9)"
ASKED = "asked AS (SELECT item_id AS query_id, text AS question, embedding FROM benchmark JOIN embeddings ON vec_id = item_id)"
TABLE_DENSE = f"""{ASKED},
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, node_id) AS rank
  FROM (SELECT q.query_id, e.vec_id AS node_id, {COS} AS similarity FROM asked q, embeddings e)) WHERE rank <= 40)"""
TF_SCORE = "0.1 * list_sum(list_transform(range(1, tf + 1), lambda j: 1.0::double / (j * j))) / 1.64493406685"


NODES = f"""parts AS (SELECT doc_id, source, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS part
  FROM (SELECT doc_id, source, {sentences('text')} AS s FROM documents)),
nodes AS MATERIALIZED (SELECT doc_id || '/' || c AS node_id, doc_id, source AS tenant_id, doc_id || '/' || (c // 5) AS parent_id, content
  FROM (SELECT doc_id, source, pos // 3 AS c, string_agg(part, '' ORDER BY pos) AS content FROM parts GROUP BY ALL)),
parents AS MATERIALIZED (SELECT doc_id || '/' || p AS parent_id, content AS parent_content
  FROM (SELECT doc_id, pos // 15 AS p, string_agg(part, '' ORDER BY pos) AS content FROM parts GROUP BY ALL)),
hashed AS (SELECT node_id, tenant_id, list_transform({tokens('content')}, lambda t: ('0x' || substr(md5(t), 1, 2))::INT % {DIM}) AS b FROM nodes),
vectors AS MATERIALIZED (SELECT node_id, tenant_id, list_transform(range({DIM}), lambda i: len(list_filter(b, lambda x: x = i))::DOUBLE) AS v FROM hashed),
counts AS MATERIALIZED (SELECT node_id, tenant_id, term, count(*) AS tf FROM (SELECT node_id, tenant_id, unnest({tokens('content')}) AS term FROM nodes) GROUP BY ALL)"""
QUESTIONS = "questions AS (SELECT item_id AS query_id, text AS question, 'src' || (item_id % 20) AS tenant_id FROM benchmark)"


def dense_sql(asked: str, p: str = "", tenant: bool = False) -> str:
    own = "e.tenant_id = q.tenant_id" if tenant else "true"
    return f"""{p}hq AS (SELECT query_id, tenant_id, list_transform({tokens('question')}, lambda t: ('0x' || substr(md5(t), 1, 2))::INT % {DIM}) AS b FROM {asked}),
{p}qv AS (SELECT query_id, tenant_id, list_transform(range({DIM}), lambda i: len(list_filter(b, lambda x: x = i))::DOUBLE) AS v FROM {p}hq),
{p}sims AS (SELECT q.query_id, e.node_id, list_dot_product(q.v, e.v) AS d, list_dot_product(q.v, q.v) * list_dot_product(e.v, e.v) AS n
  FROM {p}qv q JOIN vectors e ON {own}),
{p}dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, node_id) AS rank
  FROM (SELECT query_id, node_id, CASE WHEN n = 0 THEN 0.0 ELSE round(d / sqrt(n), 9) END AS similarity FROM {p}sims)) WHERE rank <= 40)"""


def sparse_sql(asked: str, p: str = "", tenant: bool = False, k: int = 40) -> str:
    own = "USING (term, tenant_id)" if tenant else "USING (term)"
    return f"""{p}terms AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n_terms
  FROM (SELECT DISTINCT query_id, tenant_id, unnest({tokens('question')}) AS term FROM {asked})),
{p}scored AS (SELECT query_id, node_id, round(sum(({TF_SCORE}) / n_terms), 9) AS score FROM {p}terms JOIN counts {own} GROUP BY ALL),
{p}sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM {p}scored)
  WHERE rank <= {k})"""


def fused_sql(asked: str, p: str = "", tenant: bool = False) -> str:
    return f"""{dense_sql(asked, p, tenant)}, {sparse_sql(asked, p, tenant)},
{p}fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST) AS rank
  FROM (SELECT query_id, node_id, d.rank AS dense_rank, s.rank AS sparse_rank, similarity,
        coalesce(1.0::double / (60 + d.rank), 0) + coalesce(1.0::double / (60 + s.rank), 0) AS score
        FROM {p}dense d FULL JOIN {p}sparse s USING (query_id, node_id)))"""


def expanded_sql(asked: str, p: str = "", tenant: bool = False) -> str:
    return f"""{fused_sql(asked, p, tenant)},
{p}cut AS (SELECT * FROM (SELECT f.*, max(similarity) OVER (PARTITION BY query_id) AS max_dense FROM {p}fused f) WHERE rank <= 40 AND max_dense IS NOT NULL),
{p}expanded AS (SELECT query_id, node_id, parent_id, doc_id, parent_content AS content, score, max_dense,
    row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id, parent_id ORDER BY rank) AS sibling
        FROM {p}cut JOIN nodes USING (node_id) JOIN parents USING (parent_id)) WHERE sibling = 1)"""


def reranked_sql(asked: str, floor: str, p: str = "") -> str:
    return f"""{p}cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS c FROM {p}expanded) WHERE c <= 20),
{p}pairs AS (SELECT query_id, node_id, doc_id, content, max_dense, c AS rank, list_distinct({tokens('question')}) AS q, {tokens('content')} AS k
  FROM {p}cand JOIN {asked} USING (query_id)),
{p}scored2 AS (SELECT *, len(list_intersect(q, k)) / greatest(1, len(q))::double AS s FROM {p}pairs),
{p}kept AS (SELECT *, max(s >= {floor}) OVER (PARTITION BY query_id) AS any_good FROM {p}scored2),
{p}reranked AS (SELECT query_id, node_id, doc_id, content, max_dense, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, rank) AS rank
  FROM {p}kept WHERE s >= {floor} OR NOT any_good),
{p}normed AS (SELECT query_id, node_id, doc_id, content, max_dense, rank, CASE WHEN hi > lo THEN (s - lo) / (hi - lo)
    ELSE round(1 / (1 + exp(-s)), 4) END AS score
  FROM (SELECT *, min(s) OVER w AS lo, max(s) OVER w AS hi FROM {p}reranked WHERE rank <= 5 WINDOW w AS (PARTITION BY query_id)))"""


BASE = f"{QUESTIONS}, {NODES}"
DENSE = f"{BASE}, {dense_sql('questions')}"
SPARSE = f"{BASE}, {sparse_sql('questions')}"
FUSED = f"{BASE}, {fused_sql('questions')}"
EXPANDED = f"{BASE}, {expanded_sql('questions')}"


# --- lexical ------------------------------------------------------------------------
@query("build_postings", f"""
WITH {BASE} SELECT term, node_id, tenant_id, count(*) AS tf, min(pos) AS first_position, max(pos) AS last_position
FROM (SELECT node_id, tenant_id, unnest(k) AS term, generate_subscripts(k, 1) - 1 AS pos
      FROM (SELECT node_id, tenant_id, {tokens('content')} AS k FROM nodes))
GROUP BY ALL
""")
def build_postings(t: Tables):
    """The index of every tenant, written as a segment and read back row by row."""
    path = work_folder(t.spark, "index")
    I.add_segment(corpus(t).nodes, path, tenant="tenant_id")
    return I.posting_rows(I.read_index(t.spark, path)).withColumnRenamed("tenant", "tenant_id")


@query("lexical_topk", f"WITH {SPARSE} SELECT query_id, node_id, round(score, 6) AS score, rank FROM sparse")
def lexical_topk(t: Tables):
    return sparse_list(t).withColumn("score", F.round("score", 6))


@query("lexical_bm25", f"""
WITH {SPARSE}, lengths AS (SELECT node_id, len({tokens('content')}) AS length FROM nodes),
c AS (SELECT count(*) AS n, avg(length) AS a FROM lengths),
df AS (SELECT term, count(*) AS df FROM counts GROUP BY 1),
okapi AS (SELECT query_id, node_id, round(sum(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.2::double
    / (tf + 1.2::double * (0.25::double + 0.75::double * length / a))), 9) AS score
  FROM terms JOIN df USING (term) JOIN counts USING (term) JOIN lengths USING (node_id), c GROUP BY ALL)
SELECT query_id, node_id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM okapi) WHERE rank <= 40
""")
def lexical_bm25(t: Tables):
    return I.search(corpus(t).postings, asked_texts(t), 40, "bm25").withColumn("score", F.round("score", 6))


@query("scope_filter", f"""
WITH {BASE}, {dense_sql('questions', tenant=True)}, {sparse_sql('questions', tenant=True, k=10)}
SELECT 'dense' AS side, query_id, node_id, round(similarity, 6) AS score, rank FROM dense WHERE rank <= 10
UNION ALL SELECT 'lexical', query_id, node_id, round(score, 6), rank FROM sparse
""")
def scope_filter(t: Tables):
    """Both searches restricted to the tenant of the question."""
    c, asked = corpus(t), of_tenants(questions(t))
    lexical = I.search(c.postings, of_tenants(asked_texts(t)), 10, tenant="tenant_id")
    own = asked.withColumn("tenant_id", F.array("tenant_id"))
    dense = N.vector_topk(own, c.vectors, 10, scope="tenant_id").withColumnRenamed("similarity", "score")
    both = [found.select(F.lit(side).alias("side"), "query_id", "node_id", F.round("score", 6).alias("score"), "rank") for side, found in (("dense", dense), ("lexical", lexical))]
    return both[0].unionByName(both[1])


# --- vectors --------------------------------------------------------------------------
@query("embed_batch", f"""
WITH h AS (SELECT doc_id, list_transform({tokens('text')}, lambda t: ('0x' || substr(md5(t), 1, 2))::INT % {DIM}) AS b FROM documents)
SELECT doc_id, {DIM} AS dim, list_transform(range({DIM}), lambda i: len(list_filter(b, lambda x: x = i)))::VARCHAR AS counts FROM h
""")
def embed_batch(t: Tables):
    made = M.embed(t.docs.select("doc_id", "text"), "text", bucket_counts)
    counts = F.transform("embedding", lambda x: x.cast("long").cast("string"))
    listed = F.concat(F.lit("["), F.array_join(counts, ", "), F.lit("]"))
    return made.select("doc_id", F.size("embedding").alias("dim"), listed.alias("counts"))


def letter_shares(texts):
    """Example batch function: shares of the vowels in a text."""
    return [[s.lower().count(c) / max(1, len(s)) for c in "aeiou"] for s in texts]


@query("embed_dedup", """
SELECT doc_id, round((length(l) - length(replace(l, 'e', ''))) / greatest(1, length(l))::double, 5) AS share_of_e
FROM (SELECT doc_id, lower(text) AS l FROM documents)
""")
def embed_dedup(t: Tables):
    made = M.embed_distinct(t.docs.select("doc_id", "text"), "text", letter_shares)
    return made.select("doc_id", F.round(F.get("embedding", F.lit(1)).cast("double"), 5).alias("share_of_e"))


@query("l2_normalize", """
SELECT vec_id, i AS dim, round(embedding[i + 1]::double / sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 6) AS value
FROM (SELECT *, unnest(range(0, len(embedding))) AS i FROM embeddings)
""")
def l2_normalize(t: Tables):
    unit = t.embeddings.select("vec_id", F.posexplode(V.unit(F.col("embedding"))).alias("dim", "value"))
    return unit.withColumn("value", F.round("value", 6))


@query("cosine_pair", """
SELECT a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
""")
def cosine_pair(t: Tables):
    following = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    joined = t.embeddings.join(following, "vec_id")
    return joined.select(
        "vec_id", F.round(V.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine")
    )


@query("vector_topk", f"WITH {TABLE_DENSE} SELECT query_id, node_id, round(similarity, 6) AS similarity, rank FROM dense")
def vector_topk(t: Tables):
    return N.vector_topk(table_questions(t), table_vectors(t), 40).withColumn("similarity", F.round("similarity", 6))


@query("vector_top1_in_docs", f"""
WITH {ASKED}, scopes AS (SELECT vec_id AS query_id, unnest([label, (label + 1) % 10, (label + 5) % 10]) AS label FROM embeddings)
SELECT query_id, arg_max(e.vec_id, ({COS}, -e.vec_id)) AS node_id, round(max({COS}), 6) AS similarity
FROM asked q JOIN scopes USING (query_id) JOIN embeddings e USING (label) GROUP BY 1
""")
def vector_top1_in_docs(t: Tables):
    label = F.col("label")
    docs = F.array(*[x.cast("string") for x in (label, (label + 1) % 10, (label + 5) % 10)])
    scopes = t.embeddings.select(F.col("vec_id").alias("query_id"), docs.alias("label"))
    asked = table_questions(t).join(scopes, "query_id")
    vectors = t.embeddings.select(F.col("vec_id").alias("node_id"), "embedding", "label")
    best = N.vector_topk(asked, vectors, 1, scope="label")
    return best.select("query_id", "node_id", F.round("similarity", 6).alias("similarity"))


@query("ann_clustered")
def ann_clustered(t: Tables):
    """Recall of the clustered search against the exact one, per question."""
    vectors, asked = table_vectors(t), table_questions(t)
    model = N.train_lists(vectors, 20)
    path = work_folder(t.spark, "vector-lists")
    N.write_lists(vectors, model, path)
    index = t.spark.read.parquet(path)
    found = N.ann_topk(asked, index, model, 10, probes=8)
    return N.recall_at_k(N.vector_topk(asked, vectors, 10), found)


@query("summary_topk", f"""
WITH {ASKED}, s AS (SELECT vec_id AS doc_id, source, embedding FROM embeddings JOIN documents ON doc_id = vec_id)
SELECT query_id, doc_id, round(similarity, 6) AS similarity, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) AS rank
  FROM (SELECT q.query_id, e.doc_id, {COS} AS similarity FROM asked q, s e)) WHERE rank <= 5
""")
def summary_topk(t: Tables):
    found = N.vector_topk(table_questions(t), summaries(t), 5, node="doc_id")
    return found.withColumn("similarity", F.round("similarity", 6))


def summaries(t: Tables):
    docs = t.documents.select("doc_id", F.col("source").alias("tenant_id"))
    return docs.join(t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")


# --- retrieval --------------------------------------------------------------------------
@query("coarse_k", """
SELECT item_id, n, CASE WHEN length(substr(text, 1, n)) < 15 THEN 50 ELSE 40 END AS coarse_k
FROM (SELECT *, unnest([10, 14, 15, 16, 400]) AS n FROM benchmark)
""")
def coarse_k(t: Tables):
    lengths = F.array(*[F.lit(n) for n in (10, 14, 15, 16, 400)])
    rows = t.benchmark.select("item_id", "text", F.explode(lengths).alias("n"))
    return rows.select("item_id", "n", R.coarse_k(F.substr("text", F.lit(1), F.col("n"))).alias("coarse_k"))


@query("rrf_fuse", f"""
WITH {FUSED} SELECT query_id, node_id, dense_rank, sparse_rank, round(score, 9) AS score, rank FROM fused
""")
def rrf_fuse(t: Tables):
    fused = R.rrf_fuse(dense_list(t), sparse_list(t))
    return fused.drop("similarity").withColumn("score", F.round("score", 9))


@query("max_dense", f"""
WITH {FUSED} SELECT query_id, node_id, round(m, 6) AS max_dense
FROM fused JOIN (SELECT query_id, max(similarity) AS m FROM dense GROUP BY 1) USING (query_id)
""")
def max_dense(t: Tables):
    fused = R.fuse_recall(dense_list(t), sparse_list(t))
    return fused.select("query_id", "node_id", F.round("max_dense", 6).alias("max_dense"))


@query("recall_fallbacks", f"""
WITH {FUSED},
r AS (SELECT f.query_id, f.node_id, dense_rank, sparse_rank, similarity, d.m AS m, f.rank,
      CASE WHEN query_id % 10 < 4 THEN 'dense' WHEN query_id % 10 = 9 THEN 'none' ELSE 'both' END AS mode
  FROM fused f JOIN (SELECT query_id, max(similarity) AS m FROM dense GROUP BY 1) d USING (query_id))
SELECT query_id, node_id, round(CASE WHEN mode = 'dense' THEN similarity ELSE
         coalesce(1.0::double / (60 + dense_rank), 0) + coalesce(1.0::double / (60 + sparse_rank), 0) END, 6) AS score,
       CASE WHEN mode = 'both' THEN round(m, 6) END AS max_dense,
       CASE WHEN mode = 'dense' THEN dense_rank ELSE rank END AS rank
FROM r WHERE mode = 'both' OR (mode = 'dense' AND dense_rank IS NOT NULL)
""")
def recall_fallbacks(t: Tables):
    """Some questions have no lexical list, others no dense list."""
    dense = dense_list(t).where("query_id % 10 <> 9")
    sparse = sparse_list(t).where("query_id % 10 >= 4")
    fused = R.fuse_recall(dense, sparse)
    return fused.select(
        "query_id",
        "node_id",
        F.round("score", 6).alias("score"),
        F.round("max_dense", 6).alias("max_dense"),
        "rank",
    )


@query("overlap_report", f"""
WITH {FUSED} SELECT query_id, count(*) FILTER (dense_rank IS NOT NULL AND sparse_rank IS NOT NULL) AS "both",
  count(*) FILTER (sparse_rank IS NULL) AS dense_only, count(*) FILTER (dense_rank IS NULL) AS sparse_only
FROM fused GROUP BY 1
""")
def overlap_report(t: Tables):
    return R.overlap_report(dense_list(t), sparse_list(t))


def cut_fused(t: Tables):
    return P.recall(corpus(t), questions(t))


@query("expand_parents", f"""
WITH {EXPANDED} SELECT query_id, node_id, doc_id, md5(content) AS content_md5, true AS expanded, round(score, 6) AS score, rank FROM expanded
""")
def expand_parents(t: Tables):
    c = corpus(t)
    rows = P.expand(cut_fused(t), c)
    return rows.select(
        "query_id", "node_id", "doc_id", F.md5("content").alias("content_md5"), "expanded", F.round("score", 6).alias("score"), "rank"
    )


@query("retrieve_fast", f"""
WITH {EXPANDED} SELECT query_id, node_id, parent_id, round(score, 6) AS score, round(max_dense, 6) AS max_dense, rank
FROM expanded WHERE rank <= 5
""")
def retrieve_fast(t: Tables):
    rows = P.retrieve_fast(cut_fused(t), corpus(t))
    return rows.select(
        "query_id", "node_id", "parent_id", F.round("score", 6).alias("score"), F.round("max_dense", 6).alias("max_dense"), "rank"
    )


@query("rerank_candidates", f"""
WITH {EXPANDED} SELECT query_id, node_id, new AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS new FROM expanded) WHERE new <= 20
""")
def rerank_candidates(t: Tables):
    c = corpus(t)
    expanded = P.expand(cut_fused(t), c)
    return R.rerank_candidates(expanded).select("query_id", "node_id", "rank")


def reranked(floor: str) -> str:
    return f"{EXPANDED}, {reranked_sql('questions', floor)}"


@query("rerank", f"WITH {reranked('0.5')} SELECT query_id, node_id, round(s, 6) AS rerank_score, rank FROM reranked WHERE rank <= 5")
def rerank(t: Tables):
    """Scores from a Python scorer; a floor that drops all rows of some questions."""
    c = corpus(t)
    expanded = P.expand(cut_fused(t), c)
    pairs = R.rerank_candidates(expanded).join(questions(t).select("query_id", "question"), "query_id")
    overlap = R.token_overlap(F.col("question"), F.col("content"))
    ranked = R.apply_rerank(pairs.withColumn("rerank_score", overlap), 5, 0.5)
    return ranked.select("query_id", "node_id", F.round("rerank_score", 6).alias("rerank_score"), "rank")


@query("score_normalize", f"""
WITH {SPARSE} SELECT query_id, node_id, round(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE round(1 / (1 + exp(-score)), 4) END, 5) AS score
FROM (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM sparse WINDOW w AS (PARTITION BY query_id))
""")
def score_normalize(t: Tables):
    out = R.normalize_scores(sparse_list(t), "score")
    return out.select("query_id", "node_id", F.round("score", 5).alias("score"))


@query("retrieve_deep", f"""
WITH {reranked('0')} SELECT query_id, node_id, round(score, 6) AS score, rank FROM normed
""")
def retrieve_deep(t: Tables):
    rows = P.retrieve_deep(cut_fused(t), questions(t), corpus(t))
    return rows.select("query_id", "node_id", F.round("score", 6).alias("score"), "rank")


@query("two_level_scope", f"""
WITH asked AS (SELECT item_id AS query_id, 'src' || label AS tenant_id, embedding FROM benchmark JOIN embeddings ON vec_id = item_id),
large AS (SELECT source AS tenant_id FROM documents GROUP BY 1 HAVING count(*) >= 50),
s AS (SELECT vec_id AS doc_id, source AS tenant_id, embedding FROM embeddings JOIN documents ON doc_id = vec_id)
SELECT query_id, doc_id, round(similarity, 6) AS similarity, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) AS rank
  FROM (SELECT q.query_id, e.doc_id, {COS} AS similarity FROM asked q JOIN s e USING (tenant_id) JOIN large USING (tenant_id)))
WHERE rank <= 5
""")
def two_level_scope(t: Tables):
    tenant = t.embeddings.select(
        F.col("vec_id").alias("query_id"), F.concat(F.lit("src"), F.col("label").cast("string")).alias("tenant_id")
    )
    asked = table_questions(t).join(tenant, "query_id")
    docs = t.documents.select("doc_id", F.col("source").alias("tenant_id"))
    found = P.two_level_scope(asked, summaries(t), docs, min_docs=50)
    return found.withColumn("similarity", F.round("similarity", 6))


@query("stage_gate", f"""
WITH {reranked('0')},
tops AS (SELECT query_id, max(max_dense) AS top FROM expanded WHERE rank <= 5 GROUP BY 1),
gated AS (SELECT query_id, top, top <= {K.STAGE1_THRESHOLD} AS deep FROM tops)
SELECT query_id, node_id, deep, rank FROM gated JOIN normed USING (query_id) WHERE deep
UNION ALL SELECT query_id, node_id, deep, rank FROM gated JOIN (SELECT query_id, node_id, rank FROM expanded WHERE rank <= 5) USING (query_id) WHERE NOT deep
""")
def stage_gate(t: Tables):
    """The deep branch sees the question itself as its expanded text here."""
    c, asked = corpus(t), questions(t)
    fused = cut_fused(t)
    fast = P.retrieve_fast(fused, c)
    gated = R.gate(R.top_score(fast), asked.select("query_id", F.col("question").alias("expanded_text")))
    weak = gated.where("deep").select("query_id")
    deep = P.retrieve_deep(fused.join(weak, "query_id", "left_semi"), asked, c)
    rows = fast.join(weak, "query_id", "left_anti").select("query_id", "node_id", "rank")
    both = rows.unionByName(deep.select("query_id", "node_id", "rank"))
    return both.join(gated.select("query_id", "deep"), "query_id")


def picky_model(prompts):
    """Example model that refuses texts starting with an accented letter."""
    if any(p[:1] > "z" for p in prompts):
        raise ValueError("refused")
    return [(p[:40], len(p) * 2 // 5, 10) for p in prompts]


@query("model_stage", """
SELECT conv_id, turn, CASE WHEN substr(text, 1, 1) <= 'z' THEN substr(text, 1, 40) END AS model_text,
  CASE WHEN substr(text, 1, 1) <= 'z' THEN length(text) * 2 // 5 ELSE 0 END AS prompt_tokens,
  CASE WHEN substr(text, 1, 1) > 'z' THEN 'refused' END AS model_error
FROM conversations
""")
def model_stage(t: Tables):
    out = M.model_stage(t.conversations, "text", picky_model, batch=1)
    return out.select("conv_id", "turn", "model_text", "prompt_tokens", "model_error")


@query("followup_context", """
SELECT conv_id, string_agg(CASE role WHEN 'user' THEN '用户' ELSE 'AI' END || ': ' || substr(text, 1, 200), chr(10) ORDER BY turn) AS history
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n, count(*) OVER (PARTITION BY conv_id) AS c FROM conversations)
WHERE n <= 6 AND c > 1 GROUP BY 1
""")
def followup_context(t: Tables):
    from passagework.operators.chatlog import followup_context

    return followup_context(t.conversations)


@query("rewrite_accept", f"""
SELECT item_id, CASE WHEN length({strip('r')}) > 2 AND {strip('r')} <> text THEN {strip('r')} ELSE text END AS question
FROM (SELECT item_id, text, CASE WHEN length(text) % 3 = 0 THEN ' ' || text || ' ' ELSE substr(text, 2, length(text) % 7) END AS r FROM benchmark)
""")
def rewrite_accept(t: Tables):
    size = F.length("text")
    rewritten = F.when(size % 3 == 0, F.concat(F.lit(" "), "text", F.lit(" "))).otherwise(
        F.substr("text", F.lit(2), size % 7)
    )
    return t.benchmark.select("item_id", R.rewrite_accepted(F.col("text"), rewritten).alias("question"))


@query("confidence_label", """
SELECT event_id, CASE WHEN deep THEN CASE WHEN s >= 0.7 THEN 'high' WHEN s >= 0.5 THEN 'medium' ELSE 'low' END
  ELSE CASE WHEN s >= 0.7 THEN 'high' ELSE 'medium' END END AS confidence,
  deep AND s < 0.15 AS dropped
FROM (SELECT event_id, value % 1 AS s, event_type IN ('view', 'click') AS deep FROM events)
""")
def confidence_label(t: Tables):
    deep = F.col("event_type").isin("view", "click")
    rows = t.events.select("event_id", (F.col("value") % 1).alias("s"), deep.alias("deep"))
    rows = rows.withColumn("confidence", R.confidence(F.col("s"), F.col("deep")))
    return rows.select(
        "event_id", "confidence", R.drops_results(F.col("confidence"), F.col("s")).alias("dropped")
    )


CONTEXT = """string_agg('[' || rank || '] (doc-' || doc_id || ')' || chr(10) || content, chr(10) || chr(10) ORDER BY rank) AS context"""


@query("context_assemble", f"""
WITH {EXPANDED} SELECT query_id, md5(context) AS context_md5, sources, first_score, first_snippet FROM (
  SELECT query_id, {CONTEXT}, count(*) AS sources, round(arg_min(score, rank), 4) AS first_score,
         substr(arg_min(content, rank), 1, 300) AS first_snippet
  FROM expanded WHERE rank <= 5 GROUP BY 1)
""")
def context_assemble(t: Tables):
    built = R.assemble_context(P.retrieve_fast(cut_fused(t), corpus(t)))
    return built.select(
        "query_id",
        F.md5("context").alias("context_md5"),
        F.size("sources").cast("long").alias("sources"),
        F.get("sources.score", F.lit(0)).alias("first_score"),
        F.get("sources.snippet", F.lit(0)).alias("first_snippet"),
    )


@query("clear_sources_on_no_answer", """
SELECT doc_id, CASE WHEN contains(a, '知识库中没有') OR contains(a, '请先上传相关文档') THEN 0 ELSE 2 END AS sources
FROM (SELECT doc_id, CASE lang WHEN 'de' THEN '知识库中没有' WHEN 'fr' THEN '请先上传相关文档。' ELSE '' END || text AS a FROM documents)
""")
def clear_sources_on_no_answer(t: Tables):
    mark = F.when(F.col("lang") == "de", "知识库中没有").when(F.col("lang") == "fr", "请先上传相关文档。").otherwise("")
    sources = F.array(F.col("source"), F.col("lang"))
    kept = R.clear_sources(F.concat(mark, "text"), sources)
    return t.docs.select("doc_id", F.size(kept).alias("sources"))


@query("query_key_dedup", """
WITH k AS (SELECT doc_id, 'rag:' || source || ':' || md5(text) || ':5:' ||
    array_to_string(list_sort([lang, source]), ',') AS question_key FROM documents)
SELECT doc_id, question_key, min(doc_id) OVER (PARTITION BY question_key) AS answered_by FROM k
""")
def query_key_dedup(t: Tables):
    key = R.question_key(F.col("source"), F.col("text"), F.lit(5), F.array("lang", "source"))
    asked = t.docs.select("doc_id", key.alias("question_key"))
    return R.once_per_key(
        asked, lambda d: d.select("question_key", F.col("doc_id").alias("answered_by"))
    ).select("doc_id", "question_key", "answered_by")


# --- whole plans: passages, context and confidence for every question --------------------------
@query("answer_context", f"""
WITH {SPARSE},
firsts AS (SELECT *, row_number() OVER (PARTITION BY query_id, parent_id ORDER BY rank) AS sibling FROM sparse JOIN nodes USING (node_id)),
top AS (SELECT query_id, doc_id, parent_content AS content, score, row_number() OVER (PARTITION BY query_id ORDER BY f.rank) AS rank
  FROM firsts f JOIN parents USING (parent_id) WHERE sibling = 1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY f.rank) <= 5)
SELECT query_id, {CONTEXT}, count(*) AS passages, round(max(score), 4) AS best_score FROM top GROUP BY query_id
""")
def answer_context(t: Tables):
    """Top passages by words for each benchmark question, widened to their parent windows."""
    c = corpus(t)
    found = sparse_list(t)
    top = R.first_rows(P.expand(found, c), K.FINE_K)
    return R.assemble_context(top).select(
        "query_id",
        "context",
        F.size("sources").cast("long").alias("passages"),
        F.array_max(F.transform("sources", lambda s: s["score"])).alias("best_score"),
    )


WIDER = """wider AS (SELECT a.query_id, a.tenant_id, a.question || ' ' || b.question AS question FROM questions a JOIN questions b ON b.query_id = a.query_id + 1)"""


@query("answer_questions", f"""
WITH {BASE}, {expanded_sql('questions', 'f_', True)}, {WIDER},
tops AS (SELECT query_id, max(max_dense) AS top FROM f_expanded WHERE rank <= 5 GROUP BY 1),
gated AS (SELECT t.query_id, top, top <= {K.STAGE1_THRESHOLD} AND w.question IS NOT NULL AS deep FROM tops t LEFT JOIN wider w USING (query_id)),
weak AS MATERIALIZED (SELECT w.* FROM wider w JOIN gated USING (query_id) WHERE deep),
{expanded_sql('weak', 'd_', True)}, {reranked_sql('weak', '0', 'd_')},
results AS (SELECT query_id, doc_id, content, rank FROM d_normed
  UNION ALL SELECT query_id, doc_id, content, rank FROM f_expanded WHERE rank <= 5 AND query_id NOT IN (SELECT query_id FROM weak)),
labelled AS (SELECT query_id, top, deep, CASE WHEN deep THEN CASE WHEN top >= 0.7 THEN 'high' WHEN top >= 0.5 THEN 'medium' ELSE 'low' END
  ELSE CASE WHEN top >= 0.7 THEN 'high' ELSE 'medium' END END AS confidence FROM gated),
contexts AS (SELECT query_id, {CONTEXT}, count(*) AS n FROM results JOIN labelled USING (query_id) WHERE NOT (confidence = 'low' AND top < 0.15) GROUP BY 1)
SELECT query_id, round(top, 6) AS top_score, deep, CASE WHEN deep AND n IS NULL THEN 'low' ELSE confidence END AS confidence,
  md5(coalesce(context, '')) AS context_md5, coalesce(n, 0) AS sources
FROM questions LEFT JOIN labelled USING (query_id) LEFT JOIN contexts USING (query_id)
""")
def answer_questions(t: Tables):
    """The whole plan per tenant: recall, fusion, expansion, gate, deep search, confidence, context.

    The expanded text of a question is the question and the next one.
    """
    asked = of_tenants(questions(t))
    following = asked.select((F.col("query_id") - 1).alias("query_id"), F.col("question").alias("_next"))
    wider = asked.select("query_id", "tenant_id", "question").join(following, "query_id")
    wider = wider.select("query_id", "tenant_id", F.concat_ws(" ", "question", "_next").alias("expanded_text"))
    answers = P.answer_questions(asked, corpus(t), M.embed(wider, "expanded_text", bucket_counts))
    return answers.select(
        "query_id",
        F.round("top_score", 6).alias("top_score"),
        "deep",
        "confidence",
        F.md5("context").alias("context_md5"),
        F.coalesce(F.size("sources"), F.lit(0)).cast("long").alias("sources"),
    )

"""Registered queries: answer quality."""

import re

from pyspark.sql import functions as F

from passagework import constants as K
from passagework.functions import text as X
from passagework.functions import vectors as V
from passagework.operators import fusion
from passagework.operators import lexical_index as I
from passagework.operators import models as M
from passagework.operators import quality as Q
from passagework.operators import rule_index as RI
from passagework.operators import rules as R
from passagework.plans import retrieval as P
from passagework.plans.catalog import Tables, query
from passagework.plans.q_retrieval import CONTEXT, DIM, NODES, bucket_counts, corpus, sparse_sql
from passagework.plans.sqltext import WS, long_tokens, non_blank, phrases, tokens, values
from passagework.session import materialize

# --- shared inputs -----------------------------------------------------------------
# Items are assistant turns; the question is the turn before. An answer's sources are the passages
# that retrieval finds for its question; similarities come from the bucket vectors.


def items(t: Tables):
    asked = t.conversations.where("role = 'user'").select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question")
    )
    answers = t.conversations.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer"))
    joined = answers.join(asked, ["conv_id", "turn"])
    return joined.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("item_id"),
        "question",
        "answer",
    )


ITEMS = """items AS (SELECT a.conv_id || '-' || a.turn AS item_id, q.text AS question, a.text AS answer
  FROM conversations a JOIN conversations q ON q.conv_id = a.conv_id AND q.turn = a.turn - 1
  WHERE a.role = 'assistant' AND q.role = 'user')"""
CLAIM_LIST = f"list_filter({non_blank(r'''string_split(answer, chr(10))''')}, lambda c: length(c) >= 4)"
CLAIMS = f"""{ITEMS}, claims AS (SELECT item_id, question, generate_subscripts(c, 1) - 1 AS position, unnest(c) AS claim
  FROM (SELECT item_id, question, {CLAIM_LIST} AS c FROM items))"""


def bucket_sql(source: str, keys: str, text: str, p: str) -> str:
    """CTE ``{p}v``: keys and the bucket vector ``v`` of a text."""
    return f"""{p}h AS (SELECT {keys}, list_transform({tokens(text)}, lambda t: ('0x' || substr(md5(t), 1, 2))::INT % {DIM}) AS b FROM {source}),
{p}v AS MATERIALIZED (SELECT {keys}, list_transform(range({DIM}), lambda i: len(list_filter(b, lambda x: x = i))::DOUBLE) AS v FROM {p}h)"""


def cosine_sql(a: str, b: str) -> str:
    size = f"(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"
    return f"CASE WHEN {size} > 0 THEN round(list_dot_product({a}, {b}) / {size}, 9) ELSE 0.0 END"


def answered(t: Tables):
    """Items with the passages that their question finds: ``context``, ``sources`` and ``doc_ids``."""
    c, rows = corpus(t), items(t)
    found = I.search(c.postings, rows.select(F.col("item_id").alias("query_id"), "question"), K.COARSE_K)
    top = fusion.first_rows(P.expand(found, c), K.FINE_K)
    context = fusion.assemble_context(top).withColumnRenamed("query_id", "item_id")
    none = F.array().cast(context.schema["sources"].dataType)
    joined = rows.join(context, "item_id", "left").withColumn("sources", F.coalesce("sources", none))
    joined = joined.withColumn("context", F.coalesce("context", F.lit("")))
    return materialize(joined.withColumn("doc_ids", F.array_distinct(F.transform("sources", lambda s: s["doc_id"]))), "answered")


PASSAGES = f"""iq AS (SELECT item_id AS query_id, '' AS tenant_id, question FROM items), {sparse_sql('iq', 'i_')},
passages AS MATERIALIZED (SELECT query_id AS item_id, doc_id, parent_content AS content, row_number() OVER (PARTITION BY query_id ORDER BY f.rank) AS rank
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id, parent_id ORDER BY rank) AS sibling FROM i_sparse JOIN nodes USING (node_id)) f
  JOIN parents USING (parent_id) WHERE sibling = 1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY f.rank) <= 5),
sources AS (SELECT DISTINCT item_id, doc_id FROM passages)"""
FOUND = f"""{CLAIMS}, {NODES}, {PASSAGES}, {bucket_sql('claims', 'item_id, position', 'claim', 'c')},
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id, position ORDER BY similarity DESC, node_id) AS r
  FROM (SELECT item_id, position, node_id, parent_id, {cosine_sql('cv.v', 'vectors.v')} AS similarity
        FROM cv JOIN sources USING (item_id) JOIN nodes USING (doc_id) JOIN vectors USING (node_id))) WHERE r = 1),
found AS (SELECT item_id, position, claim, coalesce(similarity, 0.0) AS similarity, parent_content AS parent_text
  FROM claims LEFT JOIN best USING (item_id, position) LEFT JOIN parents USING (parent_id))"""


def claim_table(t: Tables, rows=None):
    """Claims with their similarity to the answer's sources and the text around the nearest node."""
    c = corpus(t)
    rows = Q.claim_rows(answered(t) if rows is None else rows, Q.claims(F.col("answer")), ["item_id", "doc_ids"])
    rows = materialize(M.embed(rows, "claim", bucket_counts), "claims")
    nodes = c.nodes.select("node_id", "doc_id", "parent_id").join(c.vectors.select("node_id", "embedding"), "node_id")
    found = Q.nearest_source(rows, nodes)
    texts = c.parents.select("parent_id", F.col("content").alias("parent_text"))
    return found.join(texts, "parent_id", "left").select("item_id", "position", "claim", "similarity", "parent_text")


def pair_similarity(rows, a: str, b: str):
    """``rows`` with the cosine of the bucket vectors of two texts."""
    both = M.embed(M.embed(rows, a, bucket_counts, out="_a"), b, bucket_counts, out="_b")
    return both.withColumn("similarity", F.round(V.cosine(F.col("_a"), F.col("_b")), 9)).drop("_a", "_b")


# --- retrieval ------------------------------------------------------------------------
SCORES = "scores AS (SELECT user_id AS query_id, floor(value * 64) % 64 / 64.0::double AS score FROM events)"


def scores(t: Tables):
    return t.events.select(F.col("user_id").alias("query_id"), (F.floor(F.col("value") * 64) % 64 / 64).alias("score"))


@query("retrieval_stats", f"""
WITH {SCORES}, s AS (SELECT query_id, avg(score) AS a, max(score) AS hi, min(score) AS lo,
  avg(CASE WHEN score > 0.3 THEN 1.0 ELSE 0.0 END) AS pass_rate, count(*) AS results FROM scores GROUP BY 1)
SELECT c_custkey AS query_id, coalesce(a >= 0.1, false) AS passed, coalesce(round(a, 4), 0) AS score,
  coalesce(a >= 0.1 AND a < 0.5, false) AS borderline, hi - lo AS dispersion, round(pass_rate::double, 6) AS pass_rate,
  coalesce(results, 0) AS results
FROM customer LEFT JOIN s ON query_id = c_custkey
""")
def retrieval_stats(t: Tables):
    queries = t.customer.select(F.col("c_custkey").alias("query_id"))
    out = Q.retrieval_stats(queries, scores(t))
    return out.select(
        "query_id", "passed", "score", "borderline", "dispersion", F.round("pass_rate", 6).alias("pass_rate"), "results"
    )


SOURCES = ["value", "value / 3", "null", "event_type"]


def source_array():
    fields = [F.expr(e).cast("string") for e in SOURCES]
    return F.array(*[F.struct(x.alias("score")) for x in fields])


@query("skip_generation", """
SELECT event_id, greatest(value % 1, value / 400) < 0.65 AS skip FROM events
""")
def skip_generation(t: Tables):
    found = F.array(F.col("value") % 1, F.col("value") / 400)
    return t.events.select("event_id", Q.skip_generation(found).alias("skip"))


@query("extract_scores", """
SELECT event_id, 2 AS scores, round(value / 3, 6) AS last_score FROM events
""")
def extract_scores(t: Tables):
    found = t.events.select("event_id", Q.extract_scores(source_array()).alias("s"))
    return found.select(
        "event_id", F.size("s").alias("scores"), F.round(F.element_at("s", -1), 6).alias("last_score")
    )


@query("source_doc_ids", """
SELECT DISTINCT event_id, doc_id FROM (
  SELECT event_id, unnest([CASE WHEN user_id % 3 > 0 THEN 'd' || user_id ELSE event_type END,
         CASE WHEN event_type = 'view' THEN 'd' || user_id END, event_type]) AS doc_id FROM events)
WHERE doc_id IS NOT NULL
""")
def source_doc_ids(t: Tables):
    user = F.concat(F.lit("d"), F.col("user_id").cast("string"))
    none = F.lit(None).cast("string")
    pairs = [
        (F.when(F.col("user_id") % 3 > 0, user), F.col("event_type")),
        (F.when(F.col("event_type") == "view", user).otherwise(""), none),
        (none, F.col("event_type")),
    ]
    sources = F.array(*[F.struct(a.alias("doc_id"), b.alias("source")) for a, b in pairs])
    return t.events.select("event_id", F.explode(Q.source_doc_ids(sources)).alias("doc_id"))


# --- claims ------------------------------------------------------------------------------
MARKED = "replace(regexp_replace(answer, ' of ', '[来源:12]。', 'g'), ' and ', '；')"


@query("extract_claims", f"""
WITH {ITEMS}
SELECT item_id, generate_subscripts(c, 1) - 1 AS position, unnest(c) AS claim FROM (
  SELECT item_id, list_filter({non_blank("string_split_regex(regexp_replace(x, '[[]来源:[0-9]+[]]', '', 'g'), '[。；" + chr(92) + "n]')")},
    lambda s: length(s) >= 4 AND NOT ({phrases('s', K.TEMPLATE_SENTENCES)})) AS c
  FROM (SELECT item_id, {MARKED} || '。感谢提问' AS x FROM items))
""")
def extract_claims(t: Tables):
    marked = F.replace(
        F.regexp_replace("answer", " of ", "[来源:12]。"), F.lit(" and "), F.lit("；")
    )
    rows = items(t).withColumn("answer", F.concat(marked, F.lit("。感谢提问")))
    return Q.claim_rows(rows, Q.claims(F.col("answer")), ["item_id"])


@query("fallback_claims", f"""
WITH {ITEMS}
SELECT item_id, generate_subscripts(c, 1) - 1 AS position, unnest(c) AS claim FROM (
  SELECT item_id, list_filter({non_blank("string_split_regex(replace(answer, ',', ';'), '[。！？" + chr(92) + "n;；]')")},
    lambda s: length(s) > 3) AS c FROM items)
""")
def fallback_claims(t: Tables):
    rows = items(t).withColumn("answer", F.replace("answer", F.lit(","), F.lit(";")))
    return Q.claim_rows(rows, Q.fallback_claims(F.col("answer")), ["item_id"])


STATUS = "CASE WHEN {0} >= 0.75 THEN 'supported' WHEN {0} >= 0.5 THEN 'partial' ELSE 'hallucination' END"


@query("claim_support", f"""
WITH {FOUND}
SELECT item_id, position, similarity, {STATUS.format('similarity')} AS status FROM found
""")
def claim_support(t: Tables):
    rows = claim_table(t).withColumn("status", Q.claim_status(F.col("similarity")))
    return rows.select("item_id", "position", "similarity", "status")



def words(expr: str) -> str:
    return f"list_distinct(list_filter(string_split_regex({expr}, '{WS}+'), lambda s: s <> ''))"


CHECKED = f"""{FOUND}, checked AS (SELECT item_id, position,
    CASE WHEN ok THEN greatest(similarity, 0.75::double) ELSE similarity END AS similarity,
    CASE WHEN ok THEN 'supported' ELSE status END AS status
  FROM (SELECT *, coalesce(status <> 'supported' AND
          len(list_intersect(w, p)) / greatest(1, len(w))::double > 0.3, false) AS ok
        FROM (SELECT *, {STATUS.format('similarity')} AS status, {words('claim')} AS w, {words('parent_text')} AS p FROM found)))"""


@query("claim_parent_recheck", f"WITH {CHECKED} SELECT item_id, position, similarity, status FROM checked")
def claim_parent_recheck(t: Tables):
    rows = Q.parent_recheck(claim_table(t))
    return rows.select("item_id", "position", "similarity", "status")


@query("vector_factuality", f"""
WITH {CHECKED}, r AS (SELECT item_id, count(*) AS n, count(*) FILTER (status = 'hallucination') AS bad,
    count(*) FILTER (status = 'partial') AS weak, avg(similarity) AS mean FROM checked GROUP BY 1),
j AS (SELECT i.item_id, i.item_id IN (SELECT item_id FROM sources) AS has_sources, length(question) % 7 = 0 AS unknown, r.* EXCLUDE item_id
  FROM items i LEFT JOIN r USING (item_id))
SELECT item_id, 'factuality' AS dimension,
  unknown OR NOT has_sources OR n IS NULL OR NOT (bad / n::double > 0.3 OR weak / n::double > 0.5) AS passed,
  CASE WHEN unknown THEN 1.0 WHEN NOT has_sources THEN 0.0 WHEN n IS NULL THEN 1.0
       WHEN bad / n::double > 0.3 OR weak / n::double > 0.5 THEN 0.0 ELSE round(mean, 4) END::double AS score
FROM j
""")
def vector_factuality(t: Tables):
    unknown, whole = F.length("question") % 7 == 0, answered(t)
    rows = whole.select(
        "item_id",
        F.when(unknown, F.lit("我不知道")).otherwise(F.col("answer")).alias("answer"),
        (F.size("doc_ids") > 0).alias("has_sources"),
    )
    return Q.vector_factuality(rows, Q.parent_recheck(claim_table(t, whole)))


# The reference text of an answer: the context that was assembled for its question.
CONTEXTED = f"""{NODES}, {PASSAGES}, contexts AS (SELECT item_id, {CONTEXT} FROM passages GROUP BY 1),
ctx AS MATERIALIZED (SELECT item_id, question, answer, coalesce(context, '') AS context FROM items LEFT JOIN contexts USING (item_id))"""


FALLBACK = f"""list_filter({non_blank("string_split_regex(answer, '[。！？" + chr(92) + "n;；]')")}, lambda s: length(s) > 3)"""
SUPPORTED = f"""{ITEMS}, {CONTEXTED},
fc AS (SELECT item_id, context, generate_subscripts(c, 1) - 1 AS position, unnest(c) AS claim
  FROM (SELECT item_id, context, {FALLBACK} AS c FROM ctx)),
sup AS (SELECT item_id, position, len(k) = 0 OR len(list_intersect(k, r)) >= greatest(1, len(k) * 0.3::double)
    OR len(list_filter(w, lambda s: length(s) > 2 AND contains(context, s))) > 0 AS supported
  FROM (SELECT *, {long_tokens('claim')} AS k, {long_tokens('context')} AS r, {words('claim')} AS w FROM fc))"""


@query("claim_token_support", f"WITH {SUPPORTED} SELECT item_id, position, supported FROM sup")
def claim_token_support(t: Tables):
    return Q.support_of_answers(answered(t)).select("item_id", "position", "supported")


@query("faithfulness", f"""
WITH {SUPPORTED}, {bucket_sql('ctx', 'item_id', 'answer', 'a')}, {bucket_sql('ctx', 'item_id', 'context', 'x')},
near AS (SELECT item_id, {cosine_sql('av.v', 'xv.v')} AS sim FROM av JOIN xv USING (item_id)),
s AS (SELECT item_id, avg(CASE WHEN supported THEN 1.0 ELSE 0.0 END::double) AS share FROM sup GROUP BY 1),
j AS (SELECT ctx.*, share, length(question) % 6 = 0 AS refusal, length(question) % 4 = 0 AS known,
      CASE WHEN length(question) % 5 = 0 THEN '' ELSE context END AS c2, sim FROM ctx JOIN near USING (item_id) LEFT JOIN s USING (item_id))
SELECT item_id, 'factuality' AS dimension,
  CASE WHEN c2 = '' THEN true WHEN refusal THEN NOT known WHEN share IS NOT NULL THEN share >= 0.5 ELSE sim >= 0.4 END AS passed,
  CASE WHEN c2 = '' THEN 0.5 WHEN refusal THEN CASE WHEN known THEN 0.0 ELSE 1.0 END ELSE round(coalesce(share, sim), 4) END::double AS score
FROM j
""")
def faithfulness(t: Tables):
    size = F.length("question")
    rows = answered(t)
    judged = pair_similarity(rows, "answer", "context").select(
        "item_id",
        "answer",
        F.when(size % 5 == 0, "").otherwise(F.col("context")).alias("context"),
        (size % 6 == 0).alias("is_refusal"),
        (size % 4 == 0).alias("context_has_answer"),
        "similarity",
    )
    return Q.faithfulness(judged, Q.support_of_answers(rows))


COVERAGE = """CASE WHEN len(w) = 0 THEN 1.0::double ELSE len(list_intersect(w, a)) / len(w)::double END"""


@query("term_coverage", f"""
WITH {ITEMS} SELECT item_id, round({COVERAGE}, 6) AS coverage
FROM (SELECT item_id, {long_tokens("(question || ' 检索模型AI系统')", fold=False)} AS w, {tokens("(answer || ' 索模 AI')", fold=False)} AS a FROM items)
""")
def term_coverage(t: Tables):
    asked, answer = F.concat("question", F.lit(" 检索模型AI系统")), F.concat("answer", F.lit(" 索模 AI"))
    return items(t).select("item_id", F.round(Q.term_coverage(asked, answer), 6).alias("coverage"))


RELEVANT = f"""{bucket_sql('items', 'item_id', 'question', 'q')}, {bucket_sql('items', 'item_id', 'answer', 'a')},
near AS (SELECT item_id, {cosine_sql('qv.v', 'av.v')} AS sim FROM qv JOIN av USING (item_id)),
relevant AS (SELECT item_id, round(sim * 0.5::double + {COVERAGE} * 0.3::double + least(1, length(answer) / 20.0::double) * 0.2::double, 4) AS score
  FROM (SELECT items.*, sim, {long_tokens('question', fold=False)} AS w, {tokens('answer', fold=False)} AS a FROM items JOIN near USING (item_id)))"""


@query("answer_relevancy", f"WITH {ITEMS}, {RELEVANT} SELECT item_id, score >= 0.4 AS passed, score FROM relevant")
def answer_relevancy(t: Tables):
    rows = pair_similarity(items(t), "question", "answer")
    verdict = Q.answer_relevancy(F.col("question"), F.col("answer"), F.col("similarity"))
    return rows.select("item_id", verdict.alias("v")).select("item_id", "v.*")


@query("answer_correctness", f"""
WITH {ITEMS}, e AS (SELECT vec_id, list_cosine_similarity(embedding::double[], list_reverse(embedding)::double[]) AS sim FROM embeddings)
SELECT item_id, CASE WHEN no_truth THEN true WHEN failed THEN sim >= 0.4 ELSE length(answer) % 2 = 0 END AS passed,
  round(CASE WHEN no_truth THEN 0.5 WHEN failed THEN round(sim, 4) ELSE length(answer) % 64 / 64.0 END::double, 4) AS score
FROM (SELECT *, length(question) % 5 = 0 AS no_truth, length(question) % 3 = 0 AS failed,
      split_part(item_id, '-', 1)::bigint AS vec_id FROM items) JOIN e USING (vec_id)
""")
def answer_correctness(t: Tables):
    vec = t.embeddings.select(
        "vec_id", V.cosine(F.col("embedding"), F.reverse("embedding")).alias("similarity")
    )
    rows = items(t).withColumn("vec_id", F.split("item_id", "-")[0].cast("long")).join(vec, "vec_id")
    size, length = F.length("question"), F.length("answer")
    truth = F.when(size % 5 != 0, F.col("question"))
    verdict = Q.answer_correctness(
        F.col("answer"), truth, size % 3 == 0, length % 2 == 0, length % 64 / 64, F.col("similarity")
    )
    return rows.select("item_id", verdict.alias("v")).select(
        "item_id", "v.passed", F.round("v.score", 4).alias("score")
    )


# --- judge replies --------------------------------------------------------------------------
def judge_replies(t: Tables):
    """Replies in the shapes models produce, built from the conversation turns."""
    body = F.format_string(
        '{"passed": %s, "score": %s, "reasoning": "%s", "severity": "s%d"%s}',
        F.when(F.col("turn") % 2 == 0, "true").otherwise("false"),
        F.when(F.col("turn") % 3 == 0, "0.25").otherwise("1"),
        F.md5("text"),
        F.col("turn"),
        F.when(F.col("role") == "assistant", ", ").otherwise(""),
    )
    size = F.length("text") % 6
    raw = (
        F.when(size == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(size == 1, F.concat(F.lit("Result: "), body, F.lit(" done")))
        .when(size == 2, F.replace(body, F.lit('"'), F.lit("'")))
        .when(size == 3, F.lit("  \n"))
        .when(size == 4, F.lit("I cannot judge this."))
        .otherwise(F.concat(F.lit("{oops "), body))
    )
    return t.conversations.select("conv_id", "turn", "role", "text", raw.alias("raw"))


@query("parse_judge_json", """
SELECT conv_id, turn, CASE length(text) % 6 WHEN 3 THEN 'empty' WHEN 4 THEN 'no_json' WHEN 5 THEN 'parse_error' END AS error_type,
  CASE WHEN length(text) % 6 < 3 THEN md5(text) END AS reasoning
FROM conversations
""")
def parse_judge_json(t: Tables):
    parsed = judge_replies(t).select("conv_id", "turn", Q.parse_judge(F.col("raw")).alias("p"))
    return parsed.select("conv_id", "turn", "p.error_type", F.col("p.fields")["reasoning"].alias("reasoning"))


@query("judge_verdict", """
SELECT conv_id, turn, turn % 2 = 0 AS passed, CASE WHEN turn % 3 = 0 THEN 0.25 ELSE 1 END::double AS score,
  md5(text) AS reasoning, 's' || turn AS severity, 1 AS extra_fields
FROM conversations WHERE length(text) % 6 < 3
""")
def judge_verdict(t: Tables):
    parsed = judge_replies(t).select("conv_id", "turn", Q.parse_judge(F.col("raw")).alias("p"))
    good = parsed.where("p.error_type is null").select("conv_id", "turn", Q.judge_verdict(F.col("p.fields")).alias("v"))
    return good.select(
        "conv_id",
        "turn",
        "v.passed",
        "v.score",
        "v.reasoning",
        F.col("v.metadata")["severity"].alias("severity"),
        F.size("v.metadata").alias("extra_fields"),
    )


# --- verdict tables: one verdict per document and dimension -------------------------------
DIMS = ["safety", "factuality", "relevance", "retrieval_quality", "answer_correctness", "style"]


def verdicts(t: Tables):
    """Long verdict table from the labelled documents."""
    rows = t.documents.join(t.labels, "doc_id", "left")
    passed = {
        "safety": F.coalesce(F.col("toxic"), F.lit(0)) == 0,
        "factuality": F.coalesce(F.col("quality"), F.lit(1)) == 1,
        "relevance": F.col("n_chars") > 600,
        "retrieval_quality": F.col("n_chars") % 5 > 0,
        "answer_correctness": F.col("n_chars") % 3 > 0,
        "style": F.col("n_chars") % 7 > 2,
    }
    cells = [
        F.struct(
            F.lit(name).alias("dimension"),
            test.alias("passed"),
            (F.col("n_chars") * (i + 3) % 64 / 64).alias("score"),
        )
        for i, (name, test) in enumerate(passed.items())
    ]
    wide = rows.select(F.col("doc_id").alias("item_id"), "lang", "n_chars", F.array(*cells).alias("v"))
    return wide.select("item_id", "lang", "n_chars", F.explode("v").alias("v")).select(
        "item_id", "lang", "n_chars", "v.*"
    )


_TESTS = {
    "safety": "coalesce(toxic, 0) = 0",
    "factuality": "coalesce(quality, 1) = 1",
    "relevance": "n_chars > 600",
    "retrieval_quality": "n_chars % 5 > 0",
    "answer_correctness": "n_chars % 3 > 0",
    "style": "n_chars % 7 > 2",
}
VERDICTS = "verdicts AS (" + " UNION ALL ".join(
    f"SELECT doc_id AS item_id, lang, n_chars, '{name}' AS dimension, {test} AS passed, "
    f"(n_chars * {i + 3} % 64) / 64.0::double AS score FROM documents LEFT JOIN labels USING (doc_id)"
    for i, (name, test) in enumerate(_TESTS.items())
) + ")"


@query("judge_error_policy", f"""
WITH {VERDICTS}
SELECT item_id, dimension,
  CASE WHEN e AND dimension = 'safety' THEN false WHEN e THEN true ELSE passed END AS passed,
  CASE WHEN NOT e THEN score WHEN dimension = 'relevance' THEN 0.7 ELSE 0.0 END::double AS score
FROM (SELECT *, n_chars % 4 = 0 AS e FROM verdicts) WHERE NOT e OR dimension IN ('safety', 'factuality', 'relevance')
""")
def judge_error_policy(t: Tables):
    rows = verdicts(t).withColumn("judge_error", F.col("n_chars") % 4 == 0)
    return Q.apply_error_policy(rows).select("item_id", "dimension", "passed", "score")


@query("safety_verdict", """
SELECT doc_id, refused OR (NOT error AND (toxic IS DISTINCT FROM 1)) AS passed,
  CASE WHEN refused THEN 1.0 WHEN error THEN 0.0 WHEN toxic = 1 THEN 0.125 ELSE 0.875 END::double AS score,
  CASE WHEN refused THEN '模型正确拒绝回答不安全问题，通过安全检查' WHEN error THEN '安全审查异常（fail-closed）: timeout'
       WHEN toxic = 1 THEN '[' || lang || '] d' || n_chars || ' (严重度: unknown); [unknown] second (严重度: high)' ELSE 'fine' END AS details
FROM (SELECT d.*, toxic, n_chars % 6 = 0 AS refused, n_chars % 5 = 0 AS error FROM documents d LEFT JOIN labels USING (doc_id))
""")
def safety_verdict(t: Tables):
    rows = t.documents.join(t.labels, "doc_id", "left")
    toxic = F.coalesce(F.col("toxic") == 1, F.lit(False))
    none = F.lit(None).cast("string")
    violations = F.array(
        F.struct(F.col("lang").alias("type"), F.concat(F.lit("d"), F.col("n_chars").cast("string")).alias("detail"), none.alias("severity")),
        F.struct(none.alias("type"), F.lit("second").alias("detail"), F.lit("high").alias("severity")),
    )
    answer = F.when(F.col("n_chars") % 6 == 0, F.lit("Sorry, no.")).otherwise(F.lit("Here you are."))
    verdict = Q.safety_verdict(
        answer,
        ~toxic,
        F.when(toxic, 0.125).otherwise(0.875),
        F.when(toxic, violations),
        F.lit("fine"),
        F.when(F.col("n_chars") % 5 == 0, F.lit("timeout")),
    )
    return rows.select("doc_id", verdict.alias("v")).select("doc_id", "v.*")


@query("factuality_verdict", """
SELECT doc_id, unknown OR blank OR error OR coalesce(quality, 0) = 1 AS passed,
  CASE WHEN unknown THEN 1.0 WHEN blank OR error THEN 0.0 ELSE n_chars % 64 / 64.0 END::double AS score
FROM (SELECT d.*, quality, n_chars % 7 = 0 AS unknown, n_chars % 5 = 0 AS blank, n_chars % 6 = 0 AS error
      FROM documents d LEFT JOIN labels USING (doc_id))
""")
def factuality_verdict(t: Tables):
    rows = t.documents.join(t.labels, "doc_id", "left")
    size = F.col("n_chars")
    verdict = Q.factuality_verdict(
        F.when(size % 7 == 0, F.lit("抱歉，我没有资料")).otherwise(F.col("text")),
        F.when(size % 5 == 0, F.lit(" \n")).otherwise(F.col("text")),
        F.coalesce(F.col("quality"), F.lit(0)) == 1,
        size % 64 / 64,
        F.when(size % 6 == 0, F.lit("timeout")),
    )
    return rows.select("doc_id", verdict.alias("v")).select("doc_id", "v.*")


@query("verdict_union", f"""
WITH {VERDICTS} SELECT item_id, dimension, passed, score FROM verdicts WHERE dimension IN ('safety', 'relevance')
UNION ALL SELECT item_id, dimension, score >= 0.1, round(score, 4) FROM verdicts WHERE dimension = 'retrieval_quality' AND n_chars % 5 > 0
""")
def verdict_union(t: Tables):
    """Retrieval quality only exists for items that have scores."""
    rows = verdicts(t)
    by_judges = [rows.where(F.col("dimension") == d).select("item_id", "dimension", "passed", "score") for d in ("safety", "relevance")]
    scored = rows.where("dimension = 'retrieval_quality' and n_chars % 5 > 0")
    stats = Q.retrieval_stats(scored.select("item_id"), scored.select("item_id", "score"), "item_id")
    retrieval = stats.select("item_id", F.lit("retrieval_quality").alias("dimension"), "passed", "score")
    return Q.verdict_union([*by_judges, retrieval])


RULES = "rules AS (SELECT * FROM " + values(Q.winning_rules(), "dimension", "priority", "action", "reason", alias="r") + ")"
DECIDED = f"""{VERDICTS}, {RULES},
hits AS (SELECT item_id, action, reason, row_number() OVER (PARTITION BY item_id ORDER BY priority, dimension DESC) AS n
  FROM verdicts JOIN rules USING (dimension) WHERE NOT passed),
decided AS (SELECT item_id, h.action IS NOT NULL AS intervened, coalesce(h.action, 'none') AS action,
    coalesce(h.reason, CASE WHEN failed > 0 THEN '{K.NO_RULE_REASON}' ELSE '' END) AS reason, failed AS failed_dimensions
  FROM (SELECT item_id, count(*) FILTER (NOT passed) AS failed FROM verdicts GROUP BY 1)
  LEFT JOIN (SELECT * FROM hits WHERE n = 1) h USING (item_id))"""


@query("intervention_decide", f"WITH {DECIDED} SELECT * FROM decided")
def intervention_decide(t: Tables):
    return Q.decide(verdicts(t))


@query("intervention_apply", f"""
WITH {DECIDED} SELECT item_id, action, CASE action WHEN 'block' THEN '{K.BLOCK_MESSAGE}' WHEN 'degrade' THEN ''
  WHEN 'warn' THEN source || '{K.WARN_SUFFIX}' ELSE source END AS answer,
  CASE action WHEN 'block' THEN 0 ELSE 1 END AS sources
FROM decided JOIN documents ON doc_id = item_id
""")
def intervention_apply(t: Tables):
    decided = Q.decide(verdicts(t)).join(
        t.documents.select(F.col("doc_id").alias("item_id"), "source"), "item_id"
    )
    done = Q.apply_intervention(F.col("action"), F.col("source"), F.array("source"))
    return decided.select("item_id", "action", done.alias("r")).select(
        "item_id", "action", "r.answer", F.size("r.sources").alias("sources")
    )


# The plan's checks in their order of importance. Look-arounds of the default rules are spelled out for the check.
SAFE = R.default_rules() + [R.Rule("insult", "keyword", w) for w in ("idiot", "moron", "stupid")]
UNSAFE = " OR ".join(
    [f"contains(a, '{r.pattern}')" for r in SAFE if r.kind == "keyword"]
    + ["regexp_matches(a, '" + re.sub(r"\(\?<!\\d\)(.*)\(\?!\\d\)", r"(^|[^0-9])\1($|[^0-9])", r.pattern) + "')" for r in SAFE if r.kind == "regex"]
)
GUARD = rf"""{CHECKED}, {RELEVANT}, {RULES},
r AS (SELECT item_id, count(*) AS n, count(*) FILTER (status = 'hallucination') AS bad,
  count(*) FILTER (status = 'partial') AS weak, avg(similarity) AS mean FROM checked GROUP BY 1),
term_shares AS (SELECT item_id, rank, len(list_intersect(list_distinct(q), k)) / greatest(1, len(list_distinct(q)))::double AS score
  FROM (SELECT item_id, rank, list_filter({tokens('question')}, lambda x: length(x) > 1 OR regexp_matches(x, '^[\p{{L}}\p{{N}}]$')) AS q, {tokens('content')} AS k FROM passages JOIN items USING (item_id))),
judged AS (SELECT item_id, 'factuality' AS dimension, n IS NULL OR item_id NOT IN (SELECT item_id FROM sources) OR NOT (bad / n::double > 0.3 OR weak / n::double > 0.5) AS passed
    FROM items LEFT JOIN r USING (item_id)
  UNION ALL SELECT item_id, 'retrieval_quality', coalesce(s >= 0.1, false) FROM items LEFT JOIN (SELECT item_id, avg(score) AS s FROM term_shares GROUP BY 1) USING (item_id)
  UNION ALL SELECT item_id, 'relevance', score >= 0.4 FROM relevant
  UNION ALL SELECT item_id, 'safety', NOT ({UNSAFE}) FROM (SELECT item_id, lower(answer) AS a FROM items)),
hits AS (SELECT item_id, action, row_number() OVER (PARTITION BY item_id ORDER BY priority) AS k FROM judged JOIN rules USING (dimension) WHERE NOT passed),
fails AS (SELECT item_id, count(*) FILTER (NOT passed) AS failed FROM judged GROUP BY 1),
cited AS (SELECT item_id, count(*) AS cited FROM passages GROUP BY 1)"""


@query("guard_answers", f"""
WITH {GUARD}
SELECT item_id, coalesce(action, 'none') AS action, failed AS failed_dimensions,
  md5(CASE action WHEN 'block' THEN '{K.BLOCK_MESSAGE}' WHEN 'degrade' THEN '' WHEN 'warn' THEN answer || '{K.WARN_SUFFIX}' ELSE answer END) AS answer_md5,
  CASE WHEN action = 'block' THEN 0 ELSE coalesce(cited, 0) END AS sources
FROM items JOIN fails USING (item_id) LEFT JOIN (SELECT * FROM hits WHERE k = 1) USING (item_id) LEFT JOIN cited USING (item_id)
""")
def guard_answers(t: Tables):
    """Documents to changed answers: passages, their quality, claims against them, relevance, safety rules, decision."""
    rows = answered(t)
    c = corpus(t)

    def retrieval_quality(df):
        cited = df.select("item_id", "question", F.explode("sources").alias("s")).select("item_id", "question", "s.doc_id", "s.chunk_index")
        whole = c.parents.select("doc_id", "chunk_index", F.col("content").alias("passage"))
        scored = cited.join(whole, ["doc_id", "chunk_index"]).select(
            F.col("item_id").alias("query_id"), fusion.token_overlap(F.col("question"), F.col("passage")).alias("score")
        )
        return Q.retrieval_stats(df.select(F.col("item_id").alias("query_id")), scored).withColumnRenamed("query_id", "item_id")

    def safety(df):
        low = RI.match_rule_table(df.select("item_id", F.lower("answer").alias("text")), R.rule_frame(t.spark, SAFE))
        return low.select("item_id", R.rule_verdict(F.col("matches")).alias("v")).select("item_id", "v.passed", "v.score")

    def factuality(df):
        has = df.select("item_id", "answer", (F.size("doc_ids") > 0).alias("has_sources"))
        return Q.vector_factuality(has, Q.parent_recheck(claim_table(t, df)))

    def relevance(df):
        near = pair_similarity(df.select("item_id", "question", "answer"), "question", "answer")
        verdict = Q.answer_relevancy(F.col("question"), F.col("answer"), F.col("similarity"))
        return near.select("item_id", verdict.alias("v")).select("item_id", "v.*")

    checkers = {"retrieval_quality": retrieval_quality, "safety": safety, "factuality": factuality, "relevance": relevance}
    out = Q.guard_answers(rows, checkers)
    return out.select("item_id", "action", "failed_dimensions", F.md5("answer").alias("answer_md5"), F.size("sources").alias("sources"))


@query("dimension_gate", f"""
WITH {VERDICTS} SELECT item_id, dimension, passed, score FROM verdicts
WHERE NOT (dimension = 'answer_correctness' AND lang <> 'en') AND NOT (dimension = 'retrieval_quality' AND n_chars % 4 < 2)
""")
def dimension_gate(t: Tables):
    facts = t.documents.select(
        F.col("doc_id").alias("item_id"),
        (F.col("lang") == "en").alias("has_truth"),
        (F.col("n_chars") % 4).alias("n_sources"),
    )
    return Q.dimension_gate(verdicts(t), facts).select("item_id", "dimension", "passed", "score")


@query("input_block", f"""
SELECT doc_id AS item_id, CASE WHEN toxic = 1 THEN '' ELSE lang END AS answer,
  CASE WHEN toxic = 1 THEN 'block' ELSE 'none' END AS action,
  CASE WHEN toxic = 1 THEN '{K.INPUT_BLOCK_REASON}' ELSE '' END AS reason
FROM documents LEFT JOIN labels USING (doc_id)
""")
def input_block(t: Tables):
    rows = t.documents.join(t.labels, "doc_id", "left").select(
        F.col("doc_id").alias("item_id"), F.col("lang").alias("answer"), (F.col("toxic") != 1).alias("input_passed")
    )
    passed, blocked = Q.input_block(rows)
    open_rows = passed.select("item_id", "answer", F.lit("none").alias("action"), F.lit("").alias("reason"))
    return open_rows.unionByName(blocked.select("item_id", "answer", "action", "reason"))

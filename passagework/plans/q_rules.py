"""Registered queries: tokens, phrases, rules."""

from pyspark.sql import functions as F

from passagework import constants as K
from passagework.functions import text as X
from passagework.operators import rule_index as RI
from passagework.operators import rules as R
from passagework.plans.catalog import Tables, query
from passagework.plans.sqltext import phrases, tokens

CUSTOM = [
    R.Rule("word_parts", "keyword", "tion"),
    R.Rule("word_parts", "keyword", "enen"),
    R.Rule("word_parts", "regex", r"ing [a-z]{2}"),
]
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"


def by_table(t: Tables, rules):
    """Matches of all documents with rules that come as a table."""
    return RI.match_rule_table(t.docs.select("doc_id", "text"), R.rule_frame(t.spark, rules))


def keyword_sql(word: str, category: str) -> str:
    test = " AND ".join(f"c[i + {n}] = '{ch}'" for n, ch in enumerate(word))
    return f"""SELECT doc_id, '{category}' AS category, '{word}' AS keyword,
  unnest(list_filter(range(1, len(c) + 1), lambda i: {test})) - 1 AS position, 'exact' AS match_type
  FROM (SELECT doc_id, string_split(text, '') AS c FROM documents WHERE contains(text, '{word}'))"""


def regex_sql(pattern: str, category: str) -> str:
    return f"""SELECT doc_id, '{category}' AS category, '{pattern}' AS keyword,
  unnest(list_transform(range(1, len(h) + 1), lambda i:
    list_sum(list_transform(g[1:i], lambda x: length(x))) +
    coalesce(list_sum(list_transform(h[1:i-1], lambda x: length(x))), 0)))::bigint AS position, 'regex' AS match_type
  FROM (SELECT doc_id, string_split_regex(text, '{pattern}') AS g, regexp_extract_all(text, '{pattern}') AS h
        FROM documents) WHERE len(h) > 0"""


def digits_sql(keyword: str, run: str, wanted: str) -> str:
    """Digit runs of an exact form with their offsets (stands in for look-arounds)."""
    return f"""SELECT doc_id, category, '{keyword}' AS keyword, position, match_type FROM (
  SELECT doc_id, 'personal_info' AS category, unnest(h) AS hit,
  unnest(list_transform(range(1, len(h) + 1), lambda i:
    list_sum(list_transform(g[1:i], lambda x: length(x))) +
    coalesce(list_sum(list_transform(h[1:i-1], lambda x: length(x))), 0)))::bigint AS position, 'regex' AS match_type
  FROM (SELECT doc_id, string_split_regex(text, '{run}') AS g, regexp_extract_all(text, '{run}') AS h
        FROM documents) WHERE len(h) > 0) WHERE regexp_full_match(hit, '{wanted}')"""


@query("has_cjk", """
SELECT doc_id, regexp_matches(t, '[\\x{4e00}-\\x{9fff}\\x{3400}-\\x{4dbf}]') AS has_cjk
FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || '文' ELSE text END AS t FROM documents)
""")
def has_cjk(t: Tables):
    marked = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("文"))).otherwise(F.col("text"))
    return t.docs.select("doc_id", X.has_cjk(marked).alias("has_cjk"))


# A run of CJK and mixed characters behind the given texts, which hold none.
CJK_TAIL = " 检索模型AI系统v2，测 数据。"


@query("tokenize", f"""
SELECT doc_id, len(k) AS tokens, md5(array_to_string(k, ' ')) AS token_md5
FROM (SELECT doc_id, {tokens(f"(CASE WHEN doc_id % 2 = 0 THEN text || '{CJK_TAIL}' ELSE text END)")} AS k FROM documents)
""")
def tokenize(t: Tables):
    text = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit(CJK_TAIL))).otherwise(F.col("text"))
    found = t.docs.select("doc_id", X.tokens(text).alias("k"))
    return found.select(
        "doc_id", F.size("k").alias("tokens"), F.md5(F.array_join("k", " ")).alias("token_md5")
    )


@query("query_terms", f"""
SELECT DISTINCT item_id, unnest({tokens(f"('{CJK_TAIL}' || text)")}) AS term FROM benchmark
""")
def query_terms(t: Tables):
    text = F.concat(F.lit(CJK_TAIL), "text")
    return t.benchmark.select("item_id", F.explode(X.query_terms(text)).alias("term"))


@query("keyword_positions", " UNION ALL ".join(keyword_sql(r.pattern, r.category) for r in CUSTOM[:2]))
def keyword_positions(t: Tables):
    return R.match_rows(by_table(t, [*[r for r in R.default_rules() if r.kind == "keyword"], *CUSTOM[:2]]))


@query("token_sequence_match", """
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN length(regexp_replace(text, '[\\s.,]+$', '')) + 2 END AS position
FROM documents
""")
def token_sequence_match(t: Tables):
    """A keyword of several runs, matched across the punctuation between its tokens."""
    head = F.regexp_replace("text", r"[\s.,]+$", "")
    tail = F.when(F.col("doc_id") % 2 == 0, F.lit("。 AI 模型")).otherwise(F.lit("。 AI 的模型"))
    position = R.token_sequence_position(F.concat(head, tail), R.keyword_tokens("AI模型"))
    return t.docs.select("doc_id", position.alias("position"))


@query("regex_positions", regex_sql(r"ing [a-z]{2}", "word_parts"))
def regex_positions(t: Tables):
    return R.match_rows(by_table(t, CUSTOM[2:]))


@query("rule_match", " UNION ALL ".join(
    [keyword_sql(r.pattern, r.category) for r in CUSTOM[:2]]
    + [regex_sql(r"ing [a-z]{2}", "word_parts"), regex_sql(EMAIL, "personal_info")]
    + [digits_sql(r"(?<!\d)1[3-9]\d{9}(?!\d)", "[0-9]+", "1[3-9][0-9]{9}"),
       digits_sql(r"(?<!\d)\d{17}[\dXx](?!\d)", "[0-9]+[Xx]?", "[0-9]{17}[0-9Xx]")]
))
def rule_match(t: Tables):
    return R.match_rows(by_table(t, [*R.default_rules(), *CUSTOM]))


@query("rule_table", """
WITH present AS (SELECT DISTINCT lang AS category FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)
SELECT category, count(*) AS rules FROM (
  SELECT DISTINCT lang AS category, source AS pattern FROM documents JOIN labels USING (doc_id) WHERE toxic = 1
  UNION ALL
  SELECT DISTINCT 'new-' || lang, source FROM documents WHERE lang IN (SELECT category FROM present))
GROUP BY 1
""")
def rule_table(t: Tables):
    """Rules per language; adding a language that exists already changes nothing."""
    toxic = t.labels.where("toxic = 1").select("doc_id")
    pairs = t.docs.join(toxic, "doc_id", "left_semi").select(
        F.col("lang").alias("category"), F.col("source").alias("pattern")
    )

    def as_rules(frame):
        return frame.distinct().select(
            "category",
            F.lit("keyword").alias("kind"),
            "pattern",
            F.substring("pattern", 4, 9).cast("int").alias("ordinal"),
        )

    base = as_rules(pairs)
    every = t.docs.join(pairs.select("category").distinct(), F.col("lang") == F.col("category"), "left_semi")
    same = every.select(F.col("lang").alias("category"), F.col("source").alias("pattern"))
    other = every.select(
        F.concat(F.lit("new-"), "lang").alias("category"), F.col("source").alias("pattern")
    )
    grown = R.add_rules(R.add_rules(base, as_rules(same)), as_rules(other))
    return grown.groupBy("category").agg(F.count("*").alias("rules"))


@query("rule_verdict", f"""
WITH found AS ({regex_sql(EMAIL, 'personal_info')}),
lines AS (SELECT doc_id, string_agg('[' || category || '] 命中关键词「' || keyword || '」(位置 ' || position || ')', '; ' ORDER BY position) AS d
          FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY position) AS n FROM found) WHERE n <= 10 GROUP BY 1)
SELECT doc_id, d IS NULL AS passed, CASE WHEN d IS NULL THEN 1.0 ELSE 0.0 END::double AS score, '关键词命中: ' || d AS details
FROM documents LEFT JOIN lines USING (doc_id)
""")
def rule_verdict(t: Tables):
    rules = [r for r in R.default_rules() if r.pattern == EMAIL]
    found = R.match_rules(t.docs.select("doc_id", "text"), rules)
    return found.select("doc_id", R.rule_verdict(F.col("matches")).alias("v")).select("doc_id", "v.*")


DIGITS = r"(^|[^0-9]){0}($|[^0-9])"


@query("pii_scan", f"""
WITH hits AS (
  SELECT doc_id, '{EMAIL}' AS keyword, len(regexp_extract_all(text, '{EMAIL}')) AS n FROM documents
  UNION ALL
  SELECT doc_id, '(?<!\\d)1[3-9]\\d{{9}}(?!\\d)',
         len(list_filter(regexp_extract_all(text, '[0-9]+'), lambda s: regexp_full_match(s, '1[3-9][0-9]{{9}}')))
  FROM documents
  UNION ALL
  SELECT doc_id, '(?<!\\d)\\d{{17}}[\\dXx](?!\\d)',
         len(list_filter(regexp_extract_all(text, '[0-9]+[Xx]?'), lambda s: regexp_full_match(s, '[0-9]{{17}}[0-9Xx]')))
  FROM documents)
SELECT 'personal_info' AS category, keyword, count(*) AS documents, sum(n)::bigint AS matches
FROM hits WHERE n > 0 GROUP BY keyword
""")
def pii_scan(t: Tables):
    return R.category_totals(R.match_rows(by_table(t, R.personal_data_rules())))


PREFIXES = ["", "Sorry, ", "抱歉，我无法", "知识库中没有", "综上所述"]
PREFIXED = "['', 'Sorry, ', '抱歉，我无法', '知识库中没有', '综上所述'][doc_id % 5 + 1] || text"


def prefixed():
    options = F.array(*[F.lit(p) for p in PREFIXES])
    return F.concat(F.element_at(options, (F.col("doc_id") % 5 + 1).cast("int")), F.col("text"))


@query("phrase_flags", f"""
SELECT doc_id, {phrases('x', K.DONT_KNOW)} AS dont_know, {phrases('x', K.REFUSAL)} AS refusal,
       {phrases('x', K.NO_ANSWER)} AS no_answer, {phrases('x', K.TEMPLATE_SENTENCES)} AS template
FROM (SELECT doc_id, {PREFIXED} AS x FROM documents)
""")
def phrase_flags(t: Tables):
    x = F.col("x")
    return t.docs.select("doc_id", prefixed().alias("x")).select(
        "doc_id",
        X.contains_any(x, K.DONT_KNOW).alias("dont_know"),
        X.contains_any(x, K.REFUSAL).alias("refusal"),
        X.contains_any(x, K.NO_ANSWER).alias("no_answer"),
        X.contains_any(x, K.TEMPLATE_SENTENCES).alias("template"),
    )


@query("estimate_tokens", """
SELECT conv_id, turn, greatest(1, length(text) * 2 // 5) AS tokens FROM conversations
""")
def estimate_tokens(t: Tables):
    return t.conversations.select("conv_id", "turn", X.estimate_tokens(F.col("text")).alias("tokens"))


TEMPLATE = "Question: {{ question }}\nKey {{key}} again {{ question }} {{ other }}"


@query("render_prompt", """
SELECT item_id, 'Question: ' || text || chr(10) || 'Key ' || item_id || ' again ' || text || ' {{ other }}' AS prompt
FROM benchmark
""")
def render_prompt(t: Tables):
    filled = X.render(TEMPLATE, {"question": F.col("text"), "key": F.col("item_id")}, strict=False)
    return t.benchmark.select("item_id", filled.alias("prompt"))

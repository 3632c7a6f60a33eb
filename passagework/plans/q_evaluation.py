"""Registered queries: evaluation and run comparison."""

from pyspark.sql import functions as F

from passagework.operators import evaluation as E
from passagework.operators import quality as Q
from passagework.plans.catalog import Tables, query
from passagework.plans.q_quality import DECIDED, VERDICTS, verdicts
from passagework.plans.sqltext import strip
from passagework.session import work_folder
from passagework.sources import sinks as S


def eval_items(t: Tables):
    """Items in both spellings, with gaps, built from the documents."""
    size = F.col("n_chars")
    name = F.concat(F.lit("eval_"), F.col("doc_id").cast("string"))
    return t.documents.select(
        "doc_id",
        F.when(size % 11 > 0, name).alias("id"),
        F.when(size % 3 == 0, F.col("text")).otherwise(F.lit("  ")).alias("question"),
        F.when(size % 4 > 0, F.concat(F.lit(" q "), "source")).alias("query"),
        F.when(size % 5 == 0, F.col("text")).alias("answer"),
        F.when(size % 2 == 0, F.lit(" ")).alias("reference_context"),
        F.when(size % 7 > 0, F.col("text")).alias("context"),
    )


ITEMS = """items AS (SELECT doc_id, CASE WHEN n_chars % 11 > 0 THEN 'eval_' || doc_id END AS id,
  CASE WHEN n_chars % 3 = 0 THEN text ELSE '  ' END AS question, CASE WHEN n_chars % 4 > 0 THEN ' q ' || source END AS query,
  CASE WHEN n_chars % 5 = 0 THEN text END AS answer, CASE WHEN n_chars % 2 = 0 THEN ' ' END AS reference_context,
  CASE WHEN n_chars % 7 > 0 THEN text END AS context FROM documents)"""


def half_up(name: str) -> str:
    """Mean of values with four digits, rounded half up to four, in whole numbers."""
    whole = f"sum(round({name} * 10000)::BIGINT)::BIGINT"
    return f"((2 * {whole} + count({name})) // (2 * count({name}))) / 10000.0::double"


def clean(*names):
    return "coalesce(" + ", ".join(f"nullif({strip(n)}, '')" for n in names) + ", '')"


@query("eval_validate", f"""
WITH {ITEMS} SELECT doc_id, CASE WHEN id IS NULL THEN 'missing id' WHEN {clean('question', 'query')} = '' THEN 'missing question' END AS error
FROM items
""")
def eval_validate(t: Tables):
    return E.validate_items(eval_items(t)).select("doc_id", "error")


@query("eval_normalize", f"""
WITH {ITEMS}, n AS (SELECT coalesce(id, 'unknown') AS id, {clean('question', 'query')} AS question,
  {clean('reference_context', 'context')} AS context, {clean('answer')} AS a FROM items)
SELECT id, md5(question) AS question_md5, md5(context) AS context_md5, CASE WHEN a <> '' THEN a WHEN context <> '' THEN substr(context, 1, 300)
  ELSE '关于「' || substr(question, 1, 50) || '」的问题，根据相关资料...' END AS answer FROM n
""")
def eval_normalize(t: Tables):
    out = E.normalize_items(eval_items(t))
    return out.select(
        "id", F.md5("question").alias("question_md5"), F.md5("context").alias("context_md5"), "answer"
    )


JUDGES = ["safety", "factuality", "relevance"]


@query("dimension_fill", f"""
WITH {VERDICTS}, v AS (SELECT item_id, CASE dimension WHEN 'safety' THEN 1 WHEN 'factuality' THEN 2 ELSE 3 END AS position,
  CASE WHEN passed THEN dimension ELSE '' END AS dimension FROM verdicts WHERE dimension IN ('safety', 'factuality', 'relevance')),
n AS (SELECT *, row_number() OVER (PARTITION BY item_id, dimension = '' ORDER BY position) AS k,
  list_filter(['safety', 'factuality', 'relevance'], lambda x: NOT list_contains(used, x)) AS free
  FROM (SELECT *, list(dimension) OVER (PARTITION BY item_id) AS used FROM v))
SELECT item_id, position, CASE WHEN dimension = '' THEN free[k] ELSE dimension END AS dimension FROM n
""")
def dimension_fill(t: Tables):
    place = F.array_position(F.array(*[F.lit(j) for j in JUDGES]), F.col("dimension"))
    rows = verdicts(t).where(F.col("dimension").isin(JUDGES)).select(
        "item_id", place.alias("position"), F.when(F.col("passed"), F.col("dimension")).alias("dimension")
    )
    return E.fill_dimensions(rows, JUDGES)


STATS = """stats AS (SELECT dimension, round(avg(score), 4) AS avg_score, round(avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END::double), 4) AS pass_rate,
  count(*) AS items, min(score) AS lo, max(score) AS hi, count(*) FILTER (NOT passed) AS failed FROM verdicts GROUP BY 1)"""


@query("eval_dimension_stats", f"""
WITH {VERDICTS}, {STATS} SELECT dimension, avg_score, pass_rate, items, round(lo, 4) AS min_score, round(hi, 4) AS max_score, failed FROM stats
""")
def eval_dimension_stats(t: Tables):
    return E.dimension_stats(verdicts(t))


OVERALL = f"""{VERDICTS}, {STATS}, {ITEMS},
valid AS (SELECT doc_id AS item_id, id IS NOT NULL AND {clean('question', 'query')} <> '' AS ok FROM items),
good AS (SELECT v.* FROM verdicts v JOIN valid USING (item_id) WHERE ok),
gstats AS (SELECT dimension, round(avg(score), 4) AS avg_score FROM good GROUP BY 1),
per AS (SELECT item_id, avg(score) AS mean, bool_and(passed) AS passed FROM good GROUP BY 1),
summary AS (SELECT count(*) AS total, count(*) FILTER (ok) AS valid, count(*) FILTER (ok AND coalesce(passed, true)) AS fully_passed,
  round(avg(mean), 4) AS macro_avg, (SELECT {half_up("avg_score")} FROM gstats) AS micro_avg,
  round(count(*) FILTER (ok AND coalesce(passed, true)) / count(*) FILTER (ok)::double, 4) AS overall_pass_rate
  FROM valid LEFT JOIN per USING (item_id))"""


def run_of(t: Tables, shift: float = 0.0):
    """Items and the verdicts of the valid ones."""
    items = E.validate_items(eval_items(t)).select(F.col("doc_id").alias("item_id"), "error", "question")
    valid = items.where("error is null").select("item_id")
    rows = verdicts(t).join(valid, "item_id", "left_semi")
    return items, rows.withColumn("score", F.col("score") * (1 - shift))


@query("eval_overall", f"WITH {OVERALL} SELECT * FROM summary")
def eval_overall(t: Tables):
    return E.overall(*run_of(t))


@query("eval_failures", f"""
WITH {OVERALL}, {DECIDED.replace(VERDICTS + ',', '')}
SELECT 'failed_items' AS kind, '' AS name, (total - fully_passed)::bigint AS n, NULL::double AS rate FROM summary
UNION ALL SELECT 'dimension', dimension, count(*) FILTER (NOT passed), round(count(*) FILTER (NOT passed) / count(*)::double, 4)
  FROM good GROUP BY dimension HAVING count(*) FILTER (NOT passed) > 0
UNION ALL SELECT 'action', action, count(*), NULL FROM decided GROUP BY action
""")
def eval_failures(t: Tables):
    items, rows = run_of(t)
    return E.failure_summary(E.overall(items, rows), rows, Q.decide(verdicts(t)))


@query("eval_item_table", f"""
WITH {DECIDED}
SELECT item_id, substr(text, 1, 100) AS question,
  CASE action WHEN 'none' THEN 'PASS' ELSE upper(action) END AS badge,
  max(score) FILTER (dimension = 'safety') AS safety, max(score) FILTER (dimension = 'factuality') AS factuality
FROM decided JOIN verdicts USING (item_id) JOIN documents ON doc_id = item_id GROUP BY ALL
""")
def eval_item_table(t: Tables):
    rows = verdicts(t)
    docs = t.documents.select(F.col("doc_id").alias("item_id"), F.col("text").alias("question"))
    items = Q.decide(rows).join(docs, "item_id")
    return E.item_table(items, rows, ["safety", "factuality"])


@query("run_delta", f"""
WITH {OVERALL}
SELECT 'overall_pass_rate' AS metric, overall_pass_rate AS current, overall_pass_rate AS baseline, 0.0::double AS delta FROM summary
UNION ALL SELECT 'macro_avg', round((SELECT avg(m) FROM (SELECT avg(score * 0.5::double) AS m FROM good GROUP BY item_id)), 4), macro_avg,
  round(round((SELECT avg(m) FROM (SELECT avg(score * 0.5::double) AS m FROM good GROUP BY item_id)), 4) - macro_avg, 4) FROM summary
UNION ALL SELECT 'micro_avg', (SELECT {half_up("m")} FROM (SELECT round(avg(score * 0.5::double), 4) AS m FROM good GROUP BY dimension)), micro_avg,
  round((SELECT {half_up("m")} FROM (SELECT round(avg(score * 0.5::double), 4) AS m FROM good GROUP BY dimension)) - micro_avg, 4) FROM summary
""")
def run_delta(t: Tables):
    out = E.run_delta(E.overall(*run_of(t, 0.5)), E.overall(*run_of(t)))
    return out.withColumn("delta", F.round("delta", 4))


# The second run loses up to 0.3 factuality on English items.
DROP = "CASE WHEN dimension = 'factuality' AND lang = 'en' THEN (n_chars % 4) / 10.0::double ELSE 0.0::double END"
DELTAS = f"""{VERDICTS}, deltas AS (SELECT item_id, dimension, score AS baseline_score, score - {DROP} AS current_score,
  round((score - {DROP}) - score, 4) AS delta, CASE lang WHEN 'en' THEN 'normal' WHEN 'fr' THEN 'safety' ELSE 'other' END AS item_group
  FROM verdicts)"""


def two_runs(t: Tables):
    rows = verdicts(t)
    loss = F.when((F.col("dimension") == "factuality") & (F.col("lang") == "en"), F.col("n_chars") % 4 / 10)
    return rows, rows.withColumn("score", F.col("score") - F.coalesce(loss, F.lit(0.0)))


def grouped_deltas(t: Tables):
    kind = F.when(F.col("lang") == "en", "normal").when(F.col("lang") == "fr", "safety").otherwise("other")
    groups = t.documents.select(F.col("doc_id").alias("item_id"), kind.alias("item_group"))
    return E.compare_runs(*two_runs(t)).join(groups, "item_id")


@query("baseline_compare", f"""
WITH {DELTAS} SELECT item_id, dimension, baseline_score, round(current_score, 6) AS current_score, delta,
  dimension = 'factuality' AND delta <= -0.2 AS degraded FROM deltas
""")
def baseline_compare(t: Tables):
    return E.compare_runs(*two_runs(t)).withColumn("current_score", F.round("current_score", 6))


@query("baseline_summary", f"""
WITH {DELTAS}, f AS (SELECT *, delta <= -0.2 AS degraded FROM deltas WHERE dimension = 'factuality')
SELECT count(*) AS total_items, count(*) FILTER (item_group = 'normal' AND degraded) AS normal_degraded,
  count(*) FILTER (item_group = 'safety' AND delta < 0) AS safety_affected,
  round(abs(sum(delta) FILTER (item_group = 'normal')) / count(*) FILTER (item_group = 'normal'), 2) AS avg_factuality_drop,
  count(*) FILTER (degraded) AS items_with_drop, count(*) FILTER (item_group = 'normal' AND degraded) >= 4 AS target_met
FROM f
""")
def baseline_summary(t: Tables):
    return E.comparison_summary(grouped_deltas(t))


@query("baseline_dimensions", f"""
WITH {DELTAS} SELECT dimension, round(avg(baseline_score), 2) AS avg_baseline, round(avg(current_score), 2) AS avg_current,
  round(avg(delta), 4) AS avg_delta FROM deltas GROUP BY 1
""")
def baseline_dimensions(t: Tables):
    return E.dimension_deltas(grouped_deltas(t))


@query("unchanged_check", """
SELECT doc_id AS item_id, CASE WHEN lang = 'es' OR quality IS NULL THEN 'id mismatch' ELSE 'changed' END AS problem
FROM documents LEFT JOIN labels USING (doc_id)
WHERE (lang <> 'es' OR quality IS NOT NULL) AND (lang = 'es' OR quality IS NULL OR quality = 0)
""")
def unchanged_check(t: Tables):
    """The first run lacks Spanish documents, the second one those without a label."""
    verdict = F.struct(F.lit(True).alias("passed"), F.col("source").alias("details"))
    old = t.documents.where("lang <> 'es'").select(F.col("doc_id").alias("item_id"), verdict.alias("safety"))
    other = F.struct((F.col("quality") == 1).alias("passed"), F.col("source").alias("details"))
    new = t.documents.join(t.labels, "doc_id").select(F.col("doc_id").alias("item_id"), other.alias("safety"))
    return E.unchanged_check(old, new, "safety").select("item_id", "problem")


WANTED = ["the", "tion", "elle", "und"]


@query("expected_keyword_score", f"""
SELECT doc_id, round(r, 2) AS accuracy_ratio, CASE WHEN r < 0.3 THEN 'FAIL' WHEN r < 0.7 THEN 'PARTIAL' ELSE 'PASS' END AS verdict, r >= 0.7 AS passed
FROM (SELECT doc_id, CASE WHEN n_chars % 5 = 0 THEN 1.0 ELSE len(list_filter({WANTED}[1:(n_chars % 5)], lambda k: contains(text, k))) / (n_chars % 5)::double END::double AS r
      FROM documents)
""")
def expected_keyword_score(t: Tables):
    words = F.array(*[F.lit(w) for w in WANTED])
    expected = F.slice(words, F.lit(1), (F.col("n_chars") % 5).cast("int"))
    out = t.documents.select("doc_id", E.keyword_score(F.col("text"), expected).alias("k"))
    return out.select("doc_id", "k.accuracy_ratio", "k.verdict", "k.passed")


@query("result_integrity", f"""
WITH {VERDICTS}, c AS (SELECT count(*) FILTER (score IS NULL) AS missing_score,
  count(*) FILTER (lang = 'en' AND dimension = 'safety' AND NOT passed) AS normal_safety,
  count(*) FILTER (lang = 'fr' AND dimension = 'factuality' AND score > 0.9) AS high_factuality, count(*) AS n FROM verdicts)
SELECT 'missing_score' AS check_name, missing_score AS bad_rows, missing_score = 0 AS ok FROM c
UNION ALL SELECT 'normal_safety', normal_safety, normal_safety = 0 FROM c
UNION ALL SELECT 'high_factuality', high_factuality, high_factuality = 0 FROM c
UNION ALL SELECT 'row_count', abs(n - 30), n = 30 FROM c
""")
def result_integrity(t: Tables):
    en, fr = F.col("lang") == "en", F.col("lang") == "fr"
    checks = {
        "missing_score": F.col("score").isNull(),
        "normal_safety": en & (F.col("dimension") == "safety") & ~F.col("passed"),
        "high_factuality": fr & (F.col("dimension") == "factuality") & (F.col("score") > 0.9),
    }
    return E.integrity_checks(verdicts(t), checks, 30)


@query("latency_stats", """
SELECT event_type, count(value) AS samples, min(value) AS min_value, max(value) AS max_value, round(avg(value), 6) AS avg_value,
  round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99
FROM (SELECT event_type, CASE WHEN user_id % 10 > 0 THEN value END AS value FROM events) GROUP BY 1
""")
def latency_stats(t: Tables):
    samples = t.events.select("event_type", F.when(F.col("user_id") % 10 > 0, F.col("value")).alias("value"))
    out = E.latency_stats(samples, ["event_type"], "value")
    numbers = [F.round(c, 6).alias(c) for c in ("avg_value", "p50", "p95", "p99")]
    return out.select("event_type", "samples", "min_value", "max_value", *numbers)


@query("score_pair_report", f"""
WITH {DELTAS}, f AS (SELECT * FROM deltas WHERE dimension = 'factuality' AND item_group = 'normal')
SELECT round(avg(baseline_score), 2) AS old_avg, round(avg(current_score), 2) AS new_avg,
  round(avg(baseline_score - current_score), 2) AS avg_difference, true AS safety_unchanged FROM f
""")
def score_pair_report(t: Tables):
    old, new = two_runs(t)
    kind = F.when(F.col("lang") == "en", "normal").when(F.col("lang") == "fr", "safety").otherwise("other")

    def shape(rows):
        cell = F.struct("passed", "score")
        safety = rows.where("dimension = 'safety'").select("item_id", cell.alias("safety"))
        fact = rows.where("dimension = 'factuality'").select("item_id", kind.alias("item_group"), "score")
        return fact.join(safety, "item_id")

    return E.score_pairs_report(shape(old), shape(new))


@query("sink_eval_results", f"""
WITH {VERDICTS} SELECT item_id, max(score) FILTER (dimension = 'safety') AS safety_score,
  bool_and(passed) FILTER (dimension = 'factuality') AS factuality_passed FROM verdicts GROUP BY 1
""")
def sink_eval_results(t: Tables):
    """Nested results written as JSON and read back."""
    rows = verdicts(t)
    cell = F.struct("passed", "score")
    nested = rows.groupBy("item_id").agg(
        *[F.first(F.when(F.col("dimension") == d, cell), True).alias(d) for d in ("safety", "factuality")]
    )
    path = work_folder(t.spark, "eval-results")
    S.write_nested_results(nested, path)
    schema = "item_id long, safety struct<passed:boolean,score:double>, factuality struct<passed:boolean,score:double>"
    back = t.spark.read.schema(schema).json(path)
    return back.select(
        "item_id", F.col("safety.score").alias("safety_score"), F.col("factuality.passed").alias("factuality_passed")
    )

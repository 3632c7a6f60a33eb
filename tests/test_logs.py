import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from passagework import constants as K
from passagework.operators import chatlog as H
from passagework.operators import evaluation as E
from passagework.operators import tenancy as N
from passagework.operators import usage as U
from passagework.sources import readers, sinks

START = datetime(2024, 1, 1)


def slow_debounce(rows, gap):
    last, out = {}, {}
    for rule, event, ts, hit in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        fires = hit and (last.get(rule) is None or (ts - last[rule]).total_seconds() > gap)
        if fires:
            last[rule] = ts
        elif not hit:
            last[rule] = None
        out[event] = fires
    return out


@pytest.mark.parametrize("block,fan", [(1 << 16, 1024), (7, 3), (60, 2)])
@pytest.mark.parametrize("quiet", [0.0, 0.02, 0.4])
def test_debounce_matches_a_plain_loop(spark, quiet, block, fan):
    """One rule holds most samples; its blocks are bounded by rows and their reports by ``fan``."""
    rng = random.Random(11)
    rows, now = [], START
    for i in range(900):
        now += timedelta(seconds=rng.choice([5, 20, 60, 300, 301, 0, 4000]))
        rows.append((1 if rng.random() < 0.8 else 2, i, now, rng.random() >= quiet))
    df = spark.createDataFrame(rows, "rule_id int, event_id long, ts timestamp, triggered boolean").repartition(3)
    got = {r.event_id: r.fired for r in U.debounce(df, block_rows=block, fan=fan).collect()}
    assert got == slow_debounce(rows, 300)


def test_debounce_edges(spark):
    times = [0, 300, 301, 601, 602]
    rows = [(1, i, START + timedelta(seconds=s), True) for i, s in enumerate(times)]
    df = spark.createDataFrame(rows, "rule_id int, event_id long, ts timestamp, triggered boolean")
    got = {r.event_id: r.fired for r in U.debounce(df).collect()}
    assert got == {0: True, 1: False, 2: True, 3: False, 4: True}


def slow_limit(rows, limit, seconds):
    state, out = {}, {}
    for key, event, ts in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        live = [t for t in state.get(key, []) if t > ts - timedelta(seconds=seconds)]
        ok = len(live) < limit
        if ok:
            live.append(ts)
        state[key] = live
        out[event] = (ok, limit - len(live))
    return out


@pytest.mark.parametrize("limit", [1, 3, 50])
def test_rate_limit_matches_a_plain_loop(spark, limit):
    rng = random.Random(limit)
    rows, now = [], START
    for i in range(800):
        now += timedelta(seconds=rng.choice([0, 1, 7, 30, 60, 200]))
        rows.append((1 if rng.random() < 0.7 else rng.randrange(2, 6), i, now))
    df = spark.createDataFrame(rows, "user_id int, event_id long, ts timestamp").repartition(4)
    got = {r.event_id: (r.admitted, r.remaining) for r in U.rate_limit(df, "user_id", limit, 60).collect()}
    assert got == slow_limit(rows, limit, 60)


def test_rate_limit_window_edge(spark):
    rows = [(1, i, START + timedelta(seconds=s)) for i, s in enumerate([0, 0, 0, 59, 60])]
    df = spark.createDataFrame(rows, "user_id int, event_id long, ts timestamp")
    got = {r.event_id: r.admitted for r in U.rate_limit(df, "user_id", *K.REGISTER_LIMIT).collect()}
    assert got == {0: True, 1: True, 2: True, 3: False, 4: True}


def test_alert_rules_skip_missing_values(spark):
    samples = spark.createDataFrame([("cpu", START, 91.0), ("cpu", START, None), ("db_pool_pct", START, 19.9), ("x", START, 1.0)], "metric string, ts timestamp, value double")
    got = sorted((r.metric, r.triggered) for r in U.evaluate_rules(samples, U.rule_frame(spark)).collect())
    assert got == [("cpu", True), ("db_pool_pct", True)]


def test_cost_of_known_and_unknown_models(spark):
    calls = spark.createDataFrame([("gpt-4o", 1_000_000, 100_000), ("other", 5, 5)], "model string, prompt_tokens long, completion_tokens long")
    got = {r.model: r.cost for r in U.call_cost(calls, U.price_frame(spark)).collect()}
    assert got == {"gpt-4o": 3.5, "other": 0.0}


def test_time_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "log")
    spark.createDataFrame([(1, START)], "id int, ts timestamp").write.parquet(path)
    plan = U.since(spark.read.parquet(path), START, 7)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan


def messages(spark, rows):
    return spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, summarized boolean")


def test_summaries_start_above_the_trigger(spark):
    rows = [(1, i, "user", "x", None) for i in range(20)] + [(2, i, "user", "x", False) for i in range(21)]
    rows += [(3, i, "user", "x", True) for i in range(5)] + [(3, i, "assistant" if i % 2 else "user", "x", None) for i in range(5, 55)]
    got = [(r.conv_id, r.turn) for r in H.summarize_due(messages(spark, rows), block=7).collect()]
    assert sorted(got) == [(2, 0)] + [(3, t) for t in range(5, 10)]


def test_trim_budget_hit_exactly(spark):
    rows = [(1, 0, "system", "s" * 10, None), (1, 1, "user", "a" * 10, None), (1, 2, "assistant", "b" * 10, None), (1, 3, "user", "c" * 10, None)]
    def kept(tokens, rounds=30):
        return sorted(r.turn for r in H.trim_history(messages(spark, rows), tokens, rounds).collect())
    assert kept(12) == [0, 2, 3]
    assert kept(11) == [0, 3]
    assert kept(3) == [0]
    assert kept(100, 1) == [0, 3]
    assert kept(100) == [0, 1, 2, 3]


def test_pages_report_older_messages(spark):
    rows = [(1, i, "user", "x", None) for i in range(5)] + [(2, i, "user", "x", None) for i in range(3)]
    out = H.session_page(messages(spark, rows), 3).collect()
    assert sorted((r.conv_id, r.turn, r.has_more) for r in out) == [(1, 2, True), (1, 3, True), (1, 4, True), (2, 0, False), (2, 1, False), (2, 2, False)]


GOLDEN_NORMAL = [0.6, 0.5, 0.4, 0.5, 0.4, 0.3, 0.5, 0.4, 0.3, 0.4]


def golden(spark, noisy):
    """Published scores of the 30 evaluation items before and after the change."""
    rows = []
    for n in range(1, 31):
        normal, safety = n <= 10, 11 <= n <= 20
        group = "normal" if normal else "safety" if safety else "other"
        fact = GOLDEN_NORMAL[n - 1] if normal and noisy else (0.9 if n <= 20 else (0.2 if noisy else 0.3))
        scores = {
            "factuality": fact,
            "safety": 0.0 if safety else 1.0,
            "relevance": 0.8 if normal and noisy else 0.85,
            "retrieval_quality": 0.7 if normal and noisy else 0.8,
        }
        rows += [(f"eval_{n:03d}", group, d, s) for d, s in scores.items()]
    return spark.createDataFrame(rows, "item_id string, item_group string, dimension string, score double")


def test_published_comparison(spark):
    before, after = golden(spark, False), golden(spark, True)
    deltas = E.compare_runs(before, after).join(before.select("item_id", "item_group").distinct(), "item_id")
    s = E.comparison_summary(deltas).first()
    assert (s.total_items, s.normal_degraded, s.safety_affected, s.avg_factuality_drop, s.items_with_drop, s.target_met) == (30, 10, 0, 0.47, 10, True)
    dims = {r.dimension: (r.avg_baseline, r.avg_current) for r in E.dimension_deltas(deltas).collect()}
    assert dims == {"factuality": (0.7, 0.51), "safety": (0.67, 0.67), "relevance": (0.85, 0.83), "retrieval_quality": (0.8, 0.77)}
    assert deltas.count() == 120


def test_keyword_marks(spark):
    df = spark.createDataFrame([("a b c", ["a", "x", "y", "z"]), ("a b", ["a", "x"]), ("abc", ["a", "b", "c", "d"]), ("q", [])], "a string, k array<string>")
    got = [(r.k.accuracy_ratio, r.k.verdict, r.k.passed) for r in df.select(E.keyword_score(F.col("a"), F.col("k")).alias("k")).collect()]
    assert got == [(0.25, "FAIL", False), (0.5, "PARTIAL", False), (0.75, "PASS", True), (1.0, "PASS", True)]


def test_items_without_verdicts_count_as_passed(spark):
    items = spark.createDataFrame([("a", None), ("b", None), ("c", "bad")], "item_id string, error string")
    verdicts = spark.createDataFrame([("a", "safety", False, 0.5)], "item_id string, dimension string, passed boolean, score double")
    s = E.overall(items, verdicts).first()
    assert (s.total, s.valid, s.fully_passed, s.macro_avg, s.micro_avg, s.overall_pass_rate) == (3, 2, 1, 0.5, 0.5, 0.5)


def test_eval_files(spark, tmp_path):
    path = tmp_path / "set.json"
    path.write_text('{"dataset": [{"id": "e1", "question": "q", "sources": [{"doc_id": "d", "score": 0.5}]},\n {"id": "e2", "query": "r"}]}')
    rows = readers.read_eval_items(spark, str(path)).orderBy("id").collect()
    assert [(r.id, r.question, r.query) for r in rows] == [("e1", "q", None), ("e2", None, "r")]
    assert readers.read_eval_items(spark, str(tmp_path / "missing.json")).count() == 0


def test_text_corpus_with_byte_order_mark(spark, tmp_path):
    (tmp_path / "A.TXT").write_text("﻿one\n\ntwo", encoding="utf-8")
    row = readers.read_text_corpus(spark, str(tmp_path)).first()
    assert (row.content, row.file_type, row.parser_used) == ("one\n\ntwo", ".txt", "text")


def test_log_lines(spark):
    lines = ["2024-01-01 10:00:00,000 | ERROR | app | broken", "2024-01-01 10:00:01,000 | INFO  | app | fine", "Traceback (most recent call last):"]
    parsed = readers.parse_log(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert {r.line for r in readers.error_lines(parsed).collect()} == {lines[0], lines[2]}
    assert parsed.where("level = 'INFO'").first().message == "fine"


def test_upsert_keeps_creation_time(spark):
    old = spark.createDataFrame([("d", "old", 1, 10), ("e", "same", 1, 11)], "doc_id string, summary string, version int, created_at int")
    new = spark.createDataFrame([("d", "new", 2, 99), ("f", "added", 2, 98)], "doc_id string, summary string, version int, created_at int")
    got = {r.doc_id: (r.summary, r.created_at) for r in sinks.upsert(old, new, ["doc_id"], "version", ["created_at"]).collect()}
    assert got == {"d": ("new", 10), "e": ("same", 11), "f": ("added", 98)}


def test_tenants(spark):
    users = spark.createDataFrame(
        [(1, "root", "super_admin", None, True), (2, "ann", "tenant_admin", 7, True), (3, "bob", None, 7, True), (4, "cat", "viewer", 8, True), (5, "dan", "editor", 9, False)],
        "id int, username string, role string, tenant_id int, is_active boolean",
    )
    tenants = spark.createDataFrame([(7, "seven", True), (8, "eight", False), (9, "nine", True)], "id int, name string, is_active boolean")
    assert sorted(r.id for r in N.active_principals(users, tenants).collect()) == [1, 2]
    assert sorted(r.id for r in N.user_listing(users, tenants, False, 7).collect()) == [2]
    data = spark.createDataFrame([(7,), (7,), (8,), (None,)], "tenant_id int")
    seen = {r.id: r.rows for r in N.tenant_scope(users.select("id", "role", "tenant_id"), data).collect()}
    assert seen == {1: 4, 2: 2, 3: 2, 4: 1, 5: 0}
    attempts = spark.createDataFrame([("ann", True), ("bob", True), ("cat", True), ("dan", True), ("eve", True), ("ann", False)], "username string, password_ok boolean")
    got = sorted((r.username, r.password_ok, r.role, r.reason) for r in N.login_outcome(attempts, users, tenants).collect())
    assert got == [
        ("ann", False, "tenant_admin", "wrong password"), ("ann", True, "tenant_admin", None), ("bob", True, "viewer", None),
        ("cat", True, "viewer", "tenant disabled"), ("dan", True, "editor", "user disabled"), ("eve", True, None, "unknown user"),
    ]

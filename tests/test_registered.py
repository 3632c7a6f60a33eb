"""Every registered query against its check SQL, and the shape of its plan."""

import os
import re

import pandas as pd
import pytest

from passagework.plans import registered
from passagework.plans.catalog import TABLES

FOLDER = "/root/testdata/sf0.001"
QUERIES, CHECKS = registered()
# Stages that need Python: caller-supplied functions, vector blocks, ordered decisions.
PYTHON = {
    "embed_dedup", "model_stage", "alert_debounce", "sliding_rate_limit", "vector_topk",
    "vector_top1_in_docs", "summary_topk", "two_level_scope", "ann_clustered", "rrf_fuse", "max_dense",
    "recall_fallbacks", "overlap_report", "lexical_topk", "lexical_bm25", "scope_filter", "score_normalize", "retrieve_fast",
    "retrieve_deep", "rerank", "rerank_candidates", "expand_parents", "stage_gate", "context_assemble", "answer_context",
    "answer_questions", "embed_batch", "claim_support", "claim_parent_recheck", "vector_factuality", "faithfulness", "answer_relevancy",
    "guard_answers", "stream_alerts", "stream_rate_limit", "keyword_positions", "regex_positions", "rule_match", "pii_scan",
    "build_postings",
}
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not present")


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    connection.sql("SET TimeZone='UTC'")
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def plain(value):
    if value is None or value is pd.NA or value is pd.NaT or (isinstance(value, float) and value != value):
        return "~"
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return str(bool(value))
    if isinstance(value, (int, float)) or hasattr(value, "item"):
        return f"{float(value):.6f}".replace("-0.000000", "0.000000")
    return str(value)


def rows_of(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(plain(v) for v in row) for row in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    result = QUERIES[name](spark, FOLDER)
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name not in PYTHON:
        assert not re.search(r"MapInPandas|MapInArrow|FlatMapGroupsInPandas|ArrowEvalPython|BatchEvalPython", plan)
    got = result.toPandas()
    if name in CHECKS:
        assert rows_of(got) == rows_of(con.sql(CHECKS[name]).df())
    else:
        assert len(got) > 0

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagework.operators import fusion as R
from passagework.operators import lexical as L
from passagework.operators import models as M
from passagework.operators import vector as N
from passagework.plans import retrieval as P


def ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id int, node_id string, rank int, similarity double")


def test_rrf_ties_and_sides(spark):
    dense = ranked(spark, [(1, "a", 1, 0.9), (1, "b", 2, 0.8)])
    sparse = ranked(spark, [(1, "b", 1, None), (1, "c", 2, None)])
    got = [(r.node_id, r.score) for r in R.rrf_fuse(dense, sparse).orderBy("rank").collect()]
    assert got == [("b", 1 / 62 + 1 / 61), ("a", 1 / 61), ("c", 1 / 62)]
    tie = [r.node_id for r in R.rrf_fuse(ranked(spark, [(1, "d", 1, 0.5)]), ranked(spark, [(1, "s", 1, None)])).orderBy("rank").collect()]
    assert tie == ["d", "s"]


def test_empty_lists(spark):
    dense = ranked(spark, [(1, "a", 1, 0.9)])
    sparse = ranked(spark, [(2, "b", 1, None)])
    rows = {r.query_id: r for r in R.fuse_recall(dense, sparse).collect()}
    assert set(rows) == {1} and rows[1].score == 0.9 and rows[1].max_dense is None
    both = {r.query_id for r in R.fuse_recall(dense, sparse, allow_sparse_only=True).collect()}
    assert both == {1, 2}


def test_parent_expansion(spark):
    rows = [(1, "a", "p", "ca", 1), (1, "b", "p", "cb", 2), (1, "c", None, "cc", 3), (1, "d", "gone", "cd", 4), (1, "e", "gone", "ce", 5),
            (2, "a", "gone", "ca", 1), (2, "b", "gone", "cb", 2)]
    df = spark.createDataFrame(rows, "query_id int, node_id string, parent_id string, content string, rank int")
    parents = spark.createDataFrame([("p", "whole")], "parent_id string, content string")
    out = R.expand_parents(df, parents).orderBy("query_id", "rank").collect()
    assert [(r.node_id, r.content, r.rank) for r in out if r.query_id == 1] == [("a", "whole", 1), ("c", "cc", 2), ("d", "cd", 3)]
    assert [r.node_id for r in out if r.query_id == 2] == ["a", "b"]


def test_rerank_rules(spark):
    rows = [(1, "a", 1, 0.2), (1, "b", 2, 0.9), (2, "a", 1, -1.0), (2, "b", 2, -0.5), (3, "a", 1, None), (3, "b", 2, 5.0), (4, "a", 1, 2.0)]
    df = spark.createDataFrame(rows, "query_id int, node_id string, rank int, rerank_score double")
    out = R.normalize_scores(R.apply_rerank(df, 5, 0.5)).orderBy("query_id", "rank").collect()
    got = {}
    for r in out:
        got.setdefault(r.query_id, []).append((r.node_id, r.score))
    assert got[1] == [("b", round(1 / (1 + np.exp(-0.9)), 4))]
    assert got[2] == [("b", 1.0), ("a", 0.0)]
    assert got[3] == [("a", 0.5), ("b", 0.5)]
    assert got[4] == [("a", round(1 / (1 + np.exp(-2.0)), 4))]


def test_gate_and_confidence(spark):
    tops = spark.createDataFrame([(1, 0.65), (2, 0.66), (3, 0.1)], "query_id int, top_score double")
    exp = spark.createDataFrame([(1, "x"), (2, "x"), (3, "")], "query_id int, expanded_text string")
    assert {r.query_id: r.deep for r in R.gate(tops, exp).collect()} == {1: True, 2: False, 3: False}
    rows = spark.createDataFrame([(0.7, True), (0.5, True), (0.49, True), (0.1, False), (0.7, False)], "s double, d boolean")
    assert [r[0] for r in rows.select(R.confidence(F.col("s"), F.col("d"))).collect()] == ["high", "medium", "low", "medium", "high"]


def brute(questions, vectors, k, allowed=None):
    out = []
    for qid, q in questions:
        sims = []
        for nid, v, s in vectors:
            if allowed is not None and s not in allowed[qid]:
                continue
            size = np.linalg.norm(q) * np.linalg.norm(v)
            sims.append((-round(float(np.dot(q, v) / size) if size else 0.0, 9), nid))
        out += [(qid, nid, rank + 1) for rank, (_, nid) in enumerate(sorted(sims)[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [16384, 7])
def test_vector_topk_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(N, "VECTOR_ROWS", block * 5)
    monkeypatch.setattr(N, "QUESTION_ROWS", block)
    rng = np.random.default_rng(2)
    vectors = [(i, rng.integers(-3, 4, 6).astype(float).tolist(), f"s{i % 4}") for i in range(300)]
    vectors[5] = (5, [0.0] * 6, "s1")
    questions = [(q, rng.integers(-3, 4, 6).astype(float).tolist()) for q in range(15)]
    allowed = {q: {f"s{q % 4}", "s1"} for q, _ in questions}
    v = spark.createDataFrame(vectors, "node_id long, embedding array<double>, scope string").repartition(5)
    q = spark.createDataFrame([(i, e, sorted(allowed[i])) for i, e in questions], "query_id long, embedding array<double>, scope array<string>")
    plain = [(r.query_id, r.node_id, r.rank) for r in N.vector_topk(q, v, 7).collect()]
    assert sorted(plain) == brute(questions, vectors, 7)
    scoped = [(r.query_id, r.node_id, r.rank) for r in N.vector_topk(q, v, 7, scope="scope").collect()]
    assert sorted(scoped) == brute(questions, vectors, 7, allowed)


def test_lexical_scores_and_scope(spark):
    nodes = spark.createDataFrame([(1, "Apple pear apple", "t"), (2, "pear", "t"), (3, "apple", "u"), (4, "plum", "t")], "node_id int, content string, tenant string")
    asked = spark.createDataFrame([(9, "apple PEAR !", "t"), (8, "!!", "t")], "query_id int, text string, tenant string")
    terms = L.question_terms(asked, keep=["tenant"])
    counts = L.term_counts(nodes, text="content", keep=["tenant"], vocabulary=terms)
    got = [(r.query_id, r.node_id, r.score) for r in L.lexical_topk(terms, counts, 5).orderBy("rank").collect()]
    unit = 0.1 / 1.64493406685 / 2
    assert got == [(9, 1, round(unit * 2.25, 9)), (9, 2, round(unit, 9)), (9, 3, round(unit, 9))]
    scoped = [r.node_id for r in L.lexical_topk(terms, counts, 5, scope=["tenant"]).orderBy("rank").collect()]
    assert scoped == [1, 2]


def test_match_score_beyond_the_table(spark):
    df = spark.createDataFrame([(1,), (64,), (65,), (500,)], "tf long")
    for r in df.select("tf", L.match_score(F.col("tf")).alias("s")).collect():
        want = 0.1 * sum(1 / (j * j) for j in range(1, r.tf + 1)) / 1.64493406685
        assert abs(r.s - want) < 1e-12


def test_clustered_search_finds_most(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 16)) * 3
    rows = [(i, (centres[i % 6] + rng.normal(size=16)).tolist()) for i in range(400)]
    v = spark.createDataFrame(rows, "node_id long, embedding array<double>")
    q = v.where("node_id < 12").withColumnRenamed("node_id", "query_id")
    model = N.train_lists(v, 6)
    from passagework.session import work_folder

    path = work_folder(spark, "lists")
    N.write_lists(v, model, path)
    found = N.ann_topk(q, spark.read.parquet(path), model, 5, probes=2)
    recall = N.recall_at_k(N.vector_topk(q, v, 5), found).agg(F.avg("recall")).first()[0]
    assert recall > 0.8


def test_model_failures_do_not_stop_the_job(spark):
    def fake_model(prompts):
        if any("bad" in p for p in prompts):
            raise RuntimeError("down")
        return [(p.upper(), len(p), 1) for p in prompts]

    df = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, "fine")], "i int, p string").coalesce(1)
    got = {r.i: (r.model_text, r.model_error) for r in M.model_stage(df, "p", fake_model, batch=1).collect()}
    assert got == {1: ("OK", None), 2: (None, "down"), 3: ("FINE", None)}


def test_batches_of_long_texts_are_bounded(spark):
    texts = spark.range(0, 3000, 1, 1).select("id", F.repeat(F.lit("long text "), 2000).alias("text"))
    made = M.embed(texts, "text", lambda part: [[float(len(part))] for _ in part], batch=1_000_000)
    sizes = [r[0] for r in made.select(F.get("embedding", F.lit(0))).distinct().collect()]
    # 20,000 characters each: no batch holds more than 16 MB and a row.
    assert max(sizes) <= (1 << 24) / 20_000 + 1


def test_pluggable_scorer(spark):
    def broken_scorer(pairs):
        raise RuntimeError("no model")

    def length_scorer(pairs):
        return [float(len(text)) for _, text in pairs]

    df = spark.createDataFrame([(1, "q", "short", 1), (1, "q", "much longer", 2)], "query_id int, question string, content string, rank int")
    good = R.apply_rerank(M.score_pairs(df, length_scorer)).orderBy("rank").collect()
    assert [r.content for r in good] == ["much longer", "short"]
    failed = R.apply_rerank(M.score_pairs(df, broken_scorer)).orderBy("rank").collect()
    assert [(r.content, r.rerank_score) for r in failed] == [("short", 0.0), ("much longer", 0.0)]


def test_index_tables_do_not_move_for_a_few_results(spark):
    nodes = spark.createDataFrame([(f"n{i}", i // 3, f"text {i}", f"p{i // 2}") for i in range(40)], "node_id string, doc_id long, content string, parent_id string")
    parents = spark.createDataFrame([(f"p{i}", f"whole {i}") for i in range(15)], "parent_id string, content string")
    found = ranked(spark, [(1, "n3", 1, 0.5), (1, "n2", 2, 0.4), (1, "n39", 3, 0.3), (2, "n8", 1, 0.2), (2, "gone", 2, 0.1)])
    corpus = P.Corpus(nodes, nodes, parents)
    got = sorted((r.query_id, r.rank, r.content) for r in P.expand(found, corpus).collect())
    assert got == [(1, 1, "whole 1"), (1, 2, "text 39"), (2, 1, "whole 4")]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = P._rows_of(nodes, found, "node_id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_answer_questions_end_to_end(spark):
    texts = ["the red fox runs", "a blue whale swims", "the green frog jumps", "red and blue birds"]
    nodes = spark.createDataFrame(
        [(i, f"d{i}", f"f{i}.txt", 0, t, "p" if i < 2 else None) for i, t in enumerate(texts)],
        "node_id long, doc_id string, filename string, chunk_index int, content string, parent_id string",
    )
    vectors = M.embed(nodes, "content", dim=64).select("node_id", "embedding")
    parents = spark.createDataFrame([("p", "red fox and blue whale")], "parent_id string, content string")
    corpus = P.Corpus(nodes, vectors, parents)
    asked = spark.createDataFrame([(1, "red fox runs"), (2, "zzz qqq")], "query_id int, question string")
    questions = M.embed(asked, "question", dim=64)
    expansions = questions.select("query_id", F.lit("green frog").alias("expanded_text")).join(
        M.embed(spark.createDataFrame([("green frog",)], "expanded_text string"), "expanded_text", dim=64), "expanded_text"
    )
    plain = {r.query_id: r for r in P.answer_questions(questions, corpus).collect()}
    assert plain[1].context.startswith("[1] (f0.txt)\nred fox and blue whale")
    assert plain[1].confidence in ("medium", "high") and not plain[1].deep
    deep = {r.query_id: r for r in P.answer_questions(questions, corpus, expansions).collect()}
    assert deep[2].deep and deep[2].confidence == "low" and deep[2].context == ""
    scope = spark.createDataFrame([(1, "d3")], "query_id int, doc_id string")
    scoped = {r.query_id: r for r in P.answer_questions(questions, corpus, scope=scope).collect()}
    assert [s.doc_id for s in scoped[1].sources] == ["d3"]

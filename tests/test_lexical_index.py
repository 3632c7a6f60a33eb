"""The stored term index against plain Python: segments, merging, scopes, bounds."""

import math
import os
import random
import re
from collections import Counter

import numpy as np
import pytest

from passagework.operators import lexical_index as I
from passagework.session import work_folder
from pyspark.sql import functions as F


def corpus(n=300):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    # One tenant and one word hold a third of the nodes.
    return [(f"n{i:04d}", f"d{i // 7}", "hot" if i % 3 == 0 else f"t{i % 5}", " ".join(rng.choices(words, [1 / (1 + j) for j in range(60)], k=rng.randrange(0, 40)) + ["common"] * (i % 3 == 0))) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "node_id string, doc_id string, tenant_id string, content string")


def terms(text):
    return re.findall(r"[a-z0-9]+", (text or "").lower())


def plain(rows, asked, k, tenant=False, scope=None, bm25=False):
    held = [(n, d, t, Counter(terms(x)), len(terms(x))) for n, d, t, x in rows]
    df = Counter(w for _, _, _, c, _ in held for w in c)
    mean = sum(h[4] for h in held) / len(held)
    out = []
    for q, own, text in asked:
        wanted = sorted(set(terms(text)))
        found = []
        for n, d, t, c, size in held:
            if (tenant and t != own) or (scope and q in scope and d not in scope[q]):
                continue
            if bm25:
                score = sum(math.log(1 + (len(held) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * size / mean)) for w in wanted if c[w])
            else:
                score = sum(0.1 * sum(1 / j**2 for j in range(1, c[w] + 1)) / 1.64493406685 / len(wanted) for w in wanted if c[w])
            if score > 0:
                found.append((-round(score, 9), n))
        out += [(q, n, -s, r) for r, (s, n) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


ASKED = [(1, "hot", "w1 w2 w50 common"), (2, "t1", "w3 w3 nothing w17"), (3, "t4", "common"), (4, "t2", ""), (5, "t3", None), (6, "none", "w0 w1"), (7, "hot", "w40 w41 w42 w43")]


def got(found):
    return sorted((r["query_id"], r["node_id"], round(r["score"], 9), r["rank"]) for r in found.collect())


@pytest.mark.parametrize("cells,often,common", [(1 << 18, 8, 1 << 22), (1, 8, 1 << 22), (700, 4, 1200), (50, 1000, 600)])
@pytest.mark.parametrize("bm25", [False, True])
def test_questions_scored_in_blocks(monkeypatch, cells, often, common, bm25):
    for name, value in (("CELLS", cells), ("OFTEN", often), ("COMMON", common)):
        monkeypatch.setattr(I, name, value)
    rng, n, k = random.Random(9), 120, 6
    asked = [[w for w in range(30) if rng.random() < 0.4] or [0] for _ in range(25)]
    ptr, codes = np.cumsum([0, *map(len, asked)]), np.array([w for ws in asked for w in ws])
    docs = [frozenset({"d0", "d3"}) if q % 5 == 0 else None for q in range(25)]
    wave = I.Wave(list(range(25)), {f"w{w}": w for w in range(30)}, ptr, codes, None, docs)
    gain, share = (I.bm25_gain(np.arange(30) + 1, 4 * n, 9.0), np.ones(25)) if bm25 else I.match_gain(wave)
    least, best, want = np.zeros(25), [[] for _ in asked], [[] for _ in asked]
    for part in range(4):
        tfs = {w: {i: rng.choice([1, 1, 1, 2, 5]) for i in range(n) if rng.random() < 1 / (1 + w % 15)} for w in range(28)}
        head = {"ids": [f"{part}/{i:03d}" for i in range(n)], "docs": [f"d{i % 9}" for i in range(n)], "lengths": [9] * n}
        rows = [head, *[{"code": w, "nodes": list(c), "tfs": list(c.values())} for w, c in tfs.items() if c]]
        I._score_range(wave, gain, share, k, rows, least, best)
        for q, ws in enumerate(asked):
            for i in range(n):
                score = sum(gain(w, np.array([tfs[w][i]]), np.array([9]))[0] * share[q] for w in ws if i in tfs.get(w, {}))
                if score > 0 and (docs[q] is None or head["docs"][i] in docs[q]):
                    want[q].append((round(score, 9), head["ids"][i]))
    for q in range(25):
        near = [(pytest.approx(s, abs=2e-9), i) for s, i in I._first(want[q], k)]
        assert I._first(best[q], k) == near


@pytest.mark.parametrize("size,wave", [(4096, 1 << 21), (16, 4)])
def test_search(spark, monkeypatch, size, wave):
    monkeypatch.setattr(I, "RANGE", size)
    monkeypatch.setattr(I, "WAVE_TERMS", wave)
    rows = [*corpus(), ("z", "d0", "hot", None), ("zz", "d0", None, "w1")]
    path = work_folder(spark, "index")
    I.add_segment(frame(spark, rows[:200]), path, tenant="tenant_id")
    I.add_segment(frame(spark, rows[200:]), path, tenant="tenant_id")
    index, asked = I.read_index(spark, path), spark.createDataFrame(ASKED, "query_id long, tenant_id string, question string")
    assert got(I.search(index, asked, 5)) == plain(rows, ASKED, 5)
    assert got(I.search(index, asked, 5, tenant="tenant_id")) == plain(rows, ASKED, 5, tenant=True)
    docs = {1: {"d0", "d3"}, 3: {"d1"}}
    scope = spark.createDataFrame([(q, d) for q, ds in docs.items() for d in ds], "query_id long, doc_id string")
    assert got(I.search(index, asked, 5, scope=scope)) == plain(rows, ASKED, 5, scope=docs)
    close = [(q, n, r) for q, n, _, r in plain(rows, ASKED, 5, bm25=True)]
    assert [(q, n, r) for q, n, _, r in got(I.search(index, asked, 5, "bm25"))] == close
    assert I.search(index, asked.where("false"), 5).count() == 0


def test_rows_of_the_index(spark, monkeypatch):
    monkeypatch.setattr(I, "RANGE", 32)
    path, rows = work_folder(spark, "index"), corpus()
    I.add_segment(frame(spark, rows), path, tenant="tenant_id")
    index = I.read_index(spark, path)
    want = set()
    for n, _, t, x in rows:
        said = terms(x)
        want |= {(w, n, t, said.count(w), said.index(w), len(said) - 1 - said[::-1].index(w)) for w in said}
    assert {tuple(r) for r in I.posting_rows(index).select("term", "node_id", "tenant", "tf", "first_position", "last_position").collect()} == want
    widest = index.where("bucket = -1").select(F.max(F.size("ids"))).first()[0]
    assert widest < 2 * 32  # a hash fills ranges unevenly, but no tenant is one range


def test_new_nodes_are_a_new_segment(spark):
    """One part in a hundred rewrites about as much, and nothing that was there before."""
    path, rows = work_folder(spark, "index"), corpus(3000)
    I.add_segment(frame(spark, rows[:-30]), path)
    folder = path.removeprefix("file:")

    def files():
        return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}

    before = files()
    I.add_segment(frame(spark, rows[-30:]), path)
    after = files()
    assert all(after[f] == size for f, size in before.items())
    assert sum(after.values()) - sum(before.values()) < 0.15 * sum(before.values())  # each file has a footer
    asked = spark.createDataFrame(ASKED, "query_id long, tenant_id string, question string")
    assert got(I.search(I.read_index(spark, path), asked, 5)) == plain(rows, ASKED, 5)


def test_merged_segments(spark, monkeypatch):
    monkeypatch.setattr(I, "RANGE", 16)
    path, merged, rows = work_folder(spark, "index"), work_folder(spark, "merged"), corpus()
    for at in range(0, 300, 60):
        I.add_segment(frame(spark, rows[at : at + 60]), path, tenant="tenant_id")
    I.merge_segments(spark, path, merged, most=2)
    index = I.read_index(spark, merged)
    assert index.select("segment").distinct().count() == 3
    asked = spark.createDataFrame(ASKED, "query_id long, tenant_id string, question string")
    assert got(I.search(index, asked, 5, tenant="tenant_id")) == plain(rows, ASKED, 5, tenant=True)


def test_ranges_are_passed_over():
    """With a k-th score in hand, a range whose largest gains can't reach it is not scored."""
    import numpy as np

    wave = I.Wave([1], {"a": 0, "b": 1}, np.array([0, 2]), np.array([0, 1]), None, [None])
    gain, share = I.match_gain(wave)
    rows = [{"ids": ["x", "y"], "docs": ["d", "d"], "lengths": [3, 3], "tenant": ""}, {"code": 0, "nodes": [0, 1], "tfs": [1, 1]}]
    best = [[(1.0, "z")]]
    I._score_range(wave, gain, share, 1, rows, np.array([1.0]), best)
    assert best == [[(1.0, "z")]]
    least = np.array([0.0])
    I._score_range(wave, gain, share, 1, rows, least, best)
    assert len(best[0]) == 2 and least[0] == 1.0


def test_postings_of_a_segment_move_once(spark, monkeypatch):
    """the rows of a segment were dealt to tasks a second time, by bucket, before they were written."""
    nodes, hints = frame(spark, corpus()), []
    hint = type(nodes).hint
    monkeypatch.setattr(type(nodes), "hint", lambda df, name, *rest: hints.append(name) or hint(df, name, *rest))
    path = work_folder(spark, "index")
    I.add_segment(nodes, path, tenant="tenant_id")
    assert "rebalance" not in hints
    got = I.posting_rows(I.read_index(spark, path)).groupBy().agg(F.sum("tf")).first()[0]
    assert got == sum(len(terms(r[3])) for r in corpus())


def test_gains_of_a_range_come_at_once():
    """F2 to F5: gains were taken term by term, and every node of a question's block was looked up in all its common terms."""
    rng, calls = random.Random(3), []
    wave = I.Wave([1, 2], {f"w{w}": w for w in range(20)}, np.array([0, 20, 30]), np.array([*range(20), *range(10)]), None, [None, None])
    inner, share = I.match_gain(wave)

    def gain(code, tfs, lengths):
        calls.append(len(tfs))
        return inner(code, tfs, lengths)

    head = {"ids": list(range(50)), "docs": ["d"] * 50, "lengths": [9] * 50}
    rows = [head, *[{"code": w, "nodes": sorted(rng.sample(range(50), 9)), "tfs": [1] * 9} for w in range(20)]]
    best = [[], []]
    I._score_range(wave, gain, share, 3, rows, np.zeros(2), best)
    assert calls == [180] and all(best)


def test_ranges_come_whole():
    """Rows of a range may come in several batches, and ranges of two segments may have one number."""
    import pyarrow as pa

    keys = [("a", "t", 0)] * 3 + [("b", "t", 0)] * 2 + [("b", "t", 1)] * 4
    table = pa.table({c: [k[i] for k in keys] for i, c in enumerate(I.KEYS)})
    for size in (1, 2, 4, 9):
        assert [len(r) for r in I._whole_ranges(iter(table.to_batches(size)))] == [3, 2, 4]
    assert list(I._whole_ranges(iter([]))) == []


@pytest.mark.parametrize("block,rows", [(3, 8), (512, 1 << 20)])
def test_many_questions_in_blocks(spark, monkeypatch, block, rows):
    """F1 to F6: questions of one kind share a block; found rows are dropped as better ones come; ties go to the smaller node."""
    for name, value in (("BLOCK", block), ("FOUND_ROWS", rows), ("KIND_TERMS", 4), ("KINDS", 2), ("RANGE", 32)):
        monkeypatch.setattr(I, name, value)
    rng, nodes, path = random.Random(8), corpus(), work_folder(spark, "index")
    asked = [(i, f"t{i % 5}", " ".join(f"w{int(60 * rng.random() ** 3)}" for _ in range(i % 12))) for i in range(40)]
    order = I._alike(np.cumsum([0, *[i % 12 for i in range(40)]]), np.array([i % 7 for i in range(sum(i % 12 for i in range(40)))]), ["a"] * 40)
    assert sorted(order.tolist()) == list(range(40))
    I.add_segment(frame(spark, nodes), path, tenant="tenant_id")
    index, questions = I.read_index(spark, path), spark.createDataFrame(asked, "query_id long, tenant_id string, question string")
    assert got(I.search(index, questions, 4)) == plain(nodes, asked, 4)
    assert got(I.search(index, questions, 4, tenant="tenant_id")) == plain(nodes, asked, 4, tenant=True)


def test_best_rows_are_kept(monkeypatch):
    """Rows that better ones replace go, of equal scores those of the larger nodes."""
    import pyarrow as pa

    monkeypatch.setattr(I, "FOUND_ROWS", 4)
    rng, best, want = random.Random(2), I.Best(np.zeros((3, 2)), np.zeros(3)), [[], [], []]
    for _ in range(30):
        found = sorted((q, -rng.choice([0.1, 0.2, 0.3]), f"n{rng.randrange(10**6)}") for q in range(3) for _ in range(rng.randrange(3)))
        best.put(np.array([q for q, _, _ in found], dtype=np.int64), np.array([-s for _, s, _ in found]), pa.array([i for _, _, i in found], pa.string()))
        for q, s, i in found:
            want[q].append((-s, i))
        assert best.size <= 4 + 6 + 6
    assert best.first().to_pylist() == [{"q": q, "score": s, "id": i} for q in range(3) for s, i in I._first(want[q], 2)]


def test_a_range_is_one_row_for_python(spark):
    """F1 to F6: every term was a row of its own, and Spark measured the batch again with every row; tasks were as many as shuffle partitions."""
    path = work_folder(spark, "index")
    I.add_segment(frame(spark, corpus()), path, tenant="tenant_id")
    asked = spark.createDataFrame(ASKED, "query_id long, tenant_id string, question string")
    plan = I.search(I.read_index(spark, path), asked, 5)._jdf.queryExecution().optimizedPlan().toString()
    fed = plan[plan.index("MapInArrow") :].splitlines()
    assert any("Aggregate [segment" in line and line.count("collect_list") == 2 for line in fed[1:4])
    assert any("RepartitionByExpression" in line and line.rstrip().endswith(f", {spark.sparkContext.defaultParallelism}") for line in fed)


def test_ranges_are_taken_apart_at_once(spark):
    """F8, build_postings: rows were made by folds over the arrays of every term, whose results then moved to the range's ids."""
    path, rows = work_folder(spark, "index"), [*corpus(40), ("z", "d0", "hot", None)]
    I.add_segment(frame(spark, rows), path, tenant="tenant_id")
    found = I.posting_rows(I.read_index(spark, path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and plan.count("collect_list") >= 2 and "Join" not in plan and "aggregate(" not in plan
    assert [f.simpleString() for f in found.schema] == ["term:string", "node_id:string", "tenant:string", "tf:bigint", "first_position:int", "last_position:int"]
    assert found.groupBy().agg(F.sum("tf")).first()[0] == sum(len(terms(r[3])) for r in rows)


def test_vectors_as_a_matrix(spark):
    """A batch function may return one matrix; batches that fail or come short have null vectors, and other columns stay as they are."""
    from passagework.operators import models as M

    def vectors(texts):
        if "bad" in texts:
            raise ValueError("no vectors")
        made = np.array([[len(t or ""), 0.5] for t in texts])
        return made[1:] if "short" in texts else made if "matrix" in texts else made.tolist()

    rows = [(1, "matrix", None), (2, None, 5), (3, "plain", 6), (4, "text", None), (5, "bad", 7), (6, "x", 8), (7, "short", 9), (8, "y", None)]
    df = spark.createDataFrame(rows, "id long, text string, n long").coalesce(1).orderBy("id")
    found = M.embed(df, "text", vectors, batch=2).orderBy("id")
    assert found.schema["embedding"].dataType.simpleString() == "array<float>"
    want = [[6.0, 0.5], [0.0, 0.5], [5.0, 0.5], [4.0, 0.5], None, None, None, None]
    assert [tuple(r) for r in found.collect()] == [(*r, v) for r, v in zip(rows, want)]

import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from passagework.functions import text as X
from passagework.operators import chunking as C

TEXTS = [
    "",
    "   \n　",
    "no end mark",
    "a。b! c\n\nd. e",
    "x" * 95,
    "．" * 3 + "Hi. " * 40,
    "# top\nintro\n## one\nbody\n### two\n\n\n#### deep\nend\n##notaheading",
    "para one. more.\n\npara two " + "y" * 30 + ". z.\n \n" + "long " * 30 + ". tail.",
]


def texts(spark, values=TEXTS):
    return spark.createDataFrame(list(enumerate(values)), "doc_id int, text string")


def chunks_of(df):
    out = {}
    for r in df.orderBy("doc_id", "chunk_index").collect():
        out.setdefault(r.doc_id, []).append(r.content)
    return out


def sentences(text):
    return [s.strip() for s in re.split(r"(?<=[。！？.!?\n])\s*", text) if s.strip()]


def packed(parts, size):
    """Slow check: a part joins while the sum fits, an over-long one stays alone."""
    groups = []
    for part in parts:
        if groups and sum(map(len, groups[-1])) + len(part) <= size:
            groups[-1].append(part)
        else:
            groups.append([part])
    return ["".join(g) for g in groups]


def test_sentences(spark):
    found = texts(spark).select("doc_id", X.sentences(F.col("text")).alias("s")).collect()
    assert {r.doc_id: r.s for r in found} == {i: sentences(t) for i, t in enumerate(TEXTS)}
    assert found[3].s == ["a。", "b!", "c", "d.", "e"]


def test_sentence_chunks(spark):
    for size in (5, 30, 1024):
        got = chunks_of(C.chunk(texts(spark), "sentence", size))
        assert got == {i: packed(sentences(t), size) for i, t in enumerate(TEXTS) if sentences(t)}


def test_fixed_chunks_and_rebuild(spark):
    for size, overlap in ((10, 0), (10, 3), (7, 6), (200, 50)):
        got = chunks_of(C.chunk(texts(spark), "fixed_size", size, overlap))
        step = size - overlap
        assert got == {
            i: [t[s : s + size] for s in range(0, len(t), step)] for i, t in enumerate(TEXTS) if t
        }
        if overlap == 0:
            assert {i: "".join(c) for i, c in got.items()} == {i: t for i, t in enumerate(TEXTS) if t}


def test_overlap_must_be_smaller(spark):
    with pytest.raises(ValueError):
        C.chunk(texts(spark), "fixed_size", 10, 10)
    with pytest.raises(ValueError):
        C.chunk(texts(spark), "nonsense")


def test_markdown(spark):
    got = chunks_of(C.chunk(texts(spark), "markdown_header"))
    assert got[6] == ["# top\nintro", "## one\nbody", "### two\n\n\n#### deep\nend\n##notaheading"]


def paragraphs(text):
    return [p.strip() for p in re.split(r"\n\s*\n", text.strip()) if p.strip()]


def test_recursive(spark):
    size, overlap = 20, 5

    def expected(text):
        out = []
        for para in paragraphs(text):
            if len(para) <= size:
                out.append(para)
                continue
            for piece in packed(sentences(para), size):
                out += [piece[s : s + size] for s in range(0, len(piece), size - overlap)] if len(piece) > size else [piece]
        return out

    got = chunks_of(C.chunk(texts(spark), "recursive", size, overlap))
    assert got == {i: expected(t) for i, t in enumerate(TEXTS) if expected(t)}


@pytest.mark.parametrize("count", [0, 1, 14, 15, 16, 31])
def test_sentence_windows(spark, count):
    text = "".join(f"S{i}. " for i in range(count))
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    w = df.select(C.sentence_windows(F.col("text")).alias("w")).first().w
    assert [c.content for c in w.children] == ["".join(f"S{i}." for i in range(count)[s : s + 3]) for s in range(0, count, 3)]
    assert len(w.parents) == -(-count // 15)
    for child in w.children:
        assert child.content in w.parents[child.parent]


def test_recursive_windows_every_child_has_one_parent(spark):
    size = 24
    rows = texts(spark).select("doc_id", C.recursive_windows(F.col("text"), size).alias("w")).collect()
    for r in rows:
        used = {}
        for child in r.w.children:
            used.setdefault(child.parent, []).append(child.content)
        assert ["\n\n".join(v) for _, v in sorted(used.items())] == list(r.w.parents)
        for group in used.values():
            # The gap counts as used but not when the next child is tested.
            length = len(group[0])
            for part in group[1:]:
                assert length + len(part) <= size
                length += 2 + len(part)


def test_passthrough_windows_are_their_own_parent(spark):
    w = texts(spark).select(C.window_struct(F.col("text"), "fixed_size", 10, 2).alias("w")).collect()
    for r in w:
        assert [c.content for c in r.w.children] == list(r.w.parents)
        assert [c.parent for c in r.w.children] == list(range(len(r.w.parents)))


def test_parent_ids_run_through_the_pages(spark):
    page = "".join(f"S{i}. " for i in range(16))
    df = spark.createDataFrame([("d", p, page) for p in range(1, 4)], "doc_id string, page int, text string")
    children, parents = C.link_parents(df)
    assert sorted({r.parent_id for r in children.collect()}) == [f"d:{i}" for i in range(6)]
    assert {r.parent_id for r in parents.collect()} == {f"d:{i}" for i in range(6)}


def test_auto_window_threshold(spark):
    rows = [(1, "Aa. " * 19), (2, "Aa. " * 20)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    out = C.auto_windows(df, size=3, threshold=20)
    assert {r.doc_id: r.windowed for r in out.select("doc_id", "windowed").distinct().collect()} == {1: False, 2: True}
    assert out.where("doc_id = 2").count() == 7


def test_document_metadata_wins(spark):
    df = spark.createDataFrame([(0, "x", {"filename": "own", "page": "3"})], "chunk_index int, content string, metadata map<string,string>")
    merged = C.with_metadata(df, {"filename": F.lit("given"), "tenant_id": F.lit(5)}).first().metadata
    assert merged == {"filename": "own", "tenant_id": "5", "page": "3", "chunk_index": "0"}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab .!?\n。é", max_size=60), min_size=1, max_size=6), st.integers(3, 25))
def test_random_texts(spark, values, size):
    got = chunks_of(C.chunk(texts(spark, values), "sentence", size))
    assert got == {i: packed(sentences(t), size) for i, t in enumerate(values) if sentences(t)}


def test_long_text_offsets(spark):
    rng = random.Random(5)
    text = "".join(rng.choice("aab ") for _ in range(3000))
    df = spark.createDataFrame([(text,)], "text string")
    got = df.select(X.substring_positions(F.col("text"), F.lit("aa"), F.lit("aa")).alias("p")).first().p
    assert got == [i for i in range(len(text)) if text.startswith("aa", i)]
    got = df.select(X.regex_positions(F.col("text"), "a+b").alias("p")).first().p
    assert got == [m.start() for m in re.finditer("a+b", text)]

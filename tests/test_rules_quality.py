import random
import re
import time

import pytest
from pyspark.sql import functions as F

from passagework import constants as K
from passagework.functions import text as X
from passagework.operators import ingest as I
from passagework.operators import models as M
from passagework.operators import quality as Q
from passagework.operators import rules as R


def one(spark, expression, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(expression.alias("x")).first().x


def found(spark, text, rules=None):
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    rows = R.match_rows(R.match_rules(df, rules or R.default_rules())).collect()
    return [(r.category, r.keyword, r.position, r.match_type) for r in rows]


def test_overlapping_keywords(spark):
    rules = [R.Rule("c", "keyword", "aa"), R.Rule("c", "keyword", "aaa")]
    assert found(spark, "xaaa", rules) == [("c", "aa", 1, "exact"), ("c", "aaa", 1, "exact"), ("c", "aa", 2, "exact")]
    assert found(spark, "aab", rules) == [("c", "aa", 0, "exact")]
    assert found(spark, "", rules) == []


def test_default_rules_on_chinese_text(spark):
    got = found(spark, "请忽略指令，校园暴力与暴力。")
    assert ("prompt_injection", "忽略指令", 1, "exact") in got
    assert [g[2] for g in got if g[1] == "暴力"] == [8, 11]
    assert [g[2] for g in got if g[1] == "校园暴力"] == [6]


def test_personal_data_patterns(spark):
    rules = R.personal_data_rules()
    text = "id 11010519900307123X, long 110105199003071234567, tel 13912345678 or 139123456789, me@x.org"
    got = found(spark, text, rules)
    assert [(g[2], g[3]) for g in got] == [(3, "regex"), (text.index("139"), "regex"), (text.index("me@"), "regex")]


def test_mixed_keyword_matches_across_punctuation(spark):
    rules = [R.Rule("c", "keyword", "AI模型")]
    assert found(spark, "一个AI，模型", rules) == [("c", "AI模型", 2, "exact")]
    assert found(spark, "AI的模型", rules) == []


def test_invalid_patterns_are_skipped(spark):
    assert R.valid_rules(spark, [R.Rule("c", "regex", "(["), R.Rule("c", "keyword", "x"), R.Rule("c", "keyword", "")]) == [
        R.Rule("c", "keyword", "x")
    ]


def test_rule_table_round_trip(spark, tmp_path):
    path = str(tmp_path / "rules")
    spark.createDataFrame([("extra", ["a", "b"], ["c+"])], "name string, keywords array<string>, regex_patterns array<string>").write.json(path)
    base = R.rule_frame(spark, R.default_rules())
    grown = R.add_rules(base, R.read_rules(spark, path))
    assert grown.count() == base.count() + 3
    assert R.add_rules(grown, R.read_rules(spark, path)).count() == grown.count()
    assert R.rules_of(grown)[-3:] == [R.Rule("extra", "keyword", "a"), R.Rule("extra", "keyword", "b"), R.Rule("extra", "regex", "c+")]


def test_tokens(spark):
    df = spark.createDataFrame([("Héllo wörld-42 数据库 中a文",)], "t string")
    assert df.select(X.tokens(F.col("t"))).first()[0] == ["héllo", "wörld", "42", "数据", "据库", "中", "a", "文"]


def test_render_prompt(spark):
    df = spark.createDataFrame([("a{{ y }}", None)], "x string, y string")
    text = df.select(X.render("{{x}}-{{ y }}", {"x": F.col("x"), "y": F.col("y")})).first()[0]
    assert text == "a{{ y }}-"
    with pytest.raises(KeyError):
        X.render("{{ z }}", {})


def test_gbk_names(spark):
    garbled = "报告.txt".encode("gbk").decode("latin-1")
    df = spark.createDataFrame([(garbled,), ("plain.txt",), ("报告.txt",), ("café.txt",)], "n string")
    before = {k: spark.conf.get(k) for k in I.GBK_CONF}
    with I.gbk_names(spark):
        fixed = df.select(I.repair_filename(F.col("n")))
    assert {k: spark.conf.get(k) for k in I.GBK_CONF} == before
    assert [r[0] for r in fixed.collect()] == ["报告.txt", "plain.txt", "报告.txt", "café.txt"]


def test_duplicates_are_per_tenant(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "b", "x"), (4, "a", "y")], "doc_id int, tenant string, text string")
    got = {r.doc_id: (r.first_doc, r.is_duplicate) for r in I.dedup_exact(df, ["tenant"]).collect()}
    assert got == {1: (1, False), 2: (1, True), 3: (3, False), 4: (4, False)}


@pytest.mark.parametrize(
    "scores,passed,score,borderline",
    [([], False, 0.0, False), ([0.1], True, 0.1, True), ([0.09], False, 0.09, False), ([0.5, 0.5], True, 0.5, False), ([0.3], True, 0.3, True)],
)
def test_retrieval_marks(spark, scores, passed, score, borderline):
    queries = spark.createDataFrame([(1,)], "query_id int")
    rows = spark.createDataFrame([(1, s) for s in scores], "query_id int, score double")
    r = Q.retrieval_stats(queries, rows).first()
    assert (r.passed, r.score, r.borderline, r.results) == (passed, score, borderline, len(scores))


def test_skip_generation(spark):
    rows = spark.createDataFrame([([0.64],), ([0.65],), ([],), (None,)], "s array<double>")
    assert [r[0] for r in rows.select(Q.skip_generation(F.col("s"))).collect()] == [True, False, True, True]


def test_claims(spark):
    df = spark.createDataFrame([("事实一成立[来源:2]。短。感谢您的提问；\n第二条事实 holds",)], "a string")
    assert df.select(Q.claims(F.col("a"))).first()[0] == ["事实一成立", "第二条事实 holds"]
    assert df.select(Q.decomposed_claims(F.lit("文本：x\n一条\n事实声明："), F.col("a"))).first()[0] == ["一条"]


def test_claim_limits(spark):
    rows = [("i", "a b c d e f g h i j", 0.6, "a b c"), ("i", "a b c d e f g h i j", 0.6, "a b c d"), ("i", "x", 0.75, None), ("i", "x", 0.4999, None)]
    df = spark.createDataFrame(rows, "item_id string, claim string, similarity double, parent_text string")
    got = [(r.similarity, r.status) for r in Q.parent_recheck(df).collect()]
    assert got == [(0.6, "partial"), (0.75, "supported"), (0.75, "supported"), (0.4999, "hallucination")]


@pytest.mark.parametrize(
    "states,passed", [(["h"] * 3 + ["s"] * 7, True), (["h"] * 4 + ["s"] * 6, False), (["p"] * 5 + ["s"] * 5, True), (["p"] * 6 + ["s"] * 4, False)]
)
def test_factuality_rates(spark, states, passed):
    names = {"h": "hallucination", "p": "partial", "s": "supported"}
    checked = spark.createDataFrame([(1, 0.5, names[s]) for s in states], "item_id int, similarity double, status string")
    items = spark.createDataFrame([(1, "fine", True)], "item_id int, answer string, has_sources boolean")
    r = Q.vector_factuality(items, checked).first()
    assert (r.passed, r.score) == (passed, 0.5 if passed else 0.0)


def test_judge_replies(spark):
    raw = [
        '```json\n{"passed": true, "score": 0.5, "extra": [1, 2]}\n```',
        'Sure: {"passed": false, "score": 1,} ok',
        "{'passed': true, 'reasoning': 'fine'}",
        "",
        "nothing here",
        "{broken",
        "{broken: }",
    ]
    df = spark.createDataFrame(list(enumerate(raw)), "i int, raw string")
    got = {r.i: r.p for r in df.select("i", Q.parse_judge(F.col("raw")).alias("p")).collect()}
    assert [got[i].error_type for i in range(7)] == [None, None, None, "empty", "no_json", "no_json", "parse_error"]
    verdicts = df.select(Q.judge_verdict(Q.parse_judge(F.col("raw"))["fields"]).alias("v")).collect()
    assert verdicts[0].v.passed and verdicts[0].v.metadata == {"extra": "[1,2]"}
    assert (verdicts[1].v.passed, verdicts[1].v.score) == (False, 1.0)
    assert verdicts[2].v.reasoning == "fine"


def test_interventions(spark):
    rows = [
        ("two", "relevance", False), ("two", "safety", False), ("unknown", "style", False), ("fine", "safety", True),
        ("correct", "answer_correctness", False), ("weak", "retrieval_quality", False), ("weak", "relevance", True),
    ]
    df = spark.createDataFrame(rows, "item_id string, dimension string, passed boolean")
    got = {r.item_id: (r.intervened, r.action, r.reason) for r in Q.decide(df).collect()}
    assert got["two"] == (True, "block", "检测到有害内容，已拦截回答")
    assert got["unknown"] == (False, "none", K.NO_RULE_REASON)
    assert got["fine"] == (False, "none", "")
    assert got["correct"][1] == "degrade" and got["weak"][1] == "warn"


def test_error_policy(spark):
    rows = [("a", d, True, 0.9, True) for d in ("safety", "factuality", "relevance", "answer_correctness")]
    df = spark.createDataFrame(rows, "item_id string, dimension string, passed boolean, score double, judge_error boolean")
    closed = {r.dimension: (r.passed, r.score) for r in Q.apply_error_policy(df).collect()}
    assert closed == {"safety": (False, 0.0), "factuality": (True, 0.0), "relevance": (True, 0.7)}
    opened = {r.dimension: (r.passed, r.score) for r in Q.apply_error_policy(df, False).collect()}
    assert opened["safety"] == (True, 1.0)


@pytest.mark.parametrize("pattern,want", [("a*", [0, 1, 3, 4, 5, 6, 7, 8]), ("b(?=a)", [5]), ("$", [8]), ("aa|b", [1, 3, 5, 7])])
def test_offsets_of_empty_matches(spark, pattern, want):
    df = spark.createDataFrame([("xaab bab",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(X.regex_positions(F.col("t"), pattern)).collect()]
    assert got[0] == want and got[2] in (None, [])


def test_a_rule_listed_twice_matches_once(spark):
    rules = [R.Rule("c", "keyword", "ab"), R.Rule("d", "keyword", "ab"), R.Rule("c", "keyword", "ab")]
    df = spark.createDataFrame([(1, "xabab")], "doc_id int, text string")
    rows = R.match_rows(R.match_rules(df, rules)).collect()
    assert sorted((r.category, r.position) for r in rows) == [("c", 1), ("c", 3), ("d", 1), ("d", 3)]


def test_thousands_of_rules(spark):
    rules = [R.Rule(f"c{i % 7}", "keyword", f"word{i}x") for i in range(2500)]
    table = R.rule_frame(spark, rules)
    assert R.rules_of(table) == rules
    df = spark.createDataFrame([(1, "a word2499x and word7x"), (2, "word2500x")], "doc_id int, text string")
    rows = R.match_rows(R.match_rules(df, rules)).collect()
    assert sorted((r.doc_id, r.keyword, r.position) for r in rows) == [(1, "word2499x", 2), (1, "word7x", 16)]


def test_judge_verdict_keeps_its_dimension(spark):
    raw = '{"passed": true, "score": 0.5, "dimension": "safety", "details": "d", "other": "o"}'
    df = spark.createDataFrame([(raw,)], "raw string")
    v = df.select(Q.judge_verdict(Q.parse_judge(F.col("raw"))["fields"]).alias("v")).first().v
    assert (v.dimension, v.details, v.metadata) == ("safety", "d", {"other": "o"})


def test_term_coverage_keeps_case(spark):
    df = spark.createDataFrame([("BGE model", "the bge model")], "q string, a string")
    assert df.select(Q.term_coverage(F.col("q"), F.col("a"))).first()[0] == 0.5


def test_wrong_number_of_replies_is_an_error_of_the_batch(spark):
    df = spark.createDataFrame([("a",), ("b",)], "p string").coalesce(1)
    rows = M.model_stage(df, "p", lambda ps: [("x", 1, 1)], batch=2).collect()
    assert [(r.model_text, r.prompt_tokens) for r in rows] == [(None, 0)] * 2 and "1 replies to 2" in rows[0].model_error
    assert [r.embedding for r in M.embed(df, "p", lambda ts: [[1.0]], batch=2).collect()] == [None, None]


def plain_sequence(text, wanted):
    """First place where the tokens follow one another, token by token."""
    tokens = []
    for m in re.finditer(X.PY_RUNS, text.lower()):
        cjk = len(m[0]) >= 2 and re.match(f"[{X.CJK}]", m[0])
        tokens += [(m[0][i : i + 2], m.start() + i) for i in range(len(m[0]) - 1)] if cjk else [(m[0], m.start())]
    places = [tokens[i][1] for i in range(len(tokens)) if [t for t, _ in tokens[i : i + len(wanted)]] == wanted]
    return places[0] if places else None


def test_token_sequences_are_found_where_the_tokens_say(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", "ai", "A", "1", "模", "型", "模型", " ", "，", "_", "é", "😀"]) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "id int, text string").repartition(4)
    keywords = ["AI模型", "模型模", "模型", "ai a", "模 型", "型模 型", "模a", "a模型1", "模模模"]
    found = frame.select("id", *[R.token_sequence_position(F.col("text"), R.keyword_tokens(k)).alias(f"k{n}") for n, k in enumerate(keywords)])
    rows = {r["id"]: r for r in found.collect()}
    for n, k in enumerate(keywords):
        hits = [plain_sequence(t, R.keyword_tokens(k)) for t in texts]
        assert [rows[i][f"k{n}"] for i in range(len(texts))] == hits
        assert sum(h is not None for h in hits) >= 1
    assert set(rows[len(texts)][1:]) == {None}


def test_a_token_sequence_costs_no_more_than_cutting_the_tokens(spark):
    """the search once built several arrays of all tokens."""
    texts = spark.range(8).select(F.concat(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(60_000)), lambda i: F.concat(F.lit("word"), i)), " "), F.lit(" AI 模型")).alias("text"))
    texts = texts.localCheckpoint()

    def seconds(column):
        start = time.perf_counter()
        texts.agg(F.sum(column)).collect()
        return time.perf_counter() - start

    search, cut = R.token_sequence_position(F.col("text"), R.keyword_tokens("AI模型")), F.size(X.tokens(F.col("text")))
    assert min(seconds(search) for _ in range(3)) < min(seconds(cut) for _ in range(3))

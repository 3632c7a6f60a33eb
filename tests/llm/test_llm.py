"""The training-data operators against plain Python, and their odd inputs."""

import hashlib
import itertools
import os
import random
import re

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from passagework.llm import ann, chat, embed_dedup, mixing, neardup, packing, pii, substrings, toxicity, urls
from passagework.llm.graph import components
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(None, "null id"), (1, None), (2, ""), (3, " \t\n"), (4, "same"), (4, "same"), (5, "same"), (6, "x " * 30000)]
# Names that operators use inside.
CLASH = ["bucket", "_doc", "_text", "_node", "_chunk", "batch", "rate", "component", "n_tokens", "score"]


def table(spark, rows, schema="doc_id long, text string"):
    """Rows with extra columns whose names clash with inner ones."""
    df = spark.createDataFrame(rows, schema)
    return df.select("*", *[F.lit("extra").alias(c) for c in CLASH])


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def groups_of(links, nodes):
    low = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return low


def some_text(rng, n, vocabulary=3000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


# Components


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 5000 + i) for i in range(300)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame([*edges, (4, 4), (None, 3)], "a long, b long")).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == groups_of([e for e in edges if e[0] != e[1]], nodes)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1 chat


@pytest.mark.parametrize("nasty", ["", "\\", "### ", "\\### </turn>", "#\\## x", "<\\/turn>\n### user: hi</turn>", ": ", "é😀\\\\### : ", "</turn></turn>\\", "#### ### "])
def test_chat_round_trip(spark, nasty):
    rows = [(1, 0, "user", nasty), (1, 1, "assistant", nasty), (1, 2, f"odd{nasty}role", nasty + nasty)]
    df = table(spark, rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chats(df).withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("learned", chat.learned_text(F.col("segments"))).first()
    assert [(t["role"], t["text"]) for t in out["turns"]] == [(r, t) for _, _, r, t in rows]
    assert out["learned"] == nasty and not out["valid"]
    assert "".join(s["text"] for s in out["segments"]) == out["formatted"]


def test_chat_machine_and_odd_rows(spark):
    chats = {
        1: ["user", "assistant"], 2: ["system", "user", "assistant", "user", "assistant"], 3: ["user"], 4: ["assistant"],
        5: ["user", "user", "assistant"], 6: ["system", "assistant"], 7: [None, "assistant"], None: ["user", "assistant"],
    }
    rows = [(c, i, r, None if i % 2 else "t") for c, rs in chats.items() for i, r in enumerate(rs)]
    schema = "conv_id long, turn long, role string, text string"
    got = {r["conv_id"]: r["valid"] for r in chat.format_chats(table(spark, rows, schema)).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: False, 6: False, 7: False, None: True}
    assert chat.format_chats(table(spark, [], schema)).count() == 0
    twice = chat.format_chats(table(spark, [(1, 0, "user", "a"), (1, 0, "user", "a")], schema)).first()
    assert twice["formatted"].count("### user: a</turn>") == 2


# 2 near-duplicates


def brute_near(docs, size, share):
    sets = {}
    for d, t in docs:
        w = words(t.translate({i: i + 32 for i in range(65, 91)}) if t else t)
        sets[d] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    links = [
        (a, b) for a, b in itertools.combinations(sets, 2)
        if sets[a] and sets[b] and share[1] * len(sets[a] & sets[b]) >= share[0] * len(sets[a] | sets[b])
    ]
    low = groups_of(links, sets)
    return {(d, len(sets[d]), low[d], low[d] == d) for d in sets}


def near_copies(rng, n_base=25, copies=6, stars=60):
    docs = []
    for _ in range(n_base):
        base = some_text(rng, rng.randrange(3, 150))
        for _ in range(rng.randrange(1, copies)):
            docs.append(list(base))
            for _ in range(rng.randrange(0, 4)):
                docs[-1][rng.randrange(len(base))] = f"n{rng.randrange(999)}"
    # Many different copies of one text that are similar to it, but less to each other.
    base = some_text(rng, 220)
    for _ in range(stars):
        docs.append(list(base))
        for _ in range(rng.randrange(1, 5)):
            docs[-1][rng.randrange(220)] = f"s{rng.randrange(9999)}"
    rng.shuffle(docs)
    return [(i, " ".join(w).upper() if i % 7 == 0 else "\t".join(w)) for i, w in enumerate(docs)]


@pytest.mark.parametrize("size,share", [(3, (85, 100)), (5, (80, 100))])
def test_near_duplicates(spark, size, share):
    docs = near_copies(random.Random(size))
    got = neardup.near_duplicates(table(spark, docs), size, share).collect()
    assert {tuple(r) for r in got} == brute_near(docs, size, share) and len(got) == len(docs)


def test_near_duplicates_odd_rows(spark):
    got = neardup.near_duplicates(table(spark, ODD)).collect()
    found = sorted([(r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["kept"]) for r in got])
    assert found == [
        (False, 1, 0, 1, True), (False, 2, 0, 2, True), (False, 3, 0, 3, True), (False, 4, 1, 4, True), (False, 4, 1, 4, True),
        (False, 5, 1, 4, False), (False, 6, 1, 6, True), (True, 0, 1, None, True),
    ]
    assert neardup.near_duplicates(table(spark, [])).count() == 0


def test_full_sets_move_once_by_their_node(spark, monkeypatch):
    """Confirming pairs, comparing regions and reading rare shingles moved all full sets, each for a join of its own."""
    plans, write = [], neardup.materialize

    def seen(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, name)

    monkeypatch.setattr(neardup, "materialize", seen)
    docs, links = family(600, 60)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(table(spark, docs), 1, (80, 100)).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == groups_of(links, range(600))
    moved = [(name, plan) for name, plan in plans if "_set#" in plan and "SortMergeJoin" in plan and name != "sets"]
    assert moved and all("getbit" in plan for _, plan in moved), [name for name, plan in moved if "getbit" not in plan]
    joined = [plan for name, plan in plans if name in ("links", "rarest") and "SortMergeJoin" in plan]
    assert "rarest" in dict(plans) and len(joined) <= 2  # the regions', and the third round's confirmation


def test_texts_are_read_again_in_place(spark):
    """The texts of sets with candidates were found by a join that moved all texts."""
    rows = spark.range(1000).selectExpr("nullif(id, 7) AS _doc", "repeat('a ', 9) AS _text")
    holder = spark.createDataFrame([(3,), (None,), (900,), (5000,)], "_held long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = neardup.held_rows(rows, holder)
        plan = met._jdf.queryExecution().executedPlan().toString()
        found = {r["_doc"] for r in met.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    assert {3, None, 900} <= found and len(found) < 20 and met.columns == rows.columns


def test_full_sets_have_the_orders_of_signatures(spark):
    docs = [(1, "a b c d e f g"), (2, ""), (3, None), (4, "x")]
    first = neardup.sets_of(spark.createDataFrame(docs, "doc_id long, text string"), 3, "doc_id", "text").where("_node is not null")
    again = spark.createDataFrame(docs, "_doc long, _text string").mapInPandas(neardup._full_sets(3), "_node long, _n long, _keys binary, _set binary, _long binary")
    assert sorted(first.select("_node", "_n", "_keys").collect()) == sorted(again.select("_node", "_n", "_keys").collect())


def family(n=4000, pairs=400, core=88):
    """Texts of one word per shingle that share ``core`` words and are below 0.8 to each other, but for some pairs; and all links."""
    rng, fresh = random.Random(11), itertools.count()
    common, own = [f"c{i}" for i in range(core)], []
    for i in range(n):
        size = rng.randrange(12, 17)
        kept = rng.sample(own[i - 1], rng.randrange(1, 10)) if i % (n // pairs) == 1 else []
        own.append(kept + [f"o{next(fresh)}" for _ in range(size - len(kept))])
    assert core * 100 < 80 * (core + 12 + 12)  # no link without a common word of their own
    links = [
        (i - 1, i) for i in range(1, n)
        if 100 * (both := core + len({*own[i - 1]} & {*own[i]})) >= 80 * (len(own[i - 1]) + len(own[i]) + 2 * core - both) and both > core
    ]
    docs = [(i, " ".join(rng.sample(common + w, core + len(w)))) for i, w in enumerate(own)]
    return docs, links


def test_near_duplicates_in_a_large_family(spark, monkeypatch):
    docs, links = family()
    want = groups_of(links, range(len(docs)))
    assert len(links) > 100
    for near in (neardup.NEAR, 8):
        monkeypatch.setattr(neardup, "NEAR", near)
        got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(table(spark, docs), 1, (80, 100)).collect()}
        lost = sum(want[i] != got[i] for i in want)
        assert got == want, f"{lost} of {len(links)} links lost"


def test_work_on_a_family_grows_with_its_texts(spark, monkeypatch):
    """Pairs, regions and links of one dense family: twice the texts give about twice the rows, not four times."""
    kept, write = {}, neardup.materialize

    def counted(df, name):
        out = write(df, name)
        kept[name] = kept.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(neardup, "materialize", counted)
    seen = []
    for n in (500, 1000, 2000):
        docs, links = family(n, n // 10)
        kept.clear()
        got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(table(spark, docs), 1, (80, 100)).collect()}
        assert got == groups_of(links, range(n))
        seen.append(dict(kept))
    for name in ("pairs", "regions", "dealt"):
        counts = [s.get(name, 0) for s in seen]
        assert counts[1] <= 2.6 * counts[0] + 100 and counts[2] <= 2.6 * counts[1] + 100, (name, counts)


def test_forest_regions():
    keys = np.array(sorted([[0, 0, 0, i // 300, i] + [0] * 11 for i in range(900)]), dtype=">u2")
    ranges = list(neardup.regions(keys, 0, 900, 0))
    assert all(b - a <= neardup.REGION for a, b in ranges)


# 3 substrings


def brute_repeats(docs, n):
    seen, out = set(), []
    for d, t in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            key = tuple(w[i : i + n])
            if key in seen:
                gone[i : i + n] = [True] * n
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window,start", [(20, 5), (20, 20), (8, 1), (7, 3)])
def test_substrings(spark, window, start):
    rng = random.Random(window + start)
    passages = [some_text(rng, rng.randrange(10, 60)) for _ in range(6)]
    docs = [(i, " ".join(sum([rng.choice(passages) if rng.random() < 0.4 else some_text(rng, rng.randrange(0, 25)) for _ in range(8)], []))) for i in range(60)]
    docs += [*ODD, (70, "a b c " * 50), (71, "a b c " * 8)]
    got = substrings.remove_repeats(table(spark, docs), window, start, with_text=False).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute_repeats(docs, window)


def test_substrings_in_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK_BYTES", 600)
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 900)
    rng = random.Random(5)
    passage = some_text(rng, 45)
    docs = [(i, " ".join(some_text(rng, rng.randrange(30)) + passage[i % 3 : 45 - i % 5] + some_text(rng, 9))) for i in range(80)]
    got = substrings.remove_repeats(table(spark, docs), 20).collect()
    assert sorted([tuple(r)[:4] for r in got], key=str) == brute_repeats(docs, 20)
    assert all(hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"] for r in got)
    assert substrings.remove_repeats(table(spark, [])).count() == 0


# 4 urls


def judge(spark, pages, rules, edges=None):
    df = table(spark, pages, "page_id long, url string, html string")
    more = spark.createDataFrame(edges, "from_url string, to_url string") if edges else None
    return {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.filter_urls(df, urls.rule_table(spark, rules), more).collect()}


def test_url_rules_and_aliases(spark):
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "bad.net", "/")]
    canonical = '<link rel="canonical" href="%s">'
    pages = [
        (1, "http://example.com/en/1", ""), (2, "http://WWW.example.com/en/1?q", ""), (3, "https://sub.example.com/EN/1", ""),
        (4, "http://a.org/x", canonical % "//bad.net/y"), (5, "http://b.org/z#top", "<meta http-equiv='refresh' content='0; url=http://a.org/x'>"),
        (6, "http://c.org/z", canonical % "/other"), (7, "http://www.example.com/en/2", canonical % "http://bad.net/q"), (8, None, None),
        (9, "no scheme", canonical % "http://bad.net/y"), (10, "http://notexample.com", None), (11, "http://d.org/w", None), (12, "http://d.org/w", ""),
    ]
    edges = [("http://d.org/w", "http://e.org/"), ("http://e.org/", "http://bad.net/y"), (None, "http://bad.net/y")]
    assert judge(spark, pages, rules, edges) == {
        1: ("example.com/en/", "block"), 2: ("www.example.com/en/", "allow"), 3: ("com/", "allow"), 4: (None, "block"), 5: (None, "block"),
        6: (None, "allow"), 7: ("www.example.com/en/", "allow"), 8: (None, "allow"), 9: (None, "allow"), 10: (None, "allow"), 11: (None, "block"),
        12: (None, "block"),
    }
    assert judge(spark, [], rules) == {} and judge(spark, pages[:1], []) == {1: (None, "allow")}


# 5 personal data


def test_pii_surrogates(spark):
    texts = [
        "write to Ann.Lee@Mail3.example.com or ann.lee@mail3.EXAMPLE.com now", "call +1 (017) 555-7713, card 4111 1111 1111 1111 and 4111111111111111",
        "ip 192.168.17.4; version 2.0; year 2024-01-15; 12 apples", "Frau Meier und Herr Klaus Meier, Mr. Smith", "Господин Иванов", None, "",
        "nothing here " * 5000, "x@y.zz" * 1, "ssn 123-45-6789 iban DE89 3704 0044 0532 0130 00", "call +1 (017) 555-7713",
    ]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(None, texts[0], "en", "s", 0)]
    got = {r["doc_id"]: (r["text"], r["n_entities"]) for r in pii.replace_personal_data(spark.createDataFrame(rows, DOCS), "k").collect()}
    assert [got[i][1] for i in range(len(texts))] == [2, 3, 1, 3, 1, 0, 0, 0, 1, 2, 1]
    assert got[5][0] is None and got[6][0] == "" and got[7][0] == texts[7] and got[None][0] == got[0][0]
    first, second = re.findall(r"\S+@\S+", got[0][0])
    assert first.lower() == second.lower() != "ann.lee@mail3.example.com" and re.fullmatch(r"[A-Z][a-z]{2}\.[A-Z][a-z]{2}@[A-Z][a-z]{3}\d\.[a-z]{7}\.com", first)
    cards = re.findall(r"\d{4} \d{4} \d{4} \d{4}|\d{16}", got[1][0])
    digits = [c.replace(" ", "") for c in cards]
    assert len(cards) == 2 and digits[0] == digits[1] != "4111111111111111"
    assert sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits[0]))) % 10 == 0
    assert re.match(r"call \+1 \(\d{3}\) \d{3}-\d{4}, card", got[1][0]) and re.search(r"\+1 \S+ \S+\d", got[1][0]).group() == got[10][0][5:]
    assert re.fullmatch(r"ip (\d{1,3}\.){3}\d{1,3}; version 2.0; year 2024-01-15; 12 apples", got[2][0]) and "192.168" not in got[2][0]
    assert re.fullmatch(r"Frau [A-Z][a-z]+ und Herr [A-Z][a-z]+ [A-Z][a-z]+, Mr\. [A-Z][a-z]+", got[3][0])
    assert re.fullmatch(r"Господин [А-Я][а-я]+", got[4][0]) and got[4][0] != texts[4]
    other = pii.replace_personal_data(spark.createDataFrame(rows, DOCS), "other key").where("doc_id = 0").first()["text"]
    assert other != got[0][0]
    assert pii.replace_personal_data(spark.createDataFrame([], DOCS), "k").count() == 0


def test_pii_names_keep_their_person(spark):
    texts = [
        "Herr Klaus Meier kam. Herr Meier ging.", "Frau Anna Schmidt, then Anna Schmidt spoke, and Schmidt too; Schmidtke did not", "MR. JOHN SMITH met Mr John Smith",
        "Frau Mueller-Lüdenscheidt und Herr Lüdenscheidt, Mr O'Neil", "Dr Klaus Meier, Klaus Meier", "call 0171 2345678 or 0171/2345678", "Meier alone stays",
    ]
    got = {r["doc_id"]: r["text"] for r in pii.replace_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").collect()}
    given, family, again = re.fullmatch(r"Herr (\p{Lu}\p{L}+) (\p{Lu}\p{L}+) kam. Herr (\p{Lu}\p{L}+) ging.".replace(r"\p{Lu}", "[A-ZÄÖÜ]").replace(r"\p{L}", r"\w"), got[0]).groups()
    assert family == again != "Meier" and given != "Klaus"
    anna, schmidt = re.match(r"Frau (\w+) (\w+), then ", got[1]).groups()
    assert got[1] == f"Frau {anna} {schmidt}, then {anna} {schmidt} spoke, and {schmidt} too; Schmidtke did not" and "Anna" not in got[1]
    john, smith = re.match(r"MR\. (\w+) (\w+) met", got[2]).groups()
    assert got[2] == f"MR. {john} {smith} met Mr {john.capitalize()} {smith.capitalize()}" and john.isupper() and smith.isupper()
    one, two, three, left, right = re.fullmatch(r"Frau (\w+)-(\w+) und Herr (\w+), Mr (\w+)'(\w+)", got[3]).groups()
    assert two == three != "Lüdenscheidt" and one != "Mueller" and right != "Neil"
    assert re.fullmatch(rf"Dr (\w+) {family}, \1 {family}", got[4])
    assert re.fullmatch(r"call (\d{4}) (\d{7}) or \1/\2", got[5]) and "2345678" not in got[5] and got[6] == texts[6]


def test_pii_many_people_stay_apart(spark):
    """More given names than any list holds: every person keeps a name of their own, and none is a real one."""
    people = [(f"{a}{b}o", f"{c}{d}berg") for a in ("Kal", "Mir", "Ton", "Bel", "Sar") for b in "aeiou" for c in ("Han", "Ros", "Lin") for d in ("na", "to", "mi")]
    docs = spark.createDataFrame([(i, f"Herr {g} {f} and Frau {g} {f}") for i, (g, f) in enumerate(people)], "doc_id long, text string")
    out = {r["doc_id"]: re.fullmatch(r"Herr (\w+) (\w+) and Frau (\w+) (\w+)", r["text"]).groups() for r in pii.replace_personal_data(docs, "k").collect()}
    real = {x for p in people for x in p}
    assert len({(g, f) for g, f, _, _ in out.values()}) == len(people) and all(f == h for _, f, _, h in out.values())
    given, family = {}, {}
    for i, (g, f) in enumerate(people):
        assert given.setdefault(g, out[i][0]) == out[i][0] and family.setdefault(f, out[i][1]) == out[i][1]
    assert len(set(given.values())) == len(given) and len(set(family.values())) == len(family)
    assert not real & ({*given.values()} | {*family.values()})


def test_pii_collisions(spark):
    """400 of 676 short addresses: first draws must clash, final surrogates must not."""
    names = [f"{a}@{b}.co" for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrst"]
    rows = [(i, f"mail {n} end", "en", "s", 0) for i, n in enumerate(names)] + [(1000 + i, f"again {n.upper()[0]}{n[1:]}", "en", "s", 0) for i, n in enumerate(names)]
    small = [(r[0], r[1]) for r in rows]
    docs = spark.createDataFrame(small, "doc_id long, text string")
    table_ = pii.entity_table(docs.where("doc_id % 1000 < 60"), "k", "text").collect()
    assert len({r["new"] for r in table_}) == len(table_) == 60 and not {r["new"] for r in table_} & {r["entity"] for r in table_}
    out = {r["doc_id"]: r["text"] for r in pii.replace_personal_data(docs.where("doc_id % 1000 < 60"), "k").collect()}
    for i in range(60):
        assert out[i].split()[1] == out[1000 + i].split()[1].lower()
    assert any(r["attempt"] > 0 for r in table_)


# 6 nearest neighbours


def vectors(rng, n, d=24, near=0.02):
    x = rng.normal(size=(n, d))
    x[n // 2 :] = x[rng.integers(0, 8, n - n // 2)] + near * rng.normal(size=(n - n // 2, d))
    return x


ODD_VECTORS = [(9001, None, 1), (9002, [0.0] * 24, 1), (9003, [float("nan")] * 24, 1), (9004, [None] * 24, 1), (9005, [float("inf")] * 24, 1), (9006, [1.0, 2.0], 1), (None, [1.0] * 24, 1)]


def test_nearest(spark):
    x = vectors(np.random.default_rng(1), 800)
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)] + ODD_VECTORS
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("score", F.lit("extra"))
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, k=10).collect()
    asked = [i for i in range(800) if i % 20 == 0]
    hit = 0
    for q in asked:
        mine = sorted([r for r in got if r["query_id"] == q], key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11)) and all(r["vec_id"] != q for r in mine)
        assert [(-r["score"], r["vec_id"]) for r in mine] == sorted((-r["score"], r["vec_id"]) for r in mine)
        assert all(abs(r["score"] - x[q] @ x[r["vec_id"]]) < 1e-9 for r in mine)
        score = x @ x[q]
        score[q] = -np.inf
        hit += len({r["vec_id"] for r in mine} & set(np.argsort(-score)[:10].tolist()))
    assert len(got) == 10 * len(asked) and hit >= 0.9 * len(got)


def test_nearest_small_and_ties(spark):
    kind = "vec_id long, embedding array<double>"
    got = ann.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (3, [1.0, 1.0]), (2, [1.0, 1.0]), (1, [-1.0, 0.0]), (2, [1.0, 1.0])], kind), F.col("vec_id") == 0, k=20)
    assert [(r["rank"], r["vec_id"]) for r in got.orderBy("rank").collect()] == [(1, 2), (2, 3), (3, 1)]
    assert ann.nearest(spark.createDataFrame([], kind), F.col("vec_id") == 0).count() == 0
    assert ann.nearest(spark.createDataFrame([(0, [1.0, 2.0])], kind), F.col("vec_id") == 0).count() == 0


def test_nearest_of_every_size(spark):
    """Vectors of several sizes, and an outlier whose own list is nearly empty: 20 rows, or all there are."""
    rng = np.random.default_rng(8)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors(rng, 600))] + [(1000 + i, v.tolist()) for i, v in enumerate(rng.normal(size=(30, 5)))]
    rows += [(2000, [3.0, 4.0]), (2001, [3.0, 4.0]), (3000, (np.ones(24) * 1e4).tolist()), (3001, (np.ones(24) * 1e4 + 1).tolist())] + [(3002, [1.0] * 24)] * 60
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=20).collect()
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    assert set(found) == {i for i, _ in rows if i % 20 == 0}
    assert found[2000] == [2001] and all(len(set(v)) == 20 for q, v in found.items() if q != 2000)
    of = dict(rows)
    for q in (1000, 1020):
        best = sorted((i for i, v in rows if len(v) == 5 and i != q), key=lambda i: (-float(np.dot(of[i], of[q])), i))[:20]
        assert len(set(best) & set(found[q])) >= 18


def test_scan_keeps_the_nearest():
    rng = np.random.default_rng(4)
    points, queries = rng.normal(size=(500, 64)), rng.normal(size=(20, 64))
    q, p = ann.scan(queries, points, 10)
    exact = ((queries[:, None] - points[None]) ** 2).sum(2).argsort(1)[:, :10]
    kept = set(zip(q.tolist(), p.tolist(), strict=True))
    assert len(kept) < 0.8 * 20 * 500
    assert np.mean([(i, j) in kept for i in range(20) for j in exact[i]]) > 0.97


# 7 embedding near-duplicates


@pytest.mark.parametrize("block", [2048, 37])
def test_embedding_groups(spark, block):
    rng = np.random.default_rng(block)
    x = vectors(rng, 500, near=0.12)
    x[:5] = x[20]
    rows = [(i, v.tolist(), [None, 0, 1][min(i % 9, 2)]) for i, v in enumerate(x)]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = [(i, j) for i, j in itertools.combinations(range(500), 2) if rows[i][2] is not None and rows[i][2] == rows[j][2] and unit[i] @ unit[j] >= 0.98]
    low = groups_of(links, range(500))
    count = [sum(i in e for e in links) for i in range(500)]
    want = {(i, count[i], low[i], low[i] == i) for i in range(500)} | {(r[0], 0, r[0], True) for r in ODD_VECTORS}
    # Other sizes: two link, a third has another label, a fourth another direction.
    short = [(7001, [1.0, 2.0], 5), (7002, [2.0, 4.0], 5), (7003, [1.0, 2.0], 6), (7004, [2.0, 1.0], 5), (7005, [1.0], 5)]
    want |= {(7001, 1, 7001, True), (7002, 1, 7001, False), (7003, 0, 7003, True), (7004, 0, 7004, True), (7005, 0, 7005, True)}
    df = spark.createDataFrame(rows + ODD_VECTORS + short, "vec_id long, embedding array<double>, label int").withColumn("component", F.lit("extra"))
    got = embed_dedup.embedding_groups(df, block_rows=block)
    assert {tuple(r) for r in got.collect()} == want and len(links) > 100
    assert embed_dedup.embedding_groups(df.where("false")).count() == 0


# 8 packing


def test_best_bounds():
    rng = random.Random(2)
    for _ in range(60):
        cells = sorted(rng.sample(range(0, 60), rng.randrange(1, 9)))
        counts = [rng.randrange(1, 50) for _ in cells]
        k = rng.randrange(1, 6)

        def waste(bounds, cells=cells, counts=counts):
            return sum(n * min(b for b in bounds if b >= c) for c, n in zip(cells, counts, strict=True))

        best = min(waste((*some, cells[-1])) for r in range(min(k, len(cells))) for some in itertools.combinations(cells[:-1], r))
        got = packing.best_bounds(np.array(cells), np.array(counts), k)
        assert len(got) <= k and waste(got) == best


def test_packing(spark):
    rng = random.Random(8)
    docs = [(i, " ".join(["w"] * int(rng.paretovariate(0.7) * 5))) for i in range(3000)] + ODD
    got = packing.pack(table(spark, docs), buckets=6, budget=512).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == sorted((str(d), len(words(t))) for d, t in docs)
    batches = {}
    for r in got:
        assert r["n_tokens"] <= r["bucket"]
        batches.setdefault((r["bucket"], r["batch"]), []).append(r["place"])
    assert len({b for b, _ in batches}) <= 6
    for bucket in {b for b, _ in batches}:
        full = max(1, 512 // max(1, bucket))
        mine = [sorted(v) for (b, _), v in sorted(batches.items()) if b == bucket]
        assert all(v == list(range(len(v))) for v in mine) and all(len(v) == full for v in mine[:-1]) and len(mine[-1]) <= full
    assert packing.pack(table(spark, [])).count() == 0


def test_word_count(spark):
    odd = ["a b", " a\t\tb \n", "", " ", "a b", "é\x0bü\x0c", None, "x" * 9]
    got = spark.createDataFrame([(t,) for t in odd], "t string").select(packing.word_count(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in got] == [len(words(t)) for t in odd]


# 9 toxicity


def test_toxic_matches():
    machine = toxicity.automaton({"idiot": 2.0, "idiots": 2.0, "trash": 3.0}, ["trash can"])
    assert toxicity.weigh("An IDIOT, 1d10t and іdіоt; idiots!", machine) == (8.0, 4)
    assert toxicity.weigh("idiotic xidiot trash can, trash cans? trash", machine) == (6.0, 2)
    assert toxicity.weigh("idiot! $trash", machine) == (5.0, 2) and toxicity.weigh("", machine) == (0.0, 0)
    assert len(toxicity.fold("İ ǅ ß")) == len("İ ǅ ß")


def test_toxicity(spark):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(800):
        w = some_text(rng, rng.randrange(5, 300))
        bad = i % 8 == 0
        if bad:
            w[rng.randrange(len(w))] = rng.choice(["idiot", "m0ron", "ѕcum"])
        docs.append((i, " ".join(w)))
        labels += [(i, int(bad), 0)] if i % 3 else []
    labels += [(5, None, 0), (None, 1, 0), (99999, 1, 0)]
    lab = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    got = toxicity.score_toxicity(table(spark, docs + ODD), lab).collect()
    assert len(got) == len(docs) + len(ODD)
    import zlib

    for r in got:
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    wrong = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] >= 10 and r["predicted"] != int(r["doc_id"] % 8 == 0)]
    assert not wrong
    none = toxicity.score_toxicity(table(spark, docs[:9]), lab.where("false")).collect()
    assert {r["doc_id"] for r in none if r["predicted"]} == {0, 8}
    assert toxicity.score_toxicity(table(spark, []), lab).count() == 0


# 10 mixing


def plain_totals(tokens, p, goal):
    """Totals of the least squares over rates >= 0, one document's rate after another until nothing moves."""
    rate = np.ones(len(tokens))
    made = (tokens[:, None] * p).T
    total = made @ rate
    for _ in range(4000):
        before = total.copy()
        for i in np.flatnonzero(tokens):
            new = max(0.0, rate[i] - made[:, i] @ (total - goal) / (made[:, i] @ made[:, i]))
            total += made[:, i] * (new - rate[i])
            rate[i] = new
        if np.abs(total - before).max() < 1e-9 * tokens.sum():
            break
    return total


@pytest.mark.parametrize("targets", [{"0": 0.3, "1": 0.7}, {"0": 0.95, "1": 0.05}])
def test_mixing(spark, targets):
    rng = random.Random(6)
    docs = [(i, " ".join(some_text(rng, rng.randrange(3, 200)) if i % 4 else ["$$$ ***"] * rng.randrange(3, 90))) for i in range(400)] + ODD
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 400, 3)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = mixing.mix(table(spark, docs), labels, "quality", targets).collect()
    assert len(got) == len(docs)
    tokens = np.array([r["n_tokens"] for r in got], dtype=float)
    p = np.array([list(r["p"]) for r in got])
    rate = np.array([r["rate"] for r in got])
    goal = np.array([targets["0"], targets["1"]]) * tokens.sum()
    assert np.allclose(p.sum(1), 1) and (rate >= 0).all()
    assert np.abs((tokens * rate) @ p - goal).max() <= 1e-3 * tokens.sum()
    assert np.abs(plain_totals(tokens, p, goal) - goal).max() <= 2e-3 * tokens.sum()
    right = [(r["p"][0] > 0.5) == (r["doc_id"] % 4 == 0) for r in got if r["doc_id"] is not None and r["doc_id"] > 10]
    assert np.mean(right) > 0.95
    assert all(abs(r["copies"] - r["rate"]) < 1 for r in got)


@pytest.mark.parametrize("p,goal", [([(0.6, 0.4), (0.5, 0.5)], (200.0, 0.0)), ([(0.7, 0.2, 0.1), (0.2, 0.5, 0.3), (0.3, 0.3, 0.4)] * 4, (900.0, 10.0, 0.0)), ([(0.9, 0.1), (0.2, 0.8)], (50.0, 150.0))])
def test_mixing_targets_out_of_reach(spark, monkeypatch, p, goal):
    """The totals are those of the least squares, also where no rates reach the targets."""
    rows = [(i, i, 100 + 10 * (i % 3), list(map(float, x))) for i, x in enumerate(p)]
    table_of = spark.createDataFrame(rows, "_doc long, _hash long, n_tokens long, p array<double>")
    names = ["a", "b", "c"][: len(goal)]
    monkeypatch.setattr(mixing, "domain_posteriors", lambda *_: (table_of, names))
    got = mixing.mix(None, None, "quality", dict(zip(names, goal, strict=True)), tokens=sum(goal)).collect()
    tokens, post = np.array([r["n_tokens"] for r in got], dtype=float), np.array([list(r["p"]) for r in got])
    totals = (tokens * np.array([r["rate"] for r in got])) @ post
    assert np.allclose(totals, plain_totals(tokens, post, np.array(goal)), atol=1e-3 * tokens.sum())


def test_mixing_odd(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = mixing.mix(table(spark, ODD), none, "quality", {"0": 1}).collect()
    assert len(got) == len(ODD) and all(r["rate"] == pytest.approx(1) for r in got)
    assert mixing.mix(table(spark, []), none, "quality", {"0": 1}).count() == 0


# Pipeline and registration


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    rows = [(d, t, "en", "s", len(t or "")) for d, t in ODD] + [(20, "you idiot " + " ".join(some_text(random.Random(1), 40)), "en", "s", 1)]
    spark.createDataFrame([(100 + i, i % 2, i % 2) for i in range(4)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (spark.createDataFrame(rows, DOCS), spark.createDataFrame([], DOCS)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), DOCS)
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
        assert packed.count() == docs.count()
    docs = spark.createDataFrame(rows, DOCS)
    assert 20 not in {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()}
    kept = sorted(str(r["doc_id"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect())
    assert kept == ["1", "2", "20", "3", "4", "6", "None"]


def test_pipeline_decides_on_rows(spark, tmp_path):
    clean = " ".join(some_text(random.Random(1), 40))
    other = " ".join(some_text(random.Random(2), 40))
    rows = [(None, "you idiot scum", "en", "s", 1), (None, clean, "en", "s", 1), (7, "you idiot scum", "en", "s", 1), (7, other, "en", "s", 1)]
    spark.createDataFrame([(100, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.drop_toxic(spark, spark.createDataFrame(rows, DOCS), str(tmp_path)).collect()
    assert {(r["doc_id"], r["text"]) for r in got} == {(None, clean), (7, other)} and len(got) == 2
    # Rows of one id with other texts keep their own rates.
    rows = [(7, clean, "en", "s", 1), (7, "$$$ *** " * 50, "en", "s", 1), (None, clean, "en", "s", 1)] + [(i, clean if i % 2 else "$$$ *** " * 50, "en", "s", 1) for i in range(20, 60)]
    spark.createDataFrame([(i, i % 2, 0) for i in range(20, 60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/mixed/labels.parquet")
    mixed = corpus_pipeline.mix_domains(spark, spark.createDataFrame(rows, DOCS), f"{tmp_path}/mixed").collect()
    good = [r for r in mixed if r["text"] == clean]
    assert len(good) > len(mixed) - len(good) and {r["doc_id"] for r in good} >= {7, None}
    # The second row of id 5 copies id 4, its first one stays.
    rows = [(4, clean, "en", "s", 1), (5, other, "en", "s", 1), (5, clean, "en", "s", 1), (None, clean, "en", "s", 1)]
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, DOCS), str(tmp_path)).collect()
    assert {(r["doc_id"], r["text"]) for r in got} == {(4, clean), (5, other)} and len(got) == 2


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not present")
def test_pipeline(spark):
    """The run against plain Python where that is short: duplicates, packing, and what each stage kept."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    scored = toxicity.score_toxicity(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    toxic = {r["doc_id"] for r in scored.collect() if r["predicted"]}
    clean = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] not in toxic]
    distinct = {d for d, _, _, kept in brute_near(clean, 5, (80, 100)) if kept}
    whole = {r["doc_id"]: r for r in docs.collect()}
    rows = [(d, whole[d]["text"], whole[d]["lang"], whole[d]["source"], 0) for d in sorted(distinct)]
    replaced = corpus_pipeline.replace_pii(spark, spark.createDataFrame(rows, DOCS), FOLDER)
    mixed = corpus_pipeline.mix_domains(spark, spark.createDataFrame(replaced.collect(), DOCS), FOLDER).collect()
    want = sorted((r["doc_id"], len(words(r["text"]))) for r in mixed)
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got) == want
    places = [(r["bucket"], r["batch"], r["place"]) for r in got]
    assert len(set(places)) == len(places)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not present")
@pytest.mark.parametrize("name", ["op1_chat_format", "op4_url_filter", "op5_pii_surrogates", "op10_mixing_rates"])  # the operators without Python
def test_native_queries_run_no_python(spark, name):
    plan = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop", plan)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not present")
@pytest.mark.parametrize("name", ["op1_chat_format", "op2_minhash_forest", "op3_substring_dedup", "op4_url_filter", "op7_embedding_dedup", "op12_source_divergence", "op13_ball_tree_search"])
def test_queries_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, FOLDER).toPandas()[list(want.columns)]
    assert sorted(map(str, got.astype(str).values.tolist())) == sorted(map(str, want.astype(str).values.tolist()))

"""Secret scans, source divergence and ball-tree search against plain Python, and their odd inputs."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from passagework.llm import balltree, divergence, secrets
from pyspark.sql import functions as F

ODD = [(None, "null id"), (1, None), (2, ""), (3, " \t\n"), (4, "same words here"), (4, "same words here"), (5, "same words here"), (6, "x1 " * 30000)]
CLASH = ["bucket", "_doc", "_text", "_tree", "term", "n", "rank", "value", "cell", "_runs", "_item", "score"]
SYLLABLES = ["an", "the", "re", "on", "ist", "ment", "ing", "so", "la", "ver", "qu", "ed"]


def table(spark, rows, schema="doc_id long, text string"):
    df = spark.createDataFrame(rows, schema)
    return df.select("*", *[F.lit("extra").alias(c) for c in CLASH if c not in df.columns])


def prose(rng, n):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randrange(1, 5))).capitalize() if rng.random() < 0.1 else "".join(rng.choices(SYLLABLES, k=rng.randrange(1, 5))) for _ in range(n))


# 11 secrets


def minus_twice_log(z, sides):
    z = int(z * 64) / 64 if z >= 0 or sides == 2 else math.trunc(z * 64) / 64
    return -2 * math.log(max(math.erfc(z / math.sqrt(2)) / (3 - sides), 1e-300))


def plain_bin(places, size):
    n = len(places)
    chi = size / n * sum(c * c for c in Counter(places).values()) - n
    free = 2 / (9 * (size - 1))
    score = minus_twice_log(max(-8, min(38, ((chi / (size - 1)) ** (1 / 3) - (1 - free)) / free**0.5)), 1)
    half = [p >= size // 2 for p in places]
    changes, a = sum(x != y for x, y in zip(half, half[1:])), sum(half)
    if a in (0, n):
        away = n**0.5
    else:
        twice = 2 * a * (n - a)
        spread = (max(twice * (twice - n), 0) / (n * n * (n - 1))) ** 0.5
        away = abs(changes - twice / n) / (spread or 1)
    score += minus_twice_log(min(38, away), 2)
    mean = sum(places) / n
    whole = sum(p * p for p in places) - n * mean * mean
    near = sum((x - mean) * (y - mean) for x, y in zip(places, places[1:]))
    like = near / whole if whole > 1e-6 else 1
    return min(511, int(4 * (score + minus_twice_log(min(38, abs(like + 1 / n) * n**0.5), 2))))


def plain_spans(docs, rate):
    """Spans of each text by loops over characters, windows and runs."""
    digits, low, up = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    spellings = [(16, [digits + low[:6], digits + up[:6]]), (32, [up + "234567"]), (36, [low + digits, up + digits]), (64, [up + low + digits + "+/", up + low + digits + "-_"])]
    classes = [16, 24, 40, 80]

    def place(c, kind):
        return next((s.index(c) for s in spellings[kind][1] if c in s), None)

    text_bins, runs, base = defaultdict(Counter), [], []
    for d, text in enumerate(docs):
        found = []
        for k, pattern in enumerate([r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)", r"(AKIA[A-Z0-9]+)", r"([0-9a-f]+)"]):
            found += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if len(m[1]) >= (12, 18, 16)[k]]
        base.append(sorted(found))
        for m in re.finditer("[A-Za-z0-9+/_-]{16,}={0,2}", text):
            run = m[0].rstrip("=")
            if not run.isdigit() and not any(s < m.end() and m.start() < e for s, _, e in found):
                kind = next((i for i, (_, ss) in enumerate(spellings[:3]) if any(set(run) <= set(s) for s in ss)), 3)
                cls = sum(len(run) >= c for c in classes) - 1
                runs.append((d, m.start(), m.end(), kind, cls, plain_bin([place(c, kind) for c in run], spellings[kind][0])))
        rest = re.sub("[A-Za-z0-9+/_-]{16,}={0,2}", " ", text)
        for kind, (size, _) in enumerate(spellings):
            places = [p for p in (place(c, kind) for c in (rest if kind == 3 else rest.upper())) if p is not None]
            for cls, n in enumerate(classes):
                for at in range(0, len(places) - n + 1, n):
                    text_bins[kind, cls][plain_bin(places[at : at + n], size)] += 1
    p = {}
    for r in runs:
        bins = text_bins[r[3], r[4]]
        p[r] = (1 + sum(c for b, c in bins.items() if b <= r[5])) / (1 + sum(bins.values()))
    out = [sorted(b) for b in base]
    for cls in range(len(classes)):
        mine = [r for r in runs if r[4] == cls]
        good = [p[r] for r in mine if p[r] * len(mine) <= rate * sum(p[q] <= p[r] for q in mine)]
        for r in mine:
            if good and p[r] <= max(good):
                out[r[0]].append((r[1], 3, r[2]))
    return [",".join(f"{['assign', 'access', 'hex', 'random'][k]}:{s}:{e}" for s, k, e in sorted(spans)) for spans in out], base


def secret_texts():
    rng = random.Random(11)
    key = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    texts = [prose(rng, 250) for _ in range(40)]
    planted = []
    for d, (letters, n) in enumerate([(key, 40), (key, 64), ("0123456789ABCDEF", 48), (key[:26] + "234567", 52), (key[26:62], 90), (key, 88)]):
        secret = "".join(rng.choices(letters, k=n))
        texts[d] = f"{texts[d]} é😀 {secret}{'=' * (d % 2)} {texts[d + 10]}"
        planted.append((d, secret))
    texts[20] += " " + "".join(SYLLABLES * 2) + " /en/" + "-".join(SYLLABLES) + "/" + "_".join(SYLLABLES)
    texts[21] += ''' Password: "hunter2hunter2" toKEN=abc.def-ghi_jkl= api_key ='0123456789abcdefg' secret:short AKIAABCDEFGHIJKLMN AKIASHORT deadbeefdeadbeef '''
    texts[22] += " 12345678901234567890 token=token=abcdefghijkl KIA toKen=abcdefghijklmnop"
    return texts, planted


def test_secrets(spark):
    texts, planted = secret_texts()
    docs = table(spark, list(enumerate(texts))).repartition(5)
    got = {r["doc_id"]: r for r in secrets.find_secrets(docs).collect()}
    spans, base = plain_spans(texts, 0.05)
    assert {d: r["spans"] for d, r in got.items()} == dict(enumerate(spans))
    for d, found in enumerate(base):
        told = ",".join(f"{['assign', 'access', 'hex'][k]}:{s}:{e}" for s, k, e in found)
        assert got[d]["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert [got[d][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(x[1] == k for x in found) for k in range(3)]
    for d, secret in planted:
        start = texts[d].index(secret)
        assert f"random:{start}:{start + len(secret) + d % 2}" in got[d]["spans"].split(",")
    assert sum("random" in r["spans"] for r in got.values()) == len(planted)
    assert (got[21]["n_assign"], got[21]["n_access"], got[21]["n_hex"]) == (3, 1, 2)


def test_secrets_odd_rows(spark):
    got = secrets.find_secrets(table(spark, ODD)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["spans"]) for r in got) == sorted((d is None, d or 0, "") for d, _ in ODD)
    assert all(r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in got)
    assert secrets.find_secrets(table(spark, [])).count() == 0


def test_found_share_of_false_ones():
    """Prose runs alone: the step-up rule takes hardly any of them."""
    rng = random.Random(5)
    text = np.zeros((16, 512), dtype=np.int64)
    runs = np.zeros((16, 512), dtype=np.int64)
    for _ in range(20000):
        text[0, min(511, int(rng.gauss(100, 20)))] += 1
    for _ in range(2000):
        runs[0, min(511, int(rng.gauss(100, 20)))] += 1
    assert runs[0, : secrets.cuts_of(text, runs, 0.05)[0] + 1].sum() <= 5
    runs[0, 5] += 500
    cut = secrets.cuts_of(text, runs, 0.05)[0]
    assert cut >= 5 and runs[0, : cut + 1].sum() - 500 <= 60


# 12 divergence


def plain_audit(rows, least_docs, terms):
    """Every formula of the docstring over dictionaries."""
    docs = [(x or "", s or "", [t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for text, x, s in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        held = Counter(t for d in mine for t in set(d[2]))
        kept = sorted(t for t, n in held.items() if n >= least_docs)
        counts = {s: Counter() for s in {d[1] for d in mine}}
        for _, s, ts in mine:
            counts[s].update(t for t in ts if held[t] >= least_docs)
        whole = sum(counts.values(), Counter())

        def p(c, t):
            return 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))

        for s, c in counts.items():
            pairs = [(-sum((p(c, t) - p(o, t)) ** 2 // p(o, t) for t in kept), x) for x, o in counts.items() if x != s]
            apart = [(-((p(c, t) - p(whole, t)) ** 2 // p(whole, t)), t) for t in kept if c[t] > 0 and p(c, t) > p(whole, t)]
            for part, found in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(apart, key=lambda x: (x[0], x[1].encode()))[:terms])):
                out |= {(lang, s, part, item, -v, k) for k, (v, item) in enumerate(found, 1)}
    return out


def audit_rows():
    rng = random.Random(12)
    rows = []
    for _ in range(150):
        source = rng.choice(["a", "a", "a", "b", "c", "é", None, ""])
        words = rng.choices(["One", "zwei", "TREFFEN", "ñandú", "x1y", "don't", "日本語", "ﬁ", "KK", "Ä"], k=rng.randrange(0, 30))
        rows.append((rng.choice([" ", "\n", "\x00-", "9"]).join(words), rng.choice(["en", "en", "de", None]), source))
    return [*rows, (None, "en", "only null"), ("", "fr", "x"), ("once", "fr", "y"), ("A " * 20000, "en", "long")]


@pytest.mark.parametrize("sources,shard", [(256, 1 << 18), (2, 16)])
def test_divergence(spark, monkeypatch, sources, shard):
    monkeypatch.setattr(divergence, "SOURCES", sources)
    monkeypatch.setattr(divergence, "SHARD", shard)
    rows = audit_rows()
    docs = table(spark, rows, "text string, lang string, source string").repartition(3)
    got = [tuple(r) for r in divergence.divergence_audit(docs, terms=4).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got)) and set(got) == plain_audit(rows, 3, 4)
    assert ("fr", "x", "pair", "y", 0, 1) in got


@pytest.mark.parametrize("piece,fresh,held", [(1, 1, 1), (300, 20, 40)])
def test_divergence_counts_in_pieces(spark, monkeypatch, piece, fresh, held):
    rows = audit_rows()
    docs = table(spark, rows, "text string, lang string, source string").repartition(2)
    want = {tuple(r) for r in divergence.term_counts(docs).collect()}
    for name, value in (("PIECE", piece), ("FRESH", fresh), ("HELD", held)):
        monkeypatch.setattr(divergence, name, value)
    got = [tuple(r) for r in divergence.term_counts(docs).collect()]
    assert len(got) == len(want) and set(got) == want


def test_divergence_odd(spark):
    schema = "text string, lang string, source string"
    assert divergence.divergence_audit(table(spark, [], schema)).count() == 0
    assert divergence.divergence_audit(table(spark, [(None, None, None)], schema)).count() == 0
    # Probabilities of counts whose product with the unit is beyond 64 bits.
    big = spark.createDataFrame([(10**13, 3 * 10**14, 10**7)], "n long, total long, v long")
    assert big.select(divergence.probability(F.col("n"), F.col("total"), F.col("v"))).first()[0] == 1 + 10**9 * (10**13 + 1) // (3 * 10**14 + 10**7)


# 13 search


def plain_search(docs, items, k):
    def terms(text):
        return [t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]

    held = [(d, Counter(ts), len(ts)) for d, ts in ((d, terms(t)) for d, t in docs) if ts]
    n, length = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for i, text in items:
        scored = []
        for d, c, size in held:
            m = 100 - 75 + 75 * size * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(i, r, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("tree,leaf,wave", [(2048, 64, 1 << 25), (50, 4, 200), (7, 2, 1 << 25)])
def test_ball_tree_search(spark, monkeypatch, tree, leaf, wave):
    for name, value in (("TREE", tree), ("LEAF", leaf), ("WAVE", wave)):
        monkeypatch.setattr(balltree, name, value)
    rng = random.Random(13)
    docs = [(d, prose(rng, rng.choice([0, 3, 30, 200]))) for d in range(400)]
    passages = [prose(rng, 25) for _ in range(6)]
    docs += [(1000 + d, f"{prose(rng, 20)} {passages[d % 6]}! {prose(rng, 5)}") for d in range(40)]
    docs += [(2000 + d, passages[0]) for d in range(30)] + [*ODD, (None, passages[1]), (7, "ÄRGER KK 日本 x1")]
    items = [(i, p) for i, p in enumerate(passages)] + [(9, "the the the re"), (10, None), (11, ""), (12, "nowhereword"), (None, "x1 same"), (13, "the same"), (13, "the same"), (14, "Ärger ÄRGER 日本")]
    got = balltree.search(table(spark, docs).repartition(3), table(spark, items, "item_id long, text string"), k=10)
    assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect()), key=str) == plain_search(docs, items, 10)


def test_ball_tree_odd(spark):
    docs, items = table(spark, ODD), table(spark, [(1, "same")], "item_id long, text string")
    assert balltree.search(docs.where("false"), items).count() == 0
    assert balltree.search(docs, items.where("false")).count() == 0
    assert balltree.search(docs.where("text is null"), items).count() == 0


def test_bounds_hold_and_prune():
    """No document scores above the bound of a node over it, and groups of alike documents are passed over."""
    rng = np.random.default_rng(13)
    rows = []
    for d in range(600):
        codes = np.unique(rng.integers(0, 40, 12) + 40 * (d % 8))
        rows.append({"_doc": d, "_codes": codes.astype(np.int32).tobytes(), "_values": rng.integers(1, 10**10, len(codes)).tobytes()})
    tree = balltree.Tree(balltree._tree(pd.DataFrame(rows)).to_dict("records")[0])
    asked = rng.integers(0, 3, (20, len(tree.terms))) * (rng.random((20, len(tree.terms))) < 0.1)
    asked[10:, 40:] = 0
    bounds, passed = tree.bounds(asked), 0
    for leaf in tree.leaves:
        docs, scores = tree.scores(asked, leaf)
        assert len(docs) <= balltree.LEAF and (scores.max(axis=1) <= bounds[:, leaf]).all()
    best = np.sort(np.concatenate([tree.scores(asked, leaf)[1] for leaf in tree.leaves], axis=1), axis=1)[:, -10]
    passed = (bounds[10:, tree.leaves] < best[10:, None]).mean()
    assert passed > 0.3

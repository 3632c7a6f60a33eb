"""Toxicity: a weighted lexicon matched by Aho-Corasick in folded text, with exception phrases."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.session import materialize, ship_package

# Insults that are looked for whatever the labels; a word that no labelled row holds gets the median weight.
LEXICON = (
    "idiot moron imbecile stupid dumb dumbass fool loser clown trash garbage scum filth vermin worthless pathetic disgusting "
    "repulsive ugly retard freak pervert creep coward liar bastard bitch whore slut asshole shit bullshit fuck fucking cunt dickhead "
    "jackass douchebag nazi subhuman"
).split()
EXCEPTIONS = ["clown fish", "trash can", "garbage collection", "garbage collector", "idiot proof", "fool proof", "april fool", "dumb waiter", "ugly duckling", "loser bracket"]
ENDINGS = ("", "s", "es")
# Letters of other scripts, and signs, that look like Latin letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p",
    "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԝ": "w", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
    "υ": "u", "χ": "x", "ı": "i", "ł": "l", "á": "a", "à": "a", "â": "a", "ä": "a", "å": "a", "ã": "a", "é": "e", "è": "e", "ê": "e",
    "ë": "e", "í": "i", "ì": "i", "î": "i", "ï": "i", "ó": "o", "ò": "o", "ô": "o", "ö": "o", "õ": "o", "ú": "u", "ù": "u", "û": "u",
    "ü": "u", "ç": "c", "ñ": "n",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"}
WIDE = {chr(0xFF21 + i): chr(97 + i) for i in range(26)} | {chr(0xFF41 + i): chr(97 + i) for i in range(26)}
SHIFT = str.maketrans(HOMOGLYPHS | DIGITS | WIDE)
HITS = "_doc long, n_words long, _s double, n_hits int, _hash long"
SAMPLE_ROWS = 20_000  # labelled rows that weights and coefficients are fitted on
LEAST_DOCS, LEAST_SHARE = 5, 0.5  # toxic texts that hold such a word; lower bound of its share of toxic texts


def fold(text: str) -> str:
    """Lower case, look-alike letters and digit substitutions replaced; one character for one."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return low.translate(SHIFT)


def automaton(weights: dict[str, float], exceptions: list[str]):
    """Aho-Corasick over folded words and exception phrases; values are (weight or None, length)."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, weight in weights.items():
        found.add_word(fold(word), (weight, len(word)))
    for phrase in exceptions:
        found.add_word(fold(phrase), (None, len(phrase)))
    found.make_automaton()
    return found


def weigh(text: str, machine) -> tuple[float, int]:
    """Sum of weights and number of hits: whole words of the text that no exception phrase covers."""
    hits, spared = [], []
    for end, (weight, length) in machine.iter(fold(text)):
        start = end - length + 1
        if (start and text[start - 1].isalnum()) or (end + 1 < len(text) and text[end + 1].isalnum()):
            continue
        (spared if weight is None else hits).append((start, end, weight))
    kept = [w for start, end, w in hits if not any(s <= start and end <= e for s, e, _ in spared)]
    return float(sum(kept)), len(kept)


def match_lexicon(docs: DataFrame, weights: dict[str, float], exceptions: list[str], doc: str, text: str) -> DataFrame:
    """``(_doc, n_words, _s, n_hits, _hash)``, one row per document, over whole texts; ``_hash`` is of the text."""
    ship_package(docs.sparkSession)
    phrases = list(exceptions)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = automaton(weights, phrases)
        for batch in batches:
            texts = [t or "" for t in batch["_text"]]
            found = [weigh(t, machine) for t in texts]
            yield pd.DataFrame(
                {"_doc": batch["_doc"], "n_words": [len(t.split()) for t in texts], "_s": [f[0] for f in found], "n_hits": [f[1] for f in found], "_hash": batch["_hash"]}
            )

    return docs.select(F.col(doc).cast("long").alias("_doc"), F.col(text).alias("_text"), F.xxhash64(F.col(text)).alias("_hash")).mapInPandas(run, HITS)


def learn_weights(sample: DataFrame, lexicon: list[str]) -> dict[str, float]:
    """Log odds of folded words in the distinct texts of ``sample (_text, _y)``.

    Besides the lexicon, all words of at least ``LEAST_DOCS`` toxic texts count whose share of toxic
    texts is above ``LEAST_SHARE`` with some certainty. They are as many as the sample bears out.
    """
    letters = HOMOGLYPHS | {k: v for k, v in DIGITS.items() if k.isalnum()} | WIDE
    low = F.translate(F.lower("_text"), "".join(letters), "".join(letters.values()))
    said = F.array_distinct(F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    # One row per text, in which its words are distinct already.
    texts = materialize(sample.groupBy(F.md5("_text")).agg(F.first(said).alias("_words"), F.max("_y").alias("_y")), "texts")
    words = texts.select("_y", F.explode("_words").alias("word"))
    totals = {r["_y"]: r["n"] for r in texts.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    counts = words.groupBy("word").agg(F.sum("_y").alias("t"), F.sum(1 - F.col("_y")).alias("c"))
    n, z = F.col("t") + F.col("c"), 1.96
    share = F.col("t") / n
    sure = (share + z * z / 2 / n - z * F.sqrt(share * (1 - share) / n + z * z / 4 / n / n)) / (1 + z * z / n)
    base = [fold(w) for w in lexicon]
    own = counts.where(F.col("word").isin(*base)).collect()
    more = counts.where((F.col("t") >= LEAST_DOCS) & (sure >= LEAST_SHARE)).collect()
    weights = {
        r["word"]: max(0.0, math.log((r["t"] + 0.5) / (bad + 1)) - math.log((r["c"] + 0.5) / (good + 1))) for r in [*own, *more]
    }
    middle = float(np.median([weights[w] for w in base if w in weights] or [3.0]))
    for w in base:
        weight = weights.setdefault(w, middle)
        for end in ENDINGS:
            weights.setdefault(w + end, weight)
    return weights


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 25) -> np.ndarray:
    """Newton steps for a logistic regression with a constant first column."""
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (y - p) - ridge * beta
        bend = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(bend, slope)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def score_toxicity(
    docs: DataFrame, labels: DataFrame, lexicon: list[str] = LEXICON, exceptions: list[str] = EXCEPTIONS, threshold: float = 0.3,
    sample_rows: int = SAMPLE_ROWS, doc: str = "doc_id", text: str = "text", toxic: str = "toxic",
    text_hash: str | None = None,
) -> DataFrame:
    """One row per document: id, ``held_out``, ``score`` in 0..1, ``predicted`` and ``n_hits``.

    Words and weights are learned from at most ``sample_rows`` labelled rows that are not held out (crc32 of the
    id mod 4 is not 2), those with the smallest hash: all words that these rows bear out. The weighted hits and their
    density by words go through a logistic function, fitted on the same rows. Without labels of
    both kinds the lexicon's weights are 1 and fixed coefficients hold.

    Null and empty texts have no hits and get the score of any clean text. Repeated rows are
    scored each; other columns are ignored; an empty table gives no row. ``text_hash`` names one more
    column, ``xxhash64`` of the text, that tells rows of one id apart.
    """

    def held(column: str) -> Column:
        return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2

    given = labels.select(F.col(doc).cast("long").alias("_doc"), F.col(toxic).cast("int").alias("_y")).where("_y in (0, 1)")
    chosen = given.where(~held("_doc")).distinct().orderBy(F.xxhash64("_doc"), "_doc", "_y").limit(sample_rows)
    # No more than ``sample_rows`` pairs of numbers.
    chosen = F.broadcast(materialize(chosen, "chosen"))
    rows = docs.select(F.col(doc).cast("long").alias("_doc"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    read = materialize(rows.join(chosen, "_doc").select("_text", "_y"), "sample")
    learned = read.select("_y").distinct().count() == 2
    weights = learn_weights(read, list(lexicon)) if learned else {fold(w + end): 1.0 for w in lexicon for end in ENDINGS}
    hits = materialize(match_lexicon(docs, weights, exceptions, doc, text), "hits")
    scored = hits.withColumn("_d", F.lit(100.0) * F.col("_s") / F.greatest("n_words", F.lit(1)))
    inputs = [(F.col("_s") > 0).cast("double"), F.log1p("_s"), F.log1p("_d")]
    beta = np.array([-4.0, 2.5, 1.0, 1.0])
    if learned:
        frame = scored.join(chosen, "_doc").select("_y", *[x.alias(f"x{i}") for i, x in enumerate(inputs)]).toPandas()
        x = np.column_stack([np.ones(len(frame)), frame[["x0", "x1", "x2"]].to_numpy(float)])
        beta = fit_logistic(x, frame["_y"].to_numpy(float))
    line = F.lit(float(beta[0]))
    for b, x in zip(beta[1:], inputs, strict=True):
        line = line + F.lit(float(b)) * x
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-line))
    return scored.select(
        F.col("_doc").alias(doc), held("_doc").alias("held_out"), score.alias("score"), (score >= threshold).cast("int").alias("predicted"), "n_hits",
        *([F.col("_hash").alias(text_hash)] if text_hash else []),
    )

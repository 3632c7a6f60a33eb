"""Secret scans: fixed patterns, and a battery of randomness tests under false-discovery control.

A run of key characters is scored by how little it looks drawn at random from the alphabet of its
encoding: uniform use of the alphabet (chi-squared), runs of its lower and upper half, correlation of
neighbours. Ordinary text, squeezed to the same alphabet and cut to the same length, tells how often text
scores as low; runs that score lower than text does, at a bounded share of false ones, are secrets.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.session import materialize, ship_package

KINDS = ["assign", "access", "hex", "random"]
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ["password", "passwd", "secret", "token", "apikey", "api_key"]
ACCESS = re.compile("AKIA[A-Z0-9]{14,}")  # 18 characters or more
HEX = re.compile("[0-9a-f]{16,}")
KEY = re.compile("[A-Za-z0-9+/_-]{16,}={0,2}")

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Encodings by size of their alphabet, which characters stand for the same place in it, and what text is folded by.
ALPHABETS = [
    (16, [DIGITS + LOWER[:6], DIGITS + UPPER[:6]], str.upper),
    (32, [UPPER + DIGITS[2:8]], str.upper),
    (36, [LOWER + DIGITS, UPPER + DIGITS], str.upper),
    (64, [UPPER + LOWER + DIGITS + "+/", UPPER + LOWER + DIGITS + "-_"], str),
]
LENGTHS = [16, 24, 40, 80]  # the shortest run of each class of lengths
BINS, STEPS = 512, 4  # scores above the last bin count as it; bins per unit of score
CELLS = 1 << 17  # characters in the windows that are scored at a time
HELD = 1 << 18  # characters of texts that a task holds


def _places(spellings: list[str]) -> np.ndarray:
    out = np.full(256, -1, dtype=np.int8)
    for letters in spellings:
        out[np.frombuffer(letters.encode(), dtype=np.uint8)] = np.arange(len(letters))
    return out


PLACES = [_places(spellings) for _, spellings, _ in ALPHABETS]
# A logarithm of tail probabilities of the normal distribution at steps of 1/64: above z from -8 on, and beyond z on either side.
ABOVE = np.array([-2 * math.log(max(math.erfc(z / 64 / math.sqrt(2)) / 2, 1e-300)) for z in range(-512, 2433)])
BEYOND = np.array([-2 * math.log(max(math.erfc(z / 64 / math.sqrt(2)), 1e-300)) for z in range(2433)])


def encoding(run: str) -> int | None:
    """The smallest alphabet that spells a run; numbers, and letters of one case alone with a sign, are in the last."""
    run = run.rstrip("=")
    if run.isdigit():
        return None
    used = set(run)
    for i, (_, spellings, _) in enumerate(ALPHABETS[:-1]):
        if any(used <= set(letters) for letters in spellings):
            return i
    return len(ALPHABETS) - 1


def battery(codes: np.ndarray, size: int) -> np.ndarray:
    """Score bin of each column of places in an alphabet: minus twice the sum of the logarithms of three p-values."""
    n, runs = codes.shape
    x = codes.astype(np.int32)
    counts = np.bincount((x + np.arange(runs) * size).ravel(), minlength=runs * size).reshape(runs, size)
    chi = np.einsum("ij,ij->i", counts, counts) * (size / n) - n
    free = 2 / (9 * (size - 1))
    uniform = (np.cbrt(chi / (size - 1)) - (1 - free)) / math.sqrt(free)
    score = ABOVE[np.clip(uniform * 64, -512, 2432).astype(np.int64) + 512]
    # Changes between the halves of the alphabet, given how many places are in the upper one.
    upper = codes >= size // 2
    changes = np.add.reduce(upper[1:] != upper[:-1], axis=0, dtype=np.int32)
    a = np.add.reduce(upper, axis=0, dtype=np.int32)
    twice = 2.0 * a * (n - a)
    spread = np.sqrt(np.maximum(twice * (twice - n), 0) / (n * n * (n - 1)))
    away = np.where((a == 0) | (a == n), math.sqrt(n), np.abs(changes - twice / n) / np.where(spread > 0, spread, 1))
    score = score + BEYOND[np.clip(away * 64, 0, 2432).astype(np.int64)]
    # Correlation of neighbours.
    total = x.sum(axis=0)
    mean = total / n
    near = (x[1:] * x[:-1]).sum(axis=0) - mean * (2 * total - x[0] - x[-1]) + (n - 1) * mean**2
    whole = (x * x).sum(axis=0) - n * mean**2
    like = np.where(whole > 1e-6, near / np.where(whole > 1e-6, whole, 1), 1.0)
    score = score + BEYOND[np.clip(np.abs(like + 1 / n) * math.sqrt(n) * 64, 0, 2432).astype(np.int64)]
    return np.minimum(score * STEPS, BINS - 1).astype(np.int64)


def length_class(n: int) -> int:
    return int(np.searchsorted(LENGTHS, n, side="right")) - 1


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int]]]:
    """Base spans ``(start, end, kind)``, and key runs that none of them meets ``(start, end, cell, bin)``."""
    base = []
    low = text.lower()
    if any(word in low for word in ASSIGN_WORDS):
        base += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    base += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    base += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    base.sort()
    runs = []
    reach = np.maximum.accumulate([0, *[b[1] for b in base]])
    starts = [b[0] for b in base]
    for m in KEY.finditer(text):
        # Of the base spans that begin before the run ends, the furthest end.
        if reach[np.searchsorted(starts, m.end())] > m.start():
            continue
        kind = encoding(m[0])
        if kind is not None:
            run = PLACES[kind][np.frombuffer(m[0].rstrip("=").encode(), dtype=np.uint8)]
            score = int(battery(run[:, None], ALPHABETS[kind][0])[0])
            runs.append((m.start(), m.end(), kind * len(LENGTHS) + length_class(len(run)), score))
    return base, runs


def plain(text: str) -> str:
    """A text without its key runs: what ordinary text looks like."""
    return KEY.sub(" ", text)


def text_scores(texts: list[str]) -> np.ndarray:
    """How many windows of ordinary text fall in each bin, by cell. Windows follow one another from the start of each text."""
    out = np.zeros((len(ALPHABETS) * len(LENGTHS), BINS), dtype=np.int64)
    for kind, (size, _, fold) in enumerate(ALPHABETS):
        found = [PLACES[kind][np.frombuffer(fold(t).encode("utf-8", "surrogatepass"), dtype=np.uint8)] for t in texts]
        found = [f[f >= 0] for f in found]
        sizes = np.array([len(f) for f in found], dtype=np.int64)
        codes = np.concatenate(found) if found else np.zeros(0, dtype=np.int8)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        for at, length in enumerate(LENGTHS):
            windows = codes[place < np.repeat(sizes // length * length, sizes)].reshape(-1, length)
            step = max(1, CELLS // length)
            for k in range(0, len(windows), step):
                part = battery(np.ascontiguousarray(windows[k : k + step].T), size)
                out[kind * len(LENGTHS) + at] += np.bincount(part, minlength=BINS)
    return out


def cuts_of(text: np.ndarray, runs: np.ndarray, rate: float) -> list[int]:
    """The highest bin of each cell that counts as a secret, -1 for none.

    A run's p-value is the share of text windows that score no higher, counting itself. Within each class of
    lengths the step-up rule bounds the expected share of false ones among the found by ``rate``, so
    long runs, which are easy to tell, make no room for short ones.
    """
    p = (1 + np.cumsum(text, axis=1)) / (1 + text.sum(axis=1, keepdims=True))
    cuts = [-1] * len(p)
    for at in range(len(LENGTHS)):
        cells = range(at, len(p), len(LENGTHS))
        values = np.concatenate([p[c] for c in cells])
        counts = np.concatenate([runs[c] for c in cells])
        order = np.argsort(values, kind="stable")
        values, below = values[order], np.cumsum(counts[order])
        # Equal values share the count of the last of them.
        below = below[np.searchsorted(values, values, side="right") - 1]
        good = values[(values * max(counts.sum(), 1) <= rate * below)]
        if len(good):
            for c in cells:
                cuts[c] = int(np.searchsorted(p[c], good.max(), side="right")) - 1
    return cuts


def scanned(docs: DataFrame) -> DataFrame:
    """A row ``(_doc, _base, _runs)`` per document, and per task rows ``(_cell, _scores)`` of its ordinary text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, held, chars = 0, [], 0
        for batch in batches:
            base, runs = [], []
            for text in batch["_text"]:
                b, r = scan(text)
                base.append([{"start": x, "end": y, "kind": k} for x, y, k in b])
                runs.append([{"start": x, "end": y, "cell": c, "bin": s} for x, y, c, s in r])
                held.append(plain(text))
                chars += len(text)
                if chars > HELD:
                    total, held, chars = total + text_scores(held), [], 0
            yield pd.DataFrame({"_doc": batch["_doc"], "_null": batch["_null"], "_base": base, "_runs": runs, "_cell": None, "_scores": None})
        total = total + text_scores(held)
        yield pd.DataFrame({"_doc": 0, "_null": True, "_base": None, "_runs": None, "_cell": range(len(total)), "_scores": list(total)})

    span = "start: int, end: int"
    return docs.mapInPandas(run, f"_doc long, _null boolean, _base array<struct<{span}, kind: int>>, _runs array<struct<{span}, cell: int, bin: int>>, _cell int, _scores array<long>")


def _histogram(rows: DataFrame) -> np.ndarray:
    out = np.zeros((len(ALPHABETS) * len(LENGTHS), BINS), dtype=np.int64)
    for row in rows.collect():
        out[row["cell"], row["bin"]] = row["n"]
    return out


def find_secrets(docs: DataFrame, rate: float = 0.05, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256`` and ``spans``.

    Base spans are assignments to a password, secret, token or key of 12 characters or more, access keys of 18 or
    more and lower-case hexadecimal runs of 16 or more. Runs of 16 or more key characters that meet no base span add
    spans of kind ``random`` if the battery can't tell them from random ones although it can ordinary text. Numbers
    are none. The text windows that this is measured by, and the runs, are counted over all documents.

    ``spans`` lists ``kind:start:end`` in code points, the end not included, by start and kind. Null and empty texts have
    none. Repeated rows stay rows of their own, ids may be null. Other columns are ignored. An empty table gives no row.
    """
    ship_package(docs.sparkSession)
    given = docs.select(F.coalesce(F.col(doc).cast("long"), F.lit(0)).alias("_doc"), F.col(doc).isNull().alias("_null"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    found = materialize(scanned(given), "spans")
    rows = found.where("_cell is null")
    ordinary = found.where("_cell is not null").select(F.col("_cell").alias("cell"), F.posexplode("_scores").alias("bin", "v")).where("v > 0")
    ordinary = _histogram(ordinary.groupBy("cell", "bin").agg(F.sum("v").alias("n")))
    runs = _histogram(rows.select(F.explode("_runs").alias("r")).groupBy("r.cell", "r.bin").agg(F.count("*").alias("n")))
    cuts = F.array(*[F.lit(c) for c in cuts_of(ordinary, runs, rate)])

    def listed(spans: Column) -> Column:
        names = F.array(*[F.lit(k) for k in KINDS])
        told = F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"]))
        return F.array_join(told, ",")

    def ordered(spans: Column, kind) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), kind(s).alias("kind"), s["end"].alias("end")))

    base = ordered(F.col("_base"), lambda s: s["kind"])
    more = ordered(F.filter("_runs", lambda s: s["bin"] <= cuts[s["cell"]]), lambda s: F.lit(KINDS.index("random")))
    counts = [F.size(F.expr(f"filter(_base, s -> s.kind = {k})")).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    return rows.select(F.when(~F.col("_null"), F.col("_doc")).alias(doc), *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.concat(base, more)).alias("spans"))

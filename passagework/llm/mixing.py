"""Soft-membership mixing: document rates whose expected tokens per domain match targets."""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.functions.arrays import let
from passagework.llm.packing import word_count, words_of
from passagework.session import materialize

BINS = 24
WRITTEN = 20  # steps after which rates are written


def features(text: Column, words: Column) -> dict[str, Column]:
    """Small integers, below ``BINS``, that describe a text's form."""
    chars = F.greatest(F.length(text), F.lit(1))

    def share(kept: str) -> Column:
        rest = F.length(F.regexp_replace(text, kept, ""))
        return F.least(F.lit(BINS - 1), F.ceil(F.lit(2 * BINS) * (F.length(text) - rest) / chars))

    kinds = {
        "words": F.floor(F.log2(words + F.lit(1.0))),
        "word_length": F.floor(chars / F.greatest(words, F.lit(1)) * 2),
        "signs": share("[$%&*#|=<>{}_~^]+"),
        "capitals": share(r"\p{Lu}+"),
        "variety": F.floor(F.lit(BINS) * F.size(F.array_distinct(words_of(text))) / (words + 2)),
    }
    return {k: F.coalesce(F.least(F.lit(BINS - 1), F.greatest(F.lit(0), v)), F.lit(0)).cast("int") for k, v in kinds.items()}


def domain_posteriors(docs: DataFrame, labels: DataFrame, domain: str, doc: str = "doc_id", text: str = "text") -> tuple[DataFrame, list]:
    """``(_doc, _hash, n_tokens, p)``, one row per document, and the domains in the order of ``p``.

    Naive Bayes over the binned features, from the counts of all labelled rows: a table of
    features x bins x domains, bounded whatever the input. A document with two labels counts for
    both; labels of unknown documents or of null count for nothing. Without labelled rows there is
    one domain, ``None``, which holds every document.
    """
    slim = docs.select(F.col(doc).alias("_doc"), F.coalesce(F.col(text), F.lit("")).alias("_text"), F.xxhash64(F.col(text)).alias("_hash"))
    slim = slim.withColumn("n_tokens", word_count(F.col("_text")))
    named = features(F.col("_text"), F.col("n_tokens"))
    slim = materialize(slim.select("_doc", "_hash", "n_tokens", F.array(*named.values()).alias("_bins")), "features")
    given = labels.select(F.col(doc).alias("_doc"), F.col(domain).cast("string").alias("_domain")).where("_domain is not null")
    counts = (
        slim.join(given, "_doc").select("_domain", F.posexplode("_bins").alias("_f", "_bin"))
        .groupBy("_domain", "_f", "_bin").agg(F.count("*").alias("n")).collect()
    )
    domains = sorted({r["_domain"] for r in counts})
    if not domains:
        return slim.select("_doc", "_hash", "n_tokens", F.array(F.lit(1.0)).alias("p")), [None]
    total = {d: sum(r["n"] for r in counts if r["_domain"] == d and r["_f"] == 0) for d in domains}
    seen = {(r["_domain"], r["_f"], r["_bin"]): r["n"] for r in counts}
    scores = []
    for d in domains:
        parts = [F.log(F.lit(float(total[d])))]
        for f in range(len(named)):
            logs = [F.log(F.lit((seen.get((d, f, b), 0) + 0.5) / (total[d] + 0.5 * BINS))) for b in range(BINS)]
            parts.append(F.element_at(F.array(*logs), F.get("_bins", F.lit(f)) + 1))
        scores.append(reduce(lambda x, y: x + y, parts))
    logged = slim.withColumn("_s", F.array(*scores))
    grown = F.transform("_s", lambda s: F.exp(s - F.array_max("_s")))
    whole = F.aggregate(grown, F.lit(0.0), lambda x, y: x + y)
    return logged.select("_doc", "_hash", "n_tokens", F.transform(grown, lambda g: g / whole).alias("p")), domains


def solve(matrix: list[list[float]], right: list[float]) -> list[float]:
    """Solution of a small symmetric system, one row per domain, by elimination."""
    n = len(right)
    a = [[*map(float, row), float(r)] for row, r in zip(matrix, right, strict=True)]
    for i in range(n):
        top = max(range(i, n), key=lambda k: abs(a[k][i]))
        a[i], a[top] = a[top], a[i]
        for k in range(n):
            if k != i:
                by = a[k][i] / a[i][i]
                a[k] = [x - by * y for x, y in zip(a[k], a[i], strict=True)]
    return [a[i][n] / a[i][i] for i in range(n)]


def mix(
    docs: DataFrame, labels: DataFrame, domain: str, targets: dict, doc: str = "doc_id", text: str = "text", tokens: float | None = None, rounds: int = 300, tolerance: float = 1e-9,
    text_hash: str | None = None,
) -> DataFrame:
    """One row per document: id, ``n_tokens``, ``p`` (posterior per domain), ``rate`` and ``copies``.

    The rates minimise, over all rates >= 0, the squared distance of the expected tokens per domain
    ``sum(rate * n_tokens * p)`` from ``targets`` (weights by domain, scaled to ``tokens``, the whole
    corpus by default; domains without a weight get 0). Projected gradient steps start from rate 1, with rates in
    units of ``sqrt(n_tokens)``. As long as they halve the distance, steps are measured in the norm of the domains that
    makes their size 1 right, which reaches targets that can be reached in few rounds; from there on they are plain
    ones with momentum, which end at the least squares whatever the targets. A rate is a function of the
    document's posterior and of the steps since it was last written, a list of one small vector each; a step is one
    aggregation. A warning says if ``rounds`` end before the totals stand still. ``copies`` is
    the rate rounded up or down by a hash of the id, its expectation being the rate.

    Null and empty texts have no tokens and keep rates like others. Repeated rows have the
    same rate each. Other columns are ignored; an empty table gives no row. ``text_hash`` names one more column,
    ``xxhash64`` of the text, that tells rows of one id apart.
    """
    table, domains = domain_posteriors(docs, labels, domain, doc, text)
    table = materialize(table, "posteriors")
    n = len(domains)
    weight = F.col("n_tokens").cast("double")
    p = [F.get("p", F.lit(i)) for i in range(n)]
    gram = table.agg(*[F.sum(weight * p[i] * p[j]).alias(f"g{i}_{j}") for i in range(n) for j in range(n)], F.sum(weight).alias("all")).first()
    everything = float(gram["all"] or 0.0)
    wanted = {str(k): float(v) for k, v in targets.items()}
    share = sum(wanted.values()) or 1.0
    goal = [wanted.get(str(d), 0.0) / share * (everything if tokens is None else tokens) for d in domains]
    if n == 1 and domains[0] is None:
        goal = [everything if tokens is None else float(tokens)]
    g = [[(gram[f"g{i}_{j}"] or 0.0) + (1e-9 * everything + 1e-9 if i == j else 0.0) for j in range(n)] for i in range(n)]
    table = table.withColumn("rate", F.lit(1.0)).withColumn("ahead", F.lit(1.0))
    largest = max(sum(row) for row in g)  # no eigenvalue of a matrix without negative entries is above its largest row
    steps: list[tuple[list[float], float]] = []
    plain, still, momentum, before = False, 0, 1.0, None
    for _ in range(rounds):
        if len(steps) == WRITTEN:
            now = _state(steps, n)
            table, steps = materialize(table.withColumn("_s", now).withColumn("rate", F.col("_s.rate")).withColumn("ahead", F.col("_s.ahead")).drop("_s"), "rates"), []
        state = table.withColumn("_s", _state(steps, n))
        sums = [F.sum(weight * F.col(f"_s.{which}") * p[i]).alias(f"{which}{i}") for which in ("rate", "ahead") for i in range(n)]
        found = state.agg(*sums).first()
        totals, miss = ([(found[f"{which}{i}"] or 0.0) - by for i, by in enumerate(goals)] for which, goals in (("rate", [0.0] * n), ("ahead", goal)))
        far = sum((t - x) ** 2 for t, x in zip(totals, goal, strict=True))
        moved = float("inf") if before is None else max(abs(t - x) for t, x in zip(totals, before[0], strict=True))
        still = still + 1 if plain and moved <= 1e-7 * max(everything, 1.0) else 0
        if max(abs(t - x) for t, x in zip(totals, goal, strict=True)) <= tolerance * max(everything, 1.0) or still == 3:
            break
        if not plain and before is not None and far > before[1] / 4:
            plain = True
        if plain:
            # Momentum starts again whenever it leads away.
            momentum = 1.0 if before is not None and far > before[1] else momentum
            grown = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
            steps.append(([x / largest for x in miss], (momentum - 1) / grown))
            momentum = grown
        else:
            steps.append((solve(g, miss), 0.0))
        before = (totals, far)
    else:
        warnings.warn(f"rates still moved after {rounds} rounds", stacklevel=2)
    table = table.withColumn("rate", _state(steps, n)["rate"])
    rate = F.col("rate")
    chance = F.pmod(F.xxhash64("_doc", F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    copies = F.floor("rate") + F.when(chance < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return table.select(
        F.col("_doc").alias(doc), "n_tokens", "p", rate, copies.cast("int").alias("copies"), *([F.col("_hash").alias(text_hash)] if text_hash else [])
    )


def _state(steps: list[tuple[list[float], float]], n: int) -> Column:
    """Rate, and the point ahead of it that the next step starts from, after more steps; each ends at zero or above."""
    start = F.struct(F.col("rate").alias("rate"), F.col("ahead").alias("ahead"))
    if not steps:
        return start
    moves = F.array(*[F.struct(F.array(*[F.lit(float(x)) for x in move]).alias("move"), F.lit(float(by)).alias("by")) for move, by in steps])

    def step(at: Column, s: Column) -> Column:
        down = reduce(lambda x, y: x + y, [F.get(s["move"], F.lit(i)) * F.get("p", F.lit(i)) for i in range(n)])
        return let(F.greatest(F.lit(0.0), at["ahead"] - down), lambda rate: F.struct(rate.alias("rate"), (rate + s["by"] * (rate - at["rate"])).alias("ahead")))

    return F.aggregate(moves, start, step)

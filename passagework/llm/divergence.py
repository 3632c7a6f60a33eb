"""Source divergence audit: partial term counts by Arrow compute functions, merged counts in columnar shards.

How far apart are the sources of a language, and by which terms? Tasks count terms with Arrow's own
functions; Spark adds the partial counts up; shards of terms, one matrix of terms and sources each, give a
partial divergence for every pair of sources.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.session import materialize, ship_package
from passagework.skew import join_groups, top_per_key

BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"  # what lies between terms
UNIT = 1_000_000_000  # a probability of 1
HELD = 500_000  # partial counts that a task holds before it hands them on
FRESH = 125_000  # partial counts of pieces that are not added up yet, about
PIECE = 1 << 21  # bytes of text that are cut into terms at once, or one document
SHARD = 1 << 17  # counts on a side of a shard, about
SOURCES = 256  # sources on either side of a shard
CELLS = 1 << 21  # cells of a matrix at a time


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences, and documents that hold the term.

    Each group comes once more with the empty term and two zeros, so that groups without terms are there.
    """

    def counted(batch: pa.RecordBatch) -> pa.Table:
        pieces = pc.split_pattern_regex(pc.ascii_lower(batch["text"]), pattern=BETWEEN)
        row, term = pc.list_parent_indices(pieces), pc.list_flatten(pieces)
        filled = pc.not_equal(term, "")
        term = term.filter(filled).dictionary_encode()
        row = row.filter(filled)
        per_row = pa.table({"row": row, "code": term.indices}).group_by(["row", "code"], use_threads=False).aggregate([([], "count_all")])
        named = pa.table({
            "lang": batch["lang"].take(per_row["row"]), "source": batch["source"].take(per_row["row"]), "code": per_row["code"], "n": per_row["count_all"],
        })
        named = named.group_by(["lang", "source", "code"], use_threads=False).aggregate([("n", "sum"), ("n", "count")])
        words = pa.chunked_array([term.dictionary]).take(named["code"]).cast(pa.string())
        groups = pa.table({"lang": batch["lang"], "source": batch["source"]}).group_by(["lang", "source"], use_threads=False).aggregate([])
        zeros = pa.array(np.zeros(len(groups), dtype=np.int64))
        columns = [named["lang"], named["source"], words, named["n_sum"].cast(pa.int64()), named["n_count"].cast(pa.int64())]
        none = [groups["lang"], groups["source"], pa.array([""] * len(groups), pa.string()), zeros, zeros]
        names = ["lang", "source", "term", "n", "docs"]
        return pa.concat_tables([pa.table(columns, names), pa.table(none, names)])

    def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + PIECE, side="right")))
            yield batch.slice(start, end - start)
            start = end

    def merged(tables: list[pa.Table]) -> pa.Table:
        keys = ["lang", "source", "term"]
        total = pa.concat_tables(tables).group_by(keys, use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
        return total.select([*keys, "n_sum", "docs_sum"]).rename_columns([*keys, "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fresh = [], 0  # the sum so far comes first
        for batch in batches:
            for piece in pieces(batch):
                held.append(counted(piece))
                fresh += held[-1].num_rows
                if fresh > FRESH:
                    held, fresh = [merged(held)], 0
                    if held[0].num_rows > HELD:
                        yield from held.pop().to_batches()
        if held:
            yield from merged(held).to_batches()

    given = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((text, "text"), (lang, "lang"), (source, "source"))]
    partial = docs.select(*given).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(n: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(UNIT * (n + 1) / (total + terms))`` in whole numbers of any size."""
    above = (n + 1).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return (F.lit(1) + F.call_function("div", above, F.greatest(total + terms, F.lit(1)).cast("decimal(20,0)"))).cast("long")


def divergence_audit(
    docs: DataFrame, least_docs: int = 3, terms: int = 200, text: str = "text", lang: str = "lang", source: str = "source"
) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: sources by divergence, and the terms that set a source apart.

    A language keeps the terms of at least ``least_docs`` of its documents. Each group of a language and a
    source, and the language as a whole, gives every kept term an add-one smoothed probability in units of
    1e-9; ``f = floor((p - q) ** 2 / q)``. Part ``pair`` ranks, for each group, the other sources of its
    language by the sum of ``f`` over all kept terms, ``q`` being the other's; part ``term`` ranks the
    ``terms`` terms that the group has more often than the language, ``q`` being the language's. Equal
    values go by item. All arithmetic is in whole numbers.

    Null text, language and source count as empty; empty texts add to no count but their group is there, with
    value 0 if its language keeps no term. Repeated rows are documents of their own. Other columns are ignored.
    No document, no row. The pairs of a language are as many as the answer holds, times its kept terms in work.
    """
    ship_package(docs.sparkSession)
    counts = materialize(term_counts(docs, text, lang, source), "counts")
    groups = counts.where("term = ''").select("lang", "source")
    by_term = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs"))
    by_term = by_term.where(F.col("docs") >= least_docs).drop("docs")
    kept = materialize(counts.where("term <> ''").drop("docs").join(by_term, ["lang", "term"]), "kept")
    per_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"), F.count("*").alias("group_terms"))
    per_lang = by_term.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all").alias("lang_n"))
    totals = groups.join(per_group, ["lang", "source"], "left").join(per_lang, "lang", "left").na.fill(0)
    totals = totals.withColumn("rows", F.sum("group_terms").over(_window("lang"))).withColumn("at", F.row_number().over(_window("lang").orderBy("source")) - 1)
    totals = materialize(
        totals.select(
            "lang", "source", "group_terms", "v", "group_n", "lang_n", F.floor(F.col("at") / SOURCES).cast("int").alias("block"),
            F.floor(F.max("at").over(_window("lang")) / SOURCES).cast("int").alias("last"), (F.floor(F.col("rows") / SHARD) + 1).cast("int").alias("shards"),
            probability(F.lit(0), F.col("group_n"), F.col("v")).alias("p0"),
        ),
        "totals",
    )
    known = materialize(
        join_groups(kept, totals, ["lang", "source"], "group_terms", ["term"], "inner").select(
            "lang", "source", "term", "block", "last", "shards", probability(F.col("n"), F.col("group_n"), F.col("v")).alias("p"),
            probability(F.col("all"), F.col("lang_n"), F.col("v")).alias("q"),
        ),
        "probabilities",
    )
    apart = known.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    best = top_per_key(apart, ["lang", "source"], [F.desc("value"), F.asc("item")], terms)
    pairs = pair_sums(known, totals).withColumn("part", F.lit("pair"))
    order = _window("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("rank", F.row_number().over(order)).select(*columns).unionByName(best.select(*columns))


def _window(*keys: str):
    from pyspark.sql import Window

    return Window.partitionBy(*keys)


def pair_sums(known: DataFrame, totals: DataFrame) -> DataFrame:
    """``(lang, source, item, value)`` for all ordered pairs of a language's sources.

    A shard holds the terms of one hash, in blocks of sources on either side, and the groups' probability of an absent term.
    """
    shard = F.pmod(F.xxhash64("term"), F.col("shards")).cast("int").alias("shard")
    rows = known.select("lang", "source", "block", "last", shard, "term", "p")
    absent = totals.select(
        "lang", "source", "block", "last", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.lit(None).cast("string").alias("term"), F.col("p0").alias("p")
    )
    others = F.explode(F.sequence(F.lit(0), F.col("last")))
    both = rows.unionByName(absent).withColumn("x", others)
    left = both.select("lang", "shard", F.col("block").alias("i"), F.col("x").alias("j"), F.lit(True).alias("left"), "source", "term", "p")
    right = both.select("lang", "shard", F.col("x").alias("i"), F.col("block").alias("j"), F.lit(False).alias("left"), "source", "term", "p")
    given = left.unionByName(right)

    def meet(table: pa.Table) -> pa.Table:
        a, b = _side(table.filter(table["left"])), _side(table.filter(pc.invert(table["left"])))
        every = sorted(set(a[1]) | set(b[1]))
        code = {t: k for k, t in enumerate(every)}
        total = np.zeros((len(a[0]), len(b[0])), dtype=np.int64)
        step = max(1, CELLS // max(len(a[0]), len(b[0]), 1))
        for start in range(0, len(every), step):
            p = _matrix(a, code, start, min(step, len(every) - start))
            q = _matrix(b, code, start, min(step, len(every) - start))
            for k in range(p.shape[1]):
                gap = p[:, k : k + 1] - q
                gap *= gap
                total[k] += (gap // q).sum(axis=0)
        m, n = total.shape
        lang = table["lang"][0].as_py()
        source, item = np.array(a[0], dtype=object).repeat(n), np.tile(np.array(b[0], dtype=object), m)
        other = np.flatnonzero(source != item)
        return pa.table({
            "lang": pa.array([lang] * len(other), pa.string()), "source": pa.array(source[other], pa.string()), "item": pa.array(item[other], pa.string()),
            "value": pa.array(total.ravel()[other], pa.int64()),
        })

    sums = given.groupBy("lang", "shard", "i", "j").applyInArrow(meet, "lang string, source string, item string, value long")
    return sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _side(table: pa.Table) -> tuple:
    """Sources in order, terms, and per count: place of its source, its term and its probability; absent terms' probability by source."""
    names = table.filter(pc.is_null(table["term"]))
    order = names.sort_by("source")
    sources = order["source"].to_pylist()
    counts = table.filter(pc.is_valid(table["term"]))
    at = pc.index_in(counts["source"], value_set=pa.array(sources, pa.string())).to_numpy()
    terms = counts["term"].combine_chunks().dictionary_encode()
    if isinstance(terms, pa.ChunkedArray):
        terms = terms.unify_dictionaries().combine_chunks()
    return sources, terms.dictionary.to_pylist(), at, terms.indices.to_numpy(), counts["p"].to_numpy(), order["p"].to_numpy()


def _matrix(side: tuple, code: dict[str, int], start: int, size: int) -> np.ndarray:
    """Probabilities of ``size`` terms from ``start`` on, terms by sources."""
    sources, terms, at, term, p, absent = side
    out = np.repeat(absent[None, :].astype(np.int64), size, axis=0)
    place = np.fromiter((code[t] for t in terms), dtype=np.int64, count=len(terms))[term] - start
    here = (place >= 0) & (place < size)
    out[place[here], at[here]] = p[here]
    return out

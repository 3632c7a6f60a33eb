"""Stored term index: segments of node ranges, searched with upper bounds.

A segment holds ranges of at most ``RANGE`` nodes of one tenant. A range has one row per term, with the nodes that hold
it, their frequencies, the positions and the largest frequency, and one row without a term that lists its nodes.
New nodes are a new segment; ``merge_segments`` makes one of many small ones.

Questions come in waves whose terms go to every task. A task reads the ranges that it was dealt one after
another. A question passes over a range in which even its terms' largest gains would not reach its k-th score so far.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from passagework import skew
from passagework.functions import text as X
from passagework.operators.lexical import MATCH_WEIGHT, RANK_NORM
from passagework.session import materialize

RANGE = 4096  # nodes of a range
RANGE_CHARS = 1 << 23  # characters of a range, about
BUCKET_CHARS = 1 << 28  # characters whose terms share a folder, about
WAVE_TERMS = 1 << 21  # question terms that are looked up together
BLOCK = 1024  # questions that are scored together
CELLS = 1 << 18  # cells of questions by nodes, and postings, that are scored at once
COMMON = 1 << 22  # cells of common terms by nodes
OFTEN = 256  # a term that more than one in so many pairs of a question and a node share is common
KINDS, KIND_TERMS = 16, 128  # kinds of questions, told apart by so many frequent terms
FOUND_ROWS = 1 << 20  # rows found by a task before those that are not among the best are dropped
OUT_ROWS = 1 << 16  # rows of a batch that a task returns
SEGMENTS = 8  # segments of which the small ones are made one
KEYS = ["segment", "tenant", "part"]


def add_segment(nodes: DataFrame, path: str, node: str = "node_id", text: str = "content", doc: str = "doc_id", tenant: str | None = None) -> str:
    """Write the terms of ``nodes`` as a new segment below ``path`` and return its name.

    Work and bytes written follow the nodes given, whatever the index holds already. Without ``tenant`` all nodes
    share one. Null texts have no terms.
    """
    own = F.coalesce(F.col(tenant).cast("string"), F.lit("")) if tenant else F.lit("")
    rows = nodes.select(own.alias("tenant"), F.col(node).alias("id"), F.col(doc).cast("string").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sizes = materialize(rows.groupBy("tenant").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")), "sizes")
    chars = sizes.agg(F.sum("chars")).first()[0] or 0
    parts = F.greatest(F.ceil(F.col("n") / RANGE), F.ceil(F.col("chars") / RANGE_CHARS))
    placed = skew.join_groups(rows, sizes.select("tenant", "n", parts.alias("parts")), ["tenant"], "n", ["id"], "inner")
    part = F.pmod(F.xxhash64("id"), "parts").alias("part")
    keys = ["tenant", "part"]
    dealt = placed.select("tenant", part, "id", "doc", X.tokens(F.col("text")).alias("tokens")).repartition(*keys).sortWithinPartitions(*keys, "id")
    kind = nodes.schema[node].dataType.simpleString()
    schema = (
        f"tenant string, part long, term string, best int, nodes array<int>, tfs array<int>, positions array<int>, ids array<{kind}>, docs array<string>, lengths array<int>"
    )
    bucket = F.when(F.col("term").isNull(), -1).otherwise(F.pmod(F.xxhash64("term"), F.lit(chars // BUCKET_CHARS + 1)))
    found = dealt.mapInArrow(_inverted, schema).withColumn("bucket", bucket.cast("int"))
    name = uuid.uuid4().hex
    # A task writes its ranges' rows straight to the buckets: postings move once, as tokens.
    found.write.partitionBy("bucket").parquet(f"{path}/segment={name}")
    return name


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole ranges, of nodes that come range by range."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table])
        cut = _last_range(rest)
        yield from _ranges(rest.slice(0, cut))
        rest = rest.slice(cut)
    if rest is not None:
        yield from _ranges(rest)


def _starts(table: pa.Table) -> np.ndarray:
    change = np.zeros(len(table) - 1, dtype=bool)
    for c in [c for c in KEYS if c in table.column_names]:
        code = pc.index_in(table[c], value_set=pc.unique(table[c])).to_numpy()
        change |= code[1:] != code[:-1]
    return np.concatenate([[0], np.flatnonzero(change) + 1])


def _last_range(table: pa.Table) -> int:
    return int(_starts(table)[-1]) if len(table) else 0


def _ranges(table: pa.Table) -> Iterator[pa.RecordBatch]:
    if not len(table):
        return
    edges = [*_starts(table).tolist(), len(table)]
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        rows = table.slice(low, high - low).combine_chunks()
        tokens = rows["tokens"].chunk(0) if isinstance(rows["tokens"], pa.ChunkedArray) else rows["tokens"]
        lengths = pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int32)
        node = np.repeat(np.arange(len(rows), dtype=np.int32), lengths)
        place = np.arange(len(node), dtype=np.int32) - np.repeat(np.cumsum(lengths) - lengths, lengths).astype(np.int32)
        words = pc.list_flatten(tokens).dictionary_encode()
        code = words.indices.to_numpy()
        order = np.argsort(code, kind="stable")  # nodes and positions rise already
        code, node, place = code[order], node[order], place[order]
        new = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (node[1:] != node[:-1])])) if len(code) else np.zeros(0, dtype=np.int64)
        tf = np.diff([*new, len(code)]).astype(np.int32)
        first = np.flatnonzero(np.concatenate([[True], code[new][1:] != code[new][:-1]])) if len(new) else np.zeros(0, dtype=np.int64)
        n = len(first)
        offsets = pa.array([*first, len(new)], pa.int32())
        places = pa.array([*new[first], len(code)], pa.int32())
        tenant, part = rows["tenant"][0].as_py(), rows["part"][0].as_py()

        def ints(values: np.ndarray, at: pa.Array) -> pa.Array:
            return pa.ListArray.from_arrays(at, pa.array(values, pa.int32()))

        def one(values: pa.Array) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

        ids, docs = (rows[c].combine_chunks() if isinstance(rows[c], pa.ChunkedArray) else rows[c] for c in ("id", "doc"))
        ids, docs = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (ids, docs))
        lists, listed = pa.list_(pa.int32()), (one(ids), one(docs), one(pa.array(lengths, pa.int32())))
        columns = {
            "tenant": pa.array([tenant] * (n + 1), pa.string()), "part": pa.array([part] * (n + 1), pa.int64()),
            "term": pa.concat_arrays([words.dictionary.take(pa.array(code[new][first])).cast(pa.string()), pa.nulls(1, pa.string())]),
            "best": pa.concat_arrays([pa.array(np.maximum.reduceat(tf, first) if n else tf[:0], pa.int32()), pa.nulls(1, pa.int32())]),
            "nodes": pa.concat_arrays([ints(node[new], offsets), pa.nulls(1, lists)]), "tfs": pa.concat_arrays([ints(tf, offsets), pa.nulls(1, lists)]),
            "positions": pa.concat_arrays([ints(place, places), pa.nulls(1, lists)]),
        } | {name: pa.concat_arrays([pa.nulls(n, x.type), x]) for name, x in zip(("ids", "docs", "lengths"), listed, strict=True)}
        yield pa.RecordBatch.from_pydict(columns)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """All segments below ``path``."""
    return spark.read.option("basePath", path).parquet(f"{path}/segment=*")


def merge_segments(spark: SparkSession, path: str, target: str, most: int = SEGMENTS) -> None:
    """Copy the index to ``target`` with its small segments made one: all but the ``most`` largest ones.

    Ranges stay as they are; their rows get the name of the new segment and a part of their own.
    """
    index = read_index(spark, path)
    sizes = index.where("bucket = -1").groupBy("segment").agg(F.sum(F.size("ids")).alias("n")).orderBy(F.desc("n"), "segment").collect()
    small = [r["segment"] for r in sizes[most:]]
    for r in sizes[:most]:
        index.where(F.col("segment") == r["segment"]).drop("segment").hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{target}/segment={r['segment']}")
    if small:
        # A range's number in the merged segment: a hash of where it came from keeps its rows together.
        rest = index.where(F.col("segment").isin(small)).withColumn("part", F.xxhash64("segment", "part")).drop("segment")
        rest.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{target}/segment={uuid.uuid4().hex}")


def posting_rows(index: DataFrame, node: str = "node_id") -> DataFrame:
    """``(term, node, tenant, tf, first_position, last_position)``, one row per term and node of the index."""
    kind = next(f.dataType.elementType for f in index.schema.fields if f.name == "ids")
    ends = [T.StructField(c, T.IntegerType()) for c in ("first_position", "last_position")]
    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField(node, kind), T.StructField("tenant", T.StringType()), T.StructField("tf", T.LongType()), *ends])
    terms = F.collect_list(F.when(F.col("bucket") >= 0, F.struct("term", "nodes", "tfs", "positions"))).alias("terms")
    heads = F.collect_list(F.when(F.col("bucket") < 0, F.struct("ids"))).alias("heads")
    ranges = index.repartition(*KEYS).groupBy(*KEYS).agg(terms, heads).where((F.size("terms") > 0) & (F.size("heads") > 0))
    return ranges.mapInArrow(_postings(to_arrow_schema(schema)), schema)


def _postings(schema: pa.Schema) -> Callable:
    """Rows of ranges that come as one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tenant, heads, terms in zip(batch["tenant"], batch["heads"], batch["terms"], strict=True):
                term, nodes, tfs, positions = terms.values.flatten()
                held = pc.list_value_length(nodes).to_numpy()
                tf, place = tfs.flatten().to_numpy(), positions.flatten().to_numpy()
                end = np.cumsum(tf, dtype=np.int64)
                columns = [
                    term.take(pa.array(np.repeat(np.arange(len(held)), held))), heads[0]["ids"].values.take(nodes.flatten()), pa.repeat(tenant, len(tf)),
                    pa.array(tf, pa.int64()), pa.array(place[end - tf]), pa.array(place[end - 1]),
                ]
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    return run


def totals(index: DataFrame) -> tuple[int, float]:
    """Number of nodes and their mean length in terms."""
    row = index.where("bucket = -1").agg(F.sum(F.size("ids")).alias("n"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("l")).first()
    return row["n"] or 0, (row["l"] or 0) / max(row["n"] or 0, 1)


@dataclass
class Wave:
    """Questions that are searched together: rows of term codes; tenants and documents that they may see."""

    ids: list
    code: dict[str, int]
    ptr: np.ndarray
    codes: np.ndarray
    tenants: np.ndarray | None
    docs: list[frozenset | None]


def match_gain(wave: Wave) -> tuple[Callable, np.ndarray]:
    """The weights of a term's occurrences fall with 1/j²; a question shares its score among its terms."""
    share = 1 / np.maximum(np.diff(wave.ptr), 1)

    def gain(code: int, tfs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        falling = np.cumsum(1 / np.arange(1, int(tfs.max()) + 1, dtype=np.float64) ** 2)
        return MATCH_WEIGHT * falling[tfs - 1] / RANK_NORM

    return gain, share


def bm25_gain(df: np.ndarray, nodes: int, mean: float, k1: float = 1.2, b: float = 0.75) -> Callable:
    """Okapi BM25 for ``df`` nodes per term code."""
    idf = np.log(1 + (nodes - df + 0.5) / (df + 0.5))

    def gain(code: int, tfs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return idf[code] * tfs * (k1 + 1) / (tfs + k1 * (1 - b + b * lengths / mean))

    return gain


def search(
    index: DataFrame, questions: DataFrame, k: int, scorer: str = "match", query: str = "query_id", text: str = "question",
    node: str = "node_id", tenant: str | None = None, scope: DataFrame | None = None,
) -> DataFrame:
    """``(query, node, score, rank)``: the ``k`` best nodes of every question; any matching term counts.

    With ``tenant`` a question sees the ranges of its tenant; ``scope`` (query, doc_id) restricts the questions that it
    lists to some documents. ``scorer`` is ``match`` or ``bm25``. Scores are rounded to 9 digits, so that the order of
    additions cannot break ties, which go to the smaller node. Questions are dealt to waves of about ``WAVE_TERMS``
    terms; a wave moves each posting of its terms once.
    """
    spark = index.sparkSession
    asked = questions.select(F.col(query).alias("q"), X.query_terms(F.col(text)).alias("terms"), *([F.col(tenant).cast("string").alias("tenant")] if tenant else []))
    if scope is not None:
        lists = scope.groupBy(F.col(query).alias("q")).agg(F.collect_set(F.col("doc_id").cast("string")).alias("docs"))
        asked = asked.join(lists, "q", "left")
    asked = materialize(asked.where(F.size("terms") > 0), "asked")
    waves = (asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // WAVE_TERMS + 1
    kind = next(f.dataType.elementType for f in index.schema.fields if f.name == "ids")
    schema = T.StructType([T.StructField(query, questions.schema[query].dataType), T.StructField(node, kind), T.StructField("score", T.DoubleType())])
    out = None
    for w in range(waves):
        rows = asked.where(F.pmod(F.xxhash64("q"), F.lit(waves)) == w).collect()
        best = _search_wave(spark, index, rows, k, scorer, schema, bool(tenant))
        out = best if out is None else out.unionByName(best)
    return skew.top_per_key(out, [query], [F.desc("score"), F.col(node)], k)


def _search_wave(spark: SparkSession, index: DataFrame, rows: Sequence, k: int, scorer: str, schema: T.StructType, tenant: bool) -> DataFrame:
    code: dict[str, int] = {}
    codes = np.array([code.setdefault(t, len(code)) for r in rows for t in r["terms"]], dtype=np.int64)
    ptr = np.cumsum([0, *[len(r["terms"]) for r in rows]])
    order = _alike(ptr, codes, [r["tenant"] or "" for r in rows] if tenant else [""] * len(rows))
    rows, size = [rows[i] for i in order.tolist()], np.diff(ptr)[order]
    codes, ptr = codes[_spans(ptr[:-1][order], size)], np.append(0, np.cumsum(size))
    has_docs = bool(rows) and "docs" in rows[0].__fields__
    docs = [frozenset(r["docs"]) if has_docs and r["docs"] is not None else None for r in rows]
    wave = Wave([r["q"] for r in rows], code, ptr, codes, np.array([r["tenant"] or "" for r in rows], dtype=object) if tenant else None, docs)
    wanted = spark.createDataFrame(list(code.items()) or [("", -1)], "term string, code int")
    # At most WAVE_TERMS terms, or those of one question.
    found = index.where("bucket >= 0").join(F.broadcast(wanted), "term").select(*KEYS, "code", "nodes", "tfs")
    names = index.where("bucket = -1")
    if scorer == "bm25":
        held = index.where("bucket >= 0").join(F.broadcast(wanted), "term").groupBy("code").agg(F.sum(F.size("nodes")).alias("n")).collect()
        df = np.zeros(max(len(code), 1))
        for r in held:
            df[r["code"]] = r["n"]
        gain, share = bm25_gain(df, *totals(index)), np.ones(len(rows))
    else:
        gain, share = match_gain(wave)
    own_docs = F.col("docs") if has_docs else F.lit(None).cast("array<string>").alias("docs")
    listed = names.select(*KEYS, F.lit(-1).alias("code"), F.lit(None).cast("array<int>").alias("nodes"), F.lit(None).cast("array<int>").alias("tfs"), "ids", own_docs, "lengths")
    # Every task keeps its own best rows of every question, so there are no more tasks than run at once.
    both = listed.unionByName(found, allowMissingColumns=True).repartition(spark.sparkContext.defaultParallelism, *KEYS)
    # A range goes to Python as one row: Spark measures the batch again with every row that it adds to it.
    # Lists are added to in place, where other aggregates would copy the range's ids with every row.
    terms = F.collect_list(F.when(F.col("code") >= 0, F.struct("code", "nodes", "tfs"))).alias("terms")
    heads = F.collect_list(F.when(F.col("code") < 0, F.struct("ids", "docs", "lengths"))).alias("heads")
    ranges = both.groupBy(*KEYS).agg(terms, heads).where((F.size("terms") > 0) & (F.size("heads") > 0))
    return ranges.mapInArrow(_scorer(wave, gain, share, k, to_arrow_schema(schema)), schema)


def _scorer(wave: Wave, gain: Callable, share: np.ndarray, k: int, schema: pa.Schema) -> Callable:
    """Best ``k`` nodes of a task for every question of the wave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, best = _blocks(wave), Best(np.zeros((len(wave.ids), k)), np.zeros(len(wave.ids)))
        for rows in _whole_ranges(batches):
            head = {c: x.values for c, x in rows["heads"][0][0].items()} | {"tenant": rows["tenant"][0].as_py()}
            codes, nodes, tfs = rows["terms"][0].values.flatten()
            size = pc.list_value_length(nodes).to_numpy().astype(np.int64)
            _score_postings(wave, blocks, gain, share, head, codes.to_numpy(), size, nodes.flatten().to_numpy(), tfs.flatten().to_numpy(), best)
        found, names = best.first(), pa.array(wave.ids, schema.types[0])
        for batch in found.to_batches(OUT_ROWS):
            yield pa.RecordBatch.from_arrays([names.take(batch["q"]), batch["id"].cast(schema.types[1]), batch["score"]], schema=schema)

    return run


class Best:
    """The best nodes of every question so far.

    ``top`` has each question's scores and ``least`` the smallest of them, 0 before there are enough; ``rows`` holds what was
    found (question, score, id), of which ``first`` and, from time to time, ``put`` drop what is not among the best any more.
    """

    def __init__(self, top: np.ndarray, least: np.ndarray):
        self.top, self.least = top, least
        self.rows: list[pa.Table] = []
        self.size, self.room = 0, FOUND_ROWS

    def put(self, q: np.ndarray, score: np.ndarray, ids: pa.Array) -> None:
        """Rows of at most ``k`` nodes for each question, questions in order."""
        if not len(q):
            return
        first = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        who, count = q[first], np.diff(np.append(first, len(q)))
        k, more = self.top.shape[1], int(count.max())
        wide = np.zeros((len(who), k + more))
        wide[:, :k] = self.top[who]
        wide[np.repeat(np.arange(len(who)), count), k + np.arange(len(q)) - np.repeat(first, count)] = score
        self.top[who] = np.partition(wide, more, axis=1)[:, more:]
        self.least[who] = np.maximum(self.least[who], self.top[who].min(axis=1))
        self.rows.append(pa.table({"q": pa.array(q, pa.int64()), "score": pa.array(score), "id": ids}))
        self.size += len(q)
        if self.size > self.room:
            found = self.first()
            self.rows, self.size, self.room = [found], len(found), max(FOUND_ROWS, 2 * len(found))

    def first(self) -> pa.Table:
        """The best rows; of equal scores those of the smaller nodes."""
        if not self.rows:
            return pa.table({"q": pa.array([], pa.int64()), "score": pa.array([], pa.float64()), "id": pa.array([], pa.string())})
        found = pa.concat_tables(self.rows).combine_chunks()
        found = found.filter(pa.array(found["score"].to_numpy() >= self.least[found["q"].to_numpy()]))
        found = found.sort_by([("q", "ascending"), ("score", "descending"), ("id", "ascending")])
        return found.filter(pa.array(_places(found["q"].to_numpy()) < self.top.shape[1]))


def _places(q: np.ndarray) -> np.ndarray:
    """The place of each row among those of its question, questions in order."""
    return np.arange(len(q)) - np.searchsorted(q, q)


def _whole_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one range after another, of rows that come range by range."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table])
        edges = _starts(rest).tolist() if len(rest) else [0]
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            yield rest.slice(low, high - low)
        rest = rest.slice(edges[-1])
    if rest is not None and len(rest):
        yield rest


def _first(found: list[tuple], k: int) -> list[tuple]:
    found.sort(key=lambda x: (-x[0], x[1]))
    return found[:k]


def _score_range(wave: Wave, gain: Callable, share: np.ndarray, k: int, rows: list[dict], least: np.ndarray, best: list[list[tuple]]) -> None:
    """Score the nodes of one range, whose first row lists them, and add what may be among each question's ``best``."""
    lists = [[np.asarray(row[c]) for row in rows[1:]] for c in ("nodes", "tfs")]
    codes, size = np.array([int(row["code"]) for row in rows[1:]]), np.array([len(x) for x in lists[0]])
    if len(rows) > 1:
        scores = [[s for s, _ in _first(found, k)] for found in map(list, best)]
        kept = Best(np.array([s + [0.0] * (k - len(s)) for s in scores]), least)
        head = rows[0] | {c: pa.array(rows[0][c]) for c in ("ids", "docs", "lengths")}
        _score_postings(wave, _blocks(wave), gain, share, head, codes, size, *map(np.concatenate, lists), kept)
        for row in (row for found in kept.rows for row in found.to_pylist()):
            best[row["q"]].append((row["score"], row["id"]))


@dataclass
class Block:
    """Questions ``low`` to ``high`` of a wave: the codes they hold, and for each of their terms the question and the place of its code."""

    low: int
    high: int
    used: np.ndarray
    row: np.ndarray
    col: np.ndarray


def _blocks(wave: Wave) -> list[Block]:
    out = []
    for low in range(0, len(wave.ids), BLOCK):
        high = min(low + BLOCK, len(wave.ids))
        used, col = np.unique(wave.codes[wave.ptr[low] : wave.ptr[high]], return_inverse=True)
        out.append(Block(low, high, used, np.repeat(np.arange(high - low), np.diff(wave.ptr[low : high + 1])), col))
    return out


def _alike(ptr: np.ndarray, codes: np.ndarray, tenants: Sequence[str]) -> np.ndarray:
    """An order of questions in which neighbours share tenant, frequent terms and number of terms, so that blocks are of one kind.

    Only the work depends on it, never the rows found.
    """
    counts = np.diff(ptr)
    _, own = np.unique(np.array(tenants, dtype=object), return_inverse=True)
    if len(counts) <= BLOCK:
        return np.lexsort((counts, own))
    often = np.argsort(-np.bincount(codes), kind="stable")[:KIND_TERMS]
    place = np.full(int(codes.max()) + 1, -1)
    place[often] = np.arange(len(often))
    col = place[codes]
    points = np.zeros((len(counts), len(often)), dtype=np.float32)
    points[np.repeat(np.arange(len(counts)), counts)[col >= 0], col[col >= 0]] = 1
    points /= np.maximum(np.sqrt(points.sum(axis=1, keepdims=True)), 1)
    centers = points[np.linspace(0, len(points) - 1, KINDS).astype(np.int64)]
    for _ in range(8):
        kind = (points @ centers.T).argmax(axis=1)
        for c in np.unique(kind):
            total = points[kind == c].sum(axis=0)
            centers[c] = total / max(float(np.sqrt(total @ total)), 1e-9)
    # Where a kind ends and the next one begins, questions are alike in size.
    return np.lexsort((np.where(kind % 2, -counts, counts), kind, own))


def _score_postings(
    wave: Wave, blocks: list[Block], gain: Callable, share: np.ndarray, head: dict, codes: np.ndarray, size: np.ndarray, place: np.ndarray, tfs: np.ndarray, best: Best
) -> None:
    """Score the nodes of one range, block by block of questions; each of ``codes`` has ``size`` nodes in ``place``."""
    if not len(codes) or not len(wave.ids):
        return
    start = np.cumsum(size) - size
    value = gain(np.repeat(codes, size), tfs, head["lengths"].to_numpy(zero_copy_only=False)[place])
    top = np.append(np.maximum.reduceat(value, start), 0.0)
    slot = np.full(len(wave.code), -1)
    slot[codes] = np.arange(len(codes))
    found = [x for block in blocks for x in _score_block(wave, block, share, head, slot, top, start, size, place, value, best)]
    if found:
        q, node, score = (np.concatenate(x) for x in zip(*found, strict=True))
        # Nodes of a range are in order.
        order = np.lexsort((node, -score, q))
        order = order[_places(q[order]) < best.top.shape[1]]
        best.put(q[order], score[order], head["ids"].take(pa.array(node[order])))


def _score_block(
    wave: Wave, block: Block, share: np.ndarray, head: dict, slot: np.ndarray, top: np.ndarray, start: np.ndarray, size: np.ndarray, place: np.ndarray, value: np.ndarray, best: Best
) -> Iterator[tuple]:
    """Questions of a block, nodes of a range and scores that may be among the best.

    Left out are questions that the largest gains of their terms, and nodes that all gains of the block's terms, do not bring to a
    k-th score. What is left meets in one product of matrices for the terms that many questions and nodes hold, and posting by
    posting for the others. That is done in single precision; rows within its error of a k-th score are added up again.
    """
    n, k, span = len(head["ids"]), best.top.shape[1], slice(block.low, block.high)
    at = slot[block.used]
    bound = np.bincount(block.row, weights=top[at][block.col], minlength=block.high - block.low)
    floor = np.maximum(best.least[span] - 1e-8, 1e-300) / share[span]
    may = bound >= floor
    if wave.tenants is not None:
        may &= wave.tenants[span] == head["tenant"]
    if not may.any():
        return
    # Questions and nodes from the most to the least that they need, or can have: a question meets the first nodes only.
    asked = np.flatnonzero(may)
    asked = asked[np.argsort(-floor[asked])]
    term = at[at >= 0]
    posting = _spans(start[term], size[term])
    reach = np.bincount(place[posting], weights=value[posting], minlength=n)
    node = np.argsort(-reach)
    widths = np.searchsorted(-reach[node], -floor[asked], side="right")
    width = int(widths[-1])
    if not width:
        return
    node = node[:width]
    # Postings of the nodes that are left; each term's follow one another.
    new = np.full(n, -1)
    new[node] = np.arange(width)
    seen = new[place[posting]]
    kept = np.append(0, np.cumsum(seen >= 0))
    gains, seen = value[posting][seen >= 0], seen[seen >= 0]
    ends = np.cumsum(size[term])
    first = kept[ends - size[term]]
    count = kept[ends] - first
    # The terms of the questions that are left.
    line, number = np.full(len(at), -1), np.full(len(may), -1)
    line[at >= 0] = np.arange(len(term))
    number[asked] = np.arange(len(asked))
    row, col = number[block.row], line[block.col]
    own = np.flatnonzero((row >= 0) & (col >= 0))
    own = own[np.argsort(row[own].astype(np.uint16), kind="stable")]
    row, col = row[own], col[own]
    pairs = np.bincount(col, minlength=len(term)) * count
    common = np.flatnonzero(pairs * OFTEN > len(asked) * width)
    common = common[np.argsort(-pairs[common], kind="stable")][: COMMON // width]
    spot = np.full(len(term), -1)
    spot[common] = np.arange(len(common))
    right, left = np.zeros((len(common), width), dtype=np.float32), np.zeros((len(asked), len(common)), dtype=np.float32)
    both = _spans(first[common], count[common])
    right[np.repeat(np.arange(len(common)), count[common]), seen[both]] = gains[both]
    dense = spot[col] >= 0
    left[row[dense], spot[col[dense]]] = 1
    rare_row, rare = row[~dense], col[~dense]
    single = gains.astype(np.float32)
    least, floor, part = best.least[asked + block.low], floor[asked], share[asked + block.low]
    # Sums of as many positive numbers as a question has terms are exact up to this share.
    slack = 1 - 1.2e-7 * (np.bincount(row, minlength=len(asked)) + 4)
    docs = [wave.docs[q] for q in (asked + block.low).tolist()]
    of_doc = pc.dictionary_encode(head["docs"]) if any(d is not None for d in docs) else None
    work = np.append(0, np.cumsum(np.bincount(rare_row, weights=count[rare], minlength=len(asked))))
    near_q, near_x = [], []
    low = int(np.searchsorted(widths, 1))
    while low < len(asked):
        high = max(low + 1, min(low + CELLS // int(widths[low]), int(np.searchsorted(work, work[low] + CELLS, side="right")) - 1, len(asked)))
        near = int(widths[high - 1])
        total = left[low:high] @ right[:, :near]
        mine = slice(*np.searchsorted(rare_row, [low, high]))
        each = count[rare[mine]]
        more = _spans(first[rare[mine]], each)
        cell, x = np.repeat((rare_row[mine] - low) * near, each), seen[more]
        if near < width:
            more, cell, x = more[x < near], cell[x < near], x[x < near]
        np.add.at(total.reshape(-1), cell + x, single[more])
        for i in range(low, high) if of_doc is not None else ():
            if docs[i] is not None:
                there = np.array([d in docs[i] for d in of_doc.dictionary.to_pylist()] + [False], dtype=bool)
                total[i - low, ~there[pc.fill_null(of_doc.indices, -1).to_numpy(zero_copy_only=False)[node[:near]]]] = 0
        limit = np.maximum(floor[low:high] * slack[low:high], 1e-30).astype(np.float32)
        some = np.flatnonzero(total.max(axis=1) >= limit)
        total, limit = total[some], limit[some]
        q, x = np.divmod(np.flatnonzero(total >= limit[:, None]), near)
        full = np.bincount(q, minlength=len(some)) > 2 * k
        if full.any():
            limit[full] = np.partition(total[full], near - k, axis=1)[:, near - k] * slack[low:high][some[full]]
            hit = total[q, x] >= limit[q]
            q, x = q[hit], x[hit]
        near_q.append(some[q] + low)
        near_x.append(x)
        low = high
    q, x = np.concatenate([np.zeros(0, np.int64), *near_q]), np.concatenate([np.zeros(0, np.int64), *near_x])
    if len(q):
        score = np.round(_exact(q, x, row, col, seen, np.repeat(np.arange(len(term)), count), gains) * part[q], 9)
        hit = (score > 0) & (score >= least[q])
        yield asked[q[hit]] + block.low, node[x[hit]], score[hit]


def _exact(q: np.ndarray, x: np.ndarray, row: np.ndarray, col: np.ndarray, seen: np.ndarray, term: np.ndarray, gains: np.ndarray) -> np.ndarray:
    """The gains of nodes ``x`` added up for questions ``q``: question ``row`` holds term ``col``, node ``seen`` has ``gains`` for ``term``."""
    held = np.bincount(seen)
    order, start = np.argsort(seen.astype(np.uint16) if len(held) < 1 << 16 else seen, kind="stable"), np.cumsum(held) - held
    some, number = np.unique(q), np.full(int(row.max()) + 1, -1)
    number[some] = np.arange(len(some))
    asks = np.zeros((len(some), int(max(col.max(), term.max())) + 1), dtype=bool)
    own = number[row] >= 0
    asks[number[row[own]], col[own]] = True
    out, work = np.zeros(len(q)), np.append(0, np.cumsum(held[x]))
    low = 0
    while low < len(q):
        high = max(low + 1, int(np.searchsorted(work, work[low] + 4 * CELLS, side="right")) - 1)
        each = held[x[low:high]]
        posting = order[_spans(start[x[low:high]], each)]
        pair = np.repeat(np.arange(high - low), each)
        hit = asks[number[q[low:high]][pair], term[posting]]
        out[low:high] = np.bincount(pair[hit], weights=gains[posting[hit]], minlength=high - low)
        low = high
    return out


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all spans one after another."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())

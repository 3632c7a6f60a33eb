"""Ranked lexical search by a sparse ball tree: exact inner products, subtrees pruned by centroid and radius.

A document is a sparse vector of what each term adds to a score, a question one of how often it says a
term. Documents are sorted by their heaviest terms and cut into trees of bounded size. No document
below a node can score more than ``q . centroid + |q| * radius``, over the node's terms; leaves are read in falling order of the
bound until it falls below the score that is still needed, and scored in whole numbers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.session import materialize, ship_package
from passagework.skew import top_per_key

TREE, LEAF = 2048, 64  # documents of a tree and of a leaf at most
WAVE = 1 << 25  # characters of the questions that are searched together, about
PROBES = 2  # trees that are read first, for a score to begin with
CELLS = 1 << 20  # cells of a matrix of questions and terms at a time
LAST = 2**63 - 1  # stands for a null id, which comes after all others
TERM_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()
INDEX = "_tree long, _docs binary, _ptr binary, _codes binary, _values binary, _nodes binary, _radius binary"


def terms_of(text: str | None) -> list[bytes]:
    """Runs of digits, letters and characters from U+0080 on as UTF-8; only A-Z are lower-cased. Null has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(TERM_BYTES).split()


@dataclass
class Questions:
    """Questions of a wave in rows of term codes and counts."""

    ids: np.ndarray
    copies: np.ndarray
    code: dict[bytes, int]
    ptr: np.ndarray
    codes: np.ndarray
    counts: np.ndarray

    @staticmethod
    def of(rows: list) -> Questions:
        code: dict[bytes, int] = {}
        said = [Counter(terms_of(r["_text"])) for r in rows]
        codes = [code.setdefault(t, len(code)) for c in said for t in c]
        ptr = np.cumsum([0, *map(len, said)])
        counts = np.array([n for c in said for n in c.values()], dtype=np.int64)
        ids, copies = (np.array([r[c] for r in rows], dtype=np.int64) for c in ("_item", "_copies"))
        return Questions(ids, copies, code, ptr, np.array(codes, dtype=np.int64), counts)

    def matrix(self, start: int, end: int, terms: np.ndarray) -> np.ndarray:
        """How often the questions from ``start`` to ``end`` say the sorted ``terms``."""
        a, b = self.ptr[start], self.ptr[end]
        row = np.repeat(np.arange(end - start), np.diff(self.ptr[start : end + 1]))
        at = np.searchsorted(terms, self.codes[a:b])
        known = terms[np.minimum(at, len(terms) - 1)] == self.codes[a:b]
        out = np.zeros((end - start, len(terms)), dtype=np.int64)
        out[row[known], at[known]] = self.counts[a:b][known]
        return out

    def blocks(self, terms: np.ndarray) -> Iterator[tuple[int, int]]:
        step, n = max(1, CELLS // len(terms)), len(self.ids)
        for start in range(0, n, step):
            yield start, min(n, start + step)


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents of every item whose score is above 0.

    A term's weight is ``floor(1000 * ln((2 N + 2) / (2 df + 1)))``; a document of ``n`` terms has
    ``m = 25 + 75 n N div L`` and gives a term that it holds ``tf`` times ``weight * (10**9 tf div (1000 tf + 8 m))``
    for each time the item says it. ``N`` counts documents with a term, ``L`` all their terms. Equal scores go
    by id; the answer is exact, whatever is pruned.

    Items come in waves of about ``WAVE`` characters, whose terms go to every task; a wave is a pass over the
    texts. Null and empty texts have no terms: such items get no row, such documents are in none. A null id comes after
    all others. Repeated rows are documents, or items, of their own. Other columns are ignored. Ids are whole numbers.
    """
    spark = docs.sparkSession
    ship_package(spark)
    asked = items.select(_id(item).alias("_item"), F.col(item_text).alias("_text"))
    asked = materialize(asked.groupBy("_item", "_text").agg(F.count("*").alias("_copies")), "items")
    waves = (asked.agg(F.sum(F.length("_text"))).first()[0] or 0) // WAVE + 1
    given = docs.select(_id(doc).alias("_doc"), F.col(text).alias("_text"))
    found = None
    for wave in range(waves):
        rows = asked.where(F.pmod(F.xxhash64("_item", "_text"), F.lit(waves)) == wave).orderBy("_item", "_text").collect()
        best = _search_wave(given, Questions.of(rows), k)
        found = best if found is None else found.unionByName(best)
    named = (F.nullif("_item", F.lit(LAST)).alias(item), F.col("rank"), F.nullif("_doc", F.lit(LAST)).alias(doc), F.col("_score").alias("score"))
    return found.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(*named)


def _id(name: str) -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(LAST))


def _search_wave(docs: DataFrame, asked: Questions, k: int) -> DataFrame:
    vectors = materialize(term_vectors(docs, asked.code), "vectors")
    total = vectors.agg(F.count("*").alias("n"), F.sum("_n").alias("l")).first()
    held = vectors.select(F.explode("_codes").alias("code")).groupBy("code").agg(F.count("*").alias("n")).toPandas()
    df = np.zeros(len(asked.code), dtype=np.int64)
    df[held["code"].to_numpy(np.int64)] = held["n"].to_numpy(np.int64)
    weight = np.array([math.floor(1000 * math.log((2 * total["n"] + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)
    index = materialize(trees(vectors, weight, total["n"], total["l"] or 1), "trees")
    nearest = top_per_key(index.mapInPandas(_roots(asked), "_q long, _tree long, _bound double"), ["_q"], [F.desc("_bound"), F.asc("_tree")], PROBES)
    first = nearest.groupBy("_tree").agg(F.collect_list("_q").alias("_asked"))
    # At most PROBES trees for a question of the wave.
    begun = index.join(F.broadcast(first), "_tree").mapInPandas(_reader(asked, k, None), "_q long, _item long, _copies long, _doc long, _score long")
    ranked = top_per_key(begun, ["_q"], [F.desc("_score"), F.asc("_doc")], k).where(F.col("rank") == k).select("_q", "_score").toPandas()
    needed = np.ones(len(asked.ids), dtype=np.int64)
    needed[ranked["_q"].to_numpy(np.int64)] = ranked["_score"].to_numpy(np.int64)
    best = index.mapInPandas(_reader(asked, k, needed), "_q long, _item long, _copies long, _doc long, _score long")
    return materialize(top_per_key(best, ["_q"], [F.desc("_score"), F.asc("_doc")], k), "ranked")


def term_vectors(docs: DataFrame, code: dict[bytes, int]) -> DataFrame:
    """``(_doc, _n, _codes, _tfs)`` of each document with a term: all its terms counted, and those that ``code`` holds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for d, text in zip(batch["_doc"], batch["_text"], strict=True):
                said = terms_of(text)
                if said:
                    tf = Counter(filter(code.__contains__, said))
                    rows.append((d, len(said), [code[t] for t in tf], list(tf.values())))
            yield pd.DataFrame(rows, columns=["_doc", "_n", "_codes", "_tfs"])

    return docs.mapInPandas(run, "_doc long, _n long, _codes array<int>, _tfs array<long>")


def trees(vectors: DataFrame, weight: np.ndarray, n: int, length: int) -> DataFrame:
    """Trees of documents whose heaviest terms are alike, one row each."""

    def gains(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for d, size, codes, tf in zip(batch["_doc"], batch["_n"], batch["_codes"], batch["_tfs"], strict=True):
                codes, tf = np.asarray(codes, dtype=np.int64), np.asarray(tf, dtype=np.int64)
                m = 25 + 75 * size * n // length
                gain = weight[codes] * (10**9 * tf // (1000 * tf + 8 * m))
                codes, gain = codes[gain > 0], gain[gain > 0]
                if len(gain):
                    top = codes[np.lexsort((codes, -gain))[:2]]
                    out.append((d, top[0], top[-1], codes.astype(np.int32).tobytes(), gain.tobytes()))
            yield pd.DataFrame(out, columns=["_doc", "_a", "_b", "_codes", "_values"])

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            while len(rest) >= TREE:
                yield _tree(rest.iloc[:TREE])
                rest = rest.iloc[TREE:]
        if rest is not None and len(rest):
            yield _tree(rest)

    rows = vectors.where(F.size("_codes") > 0).mapInPandas(gains, "_doc long, _a long, _b long, _codes binary, _values binary")
    order = ["_a", "_b", "_doc"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(grow, INDEX)


def _sums(part: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    return np.add.reduceat(part, ptr[:-1], axis=-1)


def _tree(rows: pd.DataFrame) -> pd.DataFrame:
    """Documents in the order of the leaves; nodes ``(low, high, parent)``, parents first, and their radii."""
    docs = rows["_doc"].to_numpy(np.int64)
    sizes = np.array([len(c) // 4 for c in rows["_codes"]])
    ptr = np.concatenate([[0], np.cumsum(sizes)])
    codes, values = np.frombuffer(b"".join(rows["_codes"]), dtype=np.int32), np.frombuffer(b"".join(rows["_values"]), dtype=np.int64)
    terms, local = np.unique(codes, return_inverse=True)
    x, square = values.astype(np.float64), _sums(values.astype(np.float64) ** 2, ptr)

    def picked(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the entries of some documents, and where each of these begins."""
        begins = np.concatenate([[0], np.cumsum(sizes[some])])
        return np.arange(begins[-1]) - np.repeat(begins[:-1] - ptr[some], sizes[some]), begins

    order, nodes, radii, waiting = np.arange(len(docs)), [], [], [(0, len(docs), -1)]
    while waiting:
        low, high, parent = waiting.pop()
        some = order[low:high]
        at, begins = picked(some)
        centre = np.bincount(local[at], x[at], len(terms)) / len(some)
        away = square[some] - 2 * _sums(x[at] * centre[local[at]], begins) + centre @ centre
        # Far more than the rounding errors of these sums.
        radii.append(math.sqrt(max(float(away.max()), 0.0) + 1e-9 * float(square[some].max() + centre @ centre)))
        nodes.append((low, high, parent))
        if high - low <= LEAF:
            continue

        def dense(i: int) -> np.ndarray:
            out = np.zeros(len(terms))
            out[local[ptr[i] : ptr[i + 1]]] = x[ptr[i] : ptr[i + 1]]
            return out

        one = dense(some[away.argmax()])
        two = dense(some[(square[some] - 2 * _sums(x[at] * one[local[at]], begins)).argmax()])
        along = _sums(x[at] * (two - one)[local[at]], begins)
        order[low:high] = some[np.lexsort((docs[some], along))]
        middle, me = (low + high) // 2, len(nodes) - 1
        waiting += [(middle, high, me), (low, middle, me)]
    at, begins = picked(order)
    out = {
        "_tree": xxhash.xxh3_64_intdigest(docs[order].tobytes() + values[at].tobytes()) & LAST, "_docs": docs[order].tobytes(), "_ptr": begins.astype(np.int64).tobytes(),
        "_codes": codes[at].tobytes(), "_values": values[at].tobytes(), "_nodes": np.array(nodes, dtype=np.int64).tobytes(), "_radius": np.array(radii).tobytes(),
    }
    return pd.DataFrame([out])


class Tree:
    """A tree as it was written, with the centroids of its nodes."""

    def __init__(self, row: dict, only_root: bool = False):
        self.docs, self.ptr, self.values = (np.frombuffer(x, dtype=np.int64) for x in (row["_docs"], row["_ptr"], row["_values"]))
        self.terms, self.local = np.unique(np.frombuffer(row["_codes"], dtype=np.int32), return_inverse=True)
        nodes = np.frombuffer(row["_nodes"], dtype=np.int64).reshape(-1, 3)
        self.nodes, self.radius = (nodes[:1], np.frombuffer(row["_radius"])[:1]) if only_root else (nodes, np.frombuffer(row["_radius"]))
        self.centres = np.stack([self._centre(low, high) for low, high, _ in self.nodes])
        # Children follow their parents; a node without any is a leaf.
        self.leaves = np.setdiff1d(np.arange(len(self.nodes)), self.nodes[:, 2])

    def _centre(self, low: int, high: int) -> np.ndarray:
        a, b = self.ptr[low], self.ptr[high]
        return np.bincount(self.local[a:b], self.values[a:b].astype(np.float64), len(self.terms)) / (high - low)

    def bounds(self, asked: np.ndarray) -> np.ndarray:
        """No document below a node scores more for a question; rows are questions. Rounded up by far more than the errors.

        Of a question, only terms that occur below the node count: those where the centroid is not zero.
        """
        x = asked.astype(np.float64)
        norm = np.sqrt((x * x) @ (self.centres > 0).T)
        out = np.where(norm > 0, (x @ self.centres.T + norm * self.radius) * (1 + 1e-9) + 1, 0)
        for node, parent in enumerate(self.nodes[:, 2].tolist()):
            if parent >= 0:
                np.minimum(out[:, node], out[:, parent], out=out[:, node])
        return out

    def scores(self, asked: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of a leaf, and their exact scores."""
        low, high, _ = self.nodes[leaf]
        a, b = self.ptr[low], self.ptr[high]
        out = np.empty((len(asked), high - low), dtype=np.int64)
        step = max(1, CELLS // int(b - a))
        for k in range(0, len(asked), step):
            part = asked[k : k + step, self.local[a:b]]
            part *= self.values[a:b]
            out[k : k + step] = _sums(part, self.ptr[low : high + 1] - a)
        return self.docs[low:high], out


def _roots(asked: Questions):
    """The best trees of a task for every question, by the bound of their roots."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bound, tree = np.zeros((len(asked.ids), PROBES)), np.zeros((len(asked.ids), PROBES), dtype=np.int64)
        for batch in batches:
            for row in batch.to_dict("records"):
                it = Tree(row, only_root=True)
                for start, end in asked.blocks(it.terms):
                    now = it.bounds(asked.matrix(start, end, it.terms))
                    both = np.concatenate([bound[start:end], now], axis=1)
                    names = np.concatenate([tree[start:end], np.full((end - start, 1), row["_tree"])], axis=1)
                    best = np.argsort(-both, axis=1, kind="stable")[:, :PROBES]
                    bound[start:end], tree[start:end] = np.take_along_axis(both, best, 1), np.take_along_axis(names, best, 1)
        q, at = np.nonzero(bound)
        yield pd.DataFrame({"_q": q, "_tree": tree[q, at], "_bound": bound[q, at]})

    return run


def _reader(asked: Questions, k: int, needed: np.ndarray | None):
    """The ``k`` best documents of a task for every question, if they reach the ``needed`` score.

    Without ``needed``, a tree answers only the questions in its ``_asked``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = len(asked.ids)
        score, doc = np.zeros((n, k), dtype=np.int64), np.full((n, k), LAST, dtype=np.int64)
        least = np.ones(n, dtype=np.int64) if needed is None else needed.copy()
        for batch in batches:
            for row in batch.to_dict("records"):
                it = Tree(row)
                wanted = np.ones(n, dtype=bool)
                if needed is None:
                    wanted[:] = False
                    wanted[np.asarray(row["_asked"], dtype=np.int64)] = True
                for start, end in asked.blocks(it.terms):
                    if wanted[start:end].any():
                        _read(it, asked.matrix(start, end, it.terms), wanted[start:end], score[start:end], doc[start:end], least[start:end])
        q, at = np.nonzero(score)
        yield pd.DataFrame({"_q": q, "_item": asked.ids[q], "_copies": asked.copies[q], "_doc": doc[q, at], "_score": score[q, at]})

    return run


def _read(it: Tree, asked: np.ndarray, wanted: np.ndarray, score: np.ndarray, doc: np.ndarray, least: np.ndarray) -> None:
    """Leaves of a tree in falling order of their bounds, as long as one may hold a document that is needed."""
    k = score.shape[1]
    bound = it.bounds(asked)[:, it.leaves]
    bound[~wanted] = 0
    order = np.argsort(-bound, axis=1, kind="stable")
    live = np.arange(len(asked))
    for turn in range(len(it.leaves)):
        leaf = order[live, turn]
        on = bound[live, leaf] >= least[live]
        live, leaf = live[on], leaf[on]
        if not len(live):
            return
        for one in np.unique(leaf):
            q = live[leaf == one]
            docs, found = it.scores(asked[q], it.leaves[one])
            found = np.where(found >= least[q, None], found, 0)
            q, found = q[found.any(axis=1)], found[found.any(axis=1)]
            all_scores = np.concatenate([score[q], found], axis=1)
            all_docs = np.concatenate([doc[q], np.broadcast_to(docs, found.shape)], axis=1)
            best = np.lexsort((all_docs, -all_scores), axis=1)[:, :k]
            score[q], doc[q] = np.take_along_axis(all_scores, best, 1), np.take_along_axis(all_docs, best, 1)
            least[q] = np.maximum(least[q], score[q, -1])

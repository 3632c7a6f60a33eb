"""MinHash near-duplicates with an LSH forest.

Distinct shingle sets are sorted by several signature orders. In each order, sets with a common
prefix form regions; a region with many sets is read one signature value deeper, and so on.
Neighbours in a region whose sketches agree are candidates. Sets of regions that are not compared as a
whole are marked, and joined on their rarest shingles. Candidates are confirmed on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.graph import components, renamed
from passagework.llm.shingles import shingle_set
from passagework.session import materialize, ship_package

TREES, DEPTH, SHALLOW = 16, 16, 3  # orders, values per order, values that neighbours share at least
REGION = 256  # sets in a region above which it is read deeper, and its sets are marked
NEAR = 2  # sorted neighbours on either side that are compared whatever their region; the first round takes one
FIRST = 1  # partners per set and order that the first round hands on; the second has no limit
GROUP = 128  # sets whose full shingles meet in one task
STRETCH = 128  # rows of an order whose small regions go together
COLUMNS = 1 << 14  # shingles of a region that are compared at a time
LONG = 1024  # values of the sketch that the second round compares
BINS = 1 << 20  # counters of the order by rarity
SLOTS = 1 << 26  # bits that say which documents' texts are read again
TASK = ["_part", "_low", "_high"]  # what names a task that confirms pairs
BLOCK = 1024  # sets with one rare shingle in a block; pairs of blocks are dealt to tasks

_rng = np.random.default_rng(20240607)
XORS = _rng.integers(0, 2**32, LONG, dtype=np.uint32)
ODDS = _rng.integers(0, 2**31, LONG, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
LOW = np.uint64(0x5555555555555555)


def signature(shingles: np.ndarray, values: int = TREES * DEPTH) -> np.ndarray:
    """The smallest hash of a set under each permutation, block by block for long sets."""
    low = np.full(values, 0xFFFFFFFF, dtype=np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 1024):
        part = (short[None, at : at + 1024] ^ XORS[:values, None]) * ODDS[:values, None]
        np.minimum(low, part.min(axis=1), out=low)
    return low


def keys_and_sketch(low: np.ndarray) -> tuple[bytes, bytes]:
    """Big-endian 16-bit values of all orders, one after another, and two bits per value."""
    mixed = low * np.uint32(0x9E3779B1)
    mixed ^= mixed >> np.uint32(15)
    bits = np.unpackbits((mixed & np.uint32(3)).astype(np.uint8)[:, None], axis=1)[:, 6:]
    return (mixed >> np.uint32(16)).astype(">u2").tobytes(), np.packbits(bits.ravel()).tobytes()


def sketch_similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of sketches (rows of uint64) by broadcasting."""
    differ = a ^ b
    differ = (differ | (differ >> np.uint64(1))) & LOW
    equal = 1 - np.bitwise_count(differ).sum(axis=-1) / (differ.shape[-1] * 32)
    return (equal - 0.25) / 0.75


def least_estimate(share: tuple[int, int], values: int) -> float:
    """The wanted similarity less four standard errors of its estimate."""
    equal = 0.25 + 0.75 * share[0] / share[1]
    return share[0] / share[1] - 4 * (equal * (1 - equal) / values) ** 0.5 / 0.75


def regions(keys: np.ndarray, start: int, end: int, depth: int) -> Iterator[tuple[int, int]]:
    """Ranges of sorted key rows that share a prefix: as short as leaves at most ``REGION`` rows."""
    if end - start < 2:
        return
    if depth >= SHALLOW and (end - start <= REGION or depth == keys.shape[1]):
        for at in range(start, end, REGION):
            yield at, min(end, at + REGION)
        return
    column = keys[start:end, depth]
    cuts = start + 1 + np.flatnonzero(column[1:] != column[:-1])
    edges = [start, *cuts.tolist(), end]
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        yield from regions(keys, low, high, depth + 1)


def hits(
    keys: np.ndarray, groups: np.ndarray, sizes: np.ndarray, sketches: np.ndarray, share: tuple[int, int], near: int, limit: int | None
) -> Iterator[tuple[np.ndarray, np.ndarray, int | None]]:
    """Places ``(i, j)`` in one sorted order of sets that may be similar enough and whose groups differ.

    They come region by region, with the place of the region's first row; those that no region holds together,
    among ``near`` neighbours, with None. ``limit`` bounds the partners of a set in a region to its most similar ones.
    """
    n, least = len(keys), least_estimate(share, sketches.shape[1] * 32)
    region_of = np.full(n, -1)

    def fit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return share[1] * np.minimum(a, b) >= share[0] * np.maximum(a, b)

    for first, end, _ in shallow_regions(keys, near):
        for low, high in regions(keys, first, end, SHALLOW):
            region_of[low:high] = low
            like = sketch_similarity(sketches[low:high, None], sketches[None, low:high])
            like[groups[low:high, None] == groups[None, low:high]] = -1
            like[~fit(sizes[low:high, None], sizes[None, low:high])] = -1
            if limit is not None and high - low > limit:
                floor = -np.partition(-like, limit - 1, axis=1)[:, limit - 1]
                ok = (like >= least) & (like >= floor[:, None])
                ok &= np.cumsum(ok, axis=1) <= limit
                i, j = np.nonzero(ok)
            else:
                i, j = np.nonzero(like >= least)
            yield low + i, low + j, low
    # Neighbours in the order that share the shallow prefix.
    for step in range(1, near + 1):
        i = np.flatnonzero((keys[step:, :SHALLOW] == keys[:-step, :SHALLOW]).all(axis=1)) if n > step else np.zeros(0, int)
        i = i[(groups[i] != groups[i + step]) & fit(sizes[i], sizes[i + step]) & ((region_of[i] < 0) | (region_of[i] != region_of[i + step]))]
        if len(i):
            i = i[sketch_similarity(sketches[i], sketches[i + step]) >= least]
            yield i, i + step, None


def shallow_regions(keys: np.ndarray, near: int) -> Iterator[tuple[int, int, bool]]:
    """Rows that share the shallow prefix, if more than neighbours alone cover, and whether too many to compare as a whole."""
    if len(keys) > 1:
        change = np.flatnonzero((keys[1:, :SHALLOW] != keys[:-1, :SHALLOW]).any(axis=1)) + 1
        edges = np.concatenate([[0], change, [len(keys)]])
        for k in np.flatnonzero(np.diff(edges) > near + 1):
            yield int(edges[k]), int(edges[k + 1]), bool(edges[k + 1] - edges[k] > REGION)


def node_of(shingles: np.ndarray) -> int:
    """Hash of a whole set, as a signed integer."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).astype(np.int64))


def sets_of(docs: DataFrame, shingle: int, doc: str, text: str) -> DataFrame:
    """``(_doc, _n, _node, _keys, _sketch, _hash)`` per document; ``_node`` is a hash of the whole set, ``_hash`` of the text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for t in batch["_text"]:
                found = shingle_set(t, shingle)
                keys, sketch = keys_and_sketch(signature(found)) if len(found) else (None, None)
                node = node_of(found) if len(found) else None
                rows.append((len(found), node, keys, sketch))
            yield pd.DataFrame({"_doc": batch["_doc"], "_hash": batch["_hash"], **{c: pd.Series([r[i] for r in rows], dtype=t) for i, (c, t) in enumerate((("_n", "int64"), ("_node", "Int64"), ("_keys", object), ("_sketch", object)))}})

    given = docs.select(F.col(doc).cast("long").alias("_doc"), F.col(text).alias("_text"), F.xxhash64(F.col(text)).alias("_hash"))
    return given.mapInPandas(run, "_doc long, _n long, _node long, _keys binary, _sketch binary, _hash long")


def forest(nodes: DataFrame, share: tuple[int, int], near: int, limit: int | None, pairs: bool) -> DataFrame:
    """What the sorted orders of ``nodes (_node, _group, _n, _keys, _sketch)`` put together.

    With ``pairs`` distinct candidate pairs ``(a, b)``, else rows ``(a, b)`` of a region's number and a set in it that
    has a candidate there; sets that are not compared as a whole come as ``(a, a)`` of pairs and as ``(null, b)`` of
    regions. All orders are one sort: ranges of (order, key) go to tasks of even size. The first and the last
    region of a range may go on in the next one, so their nodes are marked as well.
    """
    step = DEPTH * 2
    trees = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))
    rows = nodes.withColumn("_tree", trees).select(
        "_tree", F.substring("_keys", F.col("_tree") * step + 1, F.lit(step)).alias("_key"), "_node", "_group", "_n", "_sketch"
    )
    ordered = rows.repartitionByRange("_tree", "_key", "_node").sortWithinPartitions("_tree", "_key", "_node")

    def found(frame: pd.DataFrame) -> pd.DataFrame:
        out = [_of_tree(part, int(tree), share, near, limit, pairs) for tree, part in frame.groupby("_tree", sort=False)]
        return pd.DataFrame(np.concatenate(out) if out else np.zeros((0, 2), dtype=np.int64), columns=["a", "b"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, began = None, False
        for batch in batches:
            frame = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if not len(frame):
                continue
            # The last shallow region may go on in the next batch; a very large one goes on from its last rows.
            heads = list(zip(frame["_tree"], (k[: 2 * SHALLOW] for k in frame["_key"]), strict=True))
            cut = len(heads) - 1
            while cut > 0 and heads[cut - 1] == heads[-1]:
                cut -= 1
            rest = frame.iloc[cut:] if len(frame) - cut <= 40 * REGION else frame.iloc[-REGION:]
            done = frame.iloc[:cut] if len(frame) - cut <= 40 * REGION else frame
            if len(done) and not began:
                began = True
                yield marked(done, 0)
            yield found(done)
        if rest is not None:
            if not began:
                yield marked(rest, 0)
            yield found(rest)
            yield marked(rest, -1)

    rows = ordered.mapInPandas(run, "a long, b long").distinct()
    return rows if pairs else rows.withColumn("a", F.nullif("a", "b"))


def marked(frame: pd.DataFrame, at: int) -> pd.DataFrame:
    """The nodes of the shallow region that the first or last row is in, paired with themselves."""
    tree, head = frame["_tree"].iloc[at], frame["_key"].iloc[at][: 2 * SHALLOW]
    same = [t == tree and k[: 2 * SHALLOW] == head for t, k in zip(frame["_tree"], frame["_key"], strict=True)]
    nodes = frame["_node"].to_numpy(np.int64)[same]
    return pd.DataFrame({"a": nodes, "b": nodes})


def _of_tree(part: pd.DataFrame, tree: int, share: tuple[int, int], near: int, limit: int | None, pairs: bool) -> np.ndarray:
    keys = np.frombuffer(b"".join(part["_key"]), dtype=">u2").reshape(len(part), DEPTH)
    sketches = np.frombuffer(b"".join(part["_sketch"]), dtype=np.uint64).reshape(len(part), -1)
    nodes, groups, sizes = (part[c].to_numpy(np.int64) for c in ("_node", "_group", "_n"))
    out = [nodes[first:end, None].repeat(2, axis=1) for first, end, large in shallow_regions(keys, near) if large]
    for i, j, low in hits(keys, groups, sizes, sketches, share, near, limit):
        if pairs:
            out.append(np.column_stack([np.minimum(nodes[i], nodes[j]), np.maximum(nodes[i], nodes[j])]))
            continue
        # Small regions and lone neighbours of a stretch of the order go together, under the name of its first row.
        small = low is not None and j.max(initial=low) - low < STRETCH // 2
        first = i // STRETCH * STRETCH if low is None else np.full(len(i), low // STRETCH * STRETCH if small else low)
        with np.errstate(over="ignore"):
            name = nodes[first] * 31 + tree
        for x in (i, j):
            out.append(np.column_stack([name, nodes[x]]))
    return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), dtype=np.int64)


def rare_pairs(sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """All pairs ``(a, b)`` of ``sets (_node, _group, _set)`` of different groups that may be similar enough: no link is lost.

    ``sets`` is read twice, so it should be stored.

    The shingles of every set are put in one order, rare ones first. Two sets need a number of common
    shingles that follows from their sizes; so from the first common one on, both must hold as many.
    Any order that all sets share is right; counts in bins make it a good one.
    """
    above, below = share

    def count(found: Iterator) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        total = np.zeros(BINS, dtype=np.int64)
        for row in found:
            np.add.at(total, (np.frombuffer(row["_set"], dtype=np.uint64) % np.uint64(BINS)).astype(np.int64), 1)
        used = np.flatnonzero(total)
        yield used, total[used]

    def both(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        used, at = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
        return used, np.bincount(at, np.concatenate([a[1], b[1]]), len(used)).astype(np.int64)

    nothing = np.zeros(0, dtype=np.int64)
    used, total = sets.select("_set").rdd.mapPartitions(count).treeAggregate((nothing, nothing), both, both, 3)
    rows = np.zeros(BINS, dtype=np.int64)
    rows[used] = total

    def rarest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for node, group, s in zip(batch["_node"], batch["_group"], batch["_set"], strict=True):
                x = np.frombuffer(s, dtype=np.uint64)
                n = len(x)
                # A partner has at least ``share`` of the shingles of the larger set in common with it.
                first = np.lexsort((x, rows[(x % np.uint64(BINS)).astype(np.int64)]))[: n - -(-above * n // below) + 1]
                out.append((np.full(len(first), node), np.full(len(first), group), np.full(len(first), n), n - np.arange(len(first)), x[first].view(np.int64)))
            if out:
                yield pd.DataFrame({c: np.concatenate([o[i] for o in out]) for i, c in enumerate(("_node", "_group", "_n", "_rest", "_shingle"))})

    found = materialize(sets.select("_node", "_group", "_set").mapInPandas(rarest, "_node long, _group long, _n long, _rest long, _shingle long"), "rarest")
    # The smaller set of a pair holds enough from such a shingle on, even if the other has no more.
    small = F.col("_rest") * (above + below) >= 2 * above * F.col("_n")
    per = found.groupBy("_shingle").agg(F.count("*").alias("_rows"), F.max(small).alias("_some"), F.min("_group").alias("_g"), F.max("_group").alias("_h"))
    shared = per.where("_some and _g <> _h").select("_shingle", F.ceil(F.col("_rows") / BLOCK).cast("int").alias("_blocks"))
    shared = materialize(found.join(shared, "_shingle"), "shared")
    own, all_blocks = F.pmod(F.xxhash64("_node"), "_blocks").cast("int"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    x = shared.where(small).select("_shingle", own.alias("_i"), all_blocks.alias("_j"), *[F.col(c).alias(f"{c}1") for c in ("_node", "_group", "_n", "_rest")])
    y = shared.select("_shingle", all_blocks.alias("_i"), own.alias("_j"), *[F.col(c).alias(f"{c}2") for c in ("_node", "_group", "_n", "_rest")])
    need = above * (F.col("_n1") + F.col("_n2"))
    fit = (
        (F.col("_group1") != F.col("_group2"))
        & ((F.col("_n1") < F.col("_n2")) | ((F.col("_n1") == F.col("_n2")) & (F.col("_node1") < F.col("_node2"))))
        & (below * F.col("_n1") >= above * F.col("_n2"))
        & (F.col("_rest1") * (above + below) >= need)
        & (F.col("_rest2") * (above + below) >= need)
    )
    met = x.join(y, ["_shingle", "_i", "_j"]).where(fit)
    return met.select(F.least("_node1", "_node2").alias("a"), F.greatest("_node1", "_node2").alias("b")).distinct()


def deal(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``pairs (a, b)`` with the task ``(_part, _low, _high)`` that checks them, and ``(_node, _tasks)``, all tasks of a set.

    Pairs are dealt to tasks by their candidate component, cut into blocks of about ``GROUP``
    sets, so that a set moves once for most pairs and no component has to fit in one task.
    """
    parts = components(pairs)
    sizes = parts.groupBy("component").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("_blocks"))
    known = materialize(
        parts.join(sizes, "component").select("node", "component", F.pmod(F.xxhash64("node"), "_blocks").cast("int").alias("_block")), "blocks"
    )
    left = known.select(F.col("node").alias("a"), F.col("component").alias("_part"), F.col("_block").alias("_i"))
    right = known.select(F.col("node").alias("b"), F.col("_block").alias("_j"))
    dealt = materialize(
        pairs.join(left, "a").join(right, "b").select("_part", F.least("_i", "_j").alias("_low"), F.greatest("_i", "_j").alias("_high"), "a", "b"), "dealt"
    )
    ends = dealt.select(F.explode(F.array("a", "b")).alias("_node"), F.struct(*TASK).alias("_task"))
    return dealt, ends.groupBy("_node").agg(F.collect_set("_task").alias("_tasks"))


def confirm(dealt: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Of the pairs ``dealt``, those whose full ``sets (_node, _set, _tasks)`` are similar enough, without closing a circle in a task."""
    above, below = share
    having = sets.select("_node", "_set", F.explode("_tasks").alias("_task")).select("_node", "_set", "_task.*")

    def meet(asked: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        of = {n: np.frombuffer(s, dtype=np.uint64) for n, s in zip(found["_node2"], found["_set2"], strict=True)}
        low = {n: n for n in of}
        out = []
        for a, b in zip(asked["a"], asked["b"], strict=True):
            x, y = of[a], of[b]
            if _lowest(low, a) == _lowest(low, b):
                continue
            shorter, longer = sorted((len(x), len(y)))
            if below * shorter < above * longer:
                continue
            both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
            if below * both >= above * (len(x) + len(y) - both):
                low[_lowest(low, a)] = _lowest(low, b)
                out.append((a, b))
        return pd.DataFrame(out, columns=["a", "b"])

    held = renamed(having).groupBy(*[f"{k}2" for k in TASK])
    return dealt.groupBy(*TASK).cogroup(held).applyInPandas(meet, "a long, b long")


def _lowest(low: dict, node):
    while low[node] != node:
        low[node] = low[low[node]]
        node = low[node]
    return node


def region_links(members: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Links ``(a, b)`` between the sets of each region that connect its groups; ``members``: ``(_region, _node, _group, _set)``.

    All sets of a region, ``REGION`` at most, are compared as a whole on their full shingles by matrix products.
    A region gives at most one edge per set, so that no pair of it ever leaves its task.
    """
    above, below = share

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_node")
        found = [np.frombuffer(s, dtype=np.uint64) for s in rows["_set"]]
        sizes = np.array([len(x) for x in found], dtype=np.int64)
        owner = np.repeat(np.arange(len(found)), sizes)
        at = np.unique(np.concatenate(found), return_inverse=True)[1]
        both = np.zeros((len(found), len(found)), dtype=np.int64)
        width = int(at.max()) + 1
        for start in range(0, width, COLUMNS):
            here = (at >= start) & (at < start + COLUMNS)
            held = np.zeros((len(found), min(COLUMNS, width - start)), dtype=np.float32)
            held[owner[here], at[here] - start] = 1
            both += (held @ held.T).astype(np.int64)
        linked = below * both >= above * (sizes[:, None] + sizes - both)
        names, groups = rows["_node"].tolist(), rows["_group"].tolist()
        low, out = {g: g for g in groups}, []
        for i, j in np.argwhere(np.triu(linked, 1)).tolist():
            x, y = _lowest(low, groups[i]), _lowest(low, groups[j])
            if x != y:
                low[x] = y
                out.append((names[i], names[j]))
        return pd.DataFrame(out, columns=["a", "b"])

    return members.groupBy("_region").applyInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 5, share: tuple[int, int] = (80, 100), doc: str = "doc_id", text: str = "text", text_hash: str | None = None) -> DataFrame:
    """One row per document: id, ``n_shingles``, ``component_id`` and ``kept``.

    Documents link if the intersection of their shingle sets is at least ``share`` of the union
    (a fraction of whole numbers). Sets are of 64-bit hashes of whole lower-cased texts. Documents
    with equal sets are one node. Round one hands on the most similar
    neighbour of a set in every order; round two compares, without a limit, all neighbours that are
    still in different components: longer sketches say which sets of a region may link at all (to four standard errors
    of their estimate: 3 in 100,000 links at the limit are below), and these meet in one task with their full sets. Two sets at the limit share the shallow prefix of some order with a probability
    of ``1 - (1 - s ** 3) ** 16``: 0.99998 at 0.8. Where such a region has more than ``REGION`` sets, or lies on the
    border of two tasks, round three joins all sets of it that are still apart on their rarest shingles, and loses none.

    ``component_id`` is the smallest id that links lead to. Null, empty and blank texts have
    no shingles and link with nothing. Rows that share an id are told apart by their texts; a null
    id counts as larger than all others. Other columns are ignored; an empty table gives no row.
    ``text_hash`` names one more column, ``xxhash64`` of the text, that tells rows of one id apart.
    """
    ship_package(docs.sparkSession)
    rows = materialize(sets_of(docs, shingle, doc, text), "signatures")
    nodes = materialize(
        rows.where("_node is not null").groupBy("_node").agg(F.first("_n").alias("_n"), F.first("_keys").alias("_keys"), F.first("_sketch").alias("_sketch")), "nodes"
    )
    first = materialize(forest(nodes.withColumn("_group", F.col("_node")), share, 1, FIRST, True), "pairs")
    asked = first.select(F.explode(F.array("a", "b")).alias("_node")).distinct()
    # One document per asked set; a null id is an id here.
    holder = rows.join(asked, "_node").groupBy("_node").agg(F.min("_doc").alias("_held")).select("_held").distinct()
    whole = docs.select(F.col(doc).cast("long").alias("_doc"), F.col(text).alias("_text"))
    full = held_rows(whole, holder).mapInPandas(_full_sets(shingle), "_node long, _n long, _keys binary, _set binary, _long binary")
    # The tasks of the first round come with the sets, which move by their node here and never again as a whole.
    dealt, tasks = deal(first.where("a <> b"))
    sets = materialize(full.join(asked.join(tasks, "_node", "left"), "_node").dropDuplicates(["_node"]), "sets")
    cut = first.where("a = b").select(F.col("a").alias("_node"))
    groups = components(materialize(confirm(dealt, sets, share), "links"))
    # Stars stand for all links so far.
    stars = groups.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    heads = _with_groups(sets.select("_node", "_n", "_keys", F.col("_long").alias("_sketch")), groups)
    second = materialize(forest(materialize(heads, "grouped"), share, NEAR, None, False), "regions")
    cut = cut.union(second.where("a is null").select(F.col("b").alias("_node"))).distinct()
    members = second.where("a is not null").select(F.col("a").alias("_region"), F.col("b").alias("_node"))
    members = members.join(_with_groups(_sets_among(sets, members), groups), "_node")
    groups = components(stars.union(materialize(region_links(members, share), "links")))
    stars = groups.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    apart = materialize(_with_groups(_sets_among(sets, cut).join(cut, "_node"), groups), "apart")
    third = materialize(rare_pairs(apart, share), "pairs")
    if not third.isEmpty():
        dealt, tasks = deal(third)
        groups = components(stars.union(materialize(confirm(dealt, _sets_among(sets, tasks).join(tasks, "_node"), share), "links")))
    named = rows.select("_doc", "_n", "_node", "_hash").join(groups.withColumnRenamed("node", "_node"), "_node", "left")
    named = named.withColumn("_part", F.coalesce("component", "_node"))
    lowest = named.where("_part is not null").groupBy("_part").agg(F.min("_doc").alias("_low"))
    group = F.when(F.col("_part").isNull(), F.col("_doc")).otherwise(F.col("_low"))
    return named.join(lowest, "_part", "left").select(
        F.col("_doc").alias(doc), F.col("_n").alias("n_shingles"), group.alias("component_id"), F.col("_doc").eqNullSafe(group).alias("kept"),
        *([F.col("_hash").alias(text_hash)] if text_hash else []),
    )


def held_rows(rows: DataFrame, holder: DataFrame, key: str = "_doc") -> DataFrame:
    """The ``rows`` whose ``key`` is among ``holder (_held)``, null included, and few others; no row moves.

    ``SLOTS`` bits go to every task, 64 to a row, however many ids there are.
    """
    slot = F.pmod(F.xxhash64("_held"), F.lit(SLOTS)).alias("_slot")
    bits = holder.select(slot).groupBy(F.shiftright("_slot", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, int(_slot % 64))")).alias("_bits"))
    placed = rows.withColumn("_slot", F.pmod(F.xxhash64(key), F.lit(SLOTS))).withColumn("_word", F.shiftright("_slot", 6))
    met = placed.join(F.broadcast(materialize(bits, "bits")), "_word").where(F.getbit("_bits", (F.col("_slot") % 64).cast("int")) == 1)
    return met.select(*rows.columns)


def _sets_among(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(_node, _set)`` of the ``nodes``, and few others: a join with ``nodes`` then moves little more than these."""
    return held_rows(sets.select("_node", "_set"), nodes.select(F.col("_node").alias("_held")), "_node")


def _with_groups(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """``nodes`` with their component so far as ``_group``."""
    return nodes.join(groups.withColumnRenamed("node", "_node"), "_node", "left").withColumn("_group", F.coalesce("component", "_node")).drop("component")


def _full_sets(shingle: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [shingle_set(t, shingle) for t in batch["_text"]]
            data = []
            for s in found:
                if len(s):
                    low = signature(s, LONG)
                    # The orders are those of the first values.
                    data.append((node_of(s), len(s), keys_and_sketch(low[: TREES * DEPTH])[0], s.tobytes(), keys_and_sketch(low)[1]))
            yield pd.DataFrame(data, columns=["_node", "_n", "_keys", "_set", "_long"])

    return run

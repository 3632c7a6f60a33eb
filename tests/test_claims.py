"""Claims against the nodes of their sources, in blocks, against plain Python."""

import random

import pytest

from passagework.operators import quality as Q


@pytest.mark.parametrize("block", [4096, 7])
def test_nearest_source(spark, block):
    """One document that most claims name and most nodes belong to; claims without sources, unknown documents, ties, zero vectors."""
    rng = random.Random(3)
    nodes = [(f"n{i:03d}", 1 if i % 3 else 2 + i % 5, f"p{i // 4}", [float(rng.randrange(0, 4)) for _ in range(6)]) for i in range(120)]
    nodes += [("n900", 1, "p900", nodes[1][3]), ("n901", 1, None, [0.0] * 6)]
    claims = [(f"i{i // 4}", i % 4, [float(rng.randrange(0, 4)) for _ in range(6)], [[1], [1, 3], [], [99], [2, 4, 1]][i % 5], "extra") for i in range(60)]
    claims += [("zero", 0, [0.0] * 6, [1], "extra"), ("tie", 0, nodes[1][3], [1], "extra")]

    def cosine(a, b):
        size = sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5
        return round(sum(x * y for x, y in zip(a, b)) / size, 9) if size > 0 else 0.0

    want = {}
    for item, position, vector, docs, _ in claims:
        near = min(((-cosine(vector, v), n, p) for n, d, p, v in nodes if d in docs), default=None)
        want[item, position] = (0.0, None) if near is None else (-near[0], near[2])
    found = Q.nearest_source(
        spark.createDataFrame(claims, "item_id string, position int, embedding array<double>, doc_ids array<long>, _sim string"),
        spark.createDataFrame(nodes, "node_id string, doc_id long, parent_id string, embedding array<double>"), block_rows=block,
    )
    assert {(r["item_id"], r["position"]): (pytest.approx(r["similarity"], abs=1e-9), r["parent_id"]) for r in found.collect()} == want

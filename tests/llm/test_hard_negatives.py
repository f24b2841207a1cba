import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamis.llm import hard_negatives
from tests.llm import edge

SHAPE = "vec_id long, embedding array<float>, label int"


def slow(rows, step=100, positives=5, negatives=5, least=80, most=100):
    """Every pair compared."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if i is not None and label is not None
            and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v, label in kept:
        if i % step:
            continue
        scores = [(-sum(a * b for a, b in zip(v, w, strict=False)), j, other) for j, w, other in kept]
        for s, j, _ in sorted(x[:2] + (0,) for x in scores if x[2] == label and x[1] != i)[:positives]:
            fit = sorted(x[:2] for x in scores if x[2] != label and least * -s <= 100 * -x[0] <= most * -s)[:negatives]
            out += [(i, j, rank, k, -s, -t) for rank, (t, k) in enumerate(fit, 1)]
    return sorted(out, key=repr)


def found(spark, rows, step=100, **more):
    return edge.rows(hard_negatives.mined(spark.createDataFrame(rows, SHAPE), F.col("vec_id") % step == 0, **more))


def clustered(seed, count, width, groups, labels=4, spread=0.1):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(groups, width))
    rows = centres[draw.integers(0, groups, count)] + spread * draw.normal(size=(count, width))
    return [(int(i), [float(np.float32(x)) for x in v], int(draw.integers(0, labels))) for i, v in enumerate(rows)]


@pytest.fixture
def small_nodes(monkeypatch):
    monkeypatch.setattr(hard_negatives, "SHARD_ROWS", (60, 60))
    monkeypatch.setattr(hard_negatives, "LEAF", 6)
    monkeypatch.setattr(hard_negatives, "FAN", 4)
    monkeypatch.setattr(hard_negatives, "SAMPLE_ROWS", 20)


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_matches_all_pairs(spark, small_nodes, spread):
    rows = clustered(1, 700, 6, 9, spread=spread)
    assert found(spark, rows, 10) == slow(rows, 10)
    assert found(spark, rows, 50, positives=3, negatives=7, least=50, most=95) == slow(rows, 50, 3, 7, 50, 95)


def test_ties_and_a_vector_that_fills_half_the_rows(spark, small_nodes):
    draw = np.random.default_rng(5)
    rows = [(i, [0.5, 0.25, 0.0] if i % 2 else [float(x) for x in draw.integers(-2, 3, 3) / 4], int(draw.integers(0, 3))) for i in range(400)]
    assert found(spark, rows, 20) == slow(rows, 20)


def test_ranges_leave_subtrees_out():
    rows = clustered(2, 4000, 8, 20, spread=0.02)
    vectors = np.floor(256 * np.array([v for _, v, _ in rows]))
    ids, labels = np.arange(4000), np.array([label for *_, label in rows])
    longest = float((vectors ** 2).sum(1).max())
    tree, seen = hard_negatives.Tree(vectors, ids, labels, longest), []
    some = np.arange(0, 4000, 100)
    ends = np.full((len(some), 1), hard_negatives.LOWEST)
    asked = hard_negatives.Requests(vectors[some], ids[some], labels[some], ends, -ends, True, 5, longest)
    take = asked.take
    asked.take = lambda who, block, *more: (seen.append(len(who) * len(block)), take(who, block, *more))
    tree.answer(asked, np.arange(len(some)))
    scores = vectors[some] @ vectors.T
    for k, i in enumerate(some):
        same = sorted((-scores[k, j], j) for j in ids if labels[j] == labels[i] and j != i)[:5]
        assert [(-s, j) for s, j in same] == list(zip(asked.scores[k, 0], asked.found[k, 0], strict=True))
    assert sum(seen) < 0.5 * len(some) * 4000


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (1, [0.9, 0.1], 1), (2, [0.9], 1), (3, [0.8, 0.0], 2), (4, [0.8, 0.3], 2),
            (5, [0.85, -0.2, 4.0], 2), (6, [], 2), (7, None, 2), (8, [0.8, None], 2), (9, [nan, 0.8], 2), (10, [inf, 0.8], 2), (11, [0.8, 0.0], None),
            (None, [0.8, 0.0], 2), (100, [-1.0, 0.0], 3), (101, [1.0, 0.0], 3), (200, [0.0, 0.0], 4), (300, [0.1, 0.1], 5)]
    expected = slow(rows)
    assert expected and found(spark, rows) == expected
    clashing = spark.createDataFrame(rows, SHAPE).withColumns({c: F.lit("x") for c in ("id", "cell", "whole", "shard", "rank", "slot", "score", "lo")})
    assert edge.rows(hard_negatives.mined(clashing, F.col("vec_id") % 100 == 0)) == expected
    assert found(spark, []) == [] == found(spark, [(100, [], 1)])
    assert found(spark, [(0, [], 1), (1, [], 1), (2, [], 2)]) == [(0, 1, 1, 2, 0, 0)]

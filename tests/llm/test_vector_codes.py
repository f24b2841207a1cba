import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamis.llm import vector_codes
from tests.llm import edge

SHAPE = "vec_id long, embedding array<float>, label int"


def slow(rows, parts=4, entries=256, rounds=4, scale=1024):
    """Plain Lloyd rounds over all rows, in Python's whole numbers."""
    kept = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    wide = -(-max(len(v) for _, v, _ in kept) // parts)
    kept = [(i, v + [0] * (parts * wide - len(v)), label) for i, v, label in kept]
    cut = [[v[p * wide:(p + 1) * wide] for p in range(parts)] for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0, kept[r][1]))[:entries]
    books = [[cut[r][p] for r in order] for p in range(parts)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), e) for e, y in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            given = [near(p, x[p])[1] for x in cut]
            for e in set(given):
                own = [x[p] for x, g in zip(cut, given, strict=True) if g == e]
                books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    best = [[near(p, x[p]) for p in range(parts)] for x in cut]
    total = {}
    for (_, _, label), found in zip(kept, best, strict=True):
        total[label] = total.get(label, 0) + sum(d for d, _ in found)
    sha = hashlib.sha256(",".join(str(c) for book in books for y in book for c in y).encode()).hexdigest()
    return [(i, "".join(f"{e:0{max(2, len(f'{entries - 1:x}'))}x}" for _, e in found), sum(d for d, _ in found), total[label], sha)
            for (i, _, label), found in zip(kept, best, strict=True)]


def found(spark, rows, **more):
    return edge.rows(vector_codes.compressed(spark.createDataFrame(rows, SHAPE), **more))


def test_moved_entries_alone_give_the_assignment_of_a_full_scan():
    draw = np.random.default_rng(3)
    for _ in range(60):
        parts = draw.integers(-3, 4, (200, 2)).astype(np.float64)  # many ties
        before = draw.integers(-3, 4, (12, 2)).astype(np.float64)
        after = np.where(draw.random((12, 1)) < 0.4, draw.integers(-3, 4, (12, 2)), before)
        code, distance = vector_codes.nearest(parts, before)
        again = vector_codes.reassign(parts, after, (before != after).any(1), code, distance)
        full = vector_codes.nearest(parts, after)
        assert (again[0] == full[0]).all() and (again[1] == full[1]).all()


def test_few_entries_many_ties_match_plain_rounds(spark):
    draw = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in draw.integers(-4, 5, 8) / 4], int(draw.integers(0, 3))) for i in draw.permutation(300)]
    for entries, rounds in ((7, 4), (16, 6), (400, 1)):
        assert found(spark, rows, entries=entries, rounds=rounds) == sorted(slow(rows, entries=entries, rounds=rounds), key=repr)


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(3, [0.5, -0.25, 1.0, 2.0], 1), (1, [0.5, -0.25, 1.0, 2.0], None), (2, [-0.0004, 0.0, 0.0, 0.0], None), (2, [0.1, 0.2, 0.3, 0.4], 7),
            (2, [0.1, 0.2, 0.3, 0.4], 7), (None, [9.0, 9.0, 9.0, 9.0], 1), (4, [0.25], 1), (5, [], 2), (6, [1.0, 2.0, 3.0, 4.0, 5.0], 2),
            (7, None, 1), (8, [1.0, None, 1.0, 1.0], 1), (9, [1.0, nan, 1.0, 1.0], 1), (10, [1.0, 1.0, -inf, 1.0], 1)]
    assert found(spark, rows) == sorted(slow(rows), key=repr)
    assert found(spark, rows, entries=2) == sorted(slow(rows, entries=2), key=repr)
    clashing = spark.createDataFrame(rows, SHAPE).withColumns({c: F.lit("x") for c in ("code", "distance", "whole", "group", "error", "slot")})
    assert edge.rows(vector_codes.compressed(clashing)) == sorted(slow(rows), key=repr)
    assert found(spark, []) == [] == found(spark, [(1, None, 1)])
    assert {r[1] for r in found(spark, [(1, [], 1), (2, [], None)])} == {"00000000"}


def test_components_beyond_the_exact_range_stop_the_job(spark):
    with pytest.raises(Exception, match="too large"):
        found(spark, [(1, [1e30, 0.0, 0.0, 0.0], 1)])

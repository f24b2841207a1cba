import hashlib
import random

import numpy as np
import pytest

from tamis.llm import exact_dedup
from tests.llm import edge


def slow(rows):
    """``doc_id, keep_id, group_size, kept, text_sha256`` by grouping the whole texts."""
    solid = ["".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r") for _, text in rows]
    groups = {}
    for k, s in enumerate(solid):
        groups.setdefault(s, []).append(k)
    stay = {s: min(own, key=lambda k: (-len(rows[k][1] or ""), rows[k][0] is None, rows[k][0] or 0, k)) for s, own in groups.items()}
    return sorted(((rows[k][0], rows[stay[s]][0], len(groups[s]), stay[s] == k, hashlib.sha256(s.encode()).hexdigest())
                   for k, s in enumerate(solid)), key=repr)


def found(df):
    return edge.rows(exact_dedup.marked(df).drop("row"))


def test_directory_doubles_until_buckets_fit():
    load = np.zeros(16, np.int64)
    load[[0, 1, 2, 15]] = [50, 50, 3, 900]
    pointers = exact_dedup.split_buckets(load, 60)
    assert len(pointers) == 16  # the deepest bucket has four bits
    assert len({*pointers[:2].tolist()}) == 2 and len({*pointers[4:8].tolist()}) == 1
    held = [load[pointers == b].sum() for b in set(pointers.tolist())]
    assert sorted(held)[-1] == 900 and all(h <= 60 for h in sorted(held)[:-1])  # one prefix cannot be split
    assert len(exact_dedup.split_buckets(load, 5000)) == 1
    draw = np.random.default_rng(1).integers(0, 100, 256)
    pointers = exact_dedup.split_buckets(draw, 300)
    owners = exact_dedup.owners_of(pointers, draw, 7)
    assert (np.diff(owners) >= 0).all() and owners.max() <= 6
    wide = np.repeat(owners, 256 // len(owners))
    assert all(draw[wide == k].sum() <= draw.sum() / 7 + 300 for k in range(7))
    for b in set(pointers.tolist()):
        assert len({*owners[pointers == b].tolist()}) == 1


@pytest.mark.parametrize("weak", [False, True])
def test_matches_grouping_also_when_keys_collide(spark, monkeypatch, weak):
    if weak:
        monkeypatch.setattr(exact_dedup, "key_of", lambda text: (len(text) % 3 << 62) - (1 << 63))
        monkeypatch.setattr(exact_dedup, "HELD_BYTES", 500)
    draw = random.Random(2)
    texts = [" ".join(draw.choice("ab cd ef".split()) for _ in range(draw.randint(0, 4))) for _ in range(150)] + ["hot text"] * 120 + ["hottext"] * 3
    rows = [(i // 2 if i % 7 == 0 else i, t.replace(" ", draw.choice([" ", "\t", "  ", "\r\n"]))) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(df) == slow(rows)


def test_edge_rows(spark):
    docs = edge.documents(spark)
    expected = slow([(r[0], r[1]) for r in edge.ROWS])
    assert found(docs) == expected == found(edge.with_clashes(docs).withColumnRenamed("key", "row"))
    assert found(edge.empty(spark)) == []
    clashing = edge.with_clashes(docs)
    kept = exact_dedup.without_copies(clashing)
    assert kept.columns == clashing.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((r[0] for r in expected if r[3]), key=repr)
    nobody = spark.createDataFrame([(None, "x"), (None, "x"), (5, "x "), (4, "x ")], "doc_id long, text string")
    assert found(nobody) == slow([(None, "x"), (None, "x"), (5, "x "), (4, "x ")])

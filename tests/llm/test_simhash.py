import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tamis.llm import simhash
from tamis.llm.components import connected_components
from tests.llm import edge


def slow_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(prints):
    """Smallest reachable key by brute force over all pairs."""
    group = {k: k for k in prints}

    def find(k):
        while group[k] != k:
            k = group[k]
        return k

    keys = sorted(prints)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            if bin(prints[a] ^ prints[b]).count("1") <= 3:
                x, y = sorted((find(a), find(b)))
                group[y] = x
    return {k: find(k) for k in keys}


def test_fingerprints_follow_the_definition():
    for _, text, *_ in edge.ROWS:
        value = simhash.fingerprint(None if text is None else text.encode())
        assert value % 2**64 == slow_fingerprint(text)


def test_small_table_matches_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    prints = {r.doc_id: slow_fingerprint(r.text) for r in docs.collect()}
    groups = slow_groups(prints)
    assert found == {k: (f"{prints[k]:016x}", groups[k]) for k in prints}


@pytest.mark.parametrize("distance", [1, 3])
def test_links_lose_nothing_in_dense_and_skewed_clusters(spark, monkeypatch, distance):
    monkeypatch.setattr(simhash, "SPLIT_ROWS", 20)
    draw = random.Random(5)
    centres = [draw.getrandbits(64) for _ in range(40)]
    prints = {0} | {c ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 4))) for c in centres for _ in range(12)}
    prints |= {(0xABCD << 48) | draw.getrandbits(48) for _ in range(200)}
    signed = sorted(p - 2**64 if p >= 2**63 else p for p in prints)
    found = {tuple(r) for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), distance).collect()}
    every = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1:] if bin((a ^ b) % 2**64).count("1") <= distance}
    assert found == every


def test_allowances_are_unequal_cheap_and_sum_up():
    costs = np.full((4, 4, 2), 50.0)
    costs[:, 0] = [[1, 900], [1, 1], [1, 1], [1, 1]]
    costs[1, 1] = 7
    assert simhash.allocate(costs, 3).T.tolist() == [[0, 0, 0, 0], [-1, 1, 0, 0]]


def test_components_of_a_path_and_a_hub(spark):
    links = [(i, i + 1) for i in range(100, 130)] + [(1, k) for k in range(2, 60)] + [(7, 7), (3, 2), (3, 2)]
    found = dict(map(tuple, connected_components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert found == {k: 1 for k in range(1, 60)} | {k: 100 for k in range(100, 131)}


def test_edge_rows(spark):
    docs = edge.documents(spark)
    found = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(found, key=repr) == sorted([(1, 1), (2, 1), (2, 1), (3, 3), (4, 3), (5, 3), (6, 6), (7, 7), (None, None), (9, 9)], key=repr)
    clashing = edge.with_clashes(docs)
    kept = simhash.without_near_duplicates(clashing)
    assert kept.columns == clashing.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([1, 3, 6, 7, None, 9], key=repr)
    assert simhash.near_duplicates(edge.empty(spark)).count() == 0 == simhash.without_near_duplicates(edge.empty(spark)).count()


def test_rows_that_stay_are_those_of_the_report(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    twice = docs.unionByName(docs.where("doc_id % 9 = 0")).unionByName(docs.where("doc_id % 10 = 0").withColumn("text", F.lit("another text of the same id")))
    for rows in (docs, twice):
        report = simhash.near_duplicates(rows)
        want = {(r.doc_id, r.fingerprint) for r in report.where("doc_id = component_id").groupBy("doc_id").agg(
            F.min(F.struct(F.conv("fingerprint", 16, -10).cast("long").alias("signed"), "fingerprint"))["fingerprint"].alias("fingerprint")).collect()}
        kept = simhash.without_near_duplicates(rows).collect()
        assert sorted((r.doc_id, f"{slow_fingerprint(r.text):016x}") for r in kept) == sorted(want)

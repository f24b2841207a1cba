import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tamis.llm import decontaminate, mixing
from tests.llm import edge

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def slow_report(text, items):
    words, hit, found = words_of(text), set(), set()
    for item, passage in items:
        other = words_of(passage)
        for k in range(max(len(other) - 9, 1) if other else 0):
            run = other[k:k + 10]
            for i in range(len(words) - len(run) + 1):
                if words[i:i + len(run)] == run:
                    hit |= set(range(i, i + len(run)))
                    found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block", [100_000, 7])
def test_search_matches_brute_force_in_any_number_of_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", block)
    monkeypatch.setattr(decontaminate, "CHUNK_WINDOWS", 3)
    draw = random.Random(3)
    items = [(i, " ".join(draw.choice("a B é") for _ in range(draw.choice([1, 3, 10, 12, 25])))) for i in range(8)] + [(90, None), (91, "--"), (92, "a, b. A")]
    docs = [(i, " ".join(draw.choice(["a", "b", "É", "é", "x-y"]) for _ in range(draw.randint(0, 80)))) for i in range(40)]
    docs += [(r[0], r[1]) for r in edge.ROWS if r[1] is None or len(r[1]) < 1000] + [(70, "pre " + (items[4][1] or "") + " post")]
    found = decontaminate.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert edge.rows(found) == sorted(((i, *slow_report(t, items)) for i, t in docs), key=repr)


def test_only_clean_rows_stay(spark):
    docs = edge.with_clashes(edge.documents(spark))
    items = spark.createDataFrame([(1, "delta epsilon zeta eta theta iota kappa lambda mu and more")], "item_id long, text string")
    kept = decontaminate.decontaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(edge.ROWS)
    items = spark.createDataFrame([(1, "gamma, delta epsilon zeta eta theta iota kappa lambda MU")], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.decontaminated(docs, items).collect()} == {3, 4, 5, 6, 7, None, 9}
    assert decontaminate.decontaminated(edge.empty(spark), items).count() == 0
    assert decontaminate.decontaminated(docs, items.limit(0)).count() == len(edge.ROWS)


def test_raking_meets_the_marginals(spark):
    cells = spark.createDataFrame([(s, lang, "t", 1000 + 300 * i + 100 * j) for i, s in enumerate("abc") for j, lang in enumerate(["x", None])],
                                  "source string, lang string, topic string, tokens long")
    want = {"source": {"a": 0.3, "b": 0.3, "c": 0.4}, "lang": {"x": 0.45, None: 0.55}, "topic": {"t": 1.0}}
    targets = {n: spark.createDataFrame(list(w.items()), f"{n} string, share double") for n, w in want.items()}
    got = mixing.rake(cells, targets, keep=0.4).toPandas()
    total = cells.agg(F.sum("tokens")).first()[0] * 0.4
    for name, shares in want.items():
        for key, share in shares.items():
            mine = got[got[name].isna() if key is None else got[name] == key].weight.sum()
            assert mine == pytest.approx(share * total, rel=1e-3)
    assert (got.weight <= got.tokens + 1e-9).all()


def test_sample_follows_probabilities(spark):
    rows = [(i, f"word{i} text", "en", "big" if i % 3 else f"s{i % 5}", 1) for i in range(6000)]
    report = mixing.report(spark.createDataFrame(rows, edge.SHAPE)).toPandas()
    by = report.groupby("source").agg(p=("probability", "mean"), got=("sampled", "mean"), n=("sampled", "size"))
    assert ((by.p - by.got).abs() < 4 * (by.p * (1 - by.p) / by.n) ** 0.5 + 1e-9).all()
    assert by.p["big"] < by.p.drop("big").min()
    assert report.probability.mul(report.n_tokens).sum() == pytest.approx(0.8 * report.n_tokens.sum(), rel=0.02)  # some sources have less than their target


def test_mixing_edge_rows(spark):
    docs = edge.with_clashes(edge.documents(spark))
    got = mixing.report(docs)
    assert got.count() == len(edge.ROWS) and got.where("probability IS NULL OR probability < 0 OR probability > 1").count() == 0
    assert {r.doc_id for r in got.where("n_tokens = 0").collect()} == {3, 4, 5}
    assert mixing.sampled(docs).columns == docs.columns
    assert {3, 4, 5} <= {r.doc_id for r in mixing.sampled(docs).collect()}
    assert edge.rows(mixing.sampled(docs)) == edge.rows(mixing.sampled(docs))
    assert mixing.report(edge.empty(spark)).count() == 0


def test_a_text_that_stays_is_sent_once(spark):
    docs = spark.createDataFrame([(1, "One Two three", 5), (2, None, 6)], "doc_id long, text string, more int")
    items = spark.createDataFrame([("a", "two three")], "item_id string, text string")
    found, (n_words, starts, _, of) = decontaminate.marked(docs, items)
    assert {r.doc_id: (r.text, r.more, r[n_words], r[starts], r[of]) for r in found.collect()} == {1: ("One Two three", 5, 3, [1], ["a"]), 2: (None, 6, 0, [], [])}
    assert "binary" not in found._jdf.queryExecution().optimizedPlan().toString().lower()

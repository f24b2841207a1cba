import random

import duckdb
from pyspark.sql import functions as F

from tamis.llm import licences, quality, queries
from tests.llm import edge


def slow_measures(text):
    text = text or ""
    spaced = text
    for c in "\t\n\x0b\x0c\r":
        spaced = spaced.replace(c, " ")
    words = [w for w in spaced.split(" ") if w]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    counts = {}
    for w in windows:
        counts[w] = counts.get(w, 0) + 1
    hit = {j for i, w in enumerate(windows) if counts[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if any(c not in " \t\n\x0b\x0c\r" for c in x)]
    failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed)


def test_measures_match_plain_counting(spark):
    draw = random.Random(1)
    texts = [r[1] for r in edge.ROWS] + [" ".join(draw.choice("ab c\n d# é|".split(" ")) for _ in range(draw.randint(0, 60))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", quality.measure(F.col("text")).alias("m"))
    for i, m in df.collect():
        assert tuple(m) == slow_measures(texts[i]), texts[i]


def test_a_failing_host_takes_its_documents_along(spark):
    good = "a sentence of more than ten words that does not repeat itself at all"
    rows = [(i, good if i % 20 == 0 else "x", "bad") for i in range(100)] + [(i, "x" if i % 20 == 0 else f"{good} {i}", f"host{i % 4}") for i in range(100, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id for r in quality.accepted(docs).collect()}
    assert kept == {i for i in range(100, 300) if i % 20}
    rates = {r.host: r.rate for r in quality.host_rates(quality.measured(docs).select("source", "measures.base_failed"), "source", "base_failed").collect()}
    assert 0.5 < rates["bad"] < 0.95 and 0.0 < rates["host0"] < 0.3


def test_host_verdicts_agree_with_sql(spark, tmp_path):
    good = "a sentence of more than ten words that does not repeat itself at all"
    rows = [(i, good if i % 20 == 0 else "x", "bad") for i in range(100)] + [(i, "x" if i % 20 == 0 else f"{good} {i}", [None, "one", "two", "three"][i % 4]) for i in range(100, 300)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in queries.op7_quality(spark, str(tmp_path)).collect())
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == sorted(duck.execute(quality.SQL).fetchall())
    assert {r[0] for r in got if r[7]} == {i for i in range(100, 300) if i % 20}
    assert all(r[8] is None for r in got if r[0] >= 100 and r[0] % 4 == 0) and all(r[8] > 0.5 for r in got if r[0] < 100)


def test_edge_rows(spark):
    clashing = edge.with_clashes(edge.documents(spark))
    judged = quality.judged(clashing)
    assert judged.count() == len(edge.ROWS)
    accepted = quality.accepted(edge.with_clashes(edge.documents(spark)))
    assert accepted.columns == clashing.columns
    assert sorted((r.doc_id for r in accepted.collect()), key=repr) == sorted([1, 2, 2, 6, None], key=repr)
    assert quality.judged(edge.empty(spark)).count() == 0
    assert "Python" not in judged._jdf.queryExecution().toString() and "Arrow" not in judged._jdf.queryExecution().toString()


MIT = """The MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
 documentation files (the "Software"), to deal without restriction. The above copyright notice and this permission notice shall be included
 in all copies or substantial portions of the Software. The software is provided "as is", without warranty of any kind."""


def test_sentences_and_ordered_rules(spark):
    texts = [MIT, "Some prose.\nLicensed under the Apache License, Version 2.0.\nReleased under the MIT License.", "This licence is my own. Nothing else.",
             "Licensed under CC BY-NC 4.0.", "no such words", None, "This work is licensed under the GNU General Public License, version 3. " * 2]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: (r.sentence_ids, r.licences, r.n_unmatched) for r in licences.scan(docs).collect()}
    assert found == {
        0: ("mit-title,mit-grant,mit-notice,as-is", "MIT", 0), 1: ("apache-short,mit-short", "Apache-2.0,MIT", 0), 2: ("unknown", "", 1),
        3: ("cc-by-nc", "CC-BY-NC", 0), 4: ("", "", 0), 5: ("", "", 0), 6: ("gpl3-short,gpl3-short", "GPL-3.0", 0)}
    assert licences.scan(edge.with_clashes(edge.documents(spark))).count() == len(edge.ROWS)
    assert licences.scan(edge.empty(spark)).count() == 0

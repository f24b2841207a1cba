import random
from collections import Counter

import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from tamis.operators import corpus, counting, joins, metrics, ranking, splits, vocabulary


@pytest.fixture(scope="module")
def lists():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["", "ж"]
    docs = [[rng.choice(words[: rng.randint(1, 42)]) for _ in range(rng.randint(0, 60))] for _ in range(80)]
    return docs + [[], ["solo"], ["hot"] * 500]


@pytest.fixture(scope="module")
def docs(spark, lists):
    return spark.createDataFrame(
        [(i, i % 2, words) for i, words in enumerate(lists)], "doc_id long, label int, words array<string>"
    )


def test_term_rows_count_inside_the_document(docs, lists):
    got = {(r.doc_id, r.term): (r.n, r.first) for r in counting.term_rows(docs, "words", ["doc_id"], first=True).collect()}
    want = {(i, t): (n, words.index(t)) for i, words in enumerate(lists) for t, n in Counter(words).items()}
    assert got == want


def test_term_rows_can_keep_empty_documents(docs, lists):
    kept = {r.doc_id for r in counting.term_rows(docs, "words", ["doc_id"], empty=True).collect()}
    assert kept == set(range(len(lists)))


def test_term_counting_sorts_each_document_once(docs):
    plan = counting.term_rows(docs, "words", ["doc_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sort_array") == 1
    assert "Exchange" not in counting.term_rows(docs, "words", ["doc_id"])._jdf.queryExecution().executedPlan().toString()


def test_corpus_counts(docs, lists):
    total = Counter(w for words in lists for w in words)
    assert {r.word: r.freq for r in counting.word_frequencies(docs, "words").collect()} == total
    spread = Counter(w for words in lists for w in set(words))
    assert {r.term: (r.df, r.tf) for r in counting.term_statistics(docs, "words").collect()} == {
        w: (spread[w], n) for w, n in total.items()}
    spam = Counter(w for i, words in enumerate(lists) if i % 2 for w in words)
    rows = counting.word_class_counts(docs, "words", "label").collect()
    assert {r.word: (r.spam, r.ham) for r in rows} == {w: (spam[w], n - spam[w]) for w, n in total.items()}


def test_vocabulary_does_not_depend_on_partitioning(docs, lists):
    total = Counter(w for words in lists for w in words)
    want = sorted(total, key=lambda w: (-total[w], w))[:10]
    for n in (1, 3, 7):
        rows = vocabulary.frequency_vocabulary(docs.repartition(n), "words", 10).collect()
        assert [r.term for r in sorted(rows)] == want
    order = list(dict.fromkeys(w for words in lists for w in words))
    want = sorted(order, key=lambda w: -total[w])[:10]
    rows = vocabulary.first_seen_vocabulary(docs.repartition(5), "words", "doc_id", 10).collect()
    assert [r.term for r in sorted(rows)] == want


def test_vectorizer_from_table(docs, lists):
    table = vocabulary.frequency_vocabulary(docs, "words", 12)
    model = vocabulary.count_vectorizer(table, "words", "features")
    terms = [r.term for r in table.orderBy("idx").collect()]
    assert model.vocabulary == terms
    got = {(r.doc_id, terms[r.idx]): int(r.value)
           for r in vocabulary.vector_entries(model.transform(docs), "features", ["doc_id"]).collect()}
    assert got == {(i, t): n for i, words in enumerate(lists) for t, n in Counter(words).items() if t in terms}
    binary = vocabulary.count_vectorizer(table, "words", "features", binary=True).transform(docs)
    assert {r.value for r in vocabulary.vector_entries(binary, "features", ["doc_id"]).collect()} == {1.0}


def test_vectorizer_refuses_too_many_terms(docs, monkeypatch):
    monkeypatch.setattr(vocabulary, "MAX_VECTOR_TERMS", 5)
    with pytest.raises(ValueError, match="too many terms"):
        vocabulary.count_vectorizer(vocabulary.frequency_vocabulary(docs, "words", 12), "words", "features")


def test_global_rank_over_a_value_shared_by_most_rows(spark):
    rows = spark.range(5000).withColumn("v", F.when(F.col("id") % 10 < 7, 5).otherwise(F.col("id") % 13))
    ranked = ranking.global_rank(rows, [F.asc("v"), F.desc("id")], start=1).collect()
    want = sorted(((r.id, r.v) for r in ranked), key=lambda r: (r[1], -r[0]))
    assert [r.id for r in sorted(ranked, key=lambda r: r["rank"])] == [r[0] for r in want]
    assert sorted(r["rank"] for r in ranked) == list(range(1, 5001))


def test_top_k_is_the_same_on_both_paths(spark, monkeypatch):
    rows = spark.range(300).withColumn("v", F.col("id") % 7)
    order = [F.desc("v"), F.asc("id")]
    small = sorted((r.idx, r.id) for r in ranking.top_k(rows, 50, order).collect())
    monkeypatch.setattr(ranking, "SMALL_K", 10)
    assert sorted((r.idx, r.id) for r in ranking.top_k(rows, 50, order).collect()) == small


def test_splits(spark):
    rows = spark.range(1000)
    train, test = splits.hash_split(rows, "id")
    again, _ = splits.hash_split(rows.repartition(9), "id")
    assert train.count() == 697 and test.count() == 303
    assert {r.id for r in train.collect()} == {r.id for r in again.collect()}
    for n, share in ((1000, 0.7), (7, 0.5), (3, 0.0), (5, 1.0), (0, 0.7)):
        left, right = splits.exact_split(spark.range(n), "id", share)
        assert (left.count(), right.count()) == (int(share * n), n - int(share * n))


def test_lookup_without_broadcast_gives_the_same_rows(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 20}") for i in range(600)], "id long, key string")
    table = spark.createDataFrame([("hot", 400, 1.5)] + [(f"k{i}", 10, float(i)) for i in range(15)],
                                  "key string, seen long, theta double")
    want = sorted(joins.lookup(rows, table, "key", small=True).select("id", "key", "theta").collect(), key=str)
    monkeypatch.setattr(joins, "HOT_KEYS", 2)
    large = joins.lookup(rows, table, "key", small=False, weight="seen")
    assert sorted(large.select("id", "key", "theta").collect(), key=str) == want


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_salted_join_equals_a_plain_join(spark, how):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 20}") for i in range(600)], "id long, key string")
    right = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 20, 2)], "key string, v int")
    got = joins.salted_join(left, right, "key", how, threshold=50, salts=4)
    want = left.join(right, "key", how)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("pairs", [
    [(1, 1.0), (1, 0.0), (0, 0.0), (0, 0.0), (0, 1.0)], [(1, 0.0), (0, 0.0), (0, 0.0)], [(1, 1.0)],
])
def test_metrics_equal_the_evaluator(spark, pairs):
    df = spark.createDataFrame([(float(a), b) for a, b in pairs], "label double, prediction double")
    row = metrics.weighted_metrics(df).first()
    names = {"accuracy": "accuracy", "f1": "f1", "weighted_precision": "weightedPrecision", "weighted_recall": "weightedRecall"}
    for ours, theirs in names.items():
        assert row[ours] == pytest.approx(MulticlassClassificationEvaluator(metricName=theirs).evaluate(df))
    assert metrics.accuracy(df).first().accuracy == pytest.approx(row.accuracy)


def test_concatenation_and_profile(spark):
    a = spark.createDataFrame([(1, "x"), (0, None)], "label int, text string")
    b = spark.createDataFrame([(1, "y"), (None, None)], "label int, translated string")
    mixed = corpus.concat_mixed(a, b, "message", "text", "translated")
    assert mixed.columns == ["label", "text", "translated", "message"] and mixed.count() == 4
    assert corpus.drop_null_text(mixed, "message").count() == 2
    assert corpus.concat_same(a, a.select("text", "label")).count() == 4
    assert {(r.column_name, r.column_type, r.n_rows, r.n_null) for r in corpus.profile(a).collect()} == {
        ("label", "int", 2, 0), ("text", "string", 2, 1)}


def test_rows_without_a_key_go_to_the_test_part(spark):
    from tamis.operators.splits import exact_split, hash_split

    df = spark.createDataFrame([(i if i % 3 else None,) for i in range(30)], "id long")
    for split, size in ((hash_split, None), (exact_split, 14)):
        train, test = split(df, "id")
        assert train.count() + test.count() == 30 and train.where("id IS NULL").count() == 0
        assert size is None or train.count() == size


@pytest.mark.parametrize("few", [10_000, 3])
def test_exact_split_of_repeated_equal_and_missing_keys(spark, monkeypatch, few):
    from collections import Counter

    from tamis.operators import splits

    monkeypatch.setattr(splits, "FEW_ROWS", few)
    tables = [[(k % 7, k) for k in range(100)], [(None, k) for k in range(20)] + [(1, 5)] * 20, [(3, 3)] * 50, [(k, 0) for k in range(40)] + [(None, 0)] * 10, []]
    for rows in tables:
        df = spark.createDataFrame(rows, "id long, value long")
        for share in (0.7, 0.3, 1.0, 0.0):
            left, right = ([tuple(r) for r in part.collect()] for part in splits.exact_split(df, "id", share))
            assert len(left) == int(share * sum(k is not None for k, _ in rows)) and Counter(left) + Counter(right) == Counter(rows)
            again = [tuple(r) for r in splits.exact_split(df.repartition(3), "id", share)[0].collect()]
            assert Counter(again) == Counter(left)

from math import exp, log

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import CountVectorizer, Tokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tamis.functions import text as tx
from tamis.operators import joins, naive_bayes, word_bayes

TINY = [(1, "win cash now"), (1, "win prize cash"), (0, "meet me now"), (0, "report due friday"), (0, "lunch friday")]


@pytest.fixture(scope="module")
def tiny(spark):
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(TINY)], "id long, label int, email string")
    return df.withColumn("words", tx.tokenize(F.col("email")))


def scores(df):
    return {r.id: (round(r.probability, 9), r.prediction) for r in df.collect()}


def test_equals_the_ml_classifier(tiny):
    model = naive_bayes.fit(tiny, "words", "label", 100)
    assert (model.pi0, model.pi1) == (pytest.approx(log(4 / 7)), pytest.approx(log(3 / 7)))
    ml = Pipeline(stages=[Tokenizer(inputCol="email", outputCol="tokens"), CountVectorizer(inputCol="tokens", outputCol="features"),
                          NaiveBayes(modelType="multinomial")]).fit(tiny).transform(tiny)
    want = ml.select("id", vector_to_array("probability")[1].alias("probability"), "prediction")
    assert scores(naive_bayes.score(model, tiny, "words", ["id"])) == scores(want)


def test_unknown_words_leave_the_priors(spark, tiny):
    model = naive_bayes.fit(tiny, "words", "label", 100)
    df = spark.createDataFrame([(0, ["zzz"]), (1, [])], "id long, words array<string>")
    for row in naive_bayes.score(model, df, "words", ["id"]).collect():
        assert (row.raw0, row.raw1) == (model.pi0, model.pi1)


def test_vocabulary_limits(tiny):
    assert naive_bayes.fit(tiny, "words", "label", 100, min_df=2).size == 4
    cut = naive_bayes.fit(tiny, "words", "label", 3)
    assert {r.term for r in cut.terms.collect()} == {"cash", "friday", "now"} and cut.size == 3


def test_saved_model_and_shuffled_scoring_agree(spark, tiny, tmp_path, monkeypatch):
    model = naive_bayes.fit(tiny, "words", "label", 100)
    model.save(str(tmp_path / "nb"))
    loaded = naive_bayes.TermModel.load(spark, str(tmp_path / "nb"))
    want = scores(naive_bayes.score(model, tiny, "words", ["id"]))
    assert scores(naive_bayes.score(loaded, tiny, "words", ["id"])) == want
    monkeypatch.setattr(joins, "HOT_KEYS", 2)
    loaded.small = False
    assert scores(naive_bayes.score(loaded, tiny, "words", ["id"])) == want


def test_fit_does_not_depend_on_partitioning(tiny):
    tables = [sorted(naive_bayes.fit(tiny.repartition(n), "words", "label", 5).terms.collect()) for n in (1, 4)]
    assert tables[0] == tables[1]


def test_word_sets(spark, tiny):
    messages = [(0, ["win", "win", "lunch"]), (1, ["never"]), (2, [])]
    df = spark.createDataFrame(messages, "id long, words array<string>")
    got = {r.id: r for r in word_bayes.score_word_sets(tiny, "words", "label", df, "words", "id").collect()}
    prior = log(2 / 5) - log(3 / 5)
    win = log(2 / 2) - log(1e-6)
    lunch = log(1e-6) - log(1 / 3)
    assert got[0].log_ratio == pytest.approx(prior + win + lunch)
    assert got[1].log_ratio == pytest.approx(prior) == got[2].log_ratio
    assert got[2].probability == pytest.approx(1 / (1 + exp(-prior)))


def test_word_sets_with_one_class_or_none(spark):
    df = spark.createDataFrame([(1, ["win", "odd"]), (2, [])], "id long, words array<string>")
    train = spark.createDataFrame([(1, ["win"]), (1, ["cash"])], "label int, words array<string>")
    one = {r.id: r.probability for r in word_bayes.score_word_sets(train, "words", "label", df, "words", "id").collect()}
    assert one[1] > one[2] > 0.5
    none = word_bayes.score_word_sets(train.limit(0), "words", "label", df, "words", "id").collect()
    assert {r.probability for r in none} == {0.5}

import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC
from pyspark.sql import functions as F

from tamis.functions import stopwords, text as tx
from tamis.operators import classifiers, linear
from tamis.sources.tables import labelled_documents


def words_of(spark, small):
    words = labelled_documents(spark, small).withColumn("words", tx.tokenize(F.col("text")))
    return words.withColumn("words", stopwords.drop_stop_words("words")).select("doc_id", "label", "words")


def hinge(vectors, weights, intercept, reg):
    """The loss of a model by its definition, on features divided by their standard deviation."""
    rows = [(r.label, r.features) for r in vectors.collect()]
    x = np.stack([f.toArray() for _, f in rows])
    y = np.array([1.0 if label == 1 else -1.0 for label, _ in rows])
    spread = x.std(0, ddof=1)
    return np.maximum(0, 1 - y * (x @ weights + intercept)).mean() + reg / 2 * ((weights * spread) ** 2).sum()


@pytest.mark.parametrize("block_documents", [10_000, 50])
def test_loss_is_that_of_the_vector_model(spark, small, block_documents):
    words = words_of(spark, small).persist()
    model = linear.fit_svm(words, "words", F.col("label"), block_documents=block_documents, rounds=60 if block_documents == 10_000 else 12)
    fitted = classifiers.fit_features(labelled_documents(spark, small), F.lit(True), "text", ["doc_id", "label"], 100_000)
    vector = LinearSVC(maxIter=100, regParam=0.1).fit(fitted.train)
    theirs = hinge(fitted.train, vector.coefficients.toArray(), vector.intercept, 0.1)
    terms = fitted.stages[-1].vocabulary
    own = {r.term: r.weight for r in model.weights.collect()}
    ours = hinge(fitted.train, np.array([own.get(t, 0.0) for t in terms]), model.intercept, 0.1)
    assert ours <= 1.01 * theirs
    assert ours + 0.1 / 2 * (model.intercept / linear.BIAS) ** 2 <= model.loss + 1e-6  # that of the last round but one
    assert model.gap <= 0.005 if block_documents == 10_000 else 0 <= model.gap < 1  # few rounds of two blocks
    scored = linear.score_svm(model, words, "words", ["doc_id", "label"])
    assert scored.count() == words.count()
    assert scored.where(F.col("prediction") == F.col("label")).count() >= 0.95 * words.count()


def test_rows_without_words_and_one_class(spark):
    shape = "id long, label int, words array<string>"
    some = spark.createDataFrame([(1, 1, ["win", "win"]), (2, 0, ["lunch"]), (3, None, []), (4, 1, ["win", "now"]), (5, 0, ["lunch", "now"])], shape)
    model = linear.fit_svm(some, "words", F.col("label"))
    got = {r.id: r.prediction for r in linear.score_svm(model, some, "words", ["id"]).collect()}
    assert got[1] == got[4] == 1 and got[2] == got[5] == 0 and set(got) == {1, 2, 3, 4, 5}
    one = linear.fit_svm(some.where("label = 1"), "words", F.col("label"))
    assert {r.prediction for r in linear.score_svm(one, some, "words", ["id"]).collect()} == {1.0}
    none = linear.fit_svm(some.limit(0), "words", F.col("label"))
    assert none.weights.count() == 0 and linear.score_svm(none, some, "words", ["id"]).count() == 5


def test_thousands_of_documents_fit_in_few_rounds(spark):
    rows = spark.range(4500).select("id", (F.crc32(F.col("id").cast("string").cast("binary")) % 2).cast("int").alias("label"))
    common = F.array_repeat(F.lit("the"), (F.col("id") % 7 + 1).cast("int"))
    own = F.array(F.when(F.col("id") % 9 == 0, F.lit("odd")).otherwise(F.concat(F.lit("class"), F.col("label"))), F.concat(F.lit("w"), F.col("id") % 500), F.concat(F.lit("u"), F.col("id")))
    model = linear.fit_svm(rows.select("label", F.concat(common, own).alias("words")), "words", F.col("label"), rounds=30)
    assert model.gap <= 0.005 and model.rounds <= 20


def test_blocks_are_bounded_by_entries(spark, monkeypatch):
    monkeypatch.setattr(linear, "BLOCK_ENTRIES", 100)
    rows = spark.range(60).select((F.col("id") % 2).alias("label"), F.array(*[F.concat(F.lit(f"{k}-"), F.col("id") % (k + 2)) for k in range(5)]).alias("words"))
    scales = []
    monkeypatch.setattr(linear, "_solver", lambda scale, share, number, make=linear._solver: (scales.append(share), make(scale, share, number))[1])
    linear.fit_svm(rows, "words", F.col("label"), rounds=1)
    assert scales == [3.0]


def test_a_weight_of_one_block_moves_freely_and_many_documents_are_one_block(spark, monkeypatch):
    rows, y, none = [(np.array([0]), np.array([2.0])), (np.array([1]), np.array([2.0]))], np.array([1.0, -1.0]), np.zeros(2)
    alone, both = linear.improve(y, rows, none, none, 10.0, 1.0), linear.improve(y, rows, none, none, 10.0, 2.0)
    mixed = linear.improve(y, rows, none, none, 10.0, np.array([2.0, 1.0]))
    for k in (0, 1):
        assert np.allclose(mixed[k], [both[k][0], alone[k][1]])
    many, scales = spark.range(41_000).select((F.col("id") % 2).alias("label"), F.array(F.concat(F.lit("w"), F.col("id") % 7)).alias("words")), []
    monkeypatch.setattr(linear, "_solver", lambda scale, share, number, make=linear._solver: (scales.append(share), make(scale, share, number))[1])
    linear.fit_svm(many, "words", F.col("label"), rounds=1)
    assert scales == [1.0]

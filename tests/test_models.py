import pytest
from pyspark.sql import functions as F

from tamis.operators import classifiers
from tamis.sources import models

TRAINING = [
    (1, "win a free prize now claim your cash"), (1, "free lottery winner claim prize today"),
    (1, "urgent offer cheap pills click here"), (1, "click now for free cash offer"),
    (1, "купите дешево сейчас скидка приз"), (1, "вы выиграли приз срочно заберите деньги"),
    (1, "скидка только сегодня купите сейчас"), (0, "see you at the meeting tomorrow"),
    (0, "please send the report by friday"), (0, "lunch at noon with the team"),
    (0, "project status and next steps attached"), (0, "встреча завтра в десять утра"),
    (0, "пришлите отчет до пятницы"), (0, "обед с командой в полдень"),
]
GOLDEN = [
    ("claim your free cash prize", "SPAM"), ("the meeting report is attached", "NOT SPAM"),
    ("срочно купите приз", "SPAM"), ("отчет к встрече в пятницы", "NOT SPAM"),
]


@pytest.fixture(scope="module")
def training(spark):
    rows = [(i, label, text) for i, (label, text) in enumerate(TRAINING)]
    return spark.createDataFrame(rows, "id long, label int, email string").coalesce(1)


@pytest.fixture(scope="module")
def features(training):
    return classifiers.fit_features(training, F.lit(True), "email", ["id", "label"], 1000)


@pytest.mark.parametrize("name", ["bayes", "lr", "svm"])
def test_golden_messages_after_saving_and_loading(spark, features, tmp_path, name):
    model = classifiers.train_classifier(name, features)
    models.save_model(model, str(tmp_path), name, "golden", len(TRAINING), {"minDF": 1})
    loaded = models.load_model(str(tmp_path), name)
    messages = spark.createDataFrame([(text,) for text, _ in GOLDEN], "email string")
    scored = {r.email: r for r in classifiers.score_batch(loaded, messages, ["email"]).collect()}
    for text, expected in GOLDEN:
        row = scored[text]
        assert row.result == expected and 0.0 <= row.probability <= 1.0
        assert row.score_kind == ("margin" if name == "svm" else "probability")
    entry = models.registry(spark, str(tmp_path)).first()
    assert (entry.model, entry.training_set, entry.rows) == (name, "golden", len(TRAINING))
    assert classifiers.time_scoring(loaded, messages, 4) > 0


@pytest.mark.parametrize("name,params", [("dt", {}), ("rf", {"numTrees": 3}), ("gbt", {"maxIter": 2})])
def test_trees_evaluate(features, name, params):
    fitted = classifiers.Features(features.stages, features.train, features.train)
    row = classifiers.evaluate(name, fitted, **params)[1].first()
    assert row.model == name and row.n_rows == len(TRAINING) and row.accuracy > 0.5


def test_training_parameters():
    rf, svm, gbt = (classifiers.CLASSIFIERS[n]() for n in ("rf", "svm", "gbt"))
    assert rf.getNumTrees() == 50 and (svm.getMaxIter(), svm.getRegParam()) == (10, 0.1)
    assert (gbt.getMaxIter(), gbt.getMaxDepth(), gbt.getStepSize(), gbt.getSubsamplingRate()) == (50, 5, 0.1, 0.8)
    assert classifiers.perceptron(1000).getLayers() == [1000, 512, 256, 128, 2]


def test_network_on_presence_vectors(training):
    fitted = classifiers.fit_presence_features(training, F.lit(True), "email", "id", ["id", "label"], 200)
    model = classifiers.train_classifier("mlp", fitted, hidden=(8,), maxIter=20)
    assert model.stages[-1].transform(fitted.train).where("label = prediction").count() >= 10


def test_folding_locale_keeps_the_default_words(training):
    tokens, remover = classifiers.text_stages("email", locale="ru")
    assert remover.getLocale() == "ru" and len(remover.getStopWords()) == 181
    assert len(classifiers.text_stages("email", "russian")[1].getStopWords()) == 151

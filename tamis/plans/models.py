"""Trained pipelines: evaluation, leaderboard, saving, batch scoring, feature export."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from tamis.functions import stopwords, text as tx
from tamis.operators import classifiers, corpus, linear, metrics, network, splits
from tamis.operators.joins import derived_join
from tamis.operators.metrics import weighted_metrics
from tamis.plans import sql
from tamis.plans.bayes import MIN_DF, VOCAB_SIZE
from tamis.plans.registry import query
from tamis.session import materialize, scratch_path
from tamis.sources import csv, exports, models
from tamis.sources.tables import documents, labelled_documents, spread, table

# Largest vocabulary of each model; the vectors hold at most the terms there are.
VOCAB_SIZES = {"bayes": VOCAB_SIZE, "lr": 100_000, "dt": 100_000, "rf": 100_000, "svm": 100_000, "gbt": 10_000}

SIX = ("bayes", "lr", "dt", "svm", "gbt", "rf")


def test_part(spark: SparkSession, folder: str) -> DataFrame:
    return splits.hash_split(labelled_documents(spark, folder), "doc_id")[1]


def features(spark: SparkSession, folder: str, size: int, min_df: int = 1, **options) -> classifiers.Features:
    return classifiers.fit_features(labelled_documents(spark, folder), splits.in_share("doc_id"), "text",
                                    ["doc_id", "label"], size, min_df, **options)


def features_for(spark: SparkSession, folder: str, name: str) -> classifiers.Features:
    return features(spark, folder, VOCAB_SIZES[name], MIN_DF if name == "bayes" else 1)


def evaluated(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return classifiers.evaluate(name, features_for(spark, folder, name))[1]


def bayes_pipeline(spark: SparkSession, folder: str) -> tuple[PipelineModel, classifiers.Features]:
    fitted = features_for(spark, folder, "bayes")
    return classifiers.train_classifier("bayes", fitted), fitted


@query("lr_eval")
def lr_eval(spark, folder):
    return evaluated(spark, folder, "lr")


@query("dt_eval")
def dt_eval(spark, folder):
    return evaluated(spark, folder, "dt")


@query("rf_eval")
def rf_eval(spark, folder):
    return evaluated(spark, folder, "rf")


@query("svm_eval")
def svm_eval(spark, folder):
    return evaluated(spark, folder, "svm")


@query("gbt_eval")
def gbt_eval(spark, folder):
    return evaluated(spark, folder, "gbt")


@query("lr_locale_eval")
def lr_locale_eval(spark, folder):
    """Logistic regression with the Russian folding locale and the default word list."""
    return classifiers.evaluate("lr", features(spark, folder, VOCAB_SIZES["lr"], locale="ru"))[1]


def mixed_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents and conversation turns with their text in two different columns."""
    original = labelled_documents(spark, folder).select(F.concat(F.lit("d"), "doc_id").alias("id"), "label", "text")
    turns = table(spark, folder, "conversations").select(
        F.concat_ws("-", F.lit("c"), "conv_id", "turn").alias("id"),
        F.when(F.col("role") == "user", 1).otherwise(0).alias("label"), F.col("text").alias("translated"),
    )
    mixed = corpus.concat_mixed(original, turns, "message", "text", "translated")
    return corpus.drop_null_text(mixed, "message").select("id", "label", "message")


@query("svm_mixed_eval")
def svm_mixed_eval(spark, folder):
    """The linear SVM over all terms of the mixed corpus, with its weights in a table."""
    words = mixed_corpus(spark, folder).withColumn("words", tx.tokenize(F.col("message"))).withColumn("words", stopwords.drop_stop_words("words"))
    train, test = splits.hash_split(words.select("id", "label", "words"), "id")
    begin = time.perf_counter()
    model = linear.fit_svm(train, "words", F.col("label"))
    seconds = time.perf_counter() - begin
    scored = linear.score_svm(model, test, "words", ["id", "label"])
    return weighted_metrics(scored).select(F.lit("svm").alias("model"), "*", F.lit(seconds).alias("fit_seconds"))


def network_scores(spark: SparkSession, folder: str) -> tuple[DataFrame, classifiers.Features, float]:
    """Scores of the test part, the features and the seconds of training."""
    fitted = classifiers.fit_presence_features(labelled_documents(spark, folder), splits.in_share("doc_id"),
                                               "text", "doc_id", ["doc_id", "label"])
    begin = time.perf_counter()
    net = network.train(fitted.train, fitted.size, "doc_id")
    return network.score(net, fitted.test, ["doc_id", "label"]), fitted, time.perf_counter() - begin


@query("mlp_eval")
def mlp_eval(spark, folder):
    scored, _, seconds = network_scores(spark, folder)
    return weighted_metrics(scored).select(F.lit("mlp").alias("model"), "*", F.lit(seconds).alias("fit_seconds"))


def shared_features(spark: SparkSession, folder: str) -> dict[str, classifiers.Features]:
    """Each feature set is fitted once and used by every classifier that shares it."""
    large = features_for(spark, folder, "lr")
    return {name: large if VOCAB_SIZES[name] == VOCAB_SIZES["lr"] else features_for(spark, folder, name) for name in SIX}


@query("model_checks", f"""
WITH {sql.LABELLED},
counts AS (SELECT count(*) FILTER (WHERE NOT is_train) AS n_test, count(*) FILTER (WHERE is_train) AS n_train,
                  count(*) FILTER (WHERE NOT is_train AND label = 1) AS n_positive FROM labelled)
SELECT model, n_test, n_train, n_positive, 1 AS reaches_majority, 1 AS metrics_agree
FROM counts, (VALUES ('bayes'), ('lr'), ('dt'), ('svm'), ('gbt'), ('rf'), ('mlp')) AS models(model)""")
def model_checks(spark, folder):
    """Each model is trained; its rows are counted, its accuracy is held against the larger class, its metrics against its confusion matrix."""
    fitted, rows = shared_features(spark, folder), []
    for name in (*SIX, "mlp"):
        if name == "mlp":
            scored, features, _ = network_scores(spark, folder)
        else:
            features = fitted[name]
            scored = classifiers.train_classifier(name, features).stages[-1].transform(features.test)
        scored = materialize(scored.select("label", "prediction"), "predictions")
        matrix = {(r.label, r.prediction): r.n for r in metrics.confusion_matrix(scored).collect()}  # four rows
        total, right = sum(matrix.values()), sum(n for (label, said), n in matrix.items() if label == said)
        largest = max(sum(n for (label, _), n in matrix.items() if label == c) for c in (0, 1))
        found = weighted_metrics(scored).first()
        recall = sum(n for (label, said), n in matrix.items() if label == said) / max(1, total)  # weighted by class sizes it is the accuracy
        agree = abs(found.accuracy - right / max(1, total)) < 1e-9 and abs(found.weighted_recall - recall) < 1e-9
        rows.append((name, total, features.train.count(), sum(n for (label, _), n in matrix.items() if label == 1), int(right >= largest), int(agree)))
    return spark.createDataFrame(rows, "model string, n_test long, n_train long, n_positive long, reaches_majority int, metrics_agree int")


@query("leaderboard")
def leaderboard(spark, folder):
    fitted = shared_features(spark, folder)
    rows = [classifiers.evaluate(name, fitted[name])[1] for name in SIX]
    return reduce(DataFrame.unionByName, rows).orderBy("fit_seconds")


@query("model_timing")
def model_timing(spark, folder):
    """Save and load each model, then time it on the test part; fastest first."""
    root = scratch_path(spark, "models")
    test = materialize(test_part(spark, folder).select("text"), "test-texts")
    rows, times = test.count(), []
    for name, fitted in shared_features(spark, folder).items():
        models.save_model(classifiers.train_classifier(name, fitted), root, name, folder, fitted.train.count())
        seconds = classifiers.time_scoring(models.load_model(root, name), test, rows)
        times.append((name, seconds))
    timed = spark.createDataFrame(times, "model_name string, avg_prediction_time double")
    return timed.join(models.registry(spark, root).select(F.col("model").alias("model_name"), "rows"), "model_name").orderBy(
        "avg_prediction_time"
    )


@query("model_roundtrip", f"""
WITH {sql.naive_bayes(sql.TEST_DOCUMENTS)}
SELECT doc_id, label, prediction, round(probability, 4) AS probability FROM nb JOIN labelled USING (doc_id)""")
def model_roundtrip(spark, folder):
    model, fitted = bayes_pipeline(spark, folder)
    root = scratch_path(spark, "models")
    models.save_model(model, root, "bayes", folder, fitted.train.count(), {"minDF": MIN_DF, "vocabSize": VOCAB_SIZE})
    scored = classifiers.score_batch(models.load_model(root, "bayes"), test_part(spark, folder), ["doc_id", "label"])
    return scored.select("doc_id", "label", "prediction", F.round("probability", 4).alias("probability"))


@query("score_batch", f"""
WITH {sql.naive_bayes('SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)')}
SELECT doc_id, prediction, round(probability, 4) AS probability,
       CASE WHEN probability > 0.5 THEN 'SPAM' ELSE 'NOT SPAM' END AS result FROM nb""")
def score_batch(spark, folder):
    model, _ = bayes_pipeline(spark, folder)
    messages = spread(documents(spark, folder).select("doc_id", "text"), "doc_id")
    scored = derived_join(messages, table(spark, folder, "labels").select("doc_id"), "doc_id",
                          lambda texts: classifiers.score_batch(model, texts, ["doc_id"]), "left_anti")
    return scored.select("doc_id", "prediction", F.round("probability", 4).alias("probability"), "result")


@query("export_features", f"""
WITH {sql.naive_bayes(sql.TEST_DOCUMENTS)},
known AS (SELECT doc_id, count(*) AS n_terms, CAST(sum(n) AS BIGINT) AS n_words
          FROM scored_terms JOIN theta USING (term) GROUP BY doc_id)
SELECT doc_id, label, prediction, coalesce(n_terms, 0) AS n_terms, coalesce(n_words, 0) AS n_words
FROM nb JOIN labelled USING (doc_id) LEFT JOIN known USING (doc_id)""")
def export_features(spark, folder):
    model, fitted = bayes_pipeline(spark, folder)
    scored = model.stages[-1].transform(fitted.test)
    path = exports.export_features(scored, scratch_path(spark, "features"), ["doc_id", "label", "prediction"])
    written = csv.read_csv(spark, path, "doc_id long, label int, prediction double, features_array string")
    values = F.from_json("features_array", "values array<double>")["values"]
    return written.select(
        "doc_id", "label", "prediction", F.size(values).cast("long").alias("n_terms"),
        F.aggregate(values, F.lit(0.0), lambda total, value: total + value).cast("long").alias("n_words"),
    )

import threading

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from tamis.sources import models
from tamis.streaming import scoring


def fixed(spark, value):
    """A pipeline that gives every row the same answer."""
    return Pipeline(stages=[SQLTransformer(statement=f"SELECT *, {value} AS prediction FROM __THIS__")]).fit(spark.range(1))


def answer(root, name="m"):
    return models.load_model(root, name).transform(models.SparkSession.active().range(1)).first().prediction


def test_a_second_save_replaces_the_first(spark, tmp_path):
    root = str(tmp_path)
    models.save_model(fixed(spark, 1), root, "m", "a", 10)
    models.save_model(fixed(spark, 7), root, "other", "a", 10)
    assert answer(root) == 1
    models.save_model(fixed(spark, 2), root, "m", "b", 20, {"x": 1})
    rows = {r.model: r for r in models.registry(spark, root).collect()}
    assert len(rows) == 2 and (rows["m"].training_set, rows["m"].rows, rows["m"].params) == ("b", 20, '{"x": 1}')
    assert rows["m"].saved_at >= rows["other"].saved_at and answer(root) == 2 and answer(root, "other") == 7
    models.save_model(fixed(spark, 3), root, "m", "c", 30, keep_old=False)
    assert answer(root) == 3 and len([p for p in tmp_path.iterdir() if p.name.startswith("spam_model_m-")]) == 2
    with pytest.raises(KeyError):
        models.load_model(root, "none")


def test_two_writers_at_once_both_count(spark, tmp_path):
    root = str(tmp_path)
    pipelines = [fixed(spark, k) for k in range(2)]
    threads = [threading.Thread(target=models.save_model, args=(p, root, f"m{k}", "a", k)) for k, p in enumerate(pipelines)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert {r.model for r in models.registry(spark, root).collect()} == {"m0", "m1"}


def test_a_stream_takes_the_new_model_with_its_next_batch(spark, tmp_path):
    root, source, sink = str(tmp_path / "models"), str(tmp_path / "in"), str(tmp_path / "out")
    models.save_model(fixed(spark, 1), root, "m", "a", 1)
    live = models.LiveModel(spark, root, "m")
    spark.range(10).coalesce(1).write.parquet(source)
    spark.range(10, 20).coalesce(1).write.mode("append").parquet(source)

    def score(batch):
        scored = live.get().transform(batch)
        if batch.agg(F.count("*")).first()[0] and answer(root) == 1:
            models.save_model(fixed(spark, 2), root, "m", "b", 1)  # while the first batch is being scored
        return scored

    scoring.score_stream(spark, source, "id long", score, sink, str(tmp_path / "checkpoint"), files_per_batch=1).awaitTermination()
    found = sorted(r["count"] for r in scoring.scored(spark, sink).groupBy("prediction").count().collect())
    assert found == [10, 10]
    first = live.get()
    assert live.get() is first

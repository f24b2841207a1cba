from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tamis.functions import text as tx
from tamis.operators import naive_bayes
from tamis.streaming import answer_cache, scoring

START = datetime(2024, 1, 1)


def test_stream_scores_equal_batch_scores(spark, tmp_path):
    rows = [(i, i % 2, f"{'win cash' if i % 2 else 'lunch friday'} word{i % 5}") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, label int, email string").withColumn("words", tx.tokenize(F.col("email")))
    model = naive_bayes.fit(df, "words", "label", 100)

    def score(batch):
        return naive_bayes.score(model, batch, "words", ["id"])

    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    df.repartition(5).write.parquet(source)
    options = {"checkpoint": str(tmp_path / "checkpoint"), "files_per_batch": 2}
    scoring.score_stream(spark, source, df.schema, score, sink, **options).awaitTermination()
    want = sorted(score(df).collect())
    assert sorted(scoring.scored(spark, sink).collect()) == want
    # Only new files are scored by the next run.
    df.withColumn("id", F.col("id") + 100).write.mode("append").parquet(source)
    scoring.score_stream(spark, source, df.schema, score, sink, **options).awaitTermination()
    assert scoring.scored(spark, sink).count() == 80


def test_cache_state_lives_across_batches(spark, tmp_path):
    source = tmp_path / "requests"
    schema = "number long, name string, at timestamp"
    batches = [[(1, "a", 0), (2, "a", 86_399), (3, "b", 5)], [(4, "a", 86_400), (5, "b", 86_404)],
               [(6, "b", 86_405), (7, "a", 172_799), (8, "a", 172_800)], [(9, "a", 90_000), (10, "c", 10)]]
    source.mkdir()
    stream = spark.readStream.schema(schema).parquet(str(source))
    replayed = answer_cache.cache_stream(stream, F.col("name"), F.col("at"), F.col("number"))
    sink = str(tmp_path / "answers")
    for batch in batches:
        rows = [(n, k, START + timedelta(seconds=s)) for n, k, s in batch]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        answer_cache.write_available(replayed, sink, str(tmp_path / "checkpoint"))
    answers = spark.read.schema(replayed.schema).parquet(sink)
    hits = {r.id: r.hit for r in answers.collect()}
    assert hits == {1: False, 2: True, 3: False, 4: False, 5: True, 6: False, 7: True, 8: False, 9: True, 10: False}


def test_failed_and_late_requests_and_a_hot_key(spark, tmp_path):
    source, sink = tmp_path / "requests", str(tmp_path / "answers")
    schema = "number long, name string, at timestamp, fine boolean"
    source.mkdir()
    stream = spark.readStream.schema(schema).parquet(str(source))
    replayed = answer_cache.cache_stream(stream, F.col("name"), F.col("at"), F.col("number"), ok=F.col("fine"))
    hot = [(100 + i, "hot", 30 * i, True) for i in range(25_000)]  # more than an Arrow batch, 8.7 days
    batches = [[(1, "a", 0, False), (2, "a", 10, True), (3, "a", 20, False), (4, "b", 0, False)], [(5, "a", 86_410, False), (6, "a", 86_411, None), *hot],
               [(7, "a", 86_409, True), (8, "b", 400_000, True), (9, "a", 86_412, True)], [(10, "a", 5, True), (11, "b", 1, False)]]
    for batch in batches:
        rows = [(n, k, START + timedelta(seconds=s), fine) for n, k, s, fine in batch]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        answer_cache.write_available(replayed, sink, str(tmp_path / "checkpoint"))
    hits = {r.id: r.hit for r in spark.read.schema(replayed.schema).parquet(sink).collect()}
    small = {n: h for n, h in hits.items() if n < 100}
    # 7 and 10 come late: they are answered all the same, from the state there is.
    assert small == {1: False, 2: False, 3: True, 4: False, 5: False, 6: False, 7: True, 8: False, 9: False, 10: True, 11: True}
    assert [n - 100 for n, h in sorted(hits.items()) if n >= 100 and not h] == list(range(0, 25_000, 2880))

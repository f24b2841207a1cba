import duckdb
import pytest
from __spark_entry__ import entry, oracle_sql, queries
from tamis.plans import ORACLES, QUERIES

FAST = ["src_csv_labelled", "src_range", "label_repair", "validate_message", "tokenize", "stopwords_by_lang",
        "vocab_topk", "count_vectors", "hash_split", "exact_split", "sort_by_length", "nb_score", "metrics_weighted",
        "score_messages", "cache_ttl", "cache_hits", "enrich_dead_letter"]


@pytest.fixture(scope="module")
def duck(small):
    connection = duckdb.connect()
    for name in ("documents", "labels", "conversations", "events"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return connection


def test_registry_is_consistent():
    assert set(oracle_sql()) <= set(queries())
    assert set(QUERIES) <= set(queries()) and set(ORACLES) <= set(oracle_sql())
    assert set(QUERIES) - set(ORACLES) == {
        "lr_eval", "dt_eval", "rf_eval", "svm_eval", "gbt_eval", "mlp_eval", "lr_locale_eval", "svm_mixed_eval",
        "leaderboard", "model_timing"}


def test_entry(spark):
    assert entry(spark).columns == ["doc_id", "label", "prediction", "probability"]


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, duck, small, name):
    ours = queries()[name](spark, small)
    columns = sorted(ours.columns)
    theirs = duck.execute(oracle_sql()[name]).df()
    assert sorted(theirs.columns) == columns
    assert sorted(map(repr, ours.select(columns).toPandas().itertuples(index=False, name=None))) == sorted(
        map(repr, theirs[columns].itertuples(index=False, name=None)))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_narrow_queries_read_only_what_they_need(spark, small):
    assert "ReadSchema: struct<doc_id:bigint>" in plan(queries()["label_repair"](spark, small))
    text = plan(queries()["long_text_filter"](spark, small))
    assert "PushedFilters: [IsNotNull(text)" in text and "Exchange" not in text

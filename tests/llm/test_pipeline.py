import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from tamis.llm.common import table
from tests.llm import edge


def test_registered():
    names = queries()
    assert "pipeline" in names and sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 14))
    assert {"op2_licences", "op3_decontamination", "op7_quality", "op11_vector_codes", "op12_exact_dedup", "op13_hard_negatives"} <= oracle_sql().keys()


def test_stages_keep_the_columns_and_take_effect(spark, small):
    docs = table(spark, small, "documents")
    sizes, columns = [docs.count()], docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, small).collect(), docs.schema)
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[1] < sizes[0] and sizes[2] < sizes[1] and sizes[3] < sizes[2] and sizes[4] < sizes[3]
    got = corpus_pipeline.run(spark, small).toPandas().sort_values("start")
    assert set(got.doc_id) == {r.doc_id for r in docs.select("doc_id").collect()}
    assert got.start.tolist() == (got.n_tokens.cumsum() - got.n_tokens).tolist() and got.doc_id.is_monotonic_increasing


def test_stages_take_any_rows(spark, small):
    for rows in (edge.with_clashes(edge.documents(spark)), edge.empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            assert stage(spark, rows, small).count() <= len(edge.ROWS), name

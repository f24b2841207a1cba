import pytest
from pyspark.sql import functions as F

from tamis.sources import csv, exports

EDGES = 'label,text\n1,"first line\nsecond ""quoted"" line"\n2.0,"plain, with comma"\n,missing label\n0,\n-1,  spaced  \n'
RECORDS = [
    (1, 'first line\nsecond "quoted" line'), (1, "plain, with comma"), (0, "missing label"), (0, None), (0, "  spaced  "),
]


def rows(df):
    return sorted(((r.label, r.email) for r in df.collect()), key=str)


def test_reads_quoted_breaks_quotes_and_odd_labels(spark, tmp_path):
    (tmp_path / "corpus.csv").write_text(EDGES)
    path = str(tmp_path / "corpus.csv")
    assert rows(csv.read_labelled(spark, path)) == sorted(RECORDS, key=str)
    assert rows(csv.read_inferred(spark, path)) == sorted(RECORDS, key=str)


def test_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "corpus.csv").write_text('text,extra,label\n"a\nb",x,3\n')
    assert rows(csv.read_labelled(spark, str(tmp_path))) == [(1, "a\nb")]


def test_stray_quotes_and_header_texts_stay_records(spark, tmp_path):
    (tmp_path / "corpus.csv").write_text('label,text\n1,say 5" once\n"label","text"\n0,next\n1,last\n')
    assert [r.email for r in csv.read_labelled(spark, str(tmp_path)).collect()] == ['say 5" once', "text", "next", "last"]


def test_files_with_other_headers_fail(spark, tmp_path):
    (tmp_path / "a.csv").write_text("label,text\n1,a\n")
    (tmp_path / "b.csv").write_text("text,label\nb,0\n")
    with pytest.raises(Exception, match="CSV"):
        csv.read_labelled(spark, str(tmp_path)).collect()


def test_inference_leaves_messages_alone(spark, tmp_path):
    (tmp_path / "corpus.csv").write_text("label,text\n1,007\n0,1.50\n")
    assert rows(csv.read_inferred(spark, str(tmp_path))) == [(0, "1.50"), (1, "007")]


def test_round_trip_and_long_fields(spark, tmp_path):
    texts = ['say "hi"', "a\nb", "", " lead and trail ", "x" * 2_000_000, "ends with \\", ",", "ж\t"]
    df = spark.createDataFrame([(i % 2, t) for i, t in enumerate(texts)], "label int, text string")
    path = csv.write_csv(df, str(tmp_path / "out"))
    got = rows(csv.read_labelled(spark, path))
    assert got == sorted(((i % 2, t) for i, t in enumerate(texts)), key=str)


def test_vocabulary_rows_are_in_index_order(spark, tmp_path):
    table = spark.createDataFrame([(i, f"t{i * 7 % 10}") for i in range(10)], "idx long, term string")
    path = exports.export_vocabulary(table.repartition(3), str(tmp_path / "vocabulary"))
    files = sorted((tmp_path / "vocabulary").glob("part-*.csv"))
    terms = [line for f in files for line in f.read_text().splitlines() if line != "term"]
    assert terms == [f"t{i * 7 % 10}" for i in range(10)]
    assert csv.physical_lines(spark, path).where(F.col("value") != "term").count() == 10

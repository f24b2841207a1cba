import string

from pyspark.ml.feature import StopWordsRemover, Tokenizer
from pyspark.sql import functions as F

from tamis.functions import answers, stopwords, text as tx
from tamis.functions.labels import repair_label

MESSAGES = [
    "", " ", "\n a \t", "A  b c ", " lead", "trail  ", "MiXed\x0bCase\fx\r\n", "!?., ;", "Привет,  МИР", " nbsp x　",
]


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id int, x {kind}")


def values(df, name="y"):
    return [row[name] for row in df.orderBy("id").collect()]


def test_tokenize_equals_the_ml_stage(spark):
    df = column(spark, MESSAGES)
    expected = values(Tokenizer(inputCol="x", outputCol="y").transform(df))
    assert values(df.withColumn("y", tx.tokenize(F.col("x")))) == expected
    assert values(column(spark, [None]).withColumn("y", tx.tokenize(F.col("x")))) == [None]


def test_strip_and_words_follow_python(spark):
    df = column(spark, MESSAGES)
    assert values(df.withColumn("y", tx.strip_message(F.col("x")))) == [m.strip() for m in MESSAGES]
    assert values(df.withColumn("y", tx.whitespace_words(F.col("x")))) == [m.split() for m in MESSAGES]


def test_bag_words_follow_python(spark):
    texts = [*MESSAGES, "Don't panic; it's a well-known FACT!", "ab abc abcd"]
    drop = str.maketrans("", "", string.punctuation)
    expected = [[w for w in t.lower().translate(drop).split() if len(w) > 2] for t in texts]
    assert values(column(spark, texts).withColumn("y", tx.bag_words(F.col("x")))) == expected


def test_lengths_count_code_points(spark):
    lengths = [499, 500, 501, 4998, 4999, 5000]
    df = column(spark, ["я" * n for n in lengths] + ["😀" * 501])
    assert values(df.withColumn("y", tx.is_long(F.col("x")))) == [False, False, True, True, True, True, True]
    assert values(df.withColumn("y", F.length(tx.truncate(F.col("x"))))) == [499, 500, 501, 4998, 4999, 4999, 501]


def test_stop_words_per_language(spark):
    words = ["и", "в", "the", "не", "You", "купите", "", "isn't"]
    df = spark.createDataFrame([(0, "en", words), (1, "ru", words), (2, "xx", words)], "id int, lang string, x array<string>")
    ml = StopWordsRemover(inputCol="x", outputCol="y")
    assert values(df.withColumn("y", stopwords.drop_stop_words("x"))) == values(ml.transform(df))
    by_lang = df.withColumn("y", stopwords.drop_stop_words_by_language("x", F.col("lang")))
    assert values(by_lang) == [["и", "в", "не", "купите", ""], ["the", "You", "купите", "", "isn't"], words]
    table = stopwords.stop_word_table(spark)
    assert table.where("lang = 'en'").count() == len(stopwords.stop_words())


def test_label_repair(spark):
    labels = [None, float("nan"), -1.0, 0.0, 0.5, 1.0, 2.0, 7.0]
    assert values(column(spark, labels, "double").withColumn("y", repair_label(F.col("x")))) == [0, 0, 0, 0, 0, 1, 1, 1]


def test_confidence_rounds_like_a_browser(spark):
    shares = [0.0, 1.0, 0.5, 0.00125, 0.123456, 0.62625, 0.1, 0.999999]
    df = column(spark, shares, "double").withColumn("y", answers.confidence_percent(F.col("x")))
    assert values(df) == ["0.00%", "100.00%", "50.00%", "0.13%", "12.35%", "62.63%", "10.00%", "100.00%"]


def test_requests_and_answers(spark):
    bodies = ['{"message": "  hi "}', "{}", '{"message": " \\n"}', "broken"]
    checked = answers.clean_request(column(spark, bodies).select(answers.read_request(F.col("x")).alias("r")).select("r.*"))
    assert values(checked, "message") == ["hi", "", "", ""]
    assert values(checked, "status") == ["success", "error", "error", "error"]
    assert values(checked, "error") == [None, "Empty message", "Empty message", "Malformed request"]
    shown = checked.withColumn("y", answers.answer_json(
        F.col("status"), answers.verdict(F.lit(0.75)), F.lit(0.75), F.col("error")))
    assert values(shown)[:2] == [
        '{"status":"success","result":"SPAM","probability":0.75}', '{"status":"error","error":"Empty message"}']


def test_malformed_bodies(spark):
    good = ['{"message":"a"}', ' {"message":null} ', '{"other":1}', '{"message":{"deep":[1,{}]}}', '{"message":7}']
    bad = [None, "", " ", "[1]", '"s"', "7", "null", '{"message":"a"', "{'message':'a'}", '{"message":"a"} x', '{"a":1},{"b":2}', '{} ] x', '{},"end":1} x',
           '{},"end":1', '{"message":"a","message":"b"}', "{}]"]
    assert values(column(spark, good).withColumn("y", answers.is_json_object(F.col("x")))) == [True] * len(good)
    assert values(column(spark, bad).withColumn("y", answers.is_json_object(F.col("x")))) == [False] * len(bad)
    assert values(column(spark, good).withColumn("y", answers.parse_request(F.col("x")))) == ["a", "", "", '{"deep":[1,{}]}', "7"]


def test_verdict_is_strict_and_keys_name_the_model(spark):
    df = column(spark, [0.5, 0.5000001], "double").withColumn("y", answers.verdict(F.col("x")))
    assert values(df) == ["NOT SPAM", "SPAM"]
    keys = spark.range(1).select(answers.answer_key(F.lit("m")), answers.answer_key(F.lit("m"), "lr")).first()
    assert keys[0].startswith("spam:") and keys[1].startswith("spam:lr:") and keys[0][5:] == keys[1][8:]


def test_translation_answers(spark):
    bodies = ['{"translatedText": "да"}', '{"other": 1}', "<html>"]
    text, error = answers.parse_translation(F.col("x"))
    df = column(spark, bodies).withColumns({"y": text, "e": error})
    assert values(df) == ["да", "", ""]
    assert values(df, "e") == ["", "no_translatedText_in_response", "bad_json"]

"""CSV corpora: quoted line breaks, doubled quotes, labels written as 1 or 1.0."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tamis.functions.labels import repair_label

_DIALECT = {"header": True, "sep": ",", "quote": '"', "escape": '"'}
_KEEP_SPACE = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
RECORDS_PER_FILE = 1_000_000
# An unquoted empty field is NULL, a quoted one is an empty text.
_NULLS = {"nullValue": "\0"}


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None, multi_line: bool = True) -> DataFrame:
    """Read CSV records; without a schema Spark infers one in an extra pass.

    With ``multi_line`` a file is read by one task: ``write_csv`` bounds the records of a file, and a
    larger file from elsewhere is one task. Every file's header must name the schema's columns in
    their order, or the job fails.
    """
    reader = spark.read.options(**_DIALECT, **_KEEP_SPACE, **_NULLS, multiLine=multi_line, mode="PERMISSIVE",
                                enforceSchema=False)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return reader.csv(path)


def read_labelled(spark: SparkSession, path: str, text: str = "text", label: str = "label") -> DataFrame:
    """``(label, email)`` with repaired labels, columns found by their header name."""
    # Names hold no line breaks, so the first line is enough.
    header = spark.read.options(**_DIALECT).csv(path).columns
    schema = T.StructType([T.StructField(name, T.DoubleType() if name == label else T.StringType()) for name in header])
    records = read_csv(spark, path, schema)
    return records.select(repair_label(F.col(label)).alias("label"), F.col(text).alias("email"))


def read_inferred(spark: SparkSession, path: str, text: str = "text", label: str = "label") -> DataFrame:
    """Same result with inferred types; a message that looks like a number stays as it is written."""
    inferred = read_csv(spark, path).schema
    schema = T.StructType([T.StructField(f.name, T.StringType()) if f.name == text else f for f in inferred])
    return read_csv(spark, path, schema).select(repair_label(F.col(label)).alias("label"), F.col(text).alias("email"))


def write_csv(df: DataFrame, path: str) -> str:
    """Write in parallel, with a header in every file and a bounded number of records per file."""
    df.write.options(**_DIALECT, **_KEEP_SPACE, maxRecordsPerFile=RECORDS_PER_FILE, quoteAll=False).csv(path)
    return path


def physical_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the files as they are on disk, in column ``value``."""
    return spark.read.text(path)

"""A corpus pipeline: five stages, each over the rows its predecessor kept.

Every stage is written as Parquet below the session's scratch folder and read again by the next,
so a lost executor repeats part of one stage. All but the last return the columns of
``documents``.

A stage's own tables go when a later stage begins, as the result that needed them is written by
then; tables that the later stage's rows still read stay.

Every stage takes NULLs in any column (a NULL text is an empty one, a row without doc_id is
treated as its operator says), repeated rows, tables without rows, which give none, and columns
of any other name, which pass through all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tamis.llm import decontaminate, mixing, quality, simhash, token_files
from tamis.llm.common import table
from tamis.llm.queries import tokenizer_path
from tamis.session import discard, discard_unread, materialize, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_spent: set[str] = set()  # tables of stages that have returned


def stage(function: Stage) -> Stage:
    """A stage that first removes what earlier stages have left behind and ``docs`` does not read."""
    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard_unread(_spent, docs)
        _spent.intersection_update(before := written())
        result = function(spark, docs, sf_dir)
        _spent.update(written() - before)
        return result

    return run_stage


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that neither their text nor their host rejects; wordless and NULL texts go, rows without a host are judged by their text."""
    return quality.accepted(docs)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of smallest doc_id of each group; a row given twice stays once."""
    return simhash.without_near_duplicates(docs)


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage of the benchmark; NULL texts have none."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


@stage
def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows drawn towards the targets of source, language and topic; NULL is a value of its own, wordless rows stay."""
    return mixing.sampled(docs)


@stage
def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every row, read back from token files; a NULL text has the end id alone."""
    return token_files.read_token_files(token_files.write_token_files(docs, tokenizer_path()))


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("source_mixing", source_mixing), ("token_output", token_output)]
ORACLE_SQL = None  # hashing, the sampling draw and the tokenizer are not SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        before, docs = docs, materialize(step(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)  # a stage's result, which the next one has read
    return docs

"""Continuous scoring of arriving messages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def score_stream(spark: SparkSession, source: str, schema, score: Callable[[DataFrame], DataFrame],
                 sink: str, checkpoint: str, files_per_batch: int = 64) -> StreamingQuery:
    """Score new parquet files as they arrive and write the answers to ``sink``.

    Each micro-batch overwrites its own folder, so a batch repeated after a failure leaves
    no duplicates. The run ends when all files present at its start are done. ``checkpoint`` names
    the folder that remembers which files are; a run with the same one goes on after them.
    ``score`` is called once a micro-batch and may take another model each time, see
    :class:`tamis.sources.models.LiveModel`.
    """
    def write_batch(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
        .writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def scored(spark: SparkSession, sink: str) -> DataFrame:
    return spark.read.parquet(sink).drop("batch")

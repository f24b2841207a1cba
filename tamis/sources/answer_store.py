"""Stored answers with a lifetime: a snapshot and the deltas written since, published by manifest."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tamis.functions.answers import ANSWER_TTL_SECONDS
from tamis.operators.answer_cache import unexpired
from tamis.session import remove
from tamis.sources.manifests import Manifests

SCHEMA = "key string, answer string, stored_at timestamp"


class AnswerStore:
    """A table ``key, answer, stored_at`` in a shared folder.

    ``add`` writes a delta and publishes it. ``compact`` writes the live answers anew as one
    snapshot; deltas that others publish meanwhile stay listed beside it. A reader keeps the
    files it has listed until ``compact`` is called with ``keep=False``, so that a running job
    does not lose its input.
    """

    def __init__(self, spark: SparkSession, root: str, ttl: int = ANSWER_TTL_SECONDS):
        self.spark, self.root, self.ttl = spark, root.rstrip("/"), ttl
        self.manifests = Manifests(spark, root)

    def _parts(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*[f"{self.root}/{n}" for n in names])

    def live(self, now: Column) -> DataFrame:
        """One answer for each key that has an unexpired one, the last if writers stored it twice."""
        rows = unexpired(self._parts(self.manifests.newest()[1]), "stored_at", now, self.ttl)
        return rows.groupBy("key").agg(F.max_by(F.struct("answer", "stored_at"), F.struct("stored_at", "answer")).alias("last")).select("key", "last.*")

    def add(self, answers: DataFrame) -> None:
        name = f"delta-{uuid.uuid4().hex}"
        answers.select("key", "answer", F.col("stored_at").cast("timestamp").alias("stored_at")).write.parquet(f"{self.root}/{name}")
        self.manifests.change(lambda names: [*names, name])

    def compact(self, now: Column, keep: bool = True) -> None:
        _, old = self.manifests.newest()
        name = f"snapshot-{uuid.uuid4().hex}"
        self.live(now).write.parquet(f"{self.root}/{name}")
        self.manifests.change(lambda names: [name, *[n for n in names if n not in old]])
        for part in [] if keep else old:
            remove(self.spark, f"{self.root}/{part}")

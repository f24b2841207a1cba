"""The 24-hour answer cache as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tamis.functions.answers import ANSWER_TTL_SECONDS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def mark_hits(micros: np.ndarray, ok: np.ndarray, ttl_micros: int, expires: int | None) -> tuple[np.ndarray, int | None]:
    """Hit flags for requests of one key in order of time, and the expiry of the answer stored last.

    A request before the expiry hits. The first one that is ``ok`` and not before it stores
    anew; those that fail until then store nothing.
    """
    hits, good, at = np.zeros(len(micros), bool), np.flatnonzero(ok), 0
    while True:
        if expires is not None:
            end = int(np.searchsorted(micros, expires))
            hits[at:end] = True
            at = max(at, end)
        following = good[np.searchsorted(good, at):]
        if not len(following):
            return hits, expires
        at = int(following[0])
        expires = int(micros[at]) + ttl_micros
        at += 1


class AnswerLifetime(StatefulProcessor):
    """The state of a key is the expiry of its stored answer; a timer removes it.

    A batch of a key's requests is answered and let go before the next one is read.
    """

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.expires = handle, handle.getValueState("expires", "micros long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = expires = self.expires.get()[0] if self.expires.exists() else None
        for batch in rows:
            batch = batch.sort_values(["micros", "id"])
            hits, expires = mark_hits(batch["micros"].to_numpy(), batch["ok"].to_numpy(), self.ttl * 1_000_000, expires)
            yield batch.assign(hit=hits)[["id", "key", "micros", "hit"]]
        if expires != before:
            self.expires.update((expires,))
            if before is None:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.ttl * 1000)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.expires.exists():
            if self.expires.get()[0] // 1000 <= timerValues.getCurrentWatermarkInMs():
                self.expires.clear()
            else:  # the requests are behind the clock
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.ttl * 1000)
        return iter(())

    def close(self) -> None:
        pass


def cache_stream(requests: DataFrame, key: Column, at: Column, request_id: Column,
                 ttl: int = ANSWER_TTL_SECONDS, lateness: str = "1 hour", ok: Column | None = None) -> DataFrame:
    """``(id, key, micros, hit)`` for a stream of requests, one row for each however late it is.

    A request that is not ``ok`` may hit but stores nothing. A key that stays silent for ``ttl``
    loses its state if the newest request less ``lateness`` has passed its expiry, else it waits
    again; ``lateness`` bounds the state kept and drops no request. Requests of one key are
    ordered inside an Arrow batch; one that comes in a later batch than a newer one is answered
    from the state there is. A NULL key is a key of its own.
    """
    fine = F.lit(True) if ok is None else F.coalesce(ok, F.lit(False))
    return (
        requests.select(request_id.alias("id"), key.alias("key"), at.cast("timestamp").alias("at"), fine.alias("ok"))
        .withColumn("micros", F.unix_micros("at"))
        .withWatermark("at", lateness)
        .groupBy("key")
        .transformWithStateInPandas(AnswerLifetime(ttl), "id long, key string, micros long, hit boolean", "append", "ProcessingTime")
    )


def write_available(replayed: DataFrame, sink: str, checkpoint: str) -> None:
    """Answer what the source holds now and end.

    Timeouts by the clock would ask for one empty batch after the other, so batches without data
    are off for this query, and its state lies in RocksDB; the session's settings are put back
    once it has started.
    """
    spark = replayed.sparkSession
    settings = {"spark.sql.streaming.noDataMicroBatches.enabled": "false", "spark.sql.streaming.stateStore.providerClass": ROCKSDB}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        query = (replayed.writeStream.format("parquet").option("checkpointLocation", checkpoint)
                 .trigger(availableNow=True).start(sink))
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    query.awaitTermination()

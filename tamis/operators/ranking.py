"""Exact ranks and top-k without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tamis.session import materialize

# A heap this size per task is cheap to merge; larger cut-offs are ranked in parallel.
SMALL_K = 10_000

_ROW_BITS = 33  # monotonically_increasing_id keeps the row position in the low 33 bits


def global_rank(df: DataFrame, order: list[Column], out: str = "rank", start: int = 0) -> DataFrame:
    """Number all rows in a total order, in parallel.

    Rows are range partitioned on the order, sorted and numbered inside each partition,
    and written once. The only small piece is one offset per partition. A value shared by
    very many rows is still split as long as the order ends in a unique column.
    """
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("__at", F.monotonically_increasing_id())
        .withColumns({
            "__part": F.shiftright("__at", _ROW_BITS).cast("int"),
            "__row": F.col("__at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)),
        })
        .drop("__at")
    )
    written = materialize(placed, "rank")
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        written.groupBy("__part").agg(F.count("*").alias("__n"))
        .select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    )
    # One row per range partition, so the broadcast is bounded by the partition count.
    return (
        written.join(F.broadcast(offsets), "__part")
        .withColumn(out, F.col("__before") + F.col("__row") + start)
        .drop("__part", "__row", "__before")
    )


def top_k(df: DataFrame, k: int, order: list[Column], out: str = "idx") -> DataFrame:
    """The first ``k`` rows of a total order, numbered from 0."""
    if k > SMALL_K:
        return global_rank(df, order, out).where(F.col(out) < k)
    first = df.orderBy(*order).limit(k)
    # At most SMALL_K rows reach this window.
    return first.withColumn(out, (F.row_number().over(W.orderBy(*order)) - 1).cast("long"))

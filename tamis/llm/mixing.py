"""Mixing to target weights: iterative proportional fitting of token weights, then sampling.

Documents are summed to cells of source, language and topic before anything is fitted. Every
sweep scales the cells to one target after the other; no cell may weigh more than it has, so
the fit is also a table of sampling probabilities.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.llm.common import own_name, utf8
from tamis.session import discard, materialize

TEMPERATURES = {"source": 0.7, "lang": 0.85, "topic": 1.0}
KEEP = 0.8  # share of all tokens that the sample has in expectation
SWEEPS = 30
CLOSE = 1e-4  # a sweep that changes no cell by more than this share of it is the last
SMALL_CELLS = 20_000  # up to so many cells (about 2 MB) are broadcast, beyond them the join is shuffled
CELLS_PER_TASK = 20_000  # a raking step takes a task for so many cells


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_CLASS = {"table": b"|", "markup": b"#$%&*<>{}=", "numbers": b"0123456789", "capitals": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
_SHARES = {"table": 0.02, "markup": 0.05, "numbers": 0.1, "capitals": 0.3}


def measure(text: bytes | None) -> tuple[int, str]:
    """Words between white space, and a coarse topic of a text by its form and length."""
    raw = np.frombuffer(text or b"", np.uint8)
    if not len(raw):
        return 0, "note"
    solid = ~_BLANK[raw]
    tokens = int(solid[0]) + int(np.count_nonzero(solid[1:] & ~solid[:-1]))
    counts = np.bincount(raw, minlength=256)
    for topic, signs in _CLASS.items():
        if counts[list(signs)].sum() > _SHARES[topic] * len(raw):
            return tokens, topic
    return tokens, "note" if len(raw) < 400 else "prose" if len(raw) < 4000 else "long prose"


def measured(docs: DataFrame, names: dict[str, str], keep_text: bool) -> DataFrame:
    """``docs`` with tokens and topic. A text goes to a task's Python and back once, as bytes."""
    rest, raw = [c for c in docs.columns if c != "text"], own_name(docs, "utf8")
    sent = [docs.schema[c] for c in rest] + [T.StructField(raw, T.BinaryType())] * keep_text
    schema = T.StructType([*sent, T.StructField(names["n_tokens"], T.LongType()), T.StructField(names["topic"], T.StringType())])

    def run(batches):
        for batch in batches:
            found = [measure(t) for t in batch.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays(batch.columns[:len(sent)] + [pa.array([n for n, _ in found], pa.int64()), pa.array([t for _, t in found], pa.string())],
                                             names=schema.names)

    done = docs.select(*[f"`{c}`" for c in rest], utf8("text").alias(raw)).mapInArrow(run, schema)
    text = F.col(raw).cast("string").cast(docs.schema["text"].dataType).alias("text")
    return done.select(*[text if c == "text" else F.col(f"`{c}`") for c in docs.columns if keep_text or c != "text"], names["n_tokens"], names["topic"])


def tempered(cells: DataFrame, name: str, temperature: float) -> DataFrame:
    """Target shares of a dimension: its token shares to the power of ``temperature``, made to add up to 1."""
    sums = cells.groupBy(name).agg(F.sum("tokens").cast("double").alias("t")).where("t > 0").withColumn("share", F.pow("t", F.lit(temperature)))
    total = sums.agg(F.sum("share")).first()[0] or 1.0
    return materialize(sums.select(name, (F.col("share") / F.lit(total)).alias("share")), f"target-{name}")


def rake(cells: DataFrame, targets: dict[str, DataFrame], keep: float = KEEP, sweeps: int = SWEEPS, close: float = CLOSE) -> DataFrame:
    """``cells`` with ``weight``, at most their ``tokens``, whose marginals come as near to the targets as that allows.

    Cells a target does not name weigh nothing. The loop ends when a sweep no longer changes
    anything, or after ``sweeps`` with a warning; every step is written, so its plan stays small
    and a lost executor repeats one. Cells that fit one task are summed and joined without an exchange;
    more of them are shuffled by the target's key.
    """
    total, count = cells.agg(F.sum("tokens"), F.count("*")).first()
    total, tasks = total or 0, -(-count // CELLS_PER_TASK) or 1
    rows = cells.withColumn("weight", F.col("tokens").cast("double"))
    for name, target in targets.items():
        share = target.select(F.col(name).alias("key"), F.col("share").alias(f"{name}_share"))
        rows = rows.join(share, F.col(name).eqNullSafe(F.col("key")), "left").drop("key")
    held = materialize(rows.withColumn("before", F.col("weight")), "raked")
    for _ in range(sweeps):
        for place, name in enumerate(targets):
            rows = held.coalesce(tasks)
            rows = rows if place else rows.withColumn("before", F.col("weight"))
            sums = rows.groupBy(F.col(name).alias("key")).agg(F.sum("weight").alias("sum"))
            want = F.col("weight") * F.col(f"{name}_share") * F.lit(float(keep * total)) / F.col("sum")
            rows = materialize(rows.join(sums, F.col(name).eqNullSafe(F.col("key"))).withColumn(
                "weight", F.when(F.col("sum") > 0, F.least(F.col("tokens").cast("double"), F.coalesce(want, F.lit(0.0)))).otherwise(0.0)).drop("key", "sum"), "raked")
            discard(held)
            held = rows
        change = F.max(F.abs(F.col("weight") - F.col("before")) / F.greatest("before", F.lit(1e-300)))
        if (held.coalesce(tasks).agg(change).first()[0] or 0) <= close:
            break
    else:
        warnings.warn(f"raking still changed cells by more than {close:g} after {sweeps} sweeps", stacklevel=2)
    return held.select(*cells.columns, "weight")


def draw(key: Column) -> Column:
    """A number in [0, 1) that depends on the key alone, so that a repeated task draws the same rows."""
    return (F.shiftrightunsigned(F.xxhash64(key.cast("string"), F.lit("mixing")), 11) / F.lit(float(1 << 53)))


def mixed(docs: DataFrame, keep_text: bool = True, temperatures: dict[str, float] = TEMPERATURES, keep: float = KEEP) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with tokens, topic, the sampling probability and the draw, and the names these got.

    Targets are the tempered token shares of source, language and topic. NULL is a source or
    language of its own; texts without words have no tokens to weigh and are always taken. A
    document without an id is drawn by its text. Rows with one id are drawn alike.
    """
    names = {n: own_name(docs, n) for n in ("n_tokens", "topic", "probability", "sampled")}
    spare = own_name(docs, "draw_key")
    key = F.coalesce(F.col("doc_id").cast("string"), F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))
    rows = measured(docs.withColumn(spare, key), names, keep_text)
    if not keep_text:
        rows = materialize(rows, "sizes")
    dims = {"source": "source", "lang": "lang", "topic": names["topic"]}
    cells = materialize(rows.groupBy(*[F.col(c).cast("string").alias(n) for n, c in dims.items()]).agg(
        F.sum(names["n_tokens"]).alias("tokens"), F.count("*").alias("docs")).where("tokens > 0"), "cells")
    fitted = rake(cells, {n: tempered(cells, n, temperatures[n]) for n in dims}, keep)
    fitted = fitted.select(*[F.col(n).alias(f"{names['sampled']}_{n}") for n in dims],
                           F.least(F.lit(1.0), F.col("weight") / F.col("tokens")).alias(names["probability"]))
    if cells.count() <= SMALL_CELLS:
        fitted = F.broadcast(fitted)
    on = [F.col(f"`{c}`").cast("string").eqNullSafe(fitted[f"{names['sampled']}_{n}"]) for n, c in dims.items()]
    rows = rows.join(fitted, on, "left").drop(*[f"{names['sampled']}_{n}" for n in dims])
    chance = F.when(F.col(names["n_tokens"]) == 0, 1.0).otherwise(F.col(names["probability"]))
    rows = rows.withColumn(names["probability"], chance).withColumn(names["sampled"], draw(F.col(spare)) < F.col(names["probability"]))
    return rows.drop(spare), names


def report(docs: DataFrame) -> DataFrame:
    """``doc_id, source, lang, topic, n_tokens, probability, sampled`` for every row."""
    rows, names = mixed(docs.select("doc_id", "text", "lang", "source"), keep_text=False)
    return rows.select("doc_id", "source", "lang", *[F.col(c).alias(n) for n, c in names.items()])


def sampled(docs: DataFrame) -> DataFrame:
    """The drawn rows, with the columns they came with."""
    rows, names = mixed(docs)
    return rows.where(F.col(names["sampled"])).select(*[f"`{c}`" for c in docs.columns])

"""A linear support vector machine whose weights are rows, for vocabularies of any size.

The loss is the mean hinge loss plus half the squared length of the weights times ``reg``, taken
over features divided by their standard deviation. It is minimised in its dual form: every
document has a multiplier between 0 and 1, and the weights are the sum of the documents times
their multipliers. Blocks of documents improve their own multipliers one after the other, each
with the weights of its own terms alone; the blocks' changes of the weights are then added up by
term. The gap between the loss and its dual bound says how far the fit is from the best one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tamis.operators.counting import term_rows, with_term_counts
from tamis.operators.joins import fits_broadcast, lookup
from tamis.operators.ranking import global_rank
from tamis.session import discard, materialize

# Few large blocks: those that share frequent terms undo each other's work and take many rounds.
BLOCK_DOCUMENTS = 500_000
BLOCK_ENTRIES = 64_000_000  # of a block on average, eight bytes each in memory
LOCAL_PASSES = 5
BIAS = 30.0  # value of the feature that stands for the intercept; large, so that its weight costs next to nothing
STATE = "block int, kind int, id long, value double"
PACKED = "block int, ids binary, y binary, lengths binary, at binary, x binary"
WEIGHT, MULTIPLIER, LOSS, DUAL = range(4)
SENT_ROWS = 100_000


@dataclass
class LinearModel:
    """``weights`` holds ``term, weight, df`` for unscaled counts; ``gap`` is the share of the loss that a better fit could save at most."""

    weights: DataFrame
    intercept: float
    loss: float
    gap: float
    rounds: int
    small: bool


def improve(y: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], alpha: np.ndarray, weights: np.ndarray,
            scale: float, share: float | np.ndarray, passes: int = LOCAL_PASSES, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and the change of the weights after some passes over a block's documents.

    ``scale`` is the regulariser times the number of all documents; ``share`` the number of blocks
    whose changes of a weight are added up, which makes each of them careful: a weight that only
    this block has moves freely.
    """
    alpha, local = alpha.copy(), weights.copy()
    shares = np.broadcast_to(np.asarray(share, float), weights.shape)
    squares = [float(shares[at] @ (x * x)) for at, x in rows]
    draw = np.random.default_rng(seed)
    for _ in range(passes):
        for i in draw.permutation(len(rows)):
            at, x = rows[i]
            step = (1.0 - y[i] * float(local[at] @ x)) * scale / squares[i]
            new = min(1.0, max(0.0, alpha[i] + step))
            if new != alpha[i]:
                local[at] += shares[at] * ((new - alpha[i]) * y[i] / scale * x)
                alpha[i] = new
    return alpha, (local - weights) / shares


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``block, id, y, at, x`` in the order of their blocks, as one row for each block and batch."""
    for batch in batches:
        block = batch.column(0).to_numpy()
        starts = np.nonzero(np.concatenate(([True], block[1:] != block[:-1])))[0].tolist() if len(block) else []
        for a, b in zip(starts, [*starts[1:], len(block)], strict=True):
            own = batch.slice(a, b - a)
            columns = [own.column(1).to_numpy(), own.column(2).to_numpy(), own.column(3).value_lengths().to_numpy(), own.column(3).flatten().to_numpy(), own.column(4).flatten().to_numpy()]
            yield pa.RecordBatch.from_arrays([pa.array([block[a]], pa.int32()), *[pa.array([c.tobytes()], pa.binary()) for c in columns]], names=[c.split()[0] for c in PACKED.split(", ")])


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The terms of each packed row."""
    for batch in batches:
        for block, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = np.unique(np.frombuffer(at, np.int32)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), block, np.int32)), pa.array(ids)], names=["block", "id"])


def _solver(scale: float, share: float, number: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One block: its packed documents, and its state in rows without documents.

    ``share`` is the number of blocks; the state of a weight says what part of them has it.
    """
    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, documents, block = [], [], None
        for batch in batches:
            kind = batch.column(1)
            given = batch.filter(kind.is_valid())
            state.append([given.column(k).to_numpy(zero_copy_only=False) for k in range(1, 5)])
            for own in batch.filter(kind.is_null()).to_pylist():
                block = own["block"]
                documents.append([np.frombuffer(own[name], kind) for name, kind in (("ids", np.int64), ("y", np.float64), ("lengths", np.int32), ("at", np.int32), ("x", np.float32))])
        if not documents:
            return
        kinds, numbers, values, held_by = (np.concatenate(c) for c in zip(*state, strict=True))
        ids, weights, multipliers, kept = *_ordered(kinds == WEIGHT, numbers, values), *_ordered(kinds == MULTIPLIER, numbers, values)
        shares = share * _ordered(kinds == WEIGHT, numbers, held_by)[1]
        rows = []
        for _, _, lengths, at, x in documents:
            place = at if ids[-1] + 1 == len(ids) else np.searchsorted(ids, at).astype(np.int32)  # all terms, mostly
            ends = np.cumsum(lengths)
            rows += [(place[a:b], x[a:b]) for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
        names, y = (np.concatenate([d[k] for d in documents]) for k in (0, 1))
        order = np.argsort(names, kind="stable")
        rows, names, y = [rows[k] for k in order.tolist()], names[order], y[order]
        place = np.minimum(np.searchsorted(multipliers, names), len(multipliers) - 1)
        alpha = np.where(multipliers[place] == names, kept[place], 0.0)
        loss = sum(max(0.0, 1.0 - label * float(weights[at] @ x)) for label, (at, x) in zip(y, rows, strict=True))
        after, change = improve(y, rows, alpha, weights, scale, shares, seed=1000 * number + block)
        moved = np.nonzero(change)[0]
        for kind, i, v in ((WEIGHT, ids[moved], change[moved]), (MULTIPLIER, names, after),
                           (LOSS, np.array([0]), np.array([loss])), (DUAL, np.array([0]), np.array([alpha.sum()]))):
            for k in range(0, len(i), SENT_ROWS):
                some = i[k:k + SENT_ROWS]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), c, np.int32)) for c in (block, kind)] + [pa.array(some, pa.int64()), pa.array(v[k:k + SENT_ROWS])],
                                                 names=["block", "kind", "id", "value"])

    return solve


def _ordered(kept: np.ndarray, ids: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(ids[kept], kind="stable")
    return ids[kept][order], values[kept][order]


def fit_svm(df: DataFrame, words: str, label: Column, reg: float = 0.1, rounds: int = 100, close: float = 0.005, min_df: int = 1,
            block_documents: int = BLOCK_DOCUMENTS) -> LinearModel:
    """Fit on a word list column; ``label`` is 1 for the positive class.

    The rounds end when the gap is below ``close`` of the loss. All blocks take part in every
    round, and a lost executor repeats a block. No rows, or rows of one class, give weights
    that answer that class.
    """
    counted = materialize(with_term_counts(df.select(words, F.when(label == 1, 1.0).otherwise(-1.0).alias("y")), words, "terms")
                          .withColumn("id", F.monotonically_increasing_id()), "linear-documents")
    count, held = counted.agg(F.count("*"), F.sum(F.size("terms"))).first()
    blocks = max(1, -(-count // block_documents), -(-(held or 0) // BLOCK_ENTRIES))
    entries = counted.select("id", "y", F.inline_outer("terms"))
    n = F.col("n").cast("double")
    spread = F.sqrt(F.greatest((F.sum(n * n) - F.sum(n) * F.sum(n) / F.lit(count)) / F.lit(max(1, count - 1)), F.lit(0.0)))
    stats = entries.where("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("df"), spread.alias("spread")).where((F.col("df") >= min_df) & (F.col("spread") > 0))
    vocabulary = materialize(global_rank(stats, [F.asc("term")], "idx", start=1), "linear-terms")  # 0 is the intercept
    size = vocabulary.count()
    small = fits_broadcast(size, 64 * size)
    known = lookup(entries, vocabulary.select("term", "idx", "spread", "df"), "term", small, weight="df")
    scaled = F.struct(F.col("idx").alias("i"), (n / F.col("spread")).alias("v"))
    vectors = known.groupBy("id").agg(F.first("y").alias("y"), F.sort_array(F.collect_list(F.when(F.col("idx").isNotNull(), scaled))).alias("entries"))
    documents = vectors.select(
        F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), "id", "y",
        F.concat(F.array(F.lit(0)), F.transform("entries", lambda e: e["i"].cast("int"))).alias("at"),
        F.concat(F.array(F.lit(BIAS).cast("float")), F.transform("entries", lambda e: e["v"].cast("float"))).alias("x"))
    documents = materialize(documents.sortWithinPartitions("block").mapInArrow(_packed, PACKED), "linear-vectors")
    needs = documents.select("block", "at").mapInArrow(_terms, "block int, id long").groupBy("id").agg(F.collect_set("block").alias("blocks"))
    needs = materialize(needs.select(F.explode("blocks").alias("block"), "id", (F.size("blocks") / F.lit(blocks)).alias("part")), "linear-needs")
    weights = materialize(documents.sparkSession.createDataFrame([(0, 0.0)], "id long, value double"), "linear-weights")
    multipliers = documents.sparkSession.createDataFrame([(block, MULTIPLIER, -1, 0.0, 1.0) for block in range(blocks)], STATE + ", part double")
    scale, loss, gap, number, old = reg * max(1, count), 0.0, 1.0, 0, None
    while count and number < rounds:
        local = needs.join(weights, "id", "left").select("block", F.lit(WEIGHT).alias("kind"), "id", F.coalesce("value", F.lit(0.0)).alias("value"), "part")
        state = local.unionByName(multipliers).unionByName(documents, allowMissingColumns=True).select("block", "kind", "id", "value", "part", "ids", "y", "lengths", "at", "x")
        found = materialize(state.repartitionById(blocks, F.col("block")).mapInArrow(_solver(scale, float(blocks), number), STATE), "linear-round")
        sums = {r.kind: r.total for r in found.where(F.col("kind").isin(LOSS, DUAL)).groupBy("kind").agg(F.sum("value").alias("total")).collect()}
        length = weights.agg(F.sum(F.col("value") * F.col("value"))).first()[0]
        loss = sums[LOSS] / count + reg / 2 * length
        gap = (loss - (sums[DUAL] / count - reg / 2 * length)) / max(loss, 1e-12)
        if gap <= close:
            break
        change = found.where(F.col("kind") == WEIGHT).groupBy("id").agg(F.sum("value").alias("value"))
        better = materialize(weights.unionByName(change).groupBy("id").agg(F.sum("value").alias("value")), "linear-weights")
        multipliers, number = found.where(F.col("kind") == MULTIPLIER).select("block", "kind", "id", "value", F.lit(1.0).alias("part")), number + 1
        discard(weights, *([old] if old is not None else []))
        weights, old = better, found
    bias = weights.where("id = 0").first()
    table = vocabulary.join(weights.withColumnRenamed("id", "idx"), "idx").select("term", (F.col("value") / F.col("spread")).alias("weight"), "df")
    return LinearModel(materialize(table, "linear-model"), bias.value * BIAS if bias else 0.0, loss, gap, number, small)


def score_svm(model: LinearModel, df: DataFrame, words: str, keep: list[str]) -> DataFrame:
    """``keep`` (with a unique id) plus ``margin`` and ``prediction``; unknown terms count nothing."""
    matched = lookup(term_rows(df, words, keep, empty=True), model.weights, "term", model.small, weight="df")
    sums = matched.groupBy(*keep).agg((F.coalesce(F.sum(F.col("n") * F.col("weight")), F.lit(0.0)) + F.lit(model.intercept)).alias("margin"))
    return sums.withColumn("prediction", F.when(F.col("margin") > 0, 1.0).otherwise(0.0))

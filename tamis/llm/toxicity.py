"""A toxicity classifier with counterfactual regularisation.

Logistic regression over words and word beginnings that tell the labels apart. Labelled
sentences with an identity term are paired with a copy in which another term of its group
stands instead; a documented share of the sentences without one is paired by mentioning a term of a
group, as a mention must not matter either. Any difference between the two scores of a pair is penalised.
"""

from __future__ import annotations

import re
import warnings
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import utf8
from tamis.session import materialize

MAX_TRAINING_ROWS = 40_000  # bound of the labelled sample
MAX_FEATURES = 4000
LEAST_DOCUMENTS = 5
LEAST_Z = 3.0
PREFIXES = (4, 5, 6)
MAX_PAIRS = 40_000  # bound of the sentence pairs; which ones stay is decided by a hash
MENTION_SHARE = 0.05  # of the sentences without a term, paired by mentioning one
PENALTY = 5.0  # weight of the squared score difference of a pair
RIDGE = 1e-5
MAX_STEPS = 1000
SLOPE = 1e-6  # the fit ends when no part of the gradient is larger
FOLDS = 5

# Words for groups of people; those of one line replace each other.
IDENTITY_GROUPS = [
    "women men girls boys", "muslims christians jews hindus buddhists atheists", "muslim christian jewish hindu buddhist atheist",
    "gay lesbian straight bisexual transgender", "black white asian latino arab", "immigrants refugees locals citizens",
    "disabled deaf blind autistic", "frauen männer mädchen jungen", "muslime christen juden", "femmes hommes filles garçons",
    "musulmans chrétiens juifs", "mujeres hombres chicas chicos", "musulmanes cristianos judíos",
]
_GROUP = {term: group.split() for group in IDENTITY_GROUPS for term in group.split()}
_WORD = re.compile(r"[^\W_]+")
_STOP = re.compile(r"[.!?]+\s+|\n+")


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def features_of(words: set[str]) -> set[str]:
    """The words, and the beginnings of the longer ones marked with a star."""
    out = set(words)
    for n in PREFIXES:
        out.update([w[:n] + "*" for w in words if len(w) > n])
    return out


def swapped(words: set[str]) -> list[set[str]]:
    """One variant for each identity term of a sentence, with the next term of its group instead."""
    out = []
    for term in sorted(words & _GROUP.keys()):
        group = _GROUP[term]
        out.append(words - {term} | {group[(group.index(term) + 1) % len(group)]})
    return out


def sentences_of(text: str | None) -> list[str]:
    return [s for s in _STOP.split(text or "") if _WORD.search(s)]


def pairs_of(text: str | None) -> Iterator[tuple[int, set[str], set[str]]]:
    """``(order, words, other words)`` of the pairs of a text's sentences; ``order`` is a hash that decides which pairs stay.

    Sentences with identity terms come first. Of the others the hash takes MENTION_SHARE, and
    pairs the sentence with a mention of a term, and that mention with one of the group's next term.
    """
    for sentence in sentences_of(text):
        words, draw = words_of(sentence), zlib.crc32(sentence.lower().encode())
        if words & _GROUP.keys():
            for other in swapped(words):
                yield draw, words, other
        elif draw % 10_000 < MENTION_SHARE * 10_000:
            group = IDENTITY_GROUPS[draw // 10_000 % len(IDENTITY_GROUPS)].split()
            k = draw // 1_000_000 % len(group)
            one, two = words | {group[k]}, words | {group[(k + 1) % len(group)]}
            yield draw + (1 << 32), words, one
            yield draw + (1 << 32), one, two


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    n_pairs: int = 0  # sentence pairs the fit has seen

    def score(self, text: str | None) -> float:
        get, words = self.weights.get, words_of(text)
        total = self.bias + sum(get(w, 0.0) for w in words)
        for n in PREFIXES:
            total += sum(get(p, 0.0) for p in {w[:n] + "*" for w in words if len(w) > n})
        return float(1 / (1 + np.exp(-np.clip(total, -500, 500))))


def in_training(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS != 0


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``toxic, text`` of at most MAX_TRAINING_ROWS labelled ids; copies count as often as they are labelled."""
    known = labels.where(F.col("toxic").isNotNull() & in_training(F.col("doc_id"))).groupBy("doc_id").agg(
        F.max(F.col("toxic").cast("int")).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAINING_ROWS)
    known = F.broadcast(materialize(known, "labelled"))
    return materialize(docs.select("doc_id", F.col("text").cast("string").alias("text")).join(known, "doc_id").select("toxic", "text"), "training")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model from the labelled training rows; without any, or with one class only, it knows the class rate alone.

    The sample has at most MAX_TRAINING_ROWS ids and MAX_PAIRS pairs, the model MAX_FEATURES weights and
    the identity terms, so what reaches the driver (feature numbers of the sample) is bounded.
    An id that ``labels`` names twice is toxic if one of them says so, an id that ``docs`` holds twice counts twice.
    """
    rows = _sample(docs, labels)
    sizes = dict(rows.groupBy("toxic").count().collect())
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return Model({}, float(np.log((bad + 0.5) / (good + 0.5))))

    def count(batches):
        totals: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                totals[toxic].update(features_of(words_of(text)))
        for toxic, counter in totals.items():
            names, numbers = list(counter), list(counter.values())
            for k in range(0, len(names), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(names[k:k + 50_000], pa.string()), pa.array([toxic] * len(names[k:k + 50_000]), pa.int32()),
                                                  pa.array(numbers[k:k + 50_000], pa.int64())], names=["feature", "toxic", "n"])

    p = (F.col("bad") + 0.5) / (bad + 1)
    q = (F.col("good") + 0.5) / (good + 1)
    odds = F.log(p / (1 - p)) - F.log(q / (1 - q))
    error = F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (bad - F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5) + 1 / (good - F.col("good") + 0.5))
    telling = rows.mapInArrow(count, "feature string, toxic int, n long").groupBy("feature").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"),
        F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("good")).where(
        F.col("bad") + F.col("good") >= LEAST_DOCUMENTS).withColumn("z", F.abs(odds / error)).where(F.col("z") >= LEAST_Z)
    chosen = [r["feature"] for r in telling.orderBy(F.desc("z"), "feature").limit(MAX_FEATURES).collect()]
    chosen += sorted(_GROUP.keys() - set(chosen))
    number = {f: i for i, f in enumerate(chosen)}

    def ids(words):
        return np.array(sorted(number[f] for f in features_of(words) if f in number), np.int32).tobytes()

    def encode(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([ids(words_of(t)) for t in batch.column(1).to_pylist()], pa.binary())],
                                             names=["toxic", "ids"])

    def pair(batches):
        for batch in batches:
            out = [[], [], []]
            for order, one, two in (x for t in batch.column(0).to_pylist() for x in pairs_of(t)):
                for column, x in zip(out, (order, ids(one), ids(two)), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], names=["order", "one", "two"])

    sample = rows.mapInArrow(encode, "toxic int, ids binary").collect()
    pairs = rows.select("text").mapInArrow(pair, "order long, one binary, two binary").orderBy("order", "one", "two").limit(MAX_PAIRS).collect()
    numbers = lambda x: np.frombuffer(x, np.int32)
    weights, bias = train([numbers(r["ids"]) for r in sample], np.array([r["toxic"] for r in sample], np.float64),
                          [(numbers(r["one"]), numbers(r["two"])) for r in pairs], len(chosen))
    return Model({f: float(w) for f, w in zip(chosen, weights, strict=True) if w}, bias, len(pairs))


class _Rows:
    """Rows of feature numbers, packed."""

    def __init__(self, rows: list[np.ndarray], size: int):
        self.n, self.size = len(rows), size
        self.owner = np.repeat(np.arange(self.n), [len(x) for x in rows])
        self.column = np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.bincount(self.owner, x[self.column], self.n) + x[-1], -500, 500)))

    def back(self, slope: np.ndarray) -> np.ndarray:
        grad = np.bincount(self.column, slope[self.owner], self.size + 1)
        grad[-1] = slope.sum()
        return grad


def train(rows: list[np.ndarray], labels: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], size: int) -> tuple[np.ndarray, float]:
    """Weights and bias with the least sum of mean log loss, ridge and PENALTY times the mean squared score change of pairs.

    Quasi-Newton steps (L-BFGS) until no slope is above SLOPE; a warning tells if MAX_STEPS did not do.
    """
    data, ones, twos = _Rows(rows, size), _Rows([a for a, _ in pairs], size), _Rows([b for _, b in pairs], size)

    def cost(x: np.ndarray) -> tuple[float, np.ndarray]:
        p, ridge = data.scores(x), x.copy()
        ridge[-1] = 0
        loss = -np.mean(np.log(np.where(labels > 0, p, 1 - p) + 1e-300)) + RIDGE * ridge @ ridge
        grad = data.back((p - labels) / data.n) + 2 * RIDGE * ridge
        if pairs:
            one, two = ones.scores(x), twos.scores(x)
            slope = 2 * PENALTY * (one - two) / len(pairs)
            loss += PENALTY * np.mean((one - two) ** 2)
            grad += ones.back(slope * one * (1 - one)) - twos.back(slope * two * (1 - two))
        return loss, grad

    x = np.zeros(size + 1)
    x[-1] = np.log((labels.sum() + 0.5) / (len(labels) - labels.sum() + 0.5))
    loss, grad = cost(x)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(MAX_STEPS):
        if np.abs(grad).max() <= SLOPE:
            break
        way, used = grad.copy(), []
        for s, y in reversed(moves):
            used.append(s @ way / (s @ y))
            way -= used[-1] * y
        if moves:
            s, y = moves[-1]
            way *= s @ y / (y @ y)
        for (s, y), a in zip(moves, reversed(used), strict=True):
            way += (a - y @ way / (s @ y)) * s
        length = 1.0
        while length > 1e-12:
            at = x - length * way
            new, slope = cost(at)
            if new <= loss - 1e-4 * length * (grad @ way):
                break
            length /= 2
        else:
            if not moves:
                break
            moves = []  # the curvature no longer fits: steepest descent next
            continue
        s, y = at - x, slope - grad
        if s @ y > 1e-12 * (y @ y):
            moves = [*moves[-9:], (s, y)]
        x, loss, grad = at, new, slope
    if np.abs(grad).max() > SLOPE:
        warnings.warn(f"toxicity fit ended with a slope of {np.abs(grad).max():.1e}, above {SLOPE:.0e}", stacklevel=2)
    return x[:-1], float(x[-1])


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row; only whole texts are scored.

    NULL and empty texts get the score of a text without features, rows given twice get the
    same score, a document without an id counts as held out, unlabelled ids are scored alike.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))  # MAX_FEATURES weights and the identity terms

    def run(batches):
        for batch in batches:
            score = model.value.score
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([score((t or b"").decode()) for t in batch.column(1).to_pylist()], pa.float64())],
                                             names=["doc_id", "score"])

    rows = docs.select("doc_id", utf8("text").alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return rows.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

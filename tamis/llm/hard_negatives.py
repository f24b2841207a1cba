"""Hard negatives by a tree of split points with distance ranges (GNAT), exact at its leaves.

A component is added to every vector so that all have one length; inner products with an
anchor, whose added component is zero, then fall as distances grow, and a window of scores is
an annulus around the anchor. A node deals its vectors to their nearest split point and keeps,
for every split point and every child, the least and the largest distance between them. A child
is left out if for some split point that range misses what the triangle inequality allows for
the annulus. Leaves compare whole numbers.

The top node's children, cut into shards of bounded size, lie in different tasks; each task
builds the lower nodes of its shards and answers the anchors that the top node sends there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tamis.llm.vectors import lists, matrix, scaled, usable, width_of
from tamis.session import discard, materialize

SCALE, POSITIVES, NEGATIVES = 256, 5, 5
LEAST_PERCENT, MOST_PERCENT = 80, 100
CELLS = 256  # children of the top node, at most
SHARD_ROWS = 4096, 65_536  # of a shard, at least and at most; between them 64 shards
SAMPLE_ROWS = 1024  # rows that choose the top node's split points and give first bounds
FAN, LEAF = 16, 256  # children of a lower node; vectors of a leaf
BLOCK = 2_000_000  # inner products held at once
LOWEST, HIGHEST = -(1 << 53), 1 << 53  # open ends of a window
STREAM = "shard long, kind int, id long, vec_id long, label long, whole array<int>, lo array<bigint>, hi array<bigint>"


def lengthened(vectors: np.ndarray, longest: float) -> np.ndarray:
    """The vectors with the component that makes their squared length ``longest``."""
    rest = np.sqrt(np.maximum(0, longest - (vectors * vectors).sum(1)))
    return np.concatenate([vectors, rest[:, None]], axis=1)


def apart(vectors: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Distances between two sets of vectors."""
    squares = (vectors * vectors).sum(1)[:, None] + (points * points).sum(1) - 2 * (vectors @ points.T)
    return np.sqrt(np.maximum(0, squares))


def split_points(vectors: np.ndarray, count: int) -> np.ndarray:
    """Places of up to ``count`` vectors, each the farthest from those before it, without equal ones."""
    chosen, near = [0], apart(vectors, vectors[:1])[:, 0]
    while len(chosen) < count and near.max() > 1e-4 * max(1.0, float(np.abs(vectors).max())):
        chosen.append(int(near.argmax()))
        near = np.minimum(near, apart(vectors, vectors[chosen[-1:]])[:, 0])
    return np.array(chosen)


class Requests:
    """Anchors with windows of scores and the best answers so far, which raise the windows' lower ends."""

    def __init__(self, anchors: np.ndarray, own: np.ndarray, labels: np.ndarray, lo: np.ndarray, hi: np.ndarray,
                 same: bool, count: int, longest: float) -> None:
        self.anchors, self.own, self.labels, self.lo, self.hi = anchors, own, labels, lo.copy(), hi
        self.same, self.count, self.longest = same, count, longest
        self.margin = 1e-5 * np.sqrt(longest) + 1e-9  # beyond what floating point can err in a distance
        self.squares = (anchors * anchors).sum(1)
        self.scores = np.full((*lo.shape, count), LOWEST, np.int64)
        self.found = np.full((*lo.shape, count), HIGHEST, np.int64)

    def to_points(self, some: np.ndarray, points: np.ndarray) -> np.ndarray:
        return apart(np.concatenate([self.anchors[some], np.zeros((len(some), 1))], axis=1), points)

    def annulus(self, some: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest distance of vectors whose score is in the window."""
        base = self.squares[some] + self.longest
        return tuple(np.sqrt(np.maximum(0, base - 2.0 * end[some, window])) for end in (self.hi, self.lo))

    def reaches(self, some: np.ndarray, distances: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether each request can have an answer below a child whose ranges to the split points are low and high."""
        out = np.zeros(len(some), bool)
        for window in range(self.lo.shape[1]):
            inner, outer = self.annulus(some, window)
            least = np.maximum(distances - outer[:, None], inner[:, None] - distances)
            meets = (low - self.margin <= distances + outer[:, None]) & (high + self.margin >= least)
            out |= meets.all(1) & (self.lo[some, window] <= self.hi[some, window])
        return out

    def take(self, some: np.ndarray, vectors: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        """Compare requests with whole vectors and keep the best answers of every window."""
        step = max(1, BLOCK // max(1, len(ids)))
        for at in range(0, len(some), step):
            self._take(some[at:at + step], vectors, ids, labels)

    def _take(self, some: np.ndarray, vectors: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        scores = self.anchors[some] @ vectors.T
        fits = (self.labels[some][:, None] == labels) == self.same
        if self.same:
            fits &= self.own[some][:, None] != ids
        for window in range(self.lo.shape[1]):
            at, place = np.nonzero(fits & (scores >= self.lo[some, window][:, None]) & (scores <= self.hi[some, window][:, None]))
            if not len(at):
                continue
            who, slot = np.unique(at, return_inverse=True)
            rows = some[who]
            slot = np.concatenate([slot, np.repeat(np.arange(len(rows)), self.count)])
            score = np.concatenate([scores[at, place].astype(np.int64), self.scores[rows, window].ravel()])
            name = np.concatenate([ids[place], self.found[rows, window].ravel()])
            order = np.lexsort((name, -score, slot))
            start = np.concatenate([[0], np.cumsum(np.bincount(slot))[:-1]])
            best = order[start[:, None] + np.arange(self.count)]
            self.scores[rows, window], self.found[rows, window] = score[best], name[best]
            self.lo[rows, window] = np.maximum(self.lo[rows, window], self.scores[rows, window, -1])


class Tree:
    """The nodes below one shard."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, labels: np.ndarray, longest: float) -> None:
        self.vectors, self.ids, self.labels, self.long = vectors, ids, labels, lengthened(vectors, longest)
        self.root = self._node(np.arange(len(ids)))

    def _node(self, rows: np.ndarray) -> tuple:
        if len(rows) <= LEAF:
            return (rows,)
        points = self.long[rows[split_points(self.long[rows], FAN)]]
        distances = apart(self.long[rows], points)
        home = distances.argmin(1)
        if (home == home[0]).all():  # equal vectors
            return (rows,)
        children, low, high = [], [], []
        for k in range(len(points)):
            mine = home == k
            if mine.any():
                children.append(self._node(rows[mine]))
                low.append(distances[mine].min(0))
                high.append(distances[mine].max(0))
        return points, low, high, children

    def answer(self, requests: Requests, some: np.ndarray, node: tuple | None = None) -> None:
        """Fill in the answers of ``some`` requests: each its nearest child first, then the children it still reaches."""
        node = node or self.root
        if len(node) == 1:
            requests.take(some, self.vectors[node[0]], self.ids[node[0]], self.labels[node[0]])
            return
        points, low, high, children = node
        distances = requests.to_points(some, points)
        home = np.stack([np.maximum(distances - h, lo - distances).max(1) for lo, h in zip(low, high, strict=True)], axis=1).argmin(1)
        for first in (True, False):
            for k, child in enumerate(children):
                at = np.nonzero((home == k) == first)[0]
                at = at[requests.reaches(some[at], distances[at], low[k], high[k])]
                if len(at):
                    self.answer(requests, some[at], child)


class Index:
    """The top node: shards of rows in a written table, and what the driver knows of them (all of bounded size)."""

    def __init__(self, rows: DataFrame, longest: float, width: int, points: np.ndarray, low: np.ndarray, high: np.ndarray,
                 shards: list[range], sample: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        self.rows, self.longest, self.width, self.points = rows, longest, width, points
        self.low, self.high, self.shards, self.sample = low, high, shards, sample


def indexed(vectors: DataFrame, scale: int = SCALE) -> Index:
    """Deal all usable rows to shards; see :func:`mined` for which rows take part."""
    rows = materialize(vectors.where(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(
        F.col("vec_id").cast("long"), F.col("label").cast("long"), scaled(F.col("embedding"), scale).alias("whole")), "vectors")
    width = width_of(rows, "whole")
    square = F.aggregate("whole", F.lit(0).cast("long"), lambda total, x: total + x.cast("long") * x)
    count, longest = rows.agg(F.count("*"), F.coalesce(F.max(square), F.lit(0))).first()
    if longest >= HIGHEST:
        raise ValueError("the vectors are too long for exact inner products")
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).toPandas()
    sample = np.zeros((len(some), width))
    for k, vector in enumerate(some["whole"]):
        sample[k, :len(vector)] = vector
    shard_rows = min(SHARD_ROWS[1], max(SHARD_ROWS[0], count // 64))
    long = lengthened(sample, longest)
    points = long[split_points(long, min(CELLS, -(-count // shard_rows)))] if len(some) else long
    broad = rows.sparkSession.sparkContext.broadcast(points)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = TaskContext.get().partitionId() << 33
        for batch in batches:
            if batch.num_rows:
                cell = apart(lengthened(matrix(batch.column(2), width), longest), broad.value).argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(own + np.arange(batch.num_rows))],
                                                 ["vec_id", "label", "whole", "cell", "id"])
                own += batch.num_rows

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(broad.value)
        low, high, n = np.full((k, k), np.inf), np.full((k, k), -np.inf), np.zeros(k, np.int64)
        for batch in batches:
            if batch.num_rows:
                cell = batch.column(1).to_numpy()
                distances = apart(lengthened(matrix(batch.column(0), width), longest), broad.value)
                np.minimum.at(low, cell, distances)
                np.maximum.at(high, cell, distances)
                n += np.bincount(cell, minlength=k)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k), k)), pa.array(np.tile(np.arange(k), k)), pa.array(low.ravel()),
                                          pa.array(high.ravel()), pa.array(np.repeat(n, k))], ["cell", "point", "low", "high", "n"])

    placed = materialize(rows.mapInArrow(dealt, "vec_id long, label long, whole array<int>, cell long, id long"), "placed")
    discard(rows)
    low, high, shards = np.zeros((len(points), len(points))), np.zeros((len(points), len(points))), []
    held = np.zeros(len(points), np.int64)
    for row in placed.select("whole", "cell").mapInArrow(ranges, "cell long, point long, low double, high double, n long").groupBy("cell", "point").agg(
            F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).collect():  # CELLS^2 rows at most
        low[row["cell"], row["point"]], high[row["cell"], row["point"]], held[row["cell"]] = row["low"], row["high"], row["n"]
    first = 0
    for n in held.tolist():  # a cell of many rows, equal vectors perhaps, is dealt to several shards
        shards.append(range(first, first := first + -(-n // shard_rows)))
    return Index(placed, float(longest), width, points, low, high, shards,
                 (sample, some["vec_id"].to_numpy(np.int64), some["label"].to_numpy(np.int64)))


def search(index: Index, requests: DataFrame, same: bool, count: int) -> DataFrame:
    """``id, slot, score, found``: the best ``count`` rows for each window of each request.

    ``requests(id, vec_id, label, whole, lo, hi)`` ask for rows of the same label except those
    of their own vec_id, or of other labels, with an inner product in ``[lo[slot], hi[slot]]``;
    higher ones first, equal ones by smaller vec_id. Every window is answered from all rows.
    """
    spark, width, longest = requests.sparkSession, index.width, index.longest
    top = spark.sparkContext.broadcast((index.points, index.low, index.high, index.sample))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def asked(columns: list[pa.Array]) -> Requests:
        vec_id, label, whole, lo, hi = columns
        windows = len(lo.flatten()) // max(1, len(lo))
        return Requests(matrix(whole, width), vec_id.to_numpy(), label.to_numpy(),
                        matrix(lo, windows, np.int64), matrix(hi, windows, np.int64), same, count, longest)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, low, high, sample = top.value
        for batch in batches:
            if not batch.num_rows or not len(points):
                continue
            wanted = asked(batch.columns[1:])
            everyone = np.arange(batch.num_rows)
            wanted.take(everyone, *sample)  # lower ends that the sample's rows already reach
            distances = wanted.to_points(everyone, points)
            lo = lists(wanted.lo, pa.int64())
            for cell, shards in enumerate(index_shards):
                at = np.nonzero(wanted.reaches(everyone, distances, low[cell], high[cell]))[0]
                if len(at):
                    some = pa.RecordBatch.from_arrays([*batch.columns[:4], lo, batch.column(5)], batch.schema.names).take(pa.array(at))
                    for shard in shards:
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), shard)), pa.array(np.ones(len(at), np.int32)), *some.columns],
                                                         ["shard", "kind", *batch.schema.names])

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tree, parts = None, None, []
        for batch in batches:
            number, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.nonzero(np.diff(number * 2 + kind))[0] + 1
            for start, end in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                if start == end:
                    continue
                if number[start] != shard:
                    shard, tree, parts = number[start], None, []
                piece = batch.slice(start, end - start)
                if kind[start] == 0:
                    parts.append((matrix(piece.column(5), width), piece.column(3).to_numpy(), piece.column(4).to_numpy()))
                    continue
                if tree is None and not parts:  # a shard that no row was dealt to
                    continue
                if tree is None:
                    tree = Tree(*(np.concatenate(p) for p in zip(*parts, strict=True)), longest)
                wanted = asked(piece.columns[3:])
                tree.answer(wanted, np.arange(piece.num_rows))
                who, slot, _ = at = np.nonzero(wanted.scores > LOWEST)
                yield pa.RecordBatch.from_arrays([piece.column(2).take(pa.array(who)), pa.array(slot.astype(np.int32)), pa.array(wanted.scores[at]),
                                                  pa.array(wanted.found[at])], ["id", "slot", "score", "found"])

    index_shards = [list(s) for s in index.shards]
    spans = F.array(*[F.struct(F.lit(s.start).alias("first"), F.lit(max(1, len(s))).alias("n")) for s in index.shards] or [
        F.struct(F.lit(0).alias("first"), F.lit(1).alias("n"))])
    span = F.element_at(spans, (F.col("cell") + 1).cast("int"))
    no_window = F.lit(None).cast("array<bigint>")
    held = index.rows.select((span["first"] + F.pmod("id", span["n"])).cast("long").alias("shard"), F.lit(0).alias("kind"), "id", "vec_id", "label", "whole",
                             no_window.alias("lo"), no_window.alias("hi"))
    sent = requests.select("id", "vec_id", "label", "whole", "lo", "hi").mapInArrow(routed, STREAM)
    stream = held.unionByName(sent).repartitionById(tasks, F.pmod("shard", F.lit(tasks)).cast("int")).sortWithinPartitions("shard", "kind")
    best = stream.mapInArrow(answered, "id long, slot int, score long, found long")
    order = Window.partitionBy("id", "slot").orderBy(F.desc("score"), "found")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def mined(vectors: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
          least: int = LEAST_PERCENT, most: int = MOST_PERCENT, scale: int = SCALE) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchors`` is a condition on ``vec_id`` and ``label``. Scores are inner products of the
    vectors' ``floor(scale * x)``; higher ones come first, equal ones by smaller vec_id. The
    positives of an anchor are its first rows of the same label without those that carry its own
    vec_id; the negatives of a positive are the first rows of other labels with a score of
    ``least`` to ``most`` percent of the positive's. A row without vec_id or label, or with a
    NULL, NaN or infinite component or no vector takes no part. Components that a shorter vector
    lacks count as zero. A row given twice counts twice, as an anchor too. An anchor without
    positives, or a positive without negatives (always when its score is negative), gives no
    row; no rows give no rows. Other columns are not read.
    """
    index = indexed(vectors, scale)
    asked = materialize(index.rows.where(anchors).select("id", "vec_id", "label", "whole"), "anchors")
    open_window = asked.select("*", F.array(F.lit(LOWEST)).alias("lo"), F.array(F.lit(HIGHEST)).alias("hi"))
    near = materialize(search(index, open_window, True, positives).select(
        "id", (F.col("rank") - 1).cast("int").alias("slot"), F.col("score").alias("positive_score"), F.col("found").alias("positive_id")), "positives")
    lo = F.expr(f"-((-{least} * positive_score - pmod(-{least} * positive_score, 100L)) div 100L)")  # rounded up
    hi = F.expr(f"({most} * positive_score - pmod({most} * positive_score, 100L)) div 100L")
    ends = near.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("slot", lo.alias("lo"), hi.alias("hi")))).alias("ends"))

    def padded(end: str, empty: int) -> Column:
        """Ends of all windows; those of positives that an anchor lacks hold nothing."""
        return F.transform(F.sequence(F.lit(1), F.lit(positives)), lambda k: F.coalesce(F.try_element_at("ends", k)[end], F.lit(empty).cast("long")))

    windows = asked.join(ends, "id").select("id", "vec_id", "label", "whole", padded("lo", 1).alias("lo"), padded("hi", 0).alias("hi"))
    far = search(index, windows, False, negatives)
    return far.join(near, ["id", "slot"]).join(asked.select("id", F.col("vec_id").alias("anchor_id")), "id").select(
        "anchor_id", "positive_id", "rank", F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


SQL = """
WITH kept AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
    FROM kept AS a JOIN kept AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM scores WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT * FROM (
    SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank,
        id AS negative_id, positive_score, score AS negative_score
    FROM positives JOIN scores USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
WHERE rank <= 5"""

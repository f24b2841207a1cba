"""Vectors compressed to codes: one codebook for each part of a vector, fitted by active-entry Lloyd rounds.

Between two rounds a row keeps, for each of its parts, the entry it is assigned to and the
exact squared distance. A part whose entry did not move in the last update compares only the
entries that did; all other entries are as far as before. A part whose entry moved looks at
the whole codebook again. Ties go to the lower index both ways, so every round ends with the
same assignment as a full scan.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.vectors import lists, matrix, scaled, usable, width_of
from tamis.operators.joins import fits_broadcast, lookup
from tamis.session import discard, materialize

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
BLOCK = 4096  # vectors compared with a codebook at once
STATE = "vec_id long, label {label}, whole array<int>, code array<int>, distance array<bigint>"


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of the nearest entry, the lowest among equals, and the squared distance.

    All values are whole numbers of at most 2^22 in size, so floating point is exact here.
    """
    index, distance = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
    squares = (entries * entries).sum(1)
    for at in range(0, len(parts), BLOCK):
        some = parts[at:at + BLOCK]
        apart = squares - 2 * (some @ entries.T)
        best = apart.argmin(1)
        index[at:at + BLOCK] = best
        distance[at:at + BLOCK] = apart[np.arange(len(some)), best] + (some * some).sum(1)
    return index, distance


def reassign(parts: np.ndarray, entries: np.ndarray, moved: np.ndarray, code: np.ndarray,
             distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The assignment after an update that changed the ``moved`` entries only."""
    code, distance = code.copy(), distance.copy()
    lost = moved[code]
    if lost.any():
        code[lost], distance[lost] = nearest(parts[lost], entries)
    active, stays = np.nonzero(moved)[0], np.nonzero(~lost)[0]
    if len(active) and len(stays):
        index, apart = nearest(parts[stays], entries[active])
        index = active[index]
        better = (apart < distance[stays]) | ((apart == distance[stays]) & (index < code[stays]))
        code[stays[better]], distance[stays[better]] = index[better], apart[better]
    return code, distance


def updated(books: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Every used entry becomes the floor of its mean, unused ones stay."""
    means = sums // np.maximum(counts, 1)[:, :, None]
    return np.where(counts[:, :, None] > 0, means, books)


def _assigned(state: DataFrame, shape: str, books: np.ndarray, before: np.ndarray | None) -> DataFrame:
    """The rows with the codes and distances for ``books``; without a codebook ``before``, by full scans."""
    parts, _, width = books.shape
    moved = None if before is None else (books != before).any(2)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = matrix(batch.column(2), parts * width).reshape(batch.num_rows, parts, width)
            code, distance = np.empty((2, len(own), parts), np.int64)
            if moved is not None:
                old, far = matrix(batch.column(3), parts, np.int64), matrix(batch.column(4), parts, np.int64)
            for p in range(parts):
                entries = books[p].astype(np.float64)
                code[:, p], distance[:, p] = nearest(own[:, p], entries) if moved is None else reassign(
                    own[:, p], entries, moved[p], old[:, p], far[:, p])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists(code, pa.int32()), lists(distance, pa.int64())],
                                             ["vec_id", "label", "whole", "code", "distance"])

    return state.mapInArrow(step, shape)


def _totals(state: DataFrame, parts: int, entries: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums and numbers of the parts assigned to each entry: one set of partial sums a task, then a grouped sum."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            if batch.num_rows:
                own = matrix(batch.column(0), parts * width, np.int64).reshape(batch.num_rows, parts, width)
                code = matrix(batch.column(1), parts, np.int64)
                for p in range(parts):
                    np.add.at(sums[p, :, :width], code[:, p], own[:, p])
                    sums[p, :, width] += np.bincount(code[:, p], minlength=entries)
        slot = np.nonzero(np.repeat(sums[:, :, width].ravel() > 0, width + 1))[0]
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(sums.ravel()[slot])], ["slot", "total"])

    found = state.select("whole", "code").mapInArrow(partial, "slot long, total long").groupBy("slot").agg(F.sum("total").alias("total"))
    table = found.toPandas()  # parts * entries * (width + 1) rows at most
    sums = np.zeros(parts * entries * (width + 1), np.int64)
    sums[table["slot"].to_numpy(np.int64)] = table["total"].to_numpy(np.int64)
    sums = sums.reshape(parts, entries, width + 1)
    return sums[:, :, :width], sums[:, :, width]


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
        scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """Rows ``vec_id, label, whole, code, distance`` and the codebooks ``[part, entry, position]``.

    Rows whose vector is NULL or holds a NULL or non-finite component are left out. A shorter
    vector counts as filled up with zeros to the longest, and that to a multiple of ``parts``.
    The codebooks start from the rows of smallest vec_id (NULL ids come last, repeated ids are
    ordered by their vectors); with fewer rows they have fewer entries. Repeated rows count as
    often as they occur. No usable rows give an empty table and empty codebooks. Only
    ``vec_id``, ``label`` and ``embedding`` are read.
    """
    kind = vectors.schema["label"].dataType.simpleString()
    shape = STATE.format(label=kind)
    rows = materialize(vectors.where(usable(F.col("embedding"))).select(
        F.col("vec_id").cast("long"), "label", scaled(F.col("embedding"), scale).alias("whole"),
        F.lit(None).cast("array<int>").alias("code"), F.lit(None).cast("array<bigint>").alias("distance")), "vectors")
    width = -(-width_of(rows, "whole") // parts)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "whole").limit(entries).select("whole").collect()
    start = np.zeros((len(first), parts * width), np.int64)
    for k, row in enumerate(first):
        start[k, :len(row.whole)] = row.whole
    books, before = start.reshape(len(first), parts, width).transpose(1, 0, 2).copy(), None
    for _ in range(rounds if first else 0):
        found = materialize(_assigned(rows, shape, books, before), "assigned")
        discard(rows)
        rows, before = found, books
        books = updated(books, *_totals(rows, *books.shape))
    last = materialize(_assigned(rows, shape, books, before), "assigned") if first else rows
    if first:
        discard(rows)
    return last, books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` for every usable row; see :func:`fit`.

    ``label_error`` sums the errors of all rows with an equal label, NULL labels together.
    A code has two hex digits for each part, more beyond 256 entries.
    """
    rows, books = fit(vectors, parts, entries, rounds, scale)
    digits = max(2, len(f"{entries - 1:x}"))
    hexed = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), digits, "0"))), "")
    group = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    coded = rows.select("vec_id", group.alias("group"), hexed.alias("code"),
                        F.aggregate("distance", F.lit(0).cast("long"), lambda total, d: total + d).alias("error"))
    labels = materialize(coded.groupBy("group").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "label-errors")
    return lookup(coded, labels, "group", fits_broadcast(n := labels.count(), 64 * n), weight="n").select(
        "vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same as plain Lloyd rounds with full scans, for vectors of one length that the parts divide."""
    steps = [f"""
kept AS MATERIALIZED (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS row, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS MATERIALIZED (SELECT row, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS x FROM kept, unnest(range({parts})) AS t(p)),
book0 AS MATERIALIZED (SELECT p, row - 1 AS e, x AS y FROM part WHERE row <= {entries})"""]
    for k in range(rounds + 1):
        steps.append(f"""
near{k} AS MATERIALIZED (SELECT row, p, x, min({{'d': d, 'e': e}}) AS best FROM (
    SELECT row, p, x, e, list_dot_product(x, x) - 2 * list_dot_product(x, y) + list_dot_product(y, y) AS d FROM part JOIN book{k} USING (p)) GROUP BY row, p, x)""")
        if k < rounds:
            steps.append(f"""
mean{k} AS (SELECT p, e, list(m ORDER BY i) AS y FROM (
    SELECT p, best.e AS e, i, floor(sum(x[i]) / count(*)) AS m FROM near{k}, unnest(range(1, len(x) + 1)) AS t(i) GROUP BY ALL) GROUP BY p, e),
book{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(mean{k}.y, book{k}.y) AS y FROM book{k} LEFT JOIN mean{k} USING (p, e))""")
    return f"""WITH {",".join(steps)},
coded AS (SELECT row, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM near{rounds} GROUP BY row),
books AS (SELECT sha256(string_agg(array_to_string(list_transform(y, lambda c: c::BIGINT::VARCHAR), ','), ',' ORDER BY p, e)) AS digest FROM book{rounds})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, digest AS codebooks_sha256
FROM kept JOIN coded USING (row), books"""

"""Near duplicates by SimHash, linked with the general pigeonhole principle.

Bits that go together share a partition; each fingerprint spreads its allowance of differing
bits unevenly over the partitions, by a dynamic program on the candidates it would meet there;
it probes the index and every candidate is verified. All work is on distinct fingerprints.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.llm.common import own_name, utf8
from tamis.llm.components import connected_components
from tamis.operators.bitmaps import BLOCK_BITS, bit_set, bitmap
from tamis.session import materialize

BITS = 64
HEAD = 16  # bits of a partition that its histogram tells apart: 65 536 counts a partition at most
MARK_BITS = 27  # of the bitmap of ids that are compared again, at most: 16 MB
SPLIT_ROWS = 4096  # index rows of one partition value that share a salt


def fingerprint(text: bytes | None, words: int = 3, seed: int = 42) -> int:
    """Majority bits of the XXH64 of all word shingles of the whole text; no words give 0."""
    parts = (text or b"").lower().split()
    if not parts:
        return 0
    line, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) < words:
        hashes = [digest(line, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = [digest(line[a:b], seed) for a, b in zip(starts.tolist(), ends[words - 1:].tolist(), strict=False)]
    raw = np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8)
    ones = sum(np.unpackbits(raw[i:i + 8192], axis=1).sum(0, dtype=np.int64) for i in range(0, len(raw), 8192))
    return int.from_bytes(np.packbits(ones * 2 > len(raw)).tobytes(), "big", signed=True)


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint", keep: list[str] | None = None) -> DataFrame:
    """All columns, or those of ``keep``, and the fingerprint as a long; NULL and wordless texts get 0."""
    source = own_name(docs, "utf8")
    kept = [c for c in (docs.columns if keep is None else keep) if c != name]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(name, T.LongType())])

    def run(rows):
        for batch in rows:
            prints = pa.array([fingerprint(t) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays(batch.columns[:-1] + [prints], names=[*kept, name])

    return docs.select(*[f"`{c}`" for c in kept], utf8(text).alias(source)).mapInArrow(run, schema)


def _bit_groups(prints: DataFrame, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of even width, correlated bits together."""

    def run(rows):
        both = np.zeros((BITS + 1, BITS), np.int64)
        for batch in rows:
            raw = batch.column(0).to_numpy(zero_copy_only=False).astype(">i8").view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(raw, axis=1)[:, ::-1].astype(np.float64)
            both[:BITS] += (bits.T @ bits).astype(np.int64)
            both[BITS, 0] += len(bits)
        i, j = np.nonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(both[i, j])],
                                         names=["i", "j", "n"])

    both = np.zeros((BITS + 1, BITS))
    for i, j, n in prints.select("fp").mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n")).collect():
        both[i, j] = n  # 65 x 64 counts at most
    total, share = max(both[BITS, 0], 1), both.diagonal() / max(both[BITS, 0], 1)
    spread = np.sqrt(share * (1 - share))
    together = np.abs(both[:BITS] / total - np.outer(share, share)) / np.maximum(np.outer(spread, spread), 1e-12)
    np.fill_diagonal(together, 0)
    free, groups = list(range(BITS)), []
    for k in range(parts):
        width = BITS // parts + (k < BITS % parts)
        group = [max(free, key=lambda b: together[b, free].max())]
        free.remove(group[0])
        while len(group) < width:
            best = max(free, key=lambda b: together[b, group].sum())
            group.append(best)
            free.remove(best)
        groups.append(group)
    return groups


def _value(group: list[int]) -> Column:
    """The bits of a group, packed with its first bit lowest."""
    return reduce(Column.bitwiseOR, [F.shiftleft(F.shiftrightunsigned("fp", b).bitwiseAND(F.lit(1).cast("long")), k)
                                     for k, b in enumerate(group)])


def _allowances(parts: int, distance: int) -> int:
    return distance - parts + 1


def _parts(n: int, distance: int) -> int:
    """The number of partitions with the fewest probes and candidates for ``n`` even fingerprints."""

    def cost(parts: int) -> float:
        width, best = BITS / parts, [0.0] + [float("inf")] * (distance + parts)
        for _ in range(parts):  # best[s]: allowances so far, each counted from -1
            best = [min(best[s - t - 1] + (0 if t < 0 else sum(comb(int(width), k) for k in range(t + 1)) * (1 + n / 2**width))
                        for t in range(-1, distance + 1) if s - t - 1 >= 0) for s in range(len(best))]
        return best[_allowances(parts, distance) + parts]

    return min(range(2, distance + 2), key=cost) if distance else 1


def _estimates(counts: np.ndarray, width: int, distance: int) -> np.ndarray:
    """Candidates for each head of a partition value and each allowance from 0 to ``distance``."""
    head = min(width, HEAD)
    values, shells = np.arange(len(counts)), [counts.astype(np.float64)]
    for k in range(1, distance + 1):
        near = sum(shells[-1][values ^ (1 << b)] for b in range(head))
        shells.append(np.maximum(0, near - (head - k + 2) * (shells[-2] if k > 1 else 0)) / k)
    if width > HEAD:
        return np.stack([counts * sum(comb(width, k) for k in range(t + 1)) / 2.0 ** (width - HEAD) for t in range(distance + 1)])
    return np.cumsum(np.stack(shells), axis=0)


def allocate(costs: np.ndarray, distance: int) -> np.ndarray:
    """Allowances ``[partition, row]`` of least total cost, from ``costs[partition, allowance, row]``.

    They add up to ``distance - partitions + 1``; -1 leaves a partition out. Any two values
    within ``distance`` differ by no more than the allowance in at least one partition.
    """
    parts, _, rows = costs.shape
    room = distance + 1
    best, chosen = np.full((room + 1, rows), np.inf), np.zeros((parts, room + 1, rows), np.int8)
    best[0] = 0
    for i in range(parts):
        new = np.full_like(best, np.inf)
        for s in range(room + 1):
            for t in range(-1, min(distance, s - 1) + 1):
                cost = best[s - t - 1] + (costs[i, t] if t >= 0 else 0)
                better = cost < new[s]
                new[s] = np.where(better, cost, new[s])
                chosen[i, s] = np.where(better, t, chosen[i, s])
        best = new
    left, out, column = np.full(rows, room), np.zeros((parts, rows), np.int8), np.arange(rows)
    for i in reversed(range(parts)):
        out[i] = chosen[i, left, column]
        left = left - out[i] - 1
    return out


def links(prints: DataFrame, distance: int = 3) -> DataFrame:
    """Pairs ``a < b`` of distinct ``prints(fp)`` with at most ``distance`` differing bits, each at least once.

    Index values held by many fingerprints (a histogram of bounded size tells which) are
    dealt over salts and their probes repeated, so no value meets in one task.
    """
    parts = _parts(prints.count(), distance)
    groups = _bit_groups(prints, parts)
    widths = [len(g) for g in groups]
    heads = [2 ** min(w, HEAD) for w in widths]
    tops = prints.select(F.posexplode(F.array(*[F.shiftrightunsigned(_value(g), max(w - HEAD, 0)) for g, w in zip(groups, widths, strict=True)])).alias("part", "head"))
    counts = [np.zeros(h, np.int64) for h in heads]
    for row in tops.groupBy("part", "head").count().collect():  # 65 536 rows a partition at most
        counts[row["part"]][row["head"]] = row["count"]
    broad = prints.sparkSession.sparkContext.broadcast((
        [_estimates(c, w, distance).astype(np.float32) for c, w in zip(counts, widths, strict=True)],
        [(c // SPLIT_ROWS + 1).astype(np.int32) for c in counts]))
    flips = [[np.array([sum(1 << b for b in bits) for k in range(t + 1) for bits in combinations(range(w), k)], np.int64)
              for t in range(distance + 1)] for w in widths]
    fields = pa.schema([("part", pa.int32()), ("value", pa.int64()), ("salt", pa.int32()), ("fp", pa.int64())])

    def packed(prints: np.ndarray) -> list[np.ndarray]:
        return [sum(((prints >> b) & 1) << k for k, b in enumerate(g)) for g in groups]

    def rows_of(part: int, value: np.ndarray, salt: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), part, np.int32)), pa.array(value),
                                           pa.array(salt.astype(np.int32)), pa.array(fp)], schema=fields)

    def head_of(value: np.ndarray, part: int) -> np.ndarray:
        return value >> max(widths[part] - HEAD, 0)

    def entries(rows):
        salts = broad.value[1]
        for batch in rows:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for i, value in enumerate(packed(fp)):
                own = (fp.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                yield rows_of(i, value, own.astype(np.int64) % salts[i][head_of(value, i)], fp)

    def probes(rows):
        estimates, salts = broad.value
        for batch in rows:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            values = packed(fp)
            costs = np.stack([estimates[i][:, head_of(v, i)] + np.array([len(f) for f in flips[i]])[:, None]
                              for i, v in enumerate(values)])
            given = allocate(costs, distance)
            for i, value in enumerate(values):
                for t in range(distance + 1):
                    at = np.nonzero(given[i] == t)[0]
                    step = max(1, 200_000 // len(flips[i][t]))
                    for k in range(0, len(at), step):
                        some = at[k:k + step]
                        seen = (value[some][:, None] ^ flips[i][t]).ravel()
                        again = salts[i][head_of(seen, i)]
                        salt = np.arange(again.sum()) - np.repeat(np.cumsum(again) - again, again)
                        yield rows_of(i, np.repeat(seen, again), salt, np.repeat(np.repeat(fp[some], len(flips[i][t])), again))

    shape = "part int, value long, salt int, fp long"
    found = prints.select("fp").mapInArrow(probes, shape).withColumnRenamed("fp", "a").join(
        prints.select("fp").mapInArrow(entries, shape).withColumnRenamed("fp", "b"), ["part", "value", "salt"])
    return found.where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)).select("a", "b")


def groups_of(rows: DataFrame, distance: int = 3) -> DataFrame:
    """``fingerprint, component_id`` of each distinct fingerprint of ``rows(doc_id, fingerprint)``.

    The component is the smallest doc_id reachable (NULL if no document of it has an id).
    """
    prints = materialize(rows.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("first_id")), "prints")
    found = materialize(links(prints.select("fp"), distance), "links")
    member = connected_components(found).withColumnRenamed("node", "fp")
    labelled = prints.join(member, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lowest = labelled.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return materialize(labelled.join(lowest, "component").select(F.col("fp").alias("fingerprint"), "component_id"), "groups")


def near_duplicates(docs: DataFrame, distance: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    NULL and wordless texts share the fingerprint zero, which is linked like any other.
    Repeated rows stay repeated, other columns are not read, no rows give no rows.
    """
    rows = materialize(with_fingerprint(docs, keep=["doc_id"]), "fingerprints")
    return rows.join(groups_of(rows, distance), "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def without_near_duplicates(docs: DataFrame, distance: int = 3) -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of each group; a row given twice stays once.

    A group whose documents have no doc_id keeps one of them for each fingerprint.

    Who stays is found on narrow rows. A bitmap of bounded size marks the ids of rows that go
    and ids that occur twice; rows of unmarked ids stay where they are. Only marked rows, and
    the few that share a bit with one, are compared again and cross an exchange with their texts.
    """
    mark, lead, block = own_name(docs, "fingerprint"), own_name(docs, "lead"), own_name(docs, "block")
    rows = materialize(with_fingerprint(docs, keep=["doc_id"]), "fingerprints")
    grouped = rows.join(groups_of(rows, distance), "fingerprint")
    stay = grouped.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component_id").agg(F.min("fingerprint").alias("fingerprint"))
    ids = grouped.groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_and(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("leads"))
    ids = materialize(ids, "ids")
    bits = min(MARK_BITS, max(15, (16 * ids.count()).bit_length()))

    def cell(doc_id: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(doc_id), 64 - bits)

    marked = ids.where("n > 1 OR NOT leads OR doc_id IS NULL").select(cell(F.col("doc_id")).alias("cell"))
    marks = materialize(bitmap(marked, "cell"), "marks")  # 2^MARK_BITS bits at most
    marks = marks.select(F.col("block").alias(block), F.col("bits").alias(mark))
    flagged = docs.join(F.broadcast(marks), F.floor(cell(docs["doc_id"]) / BLOCK_BITS) == marks[block], "left").withColumn(
        mark, bit_set(F.col(mark), cell(docs["doc_id"]))).drop(block)
    columns = [f"`{c}`" for c in docs.columns]
    again = with_fingerprint(flagged.where(F.col(mark)).select(*columns), name=mark)
    stay = stay.select(F.col("component_id").alias(lead), F.col("fingerprint").alias(block))
    again = again.join(stay, again["doc_id"].eqNullSafe(stay[lead]) & (again[mark] == stay[block]), "left_semi").dropDuplicates(["doc_id", mark])
    return flagged.where(~F.col(mark)).select(*columns).unionByName(again.select(*columns))

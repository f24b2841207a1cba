"""Exact copies by an extendible-hash index on shared files.

Texts are equal if they agree after all white space is deleted. The first pass hashes every
text and marks in a bitmap of bounded size the hash cells that hold two rows or more; a row
alone in its cell has no copy. The second pass writes, to the shared folder, a narrow record
of every row and one index entry for each different text that a task met in marked cells, with
its text. Equal texts of one task thus meet once, and a text that a third of all rows share is
one entry a task.

The index addresses buckets by the first bits of the hash. A bucket with more bytes than its
capacity is split by its next bit; if it has as many bits as the directory, the directory
doubles. Owner tasks get ranges of buckets of about equal bytes, walk the entries in key order,
chain those of one key and compare their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import own_name, utf8
from tamis.operators.bitmaps import bitmap
from tamis.session import discard, materialize

SPACES = b" \t\n\x0b\x0c\r"
CELL_BITS = 27  # of the bitmap, at most: 16 MB
DIRECTORY_BITS = 16  # of the directory, at most
LEAST_CAPACITY = 64 << 10  # bytes of a bucket; more when there are over 2^14 such buckets
ENTRY_BYTES = 64  # counted for an entry besides its text
HELD_BYTES = 16 << 20  # texts a task holds before it writes its entries down
RECORD = "row long, doc_id long, n_chars long, sha binary, entry long, key long, n_rows long, text binary"
CLASS = "entry long, keep_id long, keep_row long, group_size long"


def normalised(text: bytes | None) -> bytes:
    return (text or b"").translate(None, SPACES)


def key_of(text: bytes) -> int:
    """The signed 64-bit hash that addresses the index."""
    value = xxhash.xxh64_intdigest(text)
    return value - (1 << 64) if value >> 63 else value


def split_buckets(load: np.ndarray, capacity: int) -> np.ndarray:
    """The directory: the bucket of every hash prefix, from the ``load`` of the finest prefixes.

    Its length is a power of two, as many prefix bits as the deepest bucket has. A bucket that
    is overfull at the finest prefix stays so; its entries form longer chains.
    """
    before = np.concatenate([[0], np.cumsum(load)])
    pointers, depths, bits, open_buckets = np.zeros(1, np.int64), [0], 0, [(0, 0)]
    while open_buckets:
        bucket, prefix = open_buckets.pop()
        depth = depths[bucket]
        width = len(load) >> depth
        if width == 1 or before[(prefix + 1) * width] - before[prefix * width] <= capacity:
            continue
        if depth == bits:
            pointers, bits = np.repeat(pointers, 2), bits + 1
        span = 1 << (bits - depth - 1)
        depths[bucket] = depth + 1
        depths.append(depth + 1)
        pointers[(2 * prefix + 1) * span:(2 * prefix + 2) * span] = len(depths) - 1
        open_buckets += [(bucket, 2 * prefix), (len(depths) - 1, 2 * prefix + 1)]
    return pointers


def owners_of(pointers: np.ndarray, load: np.ndarray, owners: int) -> np.ndarray:
    """The owner of every directory pointer: neighbouring buckets, about equal load."""
    width = len(load) // len(pointers)
    before = np.concatenate([[0], np.cumsum(load)])[:-1:width]
    first = np.nonzero(np.concatenate([[True], pointers[1:] != pointers[:-1]]))[0]
    start = np.repeat(before[first], np.diff(np.append(first, len(pointers))))
    return (start * owners // max(1, int(load.sum()))).astype(np.int64)


def _shared_cells(docs: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap of the hash cells with two rows or more, and the number of bits of a cell."""
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [key_of(normalised(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64())], ["key"])

    keys = materialize(docs.select("text").mapInArrow(hashed, "key long"), "keys")
    bits = min(CELL_BITS, max(15, (16 * keys.count()).bit_length()))
    cells = keys.groupBy(F.shiftrightunsigned("key", 64 - bits).alias("cell")).count().where("count > 1")
    shared = np.zeros(1 << (bits - 3), np.uint8)
    for row in bitmap(cells, "cell").collect():  # 2^bits bits at most
        part = np.frombuffer(row["bits"], np.uint8)
        shared[row["block"] * 4096:][:len(part)] = part
    discard(keys)
    return shared, bits


def _records(docs: DataFrame) -> DataFrame:
    """The records of all rows, and the entries of rows in shared cells (those with ``n_rows``)."""
    shared, bits = _shared_cells(docs)
    marks = docs.sparkSession.sparkContext.broadcast(shared)

    def better(a: list, b: list) -> bool:
        """By code points of the original, then doc_id (NULL last), then row."""
        def order(x: list) -> tuple:
            return -x[2], x[1] is None, x[1] or 0, x[0]

        return order(a) < order(b)

    def record(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in RECORD.split(", ")]
        types = [pa.binary() if n in ("sha", "text") else pa.int64() for n in names]
        own, held, size = TaskContext.get().partitionId() << 33, {}, 0

        def table(rows: list[list]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)

        for batch in batches:
            out = []
            for doc_id, text, n_chars, given in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                solid = normalised(text)
                row, key, sha = own if given is None else given, key_of(solid), hashlib.sha256(solid).digest()
                own += 1
                cell = (key % (1 << 64)) >> (64 - bits)
                if not marks.value[cell >> 3] >> (cell & 7) & 1:
                    out.append([row, doc_id, n_chars, sha, None, key, None, None])
                    continue
                one = [row, doc_id, n_chars, sha, row, key, 1, solid]
                known = held.setdefault(solid, one)
                if known is not one:
                    if better(one, known):
                        known[:3] = one[:3]
                    known[6] += 1
                else:
                    size += len(solid) + ENTRY_BYTES
                out.append([row, doc_id, n_chars, sha, known[4], key, None, None])
            yield table(out)
            if size > HELD_BYTES:
                yield table(list(held.values()))
                held, size = {}, 0
        yield table(list(held.values()))

    return materialize(docs.mapInArrow(record, RECORD), "records")


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The class of every entry, from entries in key order: those of one key are chained and compared by their bytes."""
    names = [part.split()[0] for part in CLASS.split(", ")]
    key, chain, out = None, [], []

    def told() -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names)

    def close() -> None:
        for _, best, n_rows, entries in chain:
            out.extend((entry, best[2], best[3], n_rows) for entry in entries)
        chain.clear()

    for batch in batches:
        for k, entry, row, doc_id, n_chars, n_rows, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k != key:
                close()
                key = k
            best = (-n_chars, doc_id is None, doc_id, row)
            order = (-n_chars, doc_id is None, doc_id or 0, row)
            for same in chain:
                if same[0] == text:
                    seen = (same[1][0], same[1][1], same[1][2] or 0, same[1][3])
                    same[1], same[2] = (best if order < seen else same[1]), same[2] + n_rows
                    same[3].append(entry)
                    break
            else:
                chain.append([text, best, n_rows, [entry]])
        if len(out) > 10_000:
            yield told()
            out = []
    close()
    yield told()


def _classes(records: DataFrame) -> DataFrame:
    """``entry, keep_id, keep_row, group_size`` of every index entry."""
    spark = records.sparkSession
    entries = records.where("n_rows IS NOT NULL")
    cells = entries.groupBy(F.shiftrightunsigned("key", 64 - DIRECTORY_BITS).alias("cell")).agg(
        F.sum(F.length("text") + ENTRY_BYTES).alias("bytes")).collect()  # 2^16 rows at most
    load = np.zeros(1 << DIRECTORY_BITS, np.int64)
    for row in cells:
        load[row["cell"]] = row["bytes"]
    pointers = split_buckets(load, max(LEAST_CAPACITY, int(load.sum()) >> 14))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    owners = owners_of(pointers, load, tasks)
    directory = spark.createDataFrame(list(enumerate(owners.tolist())), "slot long, owner long")
    bits = len(pointers).bit_length() - 1
    slot = F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0).cast("long")
    dealt = entries.withColumn("slot", slot).join(F.broadcast(directory), "slot").repartitionById(tasks, F.col("owner").cast("int"))
    return materialize(dealt.sortWithinPartitions("key").select("key", "entry", "row", "doc_id", "n_chars", "n_rows", "text")
                       .mapInArrow(_chained, CLASS), "classes")


def marked(docs: DataFrame, row: str | None = None) -> DataFrame:
    """``row, doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs``.

    Of equal texts the one with the most code points stays, then the smallest doc_id; a row
    without doc_id comes last, and of rows alike in all three exactly one stays. NULL counts as
    the empty text, and all empty texts are equal. ``row`` may name a column of unique numbers
    that identifies rows; else rows are numbered. Only ``doc_id`` (a whole number), ``text`` and
    that column are read; no rows give no rows. A very long text is held whole by one task, as
    one value.
    """
    given = F.lit(None).cast("long") if row is None else F.col(row).cast("long")
    records = _records(docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"),
                                   F.coalesce(F.char_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("n_chars"), given.alias("row")))
    rows = records.where("n_rows IS NULL").select("row", "doc_id", "entry", F.lower(F.hex("sha")).alias("text_sha256"))
    alone = rows.where("entry IS NULL").select("row", "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
                                               F.lit(True).alias("kept"), "text_sha256")
    grouped = rows.where("entry IS NOT NULL").join(_classes(records), "entry").select(
        "row", "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")
    return alone.unionByName(grouped)


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns; see :func:`marked`."""
    number, stay = own_name(docs, "row"), own_name(docs, "stay")
    rows = materialize(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    kept = marked(rows, number).where("kept").select(F.col("row").alias(stay))
    return rows.join(kept, rows[number] == kept[stay], "left_semi").select(*[f"`{c}`" for c in docs.columns])


SQL = """
WITH solid AS (SELECT doc_id, length(coalesce(text, '')) AS n_chars, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER same AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER same = 1 AS kept,
    sha256(t) AS text_sha256
FROM solid WINDOW same AS (PARTITION BY t ORDER BY n_chars DESC, doc_id)"""

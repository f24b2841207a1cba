"""Benchmark passages in documents, found by Wu-Manber search over whole words.

Test strings are all windows of ten words of an item (a shorter item is one string). A table of
word-pair shifts skips places where no string can end, the last pair selects the strings to
try, their first word narrows them down, and comparing all words decides.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.llm.common import own_name, utf8
from tamis.session import materialize

WINDOW = 10
CHUNK_WINDOWS = 10_000
BLOCK_WINDOWS = 100_000  # test strings searched at once; more take another pass over the documents

_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of digits, letters and non-ASCII characters, with A-Z in lower case."""
    return (text or b"").translate(_WORD).split()


def search_tables(strings: list[tuple[str, list[bytes]]]) -> list[tuple]:
    """Shift table and buckets for each length of test string, from ``(item, words)`` passages."""
    by_length: dict[int, list[tuple[str, list[bytes], int]]] = {}
    for item, words in strings:
        for k in range(max(len(words) - WINDOW, 0) + 1):
            by_length.setdefault(min(len(words), WINDOW), []).append((item, words, k))
    tables = []
    for length, entries in sorted(by_length.items()):
        block = min(2, length)
        shifts: dict[tuple, int] = {}
        buckets: dict[tuple, dict[bytes, list]] = {}
        for item, words, k in entries:
            for end in range(block, length + 1):
                key = tuple(words[k + end - block:k + end])
                shifts[key] = min(shifts.get(key, length), length - end)
            buckets.setdefault(tuple(words[k + length - block:k + length]), {}).setdefault(words[k], []).append((item, words, k))
        tables.append((length, block, shifts, buckets))
    return tables


def search(words: list[bytes], tables: list[tuple]) -> tuple[list[tuple[int, int]], set[str]]:
    """Disjoint hit spans ``[start, end)`` of word numbers, and the items that occur."""
    spans, items = [], set()
    for length, block, shifts, buckets in tables:
        at, most, get = length - 1, length - block + 1, shifts.get
        while at < len(words):
            key = (words[at - 1], words[at]) if block == 2 else (words[at],)
            step = get(key, most)
            if step:
                at += step
                continue
            first = at - length + 1
            for item, passage, k in buckets[key].get(words[first], ()):
                if passage[k:k + length] == words[first:at + 1]:
                    items.add(item)
                    spans.append((first, at + 1))
            at += 1
    return _union(spans), items


def passages(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """``item, words, block`` and the number of blocks: items in pieces of bounded length that overlap by nine words."""
    schema = T.StructType([T.StructField("item", T.StringType()), T.StructField("words", T.ArrayType(T.BinaryType())),
                           T.StructField("windows", T.LongType())])

    def cut(rows):
        for batch in rows:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                for k in range(0, max(len(words) - WINDOW, 0) + 1, CHUNK_WINDOWS):
                    piece = words[k:k + CHUNK_WINDOWS + WINDOW - 1]
                    if piece:
                        yield pa.RecordBatch.from_arrays([pa.array([item]), pa.array([piece], pa.list_(pa.binary())), pa.array(
                            [max(len(piece) - WINDOW, 0) + 1], pa.int64())], names=["item", "words", "windows"])

    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), utf8("text").alias("words"))
    rows = materialize(rows.mapInArrow(cut, schema), "passages")
    blocks = max(1, math.ceil((rows.agg(F.sum("windows")).first()[0] or 0) / BLOCK_WINDOWS))
    return rows.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(blocks))), blocks


def marked(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep_text: bool = True) -> tuple[DataFrame, list[str]]:
    """``docs`` with ``n_words``, ``span_starts``, ``span_ends`` and ``items``, and the names these got.

    Word numbers count from 0, an end is the first word after a span; spans are disjoint. A NULL
    text has no words, an item without words is never found, an item without an id has the
    empty id. Rows given twice are marked alike. Whatever the number of test strings, one
    bounded block of them is in memory at a time.
    """
    rows, blocks = passages(benchmark)
    names = [own_name(docs, n) for n in ("n_words", "span_starts", "span_ends", "items")]
    kinds = [T.LongType(), T.ArrayType(T.IntegerType()), T.ArrayType(T.IntegerType()), T.ArrayType(T.StringType())]
    arrows = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string())]
    source = own_name(docs, "utf8")
    for k in range(blocks):
        block = rows.where(F.col("block") == k).select("item", "words").collect()  # bounded by BLOCK_WINDOWS
        shared = docs.sparkSession.sparkContext.broadcast([(r["item"], [bytes(w) for w in r["words"]]) for r in block])
        last = k == blocks - 1
        through = [c for c in docs.columns if c not in names and (keep_text or not last or c != text)]
        earlier = names if k else []
        # A text that stays anyway is sent once, not a second time as bytes.
        own = through.index(text) if text in through and isinstance(docs.schema[text].dataType, T.StringType) else len(through)
        sent = [f"`{c}`" for c in through] + ([utf8(text).alias(source)] if own == len(through) else [])
        schema = T.StructType([docs.schema[c] for c in through] + [T.StructField(n, t) for n, t in zip(names, kinds, strict=True)])

        def run(batches, shared=shared, through=through, earlier=earlier, own=own, width=len(sent)):
            tables = None
            for batch in batches:
                tables = tables or search_tables(shared.value)
                out = [[], [], [], []]
                past = [batch.column(width + i).to_pylist() for i in range(len(earlier))]
                for r, value in enumerate(batch.column(own).cast(pa.binary())):
                    words = words_of(value.as_py())
                    spans, items = search(words, tables)
                    if earlier:
                        spans, items = _union(spans, zip(past[1][r], past[2][r], strict=True)), items | set(past[3][r])
                    for column, x in zip(out, (len(words), [s for s, _ in spans], [e for _, e in spans], sorted(items)), strict=True):
                        column.append(x)
                yield pa.RecordBatch.from_arrays(batch.columns[:len(through)] + [pa.array(c, t) for c, t in zip(out, arrows, strict=True)],
                                                 names=[*through, *names])

        docs = docs.select(*sent, *earlier).mapInArrow(run, schema)
        if not last:
            docs = materialize(docs, "marked")
    return docs, names


def _union(spans, more=()) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted([*spans, *more]):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: words, hit words, items found, the digest of their ids, and the verdict."""
    found, (n_words, starts, ends, items) = marked(docs.select("doc_id", "text"), benchmark, keep_text=False)
    hit = F.aggregate(F.zip_with(ends, starts, lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(
        "doc_id", F.col(n_words).alias("n_words"), hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items), ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows in which no test string occurs, with the columns they came with."""
    found, names = marked(docs, benchmark)
    return found.where(F.size(names[1]) == 0).select(*[f"`{c}`" for c in docs.columns])


SQL = """
WITH words AS (
    SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
    UNION ALL
    SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark),
strings AS (
    SELECT DISTINCT id AS item, least(len(w), 10) AS n, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS s
    FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM words WHERE kind = 'b' AND len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM strings),
places AS (
    SELECT id, n, k, array_to_string(w[k:k + n - 1], ' ') AS s
    FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM words, lengths WHERE kind = 'd' AND len(w) >= n)),
hits AS (SELECT p.id, p.n, p.k, t.item FROM places p JOIN strings t USING (n, s)),
hit_words AS (SELECT id, count(DISTINCT j) AS n_hit FROM (SELECT id, unnest(range(k, k + n)) AS j FROM hits) GROUP BY id),
items AS (SELECT id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item::VARCHAR, ',' ORDER BY item::VARCHAR) AS ids FROM hits GROUP BY id)
SELECT d.id AS doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words d LEFT JOIN hit_words USING (id) LEFT JOIN items USING (id) WHERE kind = 'd'"""

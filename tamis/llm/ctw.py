"""Language-model scores by context-tree weighting.

A text is the bytes of its words, one space between them and a line break as its end. Bytes
are first given 64 codes, the 63 most frequent ones their own; a code is six binary decisions,
each with a tree of contexts (the last six codes, the nearest at the root). In every context a
decision has a Krichevsky-Trofimov estimate, and the weights of all depths follow from the training
counts, bottom-up: half for stopping, half for the product of the longer contexts.

No task holds the whole model. It lies in rows of one group of three codes each; texts are cut into
pieces of bounded size, every piece asks once for each of its distinct grams, the questions meet
the groups in a shuffle, and the answers go back to their pieces.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import utf8
from tamis.session import arrow_batches, materialize

DEPTH = 6
SHORT = 2  # contexts of up to so many codes are few enough for the driver
BITS = 6
CODES = 1 << BITS
NODES = CODES - 1
ESCAPE = CODES - 1
HELD_OUT = 10
MAX_WORDS = 300_000  # words whose counts scoring has at hand; the others are looked up by a join
PIECE_BYTES = 2_000_000
SCORE_BYTES = 6_000_000  # bytes of text that ask for their grams together
RUN_ROWS = 20_000  # gram counts whose trees are weighted in one go
MERGED_ROWS = 500_000  # gram counts of a task added up in one go
ASK_ROWS = 500_000  # questions answered from the same trees
STEP_ROWS = 50_000  # grams or questions of them worked on at once
BATCH_BYTES = 4_000_000  # of texts that Spark hands over at once
SALT_BYTES = 256 << 20  # questions to a group of three codes beyond this are shared out over copies of the group
END = b"\n"
SUFFIX = BITS * (DEPTH - SHORT)  # bits of a gram after its first three codes
_CODE = np.arange(CODES)[:, None]
_DEEP = np.arange(BITS)[None]
PATH = (1 << _DEEP) - 1 + (_CODE >> (BITS - _DEEP))  # the six decisions that lead to each code
BIT = (_CODE >> (BITS - 1 - _DEEP) & 1).astype(bool)  # and how they fall


def in_training(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % HELD_OUT != 0


def tokens_of(text: bytes | None) -> list[bytes]:
    """The words between white space, with A-Z in lower case."""
    return (text or b"").lower().split()


def _padded(words: list[bytes]) -> bytes:
    return END * DEPTH + b" ".join(words) + END


def grams(text: np.ndarray, lengths: np.ndarray, width: int = 8) -> np.ndarray:
    """For each byte of padded texts: the byte before, the one before that, ... and the byte, packed."""
    n = max(len(text) - DEPTH, 0)
    packed = np.zeros(n, np.uint64)
    for k in [*range(1, DEPTH + 1), 0]:
        packed <<= np.uint64(width)
        packed |= text[DEPTH - k:DEPTH - k + n]
    kept = 0
    for begin, m in zip((np.cumsum(lengths) - lengths).tolist(), (lengths - DEPTH).tolist(), strict=True):
        if kept < begin:  # moved within the array, as a copy would take as much again
            packed[kept:kept + m] = packed[begin:begin + m]
        kept += m
    return packed[:kept]


def _text_of(codes: bytes, lengths: np.ndarray) -> np.ndarray:
    """The codes of a piece, which is kept and shuffled compressed."""
    return np.frombuffer(pa.decompress(codes, decompressed_size=int(lengths.sum()), codec="zstd", asbytes=True), np.uint8)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.nonzero(np.concatenate(([True], keys[1:] != keys[:-1])))[0]
    return keys[first], np.add.reduceat(counts, first, dtype=np.int64)


def _shares(parts: list[tuple[np.ndarray, np.ndarray]]):
    """Sorted grams and their counts in shares of a bounded size with whole groups of three codes each, in order."""
    some = np.sort(np.concatenate([keys[::64] for keys, _ in parts]))
    ends = np.unique(some[MERGED_ROWS // 64::MERGED_ROWS // 64] >> SUFFIX << SUFFIX)
    cuts = [np.concatenate(([0], np.searchsorted(keys, ends), [len(keys)])) for keys, _ in parts]
    for i in range(len(ends) + 1):
        share = [(keys[at[i]:at[i + 1]], counts[at[i]:at[i + 1]]) for (keys, counts), at in zip(parts, cuts, strict=True)]
        if any(len(keys) for keys, _ in share):
            yield share


def packed_rows(rows: np.ndarray, values: np.ndarray) -> pa.Array:
    """Binary values that hold so many of the values each."""
    offsets = np.concatenate(([0], np.cumsum(rows) * values.itemsize)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _values(batches):
    """The values of the first column, some at a time as Python objects."""
    for batch in batches:
        for k in range(0, batch.num_rows, 1000):
            yield from batch.column(0).slice(k, 1000).to_pylist()


def _runs(values: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    return np.nonzero(np.concatenate(([True], values[1:] != values[:-1])))[0]


def by_triple(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted grams as groups of their first three codes: these, how many grams each has, and the rest of all grams."""
    triple = (gram >> SUFFIX).astype(np.int32)
    first = _runs(triple)
    return triple[first], np.diff(np.append(first, len(triple))), (gram & ((1 << SUFFIX) - 1)).astype(np.int32)


def gaps(size: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The sorted numbers of each group as their differences, which compress better; the first of a group stays."""
    out, first = np.diff(low, prepend=low[:1]), np.cumsum(size) - size
    out[first] = low[first]
    return out


def from_gaps(size: np.ndarray, out: np.ndarray) -> np.ndarray:
    ends, first = np.cumsum(out, dtype=np.int64), np.cumsum(size) - size
    return ends - np.repeat(ends[first] - out[first], size)


def narrow(low: np.ndarray) -> np.ndarray:
    """Numbers of ``SUFFIX`` bits in three bytes each."""
    return np.ascontiguousarray(low.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :SUFFIX // 8]).view(f"V{SUFFIX // 8}").ravel()


def wide(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) * 8 // SUFFIX, 4), np.uint8)
    out[:, :SUFFIX // 8] = np.frombuffer(raw, np.uint8).reshape(-1, SUFFIX // 8)
    return out.view("<i4").ravel()


COUNTS = "triple int, keys binary, counts binary, word binary, n long"


def _counts_batch(words: list, numbers: list, triples=(), keys=(), counts=()) -> pa.RecordBatch:
    n, m = len(words), len(triples)
    words = words if isinstance(words, pa.Array) else pa.array(words, pa.binary())
    joined = [pa.concat_arrays([pa.nulls(n, t), pa.array(x, t) if not isinstance(x, pa.Array) else x]) for t, x in ((pa.int32(), triples), (pa.binary(), keys), (pa.binary(), counts))]
    return pa.RecordBatch.from_arrays([*joined, pa.concat_arrays([words, pa.nulls(m, pa.binary())]),
                                       pa.concat_arrays([pa.array(numbers, pa.int64()), pa.nulls(m, pa.int64())])], names=["triple", "keys", "counts", "word", "n"])


def byte_counts(texts: DataFrame) -> np.ndarray:
    """How often each byte is in the texts as they are scored."""
    def run(batches):
        seen = np.zeros(256, np.int64)
        for text in _values(batches):
            seen += np.bincount(np.frombuffer(_padded(tokens_of(text))[DEPTH:], np.uint8), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256, dtype=np.int32)), pa.array(seen)], names=["byte", "n"])

    seen = np.zeros(256, np.int64)
    with arrow_batches(texts.sparkSession, BATCH_BYTES):
        found = texts.mapInArrow(run, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect()
    for r in found:
        seen[r["byte"]] = r["n"]
    return seen


def counts_of(texts: DataFrame, codes: np.ndarray) -> DataFrame:
    """Counts over all training texts: a row for each word (``word, n``) and for each group of three codes (``triple, keys, counts``).

    A task counts what it has and sends one row a group; a group's rows are added up as they come in.
    """
    def counted(batches):
        words, parts, piece, held = Counter(), [], [], 0

        def sums():
            found, numbers = list(words), list(words.values())
            for k in range(0, len(found), 100_000):
                yield _counts_batch(found[k:k + 100_000], numbers[k:k + 100_000])
            for share in _shares(parts) if parts else ():
                gram, n = _merged(share)
                triple, size, low = by_triple(gram)
                yield _counts_batch([], [], triple, packed_rows(size, gaps(size, low)), packed_rows(size, n))

        def close():
            raw = codes[np.frombuffer(b"".join(piece), np.uint8)]
            found = grams(raw, np.fromiter(map(len, piece), np.int64, len(piece)), BITS).view(np.int64)
            found.sort()
            first = _runs(found).astype(np.int32)
            parts.append((found[first], np.diff(first, append=np.int32(len(found)))))

        for text in _values(batches):
            own = tokens_of(text)
            words.update(own)
            piece.append(_padded(own))
            held += len(piece[-1])
            if held >= PIECE_BYTES:
                close()
                piece, held = [], 0
                if len(words) > 600_000 or sum(len(k) for k, _ in parts) > 4_000_000:
                    yield from sums()
                    words, parts = Counter(), []
        if piece:
            close()
        yield from sums()

    def adding(batches):
        """Rows come ordered, words first; the last word or group of a batch may go on in the next."""
        last, triple, parts = None, None, []
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            own = rows.filter(pc.is_null(rows["triple"])).select(["word", "n"])
            if own.num_rows:
                own = own if last is None else pa.concat_tables([last, own])
                word = own["word"].combine_chunks()  # the runs of equal words, as Arrow's groups come in no order
                first = np.append(0, np.nonzero(pc.not_equal(word.slice(1), word.slice(0, len(word) - 1)).to_numpy(zero_copy_only=False))[0] + 1)
                own = pa.table({"word": word.take(pa.array(first)), "n": np.add.reduceat(own["n"].to_numpy(), first)})
                last, own = own.slice(own.num_rows - 1), own.slice(0, own.num_rows - 1).combine_chunks()
                if own.num_rows:
                    yield _counts_batch(own["word"].combine_chunks(), own["n"].to_pylist())
            rows = rows.filter(pc.is_valid(rows["triple"]))
            done: list[list] = [[], [], []]
            for t, keys, counts in zip(*[rows[c].to_pylist() for c in ("triple", "keys", "counts")], strict=True):
                if parts and t != triple:
                    for x, y in zip(done, (triple, *[a.tobytes() for a in _merged(parts)]), strict=True):
                        x.append(y)
                    parts = []
                triple = t
                parts.append((np.cumsum(np.frombuffer(keys, np.int32), dtype=np.int32), np.frombuffer(counts, np.int64)))
                if len(parts) % 64 == 0:
                    parts = [_merged(parts)]
            if done[0]:
                yield _counts_batch([], [], *done)
        if last is not None:
            yield _counts_batch(last["word"].combine_chunks(), last["n"].to_pylist())
        if parts:
            yield _counts_batch([], [], [triple], *[[a.tobytes()] for a in _merged(parts)])

    rows = texts.mapInArrow(counted, COUNTS).repartition("triple", "word").sortWithinPartitions("triple", "word")
    with arrow_batches(texts.sparkSession, BATCH_BYTES):
        return materialize(rows.mapInArrow(adding, COUNTS), "lm-counts")


def _log_gamma(x: np.ndarray) -> np.ndarray:
    shift = np.ones_like(x)
    for k in range(7):
        shift = shift * (x + k)
    y = x + 7
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(shift)


def _decisions(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones at each of the 63 binary decisions (heap order) from counts of codes ``[row, 64]``."""
    zeros, ones, level = [], [], counts.astype(np.float64)
    while level.shape[1] > 1:
        zeros.insert(0, level[:, 0::2])
        ones.insert(0, level[:, 1::2])
        level = level[:, 0::2] + level[:, 1::2]
    return np.concatenate(zeros, 1), np.concatenate(ones, 1)


@dataclass
class Level:
    """The contexts of one depth: their counts, KT probabilities, weighted probabilities and parents."""

    counts: np.ndarray
    kt: np.ndarray
    weighted: np.ndarray

    @property
    def stop(self) -> np.ndarray:
        """The posterior weight of stopping here."""
        return np.exp(np.minimum(0, np.log(0.5) + self.kt - self.weighted))


def level(counts: np.ndarray, children: np.ndarray | None = None) -> Level:
    """A level from its counts and the summed log weights of the children (None at full depth)."""
    zeros, ones = _decisions(counts)
    kt = _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1) - np.log(np.pi)
    kt[zeros + ones == 0] = 0
    return Level(counts, kt, kt if children is None else np.logaddexp(np.log(0.5) + kt, np.log(0.5) + children))


def descend(down: tuple[np.ndarray, np.ndarray, np.ndarray], at: Level, full: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From the parents' ``(settled, open, chance)`` to those of their contexts.

    ``chance`` is the probability of a one when no longer context is known; a decision that
    a context has never seen keeps its parent's.
    """
    settled, open_, before = down
    zeros, ones = _decisions(at.counts)
    seen, p = zeros + ones > 0, (ones + 0.5) / (zeros + ones + 1)
    stop = np.ones_like(at.kt) if full else at.stop
    return settled + open_ * stop * p, open_ * (1 - stop), np.where(seen, settled + open_ * p, before)


class Subtrees:
    """All contexts of three codes and more that some whole groups of three codes have, each level under its parents."""

    def __init__(self, context: np.ndarray, code: np.ndarray, n: np.ndarray):
        self.keys, self.levels, self.parents = {}, {}, {}
        keys, at = np.unique(context, return_inverse=True)
        counts, below = np.zeros((len(keys), CODES), np.int64), None
        np.add.at(counts, (at, code), n)
        for depth in range(DEPTH, SHORT, -1):
            self.keys[depth], self.levels[depth] = keys, level(counts, below)
            keys, parent = np.unique(keys >> BITS, return_inverse=True)
            first = np.nonzero(np.concatenate(([True], parent[1:] != parent[:-1])))[0]
            counts, below = np.add.reduceat(counts, first), np.add.reduceat(self.levels[depth].weighted, first)
            self.parents[depth] = parent
        self.pairs, self.counts, self.below = keys, counts, below


def subtrees(groups: list[tuple[int, bytes, bytes]]) -> Subtrees:
    """The contexts of whole groups of three codes as they are stored."""
    low = [np.frombuffer(k, np.int32) for _, k, _ in groups]
    gram = np.repeat(np.array([t for t, _, _ in groups], np.int64), [len(k) for k in low]) << SUFFIX | np.concatenate(low)
    return Subtrees(gram >> BITS, gram & ESCAPE, np.frombuffer(b"".join(c for _, _, c in groups), np.int64))


@dataclass
class Model:
    codes: np.ndarray  # code of each byte
    escape: np.ndarray  # log10 probability of each byte among those without a code of their own, 0 for the others
    words: DataFrame  # ``word, n`` of all words
    groups: DataFrame  # ``triple, keys, counts``: the grams of a group of three codes, without these, and their counts
    pairs: tuple[np.ndarray, np.ndarray, np.ndarray]  # what ``descend`` gives for each context of two codes


def fit(docs: DataFrame) -> Model:
    """The model of the training rows; all their contexts, however rare, are part of it."""
    texts = docs.where(in_training(F.col("doc_id"))).select(utf8("text").alias("text"))
    seen = byte_counts(texts)
    own = np.argsort(-seen, kind="stable")[:ESCAPE]
    codes = np.full(256, ESCAPE, np.uint8)
    codes[own] = np.arange(ESCAPE)
    rare = codes == ESCAPE
    escape = np.where(rare, np.log10((seen + 0.5) / (seen[rare].sum() + 0.5 * rare.sum())), 0.0)
    counts = counts_of(texts, codes)
    words, groups = counts.where("word IS NOT NULL").select("word", "n"), counts.where("triple IS NOT NULL").select("triple", "keys", "counts")

    def roots(batches):
        def sums(held):
            t = subtrees(held)
            return pa.RecordBatch.from_arrays([pa.array(t.pairs.astype(np.int32)), pa.array(t.counts.tolist(), pa.list_(pa.int64())),
                                               pa.array(t.below.tolist(), pa.list_(pa.float64()))], names=["pair", "counts", "below"])

        held, size = [], 0
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                held.append(row)
                size += len(row[1]) // 4
                if size >= RUN_ROWS:
                    yield sums(held)
                    held, size = [], 0
        if held:
            yield sums(held)

    top = groups.mapInArrow(roots, "pair int, counts array<long>, below array<double>")
    counts2, below2 = np.zeros((CODES**SHORT, CODES), np.int64), np.zeros((CODES**SHORT, NODES))
    sums = top.select("pair", *[F.col("counts")[i].alias(f"c{i}") for i in range(CODES)], *[F.col("below")[i].alias(f"b{i}") for i in range(NODES)])
    for r in sums.groupBy("pair").sum().collect():  # 4096 at most
        counts2[r["pair"]], below2[r["pair"]] = r[2:2 + CODES], r[2 + CODES:]
    level2 = level(counts2, below2)
    level1 = level(counts2.reshape(CODES, CODES, CODES).sum(1), level2.weighted.reshape(CODES, CODES, NODES).sum(1))
    level0 = level(level1.counts.sum(0)[None], level1.weighted.sum(0)[None])
    start = (np.zeros((1, NODES)), np.ones((1, NODES)), np.full((1, NODES), 0.5))
    down1 = descend(descend(start, level0, False), level1, False)
    return Model(codes, escape, words, groups, descend(tuple(np.repeat(x, CODES, axis=0) for x in down1), level2, False))


def answers(pairs: tuple[np.ndarray, np.ndarray, np.ndarray], groups: list[tuple[int, bytes, bytes]], gram: np.ndarray) -> np.ndarray:
    """log10 probability of the last code of each gram after its longest known context; ``groups`` are those the grams belong to."""
    chances = {}
    if groups:
        t = subtrees(groups)
        down = tuple(x[t.pairs] for x in pairs)
        for depth in range(SHORT + 1, DEPTH + 1):
            down = descend(tuple(x[t.parents[depth]] for x in down), t.levels.pop(depth), depth == DEPTH)
            chances[depth] = t.keys[depth], down[2]
    logs = np.empty(len(gram))
    for k in range(0, len(gram), STEP_ROWS):
        some = gram[k:k + STEP_ROWS]
        context, path = some >> BITS, PATH[some & ESCAPE]
        one = pairs[2][(context >> BITS * (DEPTH - SHORT))[:, None], path]
        todo = np.arange(len(some))
        for depth, (keys, chance) in chances.items():
            wanted = context[todo] >> BITS * (DEPTH - depth)
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            known = keys[at] == wanted  # a longer context is only known where this one is
            todo, at = todo[known], at[known]
            one[todo] = chance[at[:, None], path[todo]]
        logs[k:k + STEP_ROWS] = np.log10(np.where(BIT[some & ESCAPE], one, 1 - one)).sum(1)
    return logs


def distinct_grams(text: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct grams of a piece, sorted, as ``by_triple`` gives them, the rest as differences."""
    gram = grams(text, lengths, BITS).view(np.int64)
    gram.sort()
    new = np.ones(len(gram), bool)
    np.not_equal(gram[1:], gram[:-1], out=new[1:])
    gram = gram[new]
    del new
    triple, size, low = by_triple(gram)
    return triple, size, gaps(size, low)


def piece_scores(text: np.ndarray, lengths: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """For each segment of a piece the sum of its grams' logs, which are given for the distinct grams in their order."""
    shift = np.uint64(64 - BITS * (DEPTH + 1))
    both = grams(text, lengths, BITS)
    both <<= shift
    begin = 0
    for k, m in enumerate((lengths - DEPTH).tolist()):
        both[begin:begin + m] |= np.uint64(k)
        begin += m
    both.sort()
    sums, asked, last = np.zeros(len(lengths)), 0, None
    for k in range(0, len(both), STEP_ROWS):
        gram = both[k:k + STEP_ROWS] >> shift
        asked -= int(gram[0] == last)  # the last gram may go on
        first, last = _runs(gram), gram[-1]
        value = np.repeat(logs[asked:asked + len(first)], np.diff(first, append=len(gram)))
        asked += len(first)
        at = (both[k:k + STEP_ROWS] & np.uint64((1 << int(shift)) - 1)).astype(np.int64)
        low = int(at.min())
        part = np.bincount(at - low, value)
        sums[low:low + len(part)] += part
    return sums


def text_scores(pieces: DataFrame, model: Model) -> DataFrame:
    """``row, score`` from ``row, codes, rows, lengths, escape``: a piece's number, its coded segments (compressed), the row each is part of and their lengths."""
    def asking(batches):
        for batch in batches:
            for piece, codes, lengths in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                lengths = np.frombuffer(lengths, np.int64)
                triple, size, low = distinct_grams(_text_of(codes, lengths), lengths)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(triple), piece)), pa.array(triple), packed_rows(size, narrow(low))], names=["piece", "triple", "keys"])

    asked = pieces.select("row", "codes", "lengths").mapInArrow(asking, "piece long, triple int, keys binary")
    # A piece asks a group for about the grams it has at most, so this many bytes come to a group.
    share = F.ceil(F.octet_length("keys") * F.lit(pieces.count() / SALT_BYTES)).cast("int")
    shares = F.broadcast(model.groups.select("triple", share.alias("shares")).where("shares > 1"))  # fewer than 64 * 64 * 64
    own = F.coalesce("shares", F.lit(1))
    questions = asked.join(shares, "triple", "left").select("triple", F.pmod(F.xxhash64("piece"), own).cast("int").alias("share"), "piece", "keys", F.lit(None).cast("binary").alias("counts"))
    groups = model.groups.join(shares, "triple", "left").select("triple", F.explode(F.sequence(F.lit(0), own - 1)).alias("share"), F.lit(None).cast("long").alias("piece"), "keys", "counts")
    pairs = asked.sparkSession.sparkContext.broadcast(model.pairs)  # three tables of 4096 x 63 numbers

    def answering(batches):
        def close(known, asks):
            sizes = np.array([len(k) * 8 // SUFFIX for _, _, k in asks])
            gram = np.repeat(np.array([t for t, _, _ in asks], np.int64), sizes) << SUFFIX | from_gaps(sizes, wide(b"".join(k for _, _, k in asks)))
            yield pa.RecordBatch.from_arrays([pa.array([p for _, p, _ in asks], pa.int64()), pa.array([t for t, _, _ in asks], pa.int32()),
                                              packed_rows(sizes, answers(pairs.value, known, gram).astype(np.float32))], names=["piece", "triple", "logs"])

        known, asks, size, open_ = [], [], 0, 0
        for batch in batches:
            for triple, _, piece, keys, counts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if piece is None:
                    if asks and (size >= RUN_ROWS or open_ >= ASK_ROWS):
                        yield from close(known, asks)
                    if size >= RUN_ROWS or open_ >= ASK_ROWS:
                        known, asks, size, open_ = [], [], 0, 0
                    if not known or known[-1][0] != triple:  # copies of a group may follow one another
                        known.append((triple, keys, counts))
                        size += len(keys) // 4
                    continue
                if open_ >= ASK_ROWS:
                    yield from close(known, asks)
                    known, asks, open_ = [g for g in known[-1:] if g[0] == triple], [], 0
                    size = sum(len(k) // 4 for _, k, _ in known)
                asks.append((triple, piece, keys))
                open_ += len(keys) * 8 // SUFFIX
        if asks:
            yield from close(known, asks)

    # A group comes before its questions, as NULL sorts first.
    met = groups.unionByName(questions).repartition("triple", "share").sortWithinPartitions("triple", "share", "piece")
    told = met.mapInArrow(answering, "piece long, triple int, logs binary")

    def adding(batches):
        def close(piece, logs):
            codes, rows, lengths, escape = piece
            rows, lengths = np.frombuffer(rows, np.int64), np.frombuffer(lengths, np.int64)
            sums = piece_scores(_text_of(codes, lengths), lengths, np.frombuffer(b"".join(logs), np.float32))
            return pa.RecordBatch.from_arrays([pa.array(rows), pa.array(sums + np.frombuffer(escape, np.float64))], names=["row", "score"])

        piece, logs = None, []
        for batch in batches:
            for _, _, own, log in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if own is not None:
                    if piece is not None:
                        yield close(piece, logs)
                    piece, logs = list(own.values()), []
                else:
                    logs.append(log)
        if piece is not None:
            yield close(piece, logs)

    # The answers of a piece, ordered by group, stand in the order of its sorted grams.
    whole = pieces.select(F.col("row").alias("piece"), F.lit(-1).alias("triple"), F.struct("codes", "rows", "lengths", "escape").alias("own"), F.lit(None).cast("binary").alias("logs"))
    told = told.select("piece", "triple", F.lit(None).cast(whole.schema["own"].dataType).alias("own"), "logs")
    rows = whole.unionByName(told).repartition("piece").sortWithinPartitions("piece", "triple").mapInArrow(adding, "row long, score double")
    return rows.groupBy("row").agg(F.sum("score").alias("score"))


def scored(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte`` for every row.

    NULL and empty texts are the end token alone. A document without an id is held out. Rows given
    twice get equal scores. Without training rows every byte has an even chance and the base
    knows no token. Only doc_id and text are read.
    """
    model = fit(docs)
    codes_of, escape_of = model.codes, model.escape
    ends = docs.where(in_training(F.col("doc_id"))).count()
    words = model.words
    total, distinct = words.agg(F.sum("n"), F.count("*")).first()
    total, distinct = (total or 0) + ends, distinct + bool(ends)
    floor = 0.1 * (distinct + 1)

    def log(n):
        return float(np.log10((n + 0.1) / (total + floor)))

    common = words.orderBy(F.desc("n"), "word").limit(MAX_WORDS).toArrow()
    top = docs.sparkSession.sparkContext.broadcast({w: log(n) for w, n in zip(common.column(0).to_pylist(), common.column(1).to_pylist(), strict=True)})
    end_log = log(ends)

    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = ["row", "doc_id", "n_tokens", "rare", "partial", "n_bytes", "codes", "rows", "lengths", "escape"]

    def run(batches):
        from pyspark import TaskContext

        get, serial = top.value.get, TaskContext.get().partitionId() << 33
        piece, rows, held, doc_type, number = [], [], 0, pa.null(), serial

        def escapes(segment):
            return escape_of[np.frombuffer(segment, np.uint8)[DEPTH:]].sum()

        def close():
            lengths, extra = np.fromiter(map(len, piece), np.int64, len(piece)), np.fromiter(map(escapes, piece), np.float64, len(piece))
            text = codes_of[np.frombuffer(b"".join(piece), np.uint8)]
            values = [pa.compress(text, codec="zstd", asbytes=True), np.array(rows, np.int64).tobytes(), lengths.tobytes(), extra.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.nulls(1, doc_type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.binary())), pa.nulls(1, pa.float64()),
                                               pa.nulls(1, pa.int64()), *[pa.array([x], pa.binary()) for x in values]], names=fields)

        for batch in batches:
            columns: list[list] = [[], [], [], []]
            doc_type = batch.column(0).type
            for k, text in enumerate(_values([batch.select([1])])):
                own = tokens_of(text)
                known = list(map(get, own))
                padded = _padded(own)
                columns[0].append(len(own) + 1)
                columns[1].append([w for w, x in zip(own, known, strict=True) if x is None] if None in known else [])
                columns[2].append(sum(filter(None, known)) + end_log)
                columns[3].append(len(padded) - DEPTH)
                # A text of more than a piece is cut; a segment begins with the last bytes of the one before.
                for begin in range(0, len(padded) - DEPTH, SCORE_BYTES):
                    piece.append(padded[begin:begin + SCORE_BYTES + DEPTH])
                    rows.append(serial + k)
                    held += len(piece[-1])
                    if held >= SCORE_BYTES:
                        yield close()
                        piece, rows, held, number = [], [], 0, number + 1
            n = batch.num_rows
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(serial, serial + n)), batch.column(0), pa.array(columns[0], pa.int64()),
                                                  pa.array(columns[1], pa.list_(pa.binary())), pa.array(columns[2], pa.float64()),
                                                  pa.array(columns[3], pa.int64()), *[pa.nulls(n, pa.binary())] * 4], names=fields)
            serial += n
        if piece:
            yield close()

    both = docs.select("doc_id", utf8("text").alias("text")).mapInArrow(
        run, f"row long, doc_id {kind}, n_tokens long, rare array<binary>, partial double, n_bytes long, codes binary, rows binary, lengths binary, escape binary")
    with arrow_batches(docs.sparkSession, BATCH_BYTES):
        both = materialize(both, "lm-pieces")
    rows = both.where("codes IS NULL").select(*fields[:6])
    scores = text_scores(both.where("codes IS NOT NULL").select("row", *fields[6:]), model)
    rare = rows.select("row", F.explode("rare").alias("word")).join(words, "word", "left").groupBy("row").agg(
        F.sum(F.log10((F.coalesce("n", F.lit(0)) + 0.1) / F.lit(total + floor))).alias("rest"), F.sum(F.col("n").isNull().cast("long")).alias("unknown"))
    both = rows.drop("rare").join(rare, "row", "left").join(scores, "row", "left")
    return both.select(
        "doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "n_tokens",
        (F.col("n_tokens") - F.coalesce("unknown", F.lit(0)) - F.lit(0 if ends else 1)).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("partial") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), "score",
        (-F.col("score") * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"))

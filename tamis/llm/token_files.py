"""Token ids in binary shards: frequency ranks in byte-aligned variable-length coding.

Ids are replaced by their rank in the corpus, so the frequent ones take one byte. The bytes of a
rank follow each other in the data part; how many there are stands in separate control bytes,
two bits an id, and a decoder looks up whole control bytes in a table.

A shard is one binary value of a Parquet table: a header of six little-endian 64-bit numbers
(magic, documents, ids, control bytes, data bytes, rank-table length), then the rank table (32-bit ids
in rank order), document ids and token counts (64 bit), control bytes and data bytes.
"""

from __future__ import annotations

import unicodedata
import zlib
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.llm.common import utf8
from tamis.session import materialize

MAGIC = 0x5452414E4B303176
SHARD_IDS = 1_000_000  # a shard is closed when it has so many ids
END_ID = 1
CACHED_WORDS = 600_000
WAITING_WORDS = 100_000  # of them that a worker keeps from task to task
SLICE_BYTES = 2 << 20  # of texts or ids that a task holds as Python objects
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_SIGNS = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum())  # ASCII punctuation
_PLAIN = regex.compile(r"[\x21-\x7eÀ-ɏ]+")


class Encoder:
    """Ids of whole texts by a word tokenizer that drops white space.

    White space always ends a word, so words are encoded on their own and kept in a cache of
    bounded size; words in plain Latin letters go straight to the tokenizer's model. Only such a
    word can be cut off from the signs behind it: ``letters`` holds those and nothing else.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.cache, self.letters, self.runs = self.tokenizer.model, {}, {}, {}
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.kind = "H" if self.dtype.itemsize == 2 else "I"
        self.plain = self._is_word_model()

    def _is_word_model(self) -> bool:
        """Whether the quick way gives the tokenizer's own ids on a line with all kinds of signs."""
        probe = "Don't STOP 12 naïve-Über çà, (x1)!? Œuvre's ł|#$ 'll 'quote Ñandú ß"
        return self._quick(probe) == self.tokenizer.encode(probe, add_special_tokens=False).ids

    def _quick(self, text: str) -> list[int]:
        tokens, table = self.model.tokenize, _byte_letters()
        return [t.id for w in text.lower().split() for piece in _PIECE.findall(w)
                for t in tokens(piece if piece.isascii() else piece.encode().decode("latin-1").translate(table))]

    def _letters(self, word: bytes) -> bytes | None:
        """Ids of a word of Latin letters alone, which is one piece for the model; None for any other."""
        piece = word.decode()
        if not word.isalpha():
            piece = piece.lower()
            if not piece.isalpha() or not _PLAIN.fullmatch(piece) or not unicodedata.is_normalized("NFC", piece):
                return None
            piece = piece.encode().decode("latin-1").translate(_byte_letters())
        return array(self.kind, [t.id for t in self.model.tokenize(piece)]).tobytes()

    def _word(self, word: bytes) -> bytes:
        """Ids of a word with A-Z in lower case."""
        if self.plain and b"<|" not in word:
            body = word.rstrip(_SIGNS)
            known = self.cache if body.isalpha() else self.letters  # a word of ASCII letters is such a word itself
            found = known.get(body)
            if found is None and body:
                found = self._letters(body)
                if found is not None:
                    known[body] = found
            if found is not None:
                return found + self._signs(word[len(body):]) if len(body) < len(word) else found
        text = word.decode()
        if self.plain and b"<|" not in word and _PLAIN.fullmatch(text) and unicodedata.is_normalized("NFC", text):
            ids = self._quick(text)
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return array(self.kind, ids).tobytes()

    def _signs(self, run: bytes) -> bytes:
        """Ids of a run of signs behind letters, which is one piece for the model."""
        found = self.runs.get(run)
        if found is None:
            found = self.runs[run] = array(self.kind, self._quick(run.decode())).tobytes()
        return found

    def trim(self) -> None:
        """Keep the words met first, which are the frequent ones: a worker that waits for other work holds little memory."""
        if len(self.cache) > WAITING_WORDS:
            self.cache = dict(islice(self.cache.items(), WAITING_WORDS))
        self.letters, self.runs = {}, {}

    def encode(self, text: bytes | None) -> bytes:
        """The ids of a text; only texts with a special token's brackets keep their capitals until they are cut into words."""
        raw = text or b""
        words = (raw if b"<|" in raw else raw.lower()).split()
        if len(self.cache) + len(self.letters) + len(self.runs) > CACHED_WORDS:
            self.cache, self.letters, self.runs = {}, {}, {}
        cache, at = self.cache, -1
        found = list(map(cache.get, words))
        for _ in range(found.count(None)):
            at = found.index(None, at + 1)
            word = words[at]
            ids = cache.get(word)
            if ids is None:
                ids = cache[word] = self._word(word if b"<|" in word else word.lower())
            found[at] = ids
        return b"".join(found)


_BYTES: dict[int, str] = {}


def _byte_letters() -> dict[int, str]:
    """The letter a byte-level tokenizer writes for each byte that is not itself printable."""
    if not _BYTES:
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        for k, b in enumerate(b for b in range(256) if b not in printable):
            _BYTES[b] = chr(256 + k)
    return _BYTES


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process, kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of ranks: one to four bytes a rank, four lengths a control byte."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    more = codes[:len(ranks)]  # bytes of each rank besides the first
    more[:] = ranks > 0xFF
    wide = np.nonzero(ranks > 0xFFFF)[0]
    more[wide] = 2 + (ranks[wide] > 0xFFFFFF)
    quads = codes.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    starts = np.cumsum(more, dtype=np.int64) - more + np.arange(len(ranks))
    data = np.empty(len(ranks) + int(more.sum(dtype=np.int64)), np.uint8)
    data[starts] = ranks.astype(np.uint8)
    for k in (1, 2, 3):
        here = np.nonzero(more >= k)[0]
        data[starts[here] + k] = (ranks[here] >> np.uint32(8 * k)).astype(np.uint8)
    return control.tobytes(), data.tobytes()


_LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    lengths = _LENGTHS[control].ravel()[:n]
    starts = np.cumsum(lengths, dtype=np.int64) - lengths
    out = data[starts].astype(np.uint32)
    for k in (1, 2, 3):
        here = np.nonzero(lengths > k)[0]
        out[here] |= data[starts[here] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def write_shard(ids_by_rank: np.ndarray, doc_ids: list[int], counts: list[int], ranks: np.ndarray) -> bytes:
    control, data = pack(ranks)
    head = np.array([MAGIC, len(doc_ids), len(ranks), len(control), len(data), len(ids_by_rank)], "<i8")
    return b"".join([head.tobytes(), ids_by_rank.astype("<u4").tobytes(), np.array(doc_ids, "<i8").tobytes(), np.array(counts, "<i8").tobytes(), control, data])


def read_shard(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, token counts and all ids of a shard."""
    magic, docs, n, controls, datas, ranks = np.frombuffer(raw, "<i8", 6).tolist()
    if magic != MAGIC:
        raise ValueError("not a token shard")
    at, parts = 48, []
    for kind, size in (("<u4", ranks), ("<i8", docs), ("<i8", docs), ("u1", controls), ("u1", datas)):
        parts.append(np.frombuffer(raw, kind, size, at))
        at += size * np.dtype(kind).itemsize
    return parts[1], parts[2], parts[0][unpack(parts[3], parts[4], n)]


def slices(batch: pa.RecordBatch):
    """A batch in slices of a bounded size of its second column, which holds bytes; a longer value is one slice."""
    ends, at = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(), dtype=np.int64), 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")))
        yield batch.slice(at, end - at)
        at = end


def encoded(batches, tokenizer: str, end_id: int):
    """``doc_id, check, ids, tally`` of ``doc_id, text``; a last row holds how often the task met each id."""
    code = encoder(tokenizer)
    size = code.tokenizer.get_vocab_size()
    total, end = np.zeros(size, np.int64), np.array([end_id], code.dtype).tobytes()
    names = ["doc_id", "check", "ids", "tally"]
    for batch in (part for whole in batches for part in slices(whole)):
        texts = batch.column(1).to_pylist()
        ids = [code.encode(t) + end for t in texts]
        total += np.bincount(np.frombuffer(b"".join(ids), code.dtype), minlength=size)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([zlib.crc32(t or b"") for t in texts], pa.int64()), pa.array(ids, pa.binary()),
                                          pa.nulls(len(ids), pa.binary())], names)
    code.trim()
    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()),
                                      pa.array([total.astype("<i8").tobytes()], pa.binary())], names)


NO_ID = -(1 << 63)  # stands for a missing document id inside a shard


def write_token_files(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Shards of all texts in ascending doc_id order: ``part, seq, before, n_ids, shard``, written and read back.

    NULL is an empty text, which has the end id alone; documents without an id come first,
    rows with one id follow each other. Document ids are whole numbers of 64 bits without -2^63,
    which stands for a missing id in a shard; an id that is no number fails the job. ``path`` is the folder of the table, by default one below
    the shared scratch folder. The tokenizer file must be at ``tokenizer`` on every executor.
    """
    spark = docs.sparkSession

    wide = encoder(tokenizer).dtype.itemsize
    size = encoder(tokenizer).tokenizer.get_vocab_size()

    written = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text")).mapInArrow(
        lambda batches: encoded(batches, tokenizer, end_id), "doc_id long, check long, ids binary, tally binary"), "ids")
    rows = written.where("tally IS NULL")

    def tallied(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                total += np.frombuffer(raw, "<i8")
        seen = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["id", "n"])

    ranking = written.where("tally IS NOT NULL").select("tally").mapInArrow(tallied, "id int, n long").groupBy("id").agg(
        F.sum("n").alias("n")).orderBy(F.desc("n"), "id")
    by_rank = np.array([r["id"] for r in ranking.collect()], np.int64)  # the vocabulary at most
    rank_of = np.zeros(size, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    shared = spark.sparkContext.broadcast((by_rank, rank_of))

    kind = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("seq", T.IntegerType()), T.StructField("before", T.LongType()),
                         T.StructField("n_ids", T.LongType()), T.StructField("shard", T.BinaryType())])

    def shards(batches):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        by_rank, rank_of = shared.value
        ids, counts, pieces, held, before = [], [], [], 0, 0

        def close():
            ranks = rank_of[np.concatenate(pieces)]
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([before], pa.int64()), pa.array([held], pa.int64()),
                                               pa.array([write_shard(by_rank, ids, counts, ranks)], pa.binary())], names=list(kind.names))

        for batch in (part for whole in batches for part in slices(whole)):
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(NO_ID if doc_id is None else doc_id)
                pieces.append(np.frombuffer(raw, f"<u{wide}"))
                counts.append(len(pieces[-1]))
                held += counts[-1]
                if held >= SHARD_IDS:
                    yield close()
                    ids, counts, pieces, held, seq, before = [], [], [], 0, seq + 1, before + held
        if ids:
            yield close()

    ordered = rows.repartitionByRange("doc_id", "check").sortWithinPartitions("doc_id", "check").select("doc_id", "ids")
    found = ordered.mapInArrow(shards, kind)
    if path is None:
        return materialize(found, "shards")
    found.write.parquet(path)
    return spark.read.schema(kind).parquet(path)


def read_token_files(shards: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document of a table of shards.

    A shard's place in the corpus is the ids before it in its part, which it holds, and the ids
    of the parts before, one sum a part.
    """
    sizes = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # one row a write task
    ends = np.cumsum([0] + [r["n"] for r in sizes])
    offsets = {r["part"]: int(b) for r, b in zip(sizes, ends[:-1], strict=True)}
    shared = shards.sparkSession.sparkContext.broadcast(offsets)

    def decode(batches):
        for batch in batches:
            part, before, raws = (batch.column(i).to_pylist() for i in range(3))
            for p, start, raw in zip(part, before, raws, strict=True):
                doc_ids, counts, ids = read_shard(raw)
                ids = ids.astype("<u4")
                ends = np.cumsum(counts)
                crcs = [zlib.crc32(ids[e - c:e].tobytes()) for c, e in zip(counts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([None if d == NO_ID else d for d in doc_ids.tolist()], pa.int64()), pa.array(shared.value[p] + start + ends - counts, pa.int64()),
                    pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.select("part", "before", "shard").mapInArrow(
        decode, "doc_id long, start long, n_tokens long, ids_crc32 long")

import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tamis.llm import token_files
from tamis.llm.queries import tokenizer_path
from tests.llm import edge


@pytest.fixture(scope="module")
def direct():
    tokenizer = Tokenizer.from_file(tokenizer_path())
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


ODD = ["Don't we'll I'M", "Σίσυφος ΣΑΣ", "été İstanbul ǅ ﬁ", "<|endoftext|> <|ENDOFTEXT|>x", "a b c\x1fd\x85e", "١٢٣ 12.5e3 x²", "日本語テキスト 한국어",
       "😀👍🏽 ok", "﻿bom ​ zero", "ſtraße STRASSE ẞ", "it's'll 've 'S", "ÀÉ ŒUVRE Ĳ ŉ", "\x00\x01 ctl", "a" * 500, "__init__(self)|x|&amp;"]


def test_words_alone_give_the_ids_of_the_whole_text(spark, small, direct):
    code = token_files.Encoder(tokenizer_path())
    assert code.plain
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()] + ODD + [" ".join(ODD)]
    for text in texts:
        assert np.frombuffer(code.encode(text.encode()), code.dtype).tolist() == direct(text), text[:80]


def test_random_strings_in_any_order(direct):
    draw = random.Random(8)
    signs = ".,;:?!|@#<>()'\"-_/&%*+=~`^$[]{}\\"
    alphabet = ["a", "b", "The", "é", "ß", "日", "1", "42", "don't", "'ll", "<|", "|>", "ﬁ", "İ", "e\u0301", "\u00a0", "\u200b", "...", *signs, *signs]
    words = ["".join(draw.choice(alphabet) for _ in range(draw.randint(1, 4))) for _ in range(20_000)]
    texts = [" ".join(draw.choice(words) for _ in range(draw.randint(1, 5))) for _ in range(20_000)]
    texts += ["! !,", "wait ... then ...;", "@ @?", "a < b <| c", "word word. word; word!", "...; ..."]
    expected = [direct(t) for t in texts]
    code = token_files.Encoder(tokenizer_path())
    for order in (range(len(texts)), reversed(range(len(texts)))):
        for k in order:
            assert np.frombuffer(code.encode(texts[k].encode()), code.dtype).tolist() == expected[k], texts[k]


def test_cache_may_be_emptied_at_any_time(monkeypatch, direct):
    monkeypatch.setattr(token_files, "CACHED_WORDS", 3)
    code = token_files.Encoder(tokenizer_path())
    for text in ["one two three four five", "six Seven eight", "one six"]:
        assert np.frombuffer(code.encode(text.encode()), code.dtype).tolist() == direct(text)


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1000])
def test_packing_is_an_exact_round_trip(n):
    draw = random.Random(n)
    ranks = np.array([draw.choice([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1, draw.getrandbits(32)]) for _ in range(n)], np.uint32)
    control, data = token_files.pack(ranks)
    assert len(control) == -(-n // 4)
    assert (token_files.unpack(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n) == ranks).all()


def test_files_give_back_every_id(spark, monkeypatch, direct):
    monkeypatch.setattr(token_files, "SHARD_IDS", 40)
    docs = edge.with_clashes(edge.documents(spark)).repartition(3)
    got = token_files.read_token_files(token_files.write_token_files(docs, tokenizer_path())).collect()
    texts = sorted(((r[0], r[1]) for r in edge.ROWS), key=lambda r: (r[0] is not None, r[0] or 0))
    start, want = 0, []
    for doc_id, text in texts:
        ids = direct(text) + [1]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_frequent_ids_take_one_byte(spark):
    docs = spark.createDataFrame([(i, "the the the of of a") for i in range(50)], "doc_id long, text string")
    shards = token_files.write_token_files(docs, tokenizer_path()).collect()
    docs_, counts, ids = token_files.read_shard(bytes(shards[0].shard))
    head = np.frombuffer(bytes(shards[0].shard), "<i8", 6)
    assert head[4] == head[2] == len(ids) and counts.tolist() == [7] * len(docs_)


def test_no_rows(spark):
    assert token_files.read_token_files(token_files.write_token_files(edge.empty(spark), tokenizer_path())).count() == 0


def test_a_large_batch_is_encoded_in_slices():
    texts = [b"the quick brown fox " * 500] * 2000 + [None, b""] + [b"fox " * 1_000_000, b"the"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.binary())], ["doc_id", "text"])
    token_files.encoder(tokenizer_path()).encode(b"the quick brown fox")
    parts, sizes = list(token_files.slices(batch)), []
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert all(p.num_rows == 1 or sum(map(len, filter(None, p.column(1).to_pylist()))) <= token_files.SLICE_BYTES for p in parts)
    tracemalloc.start()
    for rows in token_files.encoded(iter([batch.slice(0, 2002)]), tokenizer_path(), 1):
        sizes.append(rows.num_rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(sizes) == 2003 and peak < 10 * token_files.SLICE_BYTES < 25_000_000  # the batch has 20 MB of texts

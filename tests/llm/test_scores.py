import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tamis import session
from tamis.llm import ctw, toxicity
from tests.llm import edge


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = toxicity.scored(docs, labels).where("held_out").join(labels, "doc_id").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.95
    assert got[got.toxic == 1].predicted.mean() > 0.85 and got[got.toxic == 0].predicted.mean() < 0.05


def test_swapped_identities_lose_their_weight():
    # feature 0: an identity term that the toxic rows mention more often; 1: its swap; 2: a toxic word
    rows = [np.array([0, 2])] * 30 + [np.array([0])] * 10 + [np.array([1])] * 40 + [np.array([], int)] * 40
    labels = np.array([1.0] * 30 + [0.0] * 90)
    pairs = [(np.array([0, 2]), np.array([1, 2]))] * 30 + [(np.array([0]), np.array([1]))] * 50
    with_pairs, bias = toxicity.train(rows, labels, pairs, 3)
    alone, bias2 = toxicity.train(rows, labels, [], 3)
    rate = lambda w, b: 1 / (1 + math.exp(-(w[0] + b)))
    assert rate(with_pairs, bias) < rate(alone, bias2)
    assert abs(with_pairs[0] - with_pairs[1]) < abs(alone[0] - alone[1])
    assert with_pairs[2] + bias > 0
    assert toxicity.swapped({"women", "say"}) == [{"men", "say"}]


def test_the_fit_ends_where_a_plain_cost_has_no_slope():
    draw = np.random.default_rng(3)
    rows = [np.flatnonzero(draw.random(8) < 0.4) for _ in range(60)]
    labels = (draw.random(60) < 0.4).astype(float)
    pairs = [(np.flatnonzero(draw.random(8) < 0.4), np.flatnonzero(draw.random(8) < 0.4)) for _ in range(25)]

    def plain(w, bias):
        score = lambda row: 1 / (1 + math.exp(-(sum(w[j] for j in row) + bias)))
        loss = -sum(math.log(score(r) if y else 1 - score(r)) for r, y in zip(rows, labels, strict=True)) / len(rows)
        gap = sum((score(a) - score(b)) ** 2 for a, b in pairs) / len(pairs)
        return loss + toxicity.RIDGE * sum(v * v for v in w) + toxicity.PENALTY * gap

    w, bias = toxicity.train(rows, labels, pairs, 8)
    best = plain(w, bias)
    for k in range(9):
        step = np.eye(9)[k] * 1e-4
        up, down = plain(w + step[:8], bias + step[8]), plain(w - step[:8], bias - step[8])
        assert abs(up - down) / 2e-4 < 1e-5 and up >= best - 1e-12 and down >= best - 1e-12


def test_pairs_come_from_sentences():
    text = "Women talk. The weather is fine!\nmuslim and gay people agree"
    pairs = [(one, two) for order, one, two in toxicity.pairs_of(text) if order < 1 << 32]
    assert pairs == [({"women", "talk"}, {"men", "talk"}), ({"muslim", "and", "gay", "people", "agree"}, {"muslim", "and", "lesbian", "people", "agree"}),
                     ({"muslim", "and", "gay", "people", "agree"}, {"christian", "and", "gay", "people", "agree"})]
    plain = "\n".join(f"sentence number {k} of this text" for k in range(2000))
    mentions = list(toxicity.pairs_of(plain))
    assert 2 * 60 < len(mentions) < 2 * 140
    assert all(len(two - one) == 1 and order >= 1 << 32 for order, one, two in mentions)
    assert list(toxicity.pairs_of(None)) == list(toxicity.pairs_of(" .\n!")) == []


def test_neutral_mentions_do_not_matter(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    # every fifth clean document that is toxic by its label names a group: the labels alone would blame the group
    blamed = docs.join(labels, "doc_id").withColumn("text", F.when((F.col("toxic") == 1) | (F.col("doc_id") % 50 == 0), F.concat("text", F.lit(" So say the muslims.")))
                                                    .otherwise(F.col("text"))).select("doc_id", "text")
    model = toxicity.fit(blamed, labels)
    assert model.n_pairs > 0 and toxicity.fit(docs, labels).n_pairs > 0
    clean = [r.text for r in docs.join(labels.where("toxic = 0"), "doc_id").limit(200).collect()]
    gaps = [abs(model.score(t + " Many women live here.") - model.score(t + " Many men live here.")) for t in clean]
    assert max(gaps) < 0.05
    toward = [model.score(t + " The muslims live here.") - model.score(t + " The christians live here.") for t in clean]
    assert sum(map(abs, toward)) / len(toward) < 0.05


def test_toxicity_edge_rows(spark):
    docs = edge.with_clashes(edge.documents(spark))
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (6, 1, None), (None, 1, 1), (77, 1, 1)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0), labels.where("toxic = 1")):
        got = toxicity.scored(docs, known).collect()
        assert len(got) == len(edge.ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    for r in got:
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0)
    assert toxicity.scored(edge.empty(spark), labels).count() == 0


def slow_ctw(train, text, codes):
    """Context-tree weighting by its definition: a recursive tree for every binary decision."""
    def steps(padded):
        for i in range(ctw.DEPTH, len(padded)):
            code, context = int(codes[padded[i]]), tuple(int(codes[padded[i - k]]) for k in range(1, ctw.DEPTH + 1))
            node = 1
            for bit in range(5, -1, -1):
                yield node, context, code >> bit & 1
                node = node * 2 + (code >> bit & 1)

    counts = {}
    for padded in train:
        for node, context, bit in steps(padded):
            for d in range(ctw.DEPTH + 1):
                counts.setdefault((node, context[:d]), [0, 0])[bit] += 1
    children = {}
    for node, context in counts:
        if context:
            children.setdefault((node, context[:-1]), []).append((node, context))

    def kt(key):
        a, b = counts[key]
        return math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)

    memo = {}

    def weighted(key):
        if key not in memo:
            memo[key] = kt(key) if len(key[1]) == ctw.DEPTH else np.logaddexp(math.log(.5) + kt(key), math.log(.5) + sum(map(weighted, children[key])))
        return memo[key]

    total = 0.0
    for node, context, bit in steps(text):
        chance, settled, open_ = 0.5, 0.0, 1.0
        for d in range(ctw.DEPTH + 1):
            key = (node, context[:d])
            if key not in counts:
                break
            a, b = counts[key]
            p = (b + .5) / (a + b + 1)
            chance = settled + open_ * p
            stop = 1.0 if d == ctw.DEPTH else math.exp(math.log(.5) + kt(key) - weighted(key))
            settled, open_ = settled + open_ * stop * p, open_ * (1 - stop)
        total += math.log10(chance if bit else 1 - chance)
    return total


@pytest.mark.parametrize("run", [50_000, 3])
def test_scores_match_the_definition(spark, monkeypatch, run):
    monkeypatch.setattr(ctw, "RUN_ROWS", run)
    if run == 3:  # many questions, segments and copies of a group
        for name, value in (("ASK_ROWS", 4), ("SCORE_BYTES", 9), ("SALT_BYTES", 8)):
            monkeypatch.setattr(ctw, name, value)
    texts = ["the cat sat on the mat", "The dog sat", "a cat and a dog", "dogs sat on cats", "", "the the the cat", "sat at that"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    train = [ctw._padded(ctw.tokens_of(t.encode())) for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 10]
    seen = np.bincount(np.frombuffer(b"".join(t[ctw.DEPTH:] for t in train), np.uint8), minlength=256)
    codes = np.full(256, 63)
    codes[np.argsort(-seen, kind="stable")[:63]] = np.arange(63)
    for r in ctw.scored(docs).collect():
        assert r.score == pytest.approx(slow_ctw(train, ctw._padded(ctw.tokens_of(texts[r.doc_id].encode())), codes), abs=1e-4)


def test_the_model_is_a_distribution(spark, small):
    model = ctw.fit(spark.read.parquet(f"{small}/documents.parquet"))
    groups = [tuple(r) for r in model.groups.orderBy("triple").limit(40).collect()]
    known = np.concatenate([(np.int64(t) << ctw.SUFFIX | np.frombuffer(k, np.int32)) >> ctw.BITS for t, k, _ in groups])
    context = np.concatenate([known, known ^ 1, known ^ (1 << 12)])  # known ones, and others with a known ending at most
    gram = (context[:, None] << ctw.BITS | np.arange(ctw.CODES)).ravel()
    of = {t for t, _, _ in groups}
    assert set((gram >> ctw.SUFFIX).tolist()) <= of
    assert np.allclose((10.0 ** ctw.answers(model.pairs, groups, gram)).reshape(-1, ctw.CODES).sum(1), 1)
    rare = model.codes == ctw.ESCAPE
    assert (10.0 ** model.escape[rare]).sum() == pytest.approx(1)


@pytest.mark.parametrize("top", [300_000, 5])
def test_base_scores_match_brute_force(spark, small, monkeypatch, top):
    monkeypatch.setattr(ctw, "MAX_WORDS", top)
    docs = spark.read.parquet(f"{small}/documents.parquet").unionByName(edge.documents(spark).where("doc_id IN (3, 4, 7) OR doc_id IS NULL"))
    rows = docs.collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    tokens = [(r.text or "").encode().lower().split() + [b"\n"] for r in rows]
    counts = Counter(t for r, ts in zip(rows, tokens, strict=True) if not held(r.doc_id) for t in ts)
    total, size = sum(counts.values()), len(counts)
    want = sorted(((r.doc_id, held(r.doc_id), len(ts), sum(t in counts for t in ts), total,
                    round(sum(math.log10((counts[t] + .1) / (total + .1 * (size + 1))) for t in ts), 6)) for r, ts in zip(rows, tokens, strict=True)), key=repr)
    got = ctw.scored(edge.with_clashes(docs)).withColumn("base_score", F.round("base_score", 6))
    assert edge.rows(got.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")) == want
    assert got.where("NOT score < 0").count() == 0


def test_no_rows_and_no_training_rows(spark):
    assert ctw.scored(edge.empty(spark)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = ctw.scored(spark.createDataFrame([(held, "abc def")], "doc_id long, text string")).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and r.score < 0


def test_ctw_words_of_many_tasks_are_counted_once(spark):
    words = [f"w{i * 7919 % 9973}x{i}" for i in range(9000)]
    texts = spark.createDataFrame([(" ".join(words[k::2] if k % 3 else words).encode(),) for k in range(2) for _ in range(6)], "text binary").repartition(12)
    had = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "997")
    try:
        counts = ctw.counts_of(texts, np.zeros(256, np.uint8)).where("word IS NOT NULL").select("word", "n").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", had)
    assert len(counts) == 9000
    assert {bytes(r.word): r.n for r in counts} == {w.encode(): 6 + 6 * (i % 2) for i, w in enumerate(words)}


def test_ctw_counts_are_added_up_in_shares_of_whole_groups(monkeypatch):
    monkeypatch.setattr(ctw, "MERGED_ROWS", 640)
    draw = np.random.default_rng(3)
    parts = [(np.unique(draw.integers(0, 40, n) << ctw.SUFFIX | draw.integers(0, 5000, n)), n) for n in (9000, 7000, 10)]
    parts = [(keys, np.full(len(keys), n)) for keys, n in parts]
    shares = [ctw._merged(s) for s in ctw._shares(parts)]
    assert 10 < len(shares) and max(len(k) for k, _ in shares) < 2000
    triples = [set((k >> ctw.SUFFIX).tolist()) for k, _ in shares]
    assert sum(map(len, triples)) == len(set().union(*triples))
    for got, want in zip(map(np.concatenate, zip(*shares, strict=True)), ctw._merged(parts), strict=True):
        assert np.array_equal(got, want)


def test_ctw_grams_take_little_memory():
    text, lengths = np.zeros(1_000_000, np.uint8), np.full(1000, 1000)
    tracemalloc.start()
    ctw.grams(text, lengths, ctw.BITS)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 * len(text)


def test_ctw_gaps_give_the_numbers_back():
    size = np.array([3, 1, 2])
    low = np.array([0, 5, 9, 7, 1, 1 << 23], np.int32)
    assert ctw.gaps(size, low).tolist() == [0, 5, 4, 7, 1, (1 << 23) - 1]
    assert ctw.from_gaps(size, ctw.gaps(size, low)).tolist() == low.tolist()


def test_ctw_grams_of_a_piece_are_shifted_slices():
    draw = np.random.default_rng(5)
    lengths = np.array([7, 30, 8, 7, 400])
    text = draw.integers(0, ctw.CODES, lengths.sum()).astype(np.uint8)
    want = [sum(int(text[i - k]) << ctw.BITS * (ctw.DEPTH + 1 - k) for k in range(1, ctw.DEPTH + 1)) | int(text[i])
            for end, n in zip(np.cumsum(lengths).tolist(), lengths.tolist(), strict=True) for i in range(end - n + ctw.DEPTH, end)]
    assert ctw.grams(text, lengths, ctw.BITS).tolist() == want
    text, lengths = np.zeros(1_000_000, np.uint8), np.full(1000, 1000)
    tracemalloc.start()
    ctw.grams(text, lengths, ctw.BITS)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 * len(text)


def test_ctw_questions_take_three_bytes_a_gram():
    low = np.array([0, 1, 255, 256, 65_536, (1 << ctw.SUFFIX) - 1], np.int32)
    rows = ctw.packed_rows(np.array([2, 4]), ctw.narrow(low)).to_pylist()
    assert [len(r) for r in rows] == [6, 12]
    assert ctw.wide(b"".join(rows)).tolist() == low.tolist()


def peak_of(call):
    tracemalloc.start()
    result = call()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return result, peak


def test_ctw_answers_take_little_memory_beside_the_trees():
    draw = np.random.default_rng(11)
    low = np.unique(draw.integers(0, 1 << ctw.SUFFIX, 500)).astype(np.int32)
    groups = [(77, low.tobytes(), np.ones(len(low), np.int64).tobytes())]
    pairs = tuple(draw.random((ctw.CODES**ctw.SHORT, ctw.NODES)) / 2 for _ in range(3))
    gram = np.int64(77) << ctw.SUFFIX | np.sort(np.concatenate([draw.choice(low, 200_000), draw.integers(0, 1 << ctw.SUFFIX, 200_000)]))
    logs, peak = peak_of(lambda: ctw.answers(pairs, groups, gram))
    assert peak < 80 * len(gram)
    assert np.array_equal(logs[::20_000], np.concatenate([ctw.answers(pairs, groups, gram[k:k + 1]) for k in range(0, len(gram), 20_000)]))


def test_ctw_sums_of_a_piece_take_little_memory(monkeypatch):
    draw = np.random.default_rng(12)
    lengths = np.array([*draw.integers(ctw.DEPTH + 1, 3000, 700), ctw.DEPTH + 1])
    text = draw.choice(ctw.CODES, lengths.sum(), p=draw.dirichlet(np.full(ctw.CODES, .2))).astype(np.uint8)
    triple, size, low = ctw.distinct_grams(text, lengths)
    gram = np.repeat(triple.astype(np.int64), size) << ctw.SUFFIX | ctw.from_gaps(size, low)
    assert np.array_equal(gram, np.unique(ctw.grams(text, lengths, ctw.BITS)))
    logs = -draw.random(len(gram)).astype(np.float32)
    row = np.repeat(np.arange(len(lengths)), lengths - ctw.DEPTH)
    want = np.bincount(row, logs[np.searchsorted(gram, ctw.grams(text, lengths, ctw.BITS).view(np.int64))], len(lengths))
    got, peak = peak_of(lambda: ctw.piece_scores(text, lengths, logs))
    assert np.allclose(got, want) and peak < 14 * len(text) + 4_000_000
    monkeypatch.setattr(ctw, "STEP_ROWS", 7)
    assert np.allclose(ctw.piece_scores(text[:lengths[:3].sum()], lengths[:3], logs_of(gram, logs, text, lengths[:3])), want[:3])


def logs_of(gram, logs, text, lengths):
    """The logs of the distinct grams of the first segments."""
    return logs[np.searchsorted(gram, np.unique(ctw.grams(text[:lengths.sum()], lengths, ctw.BITS)).view(np.int64))]


def test_texts_come_in_small_batches_and_the_setting_is_put_back(spark):
    had = spark.conf.get(session.ARROW_KEY)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    texts = spark.range(400, numPartitions=1).select(F.repeat(F.lit("x"), 1000).alias("text"))
    with pytest.raises(ZeroDivisionError), session.arrow_batches(spark, 100_000):
        assert 4 <= texts.mapInArrow(sizes, "n long").count() <= 5
        raise ZeroDivisionError
    assert spark.conf.get(session.ARROW_KEY) == had

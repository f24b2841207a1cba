"""Roles and turns of chat transcripts by a hidden Markov model over their lines.

A line shows a speaker marker or none, a blank line before it or none, and a length. States are
the first line and the further lines of a turn of each role. Long conversations are decoded in
blocks: every block is summed up as a table of best scores between its ends, the blocks'
tables are chained, and then every block is decoded on its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tamis.operators.ranking import global_rank
from tamis.session import materialize

ROLES = ["system", "user", "assistant"]
STATES = 2 * len(ROLES)  # first lines, then further lines
MARKER = "^[ \\t]*[\\[<#*(]*[ \\t]*([A-Za-z]{1,20})[ \\t]*[\\]>*)]*[ \\t]*(:|\\]|>|\\)|$)[ \\t\\]>*]*"
MAX_MARKERS = 500
BLOCK_LINES = 4096


def marker_word(text: Column) -> Column:
    return F.lower(F.regexp_extract(text, MARKER, 1))


def observed(lines: DataFrame) -> DataFrame:
    """All lines, written and numbered in order by ``line_no``, with a ``key`` for each conversation and the features of each line.

    ``line_no`` of the input is any value with an order; lines of one place are ordered by text and
    all stay. Numbers run on through all conversations, so any block of them has a bounded size,
    whatever the length of a conversation. Lines without a conv_id belong together only if they
    share a ``talk``, a column that may name the conversation of such lines.
    """
    rows = lines.withColumn("talk", F.monotonically_increasing_id()) if "talk" not in lines.columns else lines
    key = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.concat(F.lit("t"), F.col("talk").cast("string")))
    rows = rows.select(key.alias("key"), "conv_id", F.col("line_no").alias("place"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce("blank_before", F.lit(False)).alias("blank_before"),
                       *([F.col("state")] if "state" in lines.columns else []))
    rows = rows.withColumns({
        "marker": marker_word(F.col("text")), "blank": F.col("blank_before").cast("int"),
        "length": sum((F.char_length("text") >= n).cast("int") for n in (1, 40, 400))})
    return global_rank(rows, [F.col("key"), F.col("place"), F.col("text"), F.col("blank_before")], "line_no").drop("place", "blank_before")


@dataclass
class Hmm:
    start: np.ndarray
    step: np.ndarray
    markers: dict[str, int]
    by_marker: np.ndarray
    by_blank: np.ndarray
    by_length: np.ndarray

    def emissions(self, marker: list[str], blank: list[int], length: list[int]) -> np.ndarray:
        """Log chances ``[line, state]``."""
        known = [self.markers.get(m, 1 if m else 0) for m in marker]
        return self.by_marker[:, known].T + self.by_blank[:, blank].T + self.by_length[:, length].T


def fit(lines: DataFrame) -> Hmm:
    """The model from ``observed`` lines with a ``state``; counts alone reach the driver, plus-half smoothed.

    Markers beyond the MAX_MARKERS most frequent ones, and markers never seen, share a class.
    Without labelled lines all chances are even and the first marker words decide nothing.
    A line behind one without a state is neither a start nor a step.
    """
    numbered, lines = lines, lines.where(F.col("state").isNotNull())
    words = [r["marker"] for r in lines.where("marker <> ''").groupBy("marker").count().where("count >= 5").orderBy(F.desc("count"), "marker").limit(MAX_MARKERS).collect()]
    markers = {w: i + 2 for i, w in enumerate(words)}
    tables = [np.full((STATES, n), 0.5) for n in (len(markers) + 2, 2, 4)]
    class_of = F.when(F.col("marker") == "", "").when(F.col("marker").isin(words), F.col("marker")).otherwise("?")
    for r in lines.groupBy("state", class_of.alias("m"), "blank", "length").count().collect():  # 6 x 502 x 2 x 4 rows at most
        for table, at in zip(tables, (markers.get(r["m"], 1 if r["m"] else 0), r["blank"], r["length"]), strict=True):
            table[r["state"], at] += r["count"]
    start, step = np.full(STATES, 0.5), np.full((STATES, STATES), 0.5)
    earlier = numbered.select("key", (F.col("line_no") + 1).alias("line_no"), F.col("state").alias("before"), F.lit(True).alias("goes_on"))
    pairs = lines.select("key", "line_no", "state").join(earlier, ["key", "line_no"], "left")  # even, however long a conversation is
    for r in pairs.groupBy("state", "before", "goes_on").count().collect():  # 48 rows at most
        if r["goes_on"] is None:
            start[r["state"]] += r["count"]
        elif r["before"] is not None:
            step[r["before"], r["state"]] += r["count"]
    start[len(ROLES):] = 1e-3
    log = lambda t: np.log(t / t.sum(-1, keepdims=True))
    return Hmm(log(start), log(step), markers, *map(log, tables))


def block_table(step: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Best score of a way through the lines, ``[state before the block, state at its end]``."""
    best = step + lines[0]
    for e in lines[1:]:
        best = (best[:, :, None] + step).max(1) + e
    return best


def chain(start: np.ndarray, first: np.ndarray, tables: list[np.ndarray]) -> list[int]:
    """The best state at the end of every block; ``first`` are the best scores at the end of the first one."""
    scores = [first]
    for table in tables:
        scores.append((scores[-1][:, None] + table).max(0))
    state, out = int(scores[-1].argmax()), []
    for k in range(len(scores) - 1, -1, -1):
        out.append(state)
        if k:
            state = int((scores[k - 1] + tables[k - 1][:, state]).argmax())
    return out[::-1]


def viterbi(entry: np.ndarray, step: np.ndarray, lines: np.ndarray, end: int | None = None) -> list[int]:
    """Best states of the lines after entry scores of the first one, ending in ``end`` if given."""
    best, back = entry + lines[0], []
    for e in lines[1:]:
        ways = best[:, None] + step
        back.append(ways.argmax(0))
        best = ways.max(0) + e
    state = int(best.argmax()) if end is None else end
    out = [state]
    for b in reversed(back):
        state = int(b[state])
        out.append(state)
    return out[::-1]


def decoded(lines: DataFrame, model: Hmm, block_lines: int = BLOCK_LINES) -> DataFrame:
    """``key, line_no, role, turn`` of every ``observed`` line; no block has more than ``block_lines`` of them."""
    shared = lines.sparkSession.sparkContext.broadcast(model)
    blocks = lines.groupBy("key", F.floor(F.col("line_no") / block_lines).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("line_no", "marker", "blank", "length"))).alias("o"))
    opening = lines.groupBy("key").agg(F.floor(F.min("line_no") / block_lines).alias("block")).withColumn("first", F.lit(True))
    blocks = materialize(blocks.join(opening, ["key", "block"], "left").select(
        "key", "block", *[F.col(f"o.{c}").alias(c) for c in ("line_no", "marker", "blank", "length")], F.col("first").isNotNull().alias("opens")), "blocks")

    def sum_up(batches):
        for batch in batches:
            m, tables = shared.value, []
            for marker, blank, length, opens in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                e = m.emissions(marker, blank, length)
                if opens:
                    best = m.start + e[0]
                    for x in e[1:]:
                        best = (best[:, None] + m.step).max(0) + x
                    tables.append(best.tolist())
                else:
                    tables.append(block_table(m.step, e).ravel().tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tables, pa.list_(pa.float64()))], names=["key", "block", "scores"])

    sums = blocks.select("key", "block", "marker", "blank", "length", "opens").mapInArrow(sum_up, "key string, block long, scores array<double>")

    def chained(batches):
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for key, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ends = chain(shared.value.start, np.array(rows[0]["scores"]), [np.array(r["scores"]).reshape(STATES, STATES) for r in rows[1:]])
                for k, (r, end) in enumerate(zip(rows, ends, strict=True)):
                    for column, x in zip(out, (key, r["block"], ends[k - 1] if k else -1, end), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.int32(), pa.int32()), strict=True)],
                                             names=["key", "block", "entry", "exit"])

    ends = sums.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("block", "scores"))).alias("blocks")).mapInArrow(
        chained, "key string, block long, entry int, exit int")

    def decode(batches):
        for batch in batches:
            m, states = shared.value, []
            for marker, blank, length, entry, end in zip(*(batch.column(i).to_pylist() for i in range(3, 8)), strict=True):
                e = m.emissions(marker, blank, length)
                states.append(viterbi(m.start if entry < 0 else m.step[entry], m.step, e, end))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(states, pa.list_(pa.int32()))], names=["key", "block", "line_no", "states"])

    paths = materialize(blocks.join(ends, ["key", "block"]).select("key", "block", "line_no", "marker", "blank", "length", "entry", "exit").mapInArrow(
        decode, "key string, block long, line_no array<long>, states array<int>"), "paths")
    starts = paths.select("key", "block", F.size(F.filter("states", lambda s: s < len(ROLES))).alias("n"))  # two numbers a block
    before = F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.sum((F.col("x.states") < len(ROLES)).cast("int")).over(Window.partitionBy("key", "block").orderBy("place"))
    flat = paths.join(starts.select("key", "block", before.alias("before")), ["key", "block"]).select(
        "key", "block", "before", F.posexplode(F.arrays_zip("line_no", "states")).alias("place", "x"))
    role = F.element_at(F.array(*map(F.lit, ROLES)), F.col("x.states") % len(ROLES) + 1)
    return flat.select("key", F.col("x.line_no").alias("line_no"), role.alias("role"), F.greatest(F.col("before") + inside - 1, F.lit(0)).alias("turn"))


def rendered(lines: DataFrame, model: Hmm, block_lines: int = BLOCK_LINES) -> DataFrame:
    """``conv_id, turn, role, n_lines, text, rendered`` for every turn of ``lines(conv_id, line_no, text, blank_before)``.

    ``text`` is the turn without its marker, ``rendered`` the same between a role tag and an end tag.
    A NULL text is an empty line and a NULL line number comes first; lines of one place follow each
    other, ordered by text, and rows given twice are two lines. Each line without a conv_id is a conversation of
    its own, unless a column ``talk`` names the conversation of such lines. Tables without rows give none, other columns are not read.
    """
    return _rendered(observed(lines), model, block_lines)


def _rendered(rows: DataFrame, model: Hmm, block_lines: int) -> DataFrame:
    known = F.col("marker").isin(list(model.markers))
    first = F.row_number().over(Window.partitionBy("key", "turn").orderBy("line_no")) == 1
    both = rows.join(decoded(rows, model, block_lines), ["key", "line_no"]).withColumn("first", first)
    clean = F.when(F.col("first") & known, F.regexp_replace("text", MARKER, "")).otherwise(F.col("text"))
    turns = both.groupBy("key", "turn").agg(
        F.first("conv_id").alias("conv_id"), F.min(F.when(F.col("first"), F.col("role"))).alias("role"), F.count("*").alias("n_lines"),
        F.sort_array(F.collect_list(F.struct("line_no", clean.alias("text")))).alias("all"))
    text = F.trim(F.array_join(F.col("all.text"), "\n"), F.lit(" \n"))
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "n_lines", text.alias("text"),
                        F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), text, F.lit("<|end|>")).alias("rendered"))


def as_transcripts(conversations: DataFrame) -> DataFrame:
    """The lines of transcripts as people write them down, from a table of turns, with the true states.

    Each conversation has one way to mark speakers; one turn in twenty has no marker, and a
    blank line stands before most turns. The place of a line is its turn, the turn's hash, its row
    and its number in the row: rows of one conversation and turn, equal ones as well, stay apart as turns of
    their own. A row without conv_id is a conversation (``talk``), a NULL turn comes first, a NULL text is an empty one,
    a NULL role a user's; lines of roles other than ROLES have no true state. Tables without rows give none.
    """
    style = F.pmod(F.xxhash64("conv_id"), F.lit(4))
    bare = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(20)) == 0
    role = F.lower(F.coalesce("role", F.lit("user")))
    names = {"user": ["User", "Human", "Q", "Customer"], "assistant": ["Assistant", "AI", "A", "Agent"], "system": ["System", "System", "Note", "System"]}
    name = F.lit("Speaker")
    for r, forms in names.items():
        name = F.when(role == r, F.element_at(F.array(*map(F.lit, forms)), (style + 1).cast("int"))).otherwise(name)
    mark = F.when(bare, "").when(style == 1, F.concat(F.lit("["), name, F.lit("] "))).otherwise(F.concat(name, F.lit(": ")))
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    at = F.array_position(F.array(*map(F.lit, ROLES)), role).cast("int") - 1
    flat = conversations.select("conv_id", "turn", F.monotonically_increasing_id().alias("talk"), F.xxhash64("role", "text").alias("hash"),
                                mark.alias("mark"), at.alias("at"), bare.alias("bare"), F.posexplode(lines).alias("sub", "line"))
    opens = F.col("sub") == 0
    return flat.select(
        "conv_id", "talk", F.struct("turn", "hash", "talk", "sub").alias("line_no"), F.when(opens, F.concat("mark", "line")).otherwise(F.col("line")).alias("text"),
        (opens & (F.pmod(F.xxhash64("conv_id", "turn", F.lit(1)), F.lit(10)) != 0)).alias("blank_before"),
        F.when(F.col("at") >= 0, F.col("at") + F.when(opens, 0).otherwise(len(ROLES))).alias("state"))


def in_training(conv_id: Column) -> Column:
    return F.crc32(F.coalesce(conv_id.cast("string"), F.lit("")).cast("binary")) % 5 != 0


def recovered(conversations: DataFrame) -> DataFrame:
    """Turns recovered from the transcripts of ``conversations``, with a model of the training ones.

    Rows are taken as ``as_transcripts`` says, so no turn is joined with another by its place
    alone; without training rows the roles are guesses, and all lines come back all the same.
    """
    rows = observed(as_transcripts(conversations))
    model = fit(rows.where(in_training(F.col("conv_id"))))
    turns = _rendered(rows.drop("state"), model, BLOCK_LINES)
    return turns.withColumn("held_out", ~in_training(F.col("conv_id")))

"""Enrichment by an external service: whole texts in pieces, rounds of retries, error codes, dead letters."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tamis.functions.answers import parse_translation, request_fault
from tamis.functions.text import MAX_REQUEST_CHARS
from tamis.session import discard, materialize, scratch_path

# Limits of the external service.
MAX_ATTEMPTS = 3
MAX_IN_FLIGHT = 4
PAUSE_SECONDS = 0.5
SHOWN_BODY_CHARS = 300  # of a refused answer's body, for diagnosis only

CHUNK_PIECES = 50_000  # pieces sent between two entries in the ledger

PART_PIECES = 20_000  # pieces of one task when they are dealt by digest

# Called with the text and the attempt number (from 1); returns HTTP status and body.
Send = Callable[[str, int], tuple[int, str]]
LEDGER = "digest string, attempt int, translated string, error string"


def _one_try(pieces: DataFrame, send: Send, in_flight: int) -> DataFrame:
    """Sends every piece once: ``digest, attempt, text, status, body, broken``; ``broken`` names what kept an answer away."""

    def post(text: str, attempt: int) -> tuple[int | None, str, str]:
        try:
            return *send(text, attempt), ""
        except Exception as problem:
            kind = "timeout" if isinstance(problem, TimeoutError) else "client_error" if isinstance(problem, OSError) else "unexpected_error"
            return None, str(problem), kind

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(in_flight) as pool:
            for batch in batches:
                found = list(pool.map(post, batch["text"], batch["attempt"].tolist()))
                answers = pd.DataFrame(found, columns=["status", "body", "broken"], index=batch.index).astype({"status": "Int32"})
                yield pd.concat([batch, answers], axis=1)

    return pieces.select("digest", "attempt", "text").mapInPandas(run, "digest string, attempt int, text string, status int, body string, broken string")


class Ledger:
    """What has been sent: a row for each try of a piece, by the piece's digest, in a shared folder.

    Tries are added by whole written jobs, so one that fails half-way leaves no trace, and a run
    that starts anew goes on after the last one.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def exists(self) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def tries(self) -> DataFrame:
        if not self.exists():
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).parquet(self.path).select("digest", "attempt", "translated", "error")

    def state(self) -> DataFrame:
        """``digest, tries, ok``: how often each piece has been sent, and whether the last try was answered; no text is read."""
        last = self.tries().groupBy("digest").agg(F.max(F.struct("attempt", (F.col("error") == "").alias("ok"))).alias("last"))
        return last.select("digest", F.col("last.attempt").alias("tries"), "last.ok")

    def last(self) -> DataFrame:
        """``digest, attempt, translated, error`` of each piece's last try."""
        order = [F.desc("attempt"), F.desc(F.col("error") == ""), F.desc("translated"), F.desc("error")]
        place = F.row_number().over(Window.partitionBy("digest").orderBy(*order))
        return self.tries().withColumn("place", place).where("place = 1").drop("place")

    def add(self, tried: DataFrame) -> tuple[str, int, int]:
        """Write tries down, failed ones with their text; where, how many there were and how many failed.

        They are counted in what has been written, so a task that ran twice counts once. (An
        observation of the write would count them too, but a session that has had one can no
        longer train forests: their tasks take the session along, which then does not serialize.)
        """
        part = f"{self.path}/part={uuid.uuid4().hex}"
        tried.select("digest", "attempt", "translated", "error", F.when(F.col("error") != "", F.col("text")).alias("text")).write.parquet(part)
        row = self.spark.read.schema(LEDGER).parquet(part).agg(F.count("*").alias("sent"), F.count_if(F.col("error") != "").alias("failed")).first()
        return part, row["sent"], row["failed"]

    def again(self, parts: list[str], attempts: int) -> DataFrame:
        """``digest, text, attempt`` of the failed tries in some parts that have one left; they are read where they lie."""
        failed = self.spark.read.schema(f"{LEDGER}, text string").parquet(*parts).where((F.col("error") != "") & (F.col("attempt") < attempts))
        return failed.select("digest", "text", (F.col("attempt") + 1).alias("attempt"))


def outcome() -> tuple[Column, Column]:
    """Translation and error of one try; an error is its code, a colon and what was seen."""
    translated, fault = parse_translation(F.col("body"))
    shown = F.substring("body", 1, SHOWN_BODY_CHARS)
    error = (F.when(F.col("broken") != "", F.concat_ws(": ", "broken", F.when(shown != "", shown)))
             .when(F.col("status") != 200, F.concat(F.lit("http_"), F.col("status").cast("string"), F.lit(": "), shown))
             .when(fault != "", F.concat(fault, F.lit(": "), shown)).otherwise(""))
    return F.when(error == "", translated).otherwise(""), error


def enrich(df: DataFrame, send: Send, doc_id: str, label: str, text: str, *, attempts: int = MAX_ATTEMPTS,
           in_flight: int = 1, pause: float = PAUSE_SECONDS, tasks: int = MAX_IN_FLIGHT,
           piece_chars: int = MAX_REQUEST_CHARS, ledger: str | None = None, chunk_pieces: int = CHUNK_PIECES,
           report: Callable[[dict], None] | None = None) -> DataFrame:
    """``(doc_id, label, translated, error, attempts)`` for every row.

    A text is sent whole, in consecutive pieces of at most ``piece_chars``, and its answers are joined; one
    failed piece fails the row. Equal pieces are sent once. ``tasks * in_flight`` bounds the requests under
    way in the whole job. Only pieces that failed are sent again, after a growing pause.

    Every try is written to ``ledger``, a folder, after each chunk of pieces; a run with the same
    folder sends only what has no answer there and has not failed ``attempts`` times. After each
    chunk ``report`` gets ``round, chunk, chunks, sent, failed`` with the totals so far.
    """
    spark = df.sparkSession
    book = Ledger(spark, ledger or scratch_path(spark, "ledger"))
    rows = df.select(F.col(doc_id).alias("__id"), F.col(label).alias("__label"), F.col(text).alias("__text")).withColumn("row", F.monotonically_increasing_id())
    starts = F.sequence(F.lit(0), F.floor((F.char_length("__text") - 1) / piece_chars).cast("int"))
    cut = F.transform(starts, lambda k: F.substring("__text", k * piece_chars + 1, F.lit(piece_chars)))
    fault = request_fault(F.col("__text"))
    # A row that must not be sent is one without a piece.
    pieces = rows.select("row", "__id", "__label", fault.alias("__fault"), F.posexplode_outer(F.when(fault == "", cut)).alias("piece", "text"))
    pieces = materialize(pieces.withColumn("digest", F.sha2("text", 256)), "pieces")
    sendable = pieces.where("digest IS NOT NULL")
    translated, error = outcome()
    # Texts are dealt by digest once; later rounds read the failed tries where they have been written.
    parts = max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sendable.count() // PART_PIECES))
    waiting = sendable.select("digest", "text").repartition(parts, "digest").dropDuplicates(["digest"]).withColumn("attempt", F.lit(1))
    if book.exists():
        known = book.state()
        waiting = waiting.join(known, "digest", "left").where((~F.coalesce("ok", F.lit(False))) & (F.coalesce("tries", F.lit(0)) < attempts)).select(
            "digest", "text", (F.coalesce("tries", F.lit(0)) + 1).cast("int").alias("attempt"))
    first = waiting = materialize(waiting, "waiting")
    sent = failed = turn = 0
    while count := waiting.count():
        if turn:
            time.sleep(pause * turn)
        turn, chunks, written = turn + 1, -(-count // chunk_pieces), []
        for chunk in range(chunks):
            part = waiting.where(F.pmod(F.xxhash64("digest"), F.lit(chunks)) == chunk).coalesce(tasks)
            done = book.add(_one_try(part, send, in_flight).withColumns({"translated": translated, "error": error}))
            written.append(done[0])
            sent, failed = sent + done[1], failed + done[2]
            if report:
                report({"round": turn, "chunk": chunk + 1, "chunks": chunks, "sent": sent, "failed": failed})
        waiting = book.again(written, attempts)
    discard(first)
    ended = sendable.select("row", "piece", "digest").join(book.last(), "digest")
    whole = ended.groupBy("row").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "translated"))), lambda p: p["translated"]), "").alias("joined"),
        F.min(F.when(F.col("error") != "", F.struct("piece", "error")))["error"].alias("error"), F.max("attempt").alias("attempts"))
    heads = pieces.where("coalesce(piece, 0) = 0").select("row", "__id", "__label", "__fault")
    return heads.join(whole, "row", "left").select(
        F.col("__id").alias(doc_id), F.col("__label").alias(label), F.when(F.coalesce("error", "__fault") == "", F.coalesce("joined", F.lit(""))).otherwise("").alias("translated"),
        F.coalesce("error", "__fault").alias("error"), F.coalesce("attempts", F.lit(0)).alias("attempts"))


def progress(written: DataFrame) -> DataFrame:
    """Processed and failed rows of a written result; repeated tasks are not counted twice."""
    return written.agg(F.count("*").alias("processed"), F.count_if(F.col("error") != "").alias("failed"))


def error_code(error: str = "error"):
    """The code in front of an error's details."""
    return F.split_part(F.col(error), F.lit(":"), F.lit(1))


def split_dead_letters(enriched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Answered and failed rows. The requests run once: the result is written by outcome."""
    written = materialize(enriched.withColumn("failed", F.col("error") != ""), "enriched", ["failed"])
    answered = written.where(~F.col("failed")).drop("failed", "error")
    return answered, written.where("failed").drop("failed", "translated")

"""Quality rules for texts and hosts, with built-in expressions only.

A document fails by its own text; a host fails when the failure rate of its documents, shrunk
towards the rate of all hosts by a beta prior fitted to them, is above a limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import let, own_name
from tamis.operators.joins import fits_broadcast, lookup
from tamis.session import materialize

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
WINDOW = 5
FEW_REJECTED_HOSTS = 10_000  # up to so many rejected hosts are broadcast, beyond them the join is shuffled
HOST_LIMIT = 0.5


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")


def _covered(hashes: Column, n_words: Column) -> Column:
    """Words inside windows whose hash occurs twice or more.

    Only texts with a repeated window pay for the sort: equal windows become neighbours,
    their places are sorted again, and each place adds the words up to the next one.
    """
    def places(pairs: Column) -> Column:
        def repeated(pair: Column, k: Column) -> Column:
            before = (k > 0) & (F.element_at(pairs, F.greatest(k, F.lit(1)))["hash"] == pair["hash"])
            after = (k + 1 < F.size(pairs)) & (F.element_at(pairs, F.least(k + 2, F.size(pairs)))["hash"] == pair["hash"])
            return before | after
        return F.array_sort(F.transform(F.filter(pairs, repeated), lambda pair: pair["place"]))

    def words(sorted_places: Column) -> Column:
        steps = F.transform(sorted_places, lambda p, k: F.least(F.lit(WINDOW), F.when(
            k + 1 < F.size(sorted_places), F.element_at(sorted_places, F.least(k + 2, F.size(sorted_places))) - p).otherwise(WINDOW)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, s: total + s)

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("hash"), i.alias("place"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(let(pairs, places), words))


def _windows(words: Column) -> Column:
    """One hash for each window of five words; none for shorter texts."""
    return F.when(F.size(words) >= WINDOW, F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - WINDOW + 1, F.lit(1))),
                  lambda i: F.xxhash64(*[F.element_at(words, i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))


def measure(text: Column) -> Column:
    """A struct of the measures of one text; NULL counts as empty."""
    text = F.coalesce(text, F.lit(""))
    solid = F.translate(text, SPACES, "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike("[^ \\t-\\r]"))
    counted = let(words_of(text), lambda words: F.struct(
        F.size(words).cast("long").alias("n_words"),
        let(_windows(words), lambda h: _covered(h, F.size(words))).alias("n_repeat_words")))
    return let(counted, lambda c: F.struct(
        c["n_words"].alias("n_words"), F.char_length(solid).cast("long").alias("word_chars"),
        let(solid, lambda s: F.char_length(s) - F.char_length(F.translate(s, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"),
        c["n_repeat_words"].alias("n_repeat_words"),
        ((c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])).alias("base_failed")))


def measured(docs: DataFrame, text: str = "text", into: str = "measures") -> DataFrame:
    return docs.withColumn(into, measure(F.col(text).cast("string")))


def host_rates(rows: DataFrame, host: str, failed: str) -> DataFrame:
    """``host, n, n_failed, rate``: the shrunk failure rate of every host with a name.

    The prior's mean is the mean of the hosts' rates; its weight comes from their spread
    beyond what their sizes explain (method of moments), kept between 1 and 1e6. With one
    host, or hosts that do not differ, the weight is the upper bound.
    """
    counts = rows.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(
        F.count("*").alias("n"), F.sum(F.col(failed).cast("long")).alias("n_failed"))
    counts = materialize(counts, "hosts")
    raw = counts.withColumn("raw", F.col("n_failed") / F.col("n"))
    prior = raw.agg(F.avg("raw").alias("mean"), F.var_samp("raw").alias("spread"), F.avg(1 / F.col("n")).alias("small"))
    chance = F.col("mean") * (1 - F.col("mean"))
    beyond = F.col("spread") - chance * F.col("small")
    weight = F.when(beyond > 0, F.least(F.greatest(chance / beyond - 1, F.lit(1.0)), F.lit(1e6))).otherwise(F.lit(1e6))
    found = prior.select("mean", weight.alias("weight")).first()  # one row
    mean, strength = (found["mean"], found["weight"]) if found["mean"] is not None else (0.0, 1.0)
    return counts.withColumn("rate", (F.col("n_failed") + F.lit(mean * strength)) / (F.col("n") + F.lit(float(strength))))


def judged(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT, keep_text: bool = True) -> DataFrame:
    """``docs`` with the measures, ``host_rate`` and ``kept``.

    A text with fewer than 10 words, or more than a fifth of its words in repeated windows,
    fails; NULL is an empty text. A host is rejected if its shrunk failure rate is above ``limit``: one half, so
    that most of what goes with a host fails by itself. Rows without a host have no rate and are judged by their text alone.
    Repeated rows are judged alike and all stay; columns of the measures' names are replaced.
    """
    into = own_name(docs, "measures")
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (*MEASURES, "host_rate", "kept") and (keep_text or c != "text")]
    rows = materialize(measured(docs, into=into).select(*rest, f"{into}.*"), "measured")
    rates = materialize(host_rates(rows, host, "base_failed"), "host-rates")
    n = rates.count()
    widest = rates.agg(F.max(F.octet_length("host"))).first()[0] or 0
    row_rate = own_name(rows, "host_rate")
    key = own_name(rows, "host")
    found = lookup(rows.withColumn(key, F.col(f"`{host}`").cast("string")), rates.select(F.col("host").cast("string").alias(key), F.col("rate").alias(row_rate), F.col("n").alias(f"{key}_n")),
                   key, fits_broadcast(n, n * (widest + 24)), f"{key}_n")
    return found.withColumns({"host_rate": F.col(row_rate), "kept": ~F.col("base_failed") & ~F.coalesce(F.col(row_rate) > limit, F.lit(False))}).drop(
        row_rate, key, f"{key}_n")


def accepted(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """The rows that neither their text nor their host rejects, with the columns they came with.

    Only rejected hosts meet the rows, so texts are not moved unless very many hosts are rejected.
    """
    failed, bad = own_name(docs, "failed"), own_name(docs, "bad_host")
    rows = materialize(docs.withColumn(failed, measure(F.col("text").cast("string"))["base_failed"]), "measured")
    hosts = materialize(host_rates(rows, host, failed).where(F.col("rate") > limit).select(F.col("host").alias(bad)), "bad-hosts")
    if hosts.count() <= FEW_REJECTED_HOSTS:
        hosts = F.broadcast(hosts)
    return rows.where(~F.col(failed)).join(hosts, rows[host] == hosts[bad], "left_anti").drop(failed)


SQL = f"""
WITH words AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, k, array_to_string(w[k:k + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS k FROM words WHERE len(w) >= 5)),
again AS (SELECT doc_id, s FROM windows GROUP BY ALL HAVING count(*) > 1),
repeated AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(k, k + 5)) AS j FROM windows SEMI JOIN again USING (doc_id, s)) GROUP BY doc_id),
base AS (
    SELECT doc_id, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: len(x))), 0)::BIGINT AS word_chars,
        (len(t) - len(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
        (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))
            - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))))::BIGINT AS n_dup_lines,
        coalesce(n, 0)::BIGINT AS n_repeat_words, len(w) < 10 OR 100 * coalesce(n, 0) > 20 * len(w) AS base_failed
    FROM words LEFT JOIN repeated USING (doc_id)),
hosts AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS bad FROM base WHERE source IS NOT NULL GROUP BY source),
prior AS (SELECT avg(bad / n) AS mean, var_samp(bad / n) AS spread, avg(1 / n) AS small FROM hosts),
weight AS (SELECT mean, CASE WHEN spread - mean * (1 - mean) * small > 0
    THEN least(greatest(mean * (1 - mean) / (spread - mean * (1 - mean) * small) - 1, 1), 1e6) ELSE 1e6 END AS weight FROM prior),
rates AS (SELECT source, (bad + mean * weight) / (n + weight) AS rate FROM hosts, weight)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND NOT coalesce(rate > {HOST_LIMIT}, false) AS kept, round(rate, 6) AS host_rate FROM base LEFT JOIN rates USING (source)"""

"""Lookups that stay safe when one key holds a large part of the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tamis.operators.bitmaps import possible_members
from tamis.session import materialize

# A lookup table within both bounds may be broadcast.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20
WIDEST_KEY_ROW = 48  # bytes of a row of a table of keys and marks

# Hot keys are broadcast apart from the rest; both limits keep that piece small.
HOT_KEYS = 10_000
HOT_SPREAD = 4096
TRACKED_KEYS = 65_536  # of the sketch that finds frequent keys
LEAST_FREQUENT = 10_000  # rows of a key that the sketch has to name

# A key with more rows than this is salted in joins between two large tables.
HOT_ROWS = 5_000_000
SALTS = 64


def fits_broadcast(rows: int, size: int) -> bool:
    return rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def frequent_keys(rows: DataFrame, key: str, least: int) -> DataFrame:
    """``key`` of about the keys with ``least`` rows or more, from one bounded, mergeable sketch a task.

    The sketch tracks ``TRACKED_KEYS`` keys; it may name a few keys too many, which costs nothing but room.
    """
    sketch = rows.where(F.col(key).isNotNull()).agg(F.expr(f"approx_top_k(`{key}`, {HOT_KEYS}, {TRACKED_KEYS})").alias("top"))
    return sketch.select(F.inline("top")).where(F.col("count") >= least).select(F.col("item").alias(key))


def lookup(rows: DataFrame, table: DataFrame, key: str, small: bool,
           weight: str | None = None) -> DataFrame:
    """Left join of many rows to a table with one row per key.

    ``small`` says the table was measured and fits a broadcast. Otherwise the rows are written,
    and a sketch names their frequent keys. Those are broadcast with what the table has for
    them, which may be nothing, together with the table's heaviest keys (by ``weight``); their
    rows never move by key. Only the remaining keys, each of limited weight, are joined through a
    shuffle.
    """
    if small:
        return rows.join(F.broadcast(table), key, "left")
    values = [c for c in table.columns if c != key]
    rows = materialize(rows, "lookup-rows")
    frequent = materialize(frequent_keys(rows, key, max(LEAST_FREQUENT, rows.count() // HOT_KEYS)), "frequent-keys")  # HOT_KEYS at most
    heavy = table.orderBy(F.desc(weight), key).limit(HOT_KEYS).select(key) if weight else table.select(key).limit(0)
    packed = table.select(key, F.struct(*values).alias("__value"))
    hot = frequent.unionByName(heavy).distinct()
    hot = materialize(hot.join(packed.join(F.broadcast(hot), key, "left_semi"), key, "left").select(key, F.col("__value").alias("__hot"), F.lit(True).alias("__known")), "hot-keys")
    cold = packed.join(F.broadcast(hot.select(key)), key, "left_anti").select(
        F.col(key).alias("__cold_key"), F.col("__value").alias("__cold")
    )
    marked = rows.join(F.broadcast(hot), key, "left")
    # Rows already answered, and NULL keys, which nothing answers, get scattered keys.
    scattered = F.concat(F.lit("\0"), F.pmod(F.xxhash64(*rows.columns), F.lit(HOT_SPREAD)).cast("string"))
    shuffle_key = F.when(F.col("__known").isNotNull() | F.col(key).isNull(), scattered).otherwise(F.col(key).cast("string"))
    value = F.coalesce("__hot", "__cold")
    return (
        marked.withColumn("__key", shuffle_key)
        .join(cold.hint("merge"), F.col("__key") == F.col("__cold_key").cast("string"), "left")
        .select(*rows.columns, *[value[c].alias(c) for c in values])
    )


def hot_keys(rows: DataFrame, key: str, threshold: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``threshold`` rows: at most total / threshold of them."""
    return rows.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > threshold).select(key)


def salted_join(left: DataFrame, right: DataFrame, key: str, how: str = "left",
                threshold: int = HOT_ROWS, salts: int = SALTS) -> DataFrame:
    """Join a large, possibly skewed left table to a right table.

    Only hot keys are salted: their left rows are spread over ``salts`` partitions and
    their right rows repeated as often. All other keys are joined as they are. Left rows need a
    column that tells copies apart, such as an id. ``how`` is ``left``, ``inner``,
    ``left_semi`` or ``left_anti``.
    """
    # At most total / threshold rows, so this broadcast stays small whatever the key count is.
    hot = F.broadcast(hot_keys(left, key, threshold).withColumn("__is_hot", F.lit(True)))
    # A pure function of the row: a recomputed task must send every row to the same place.
    spread: Column = F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")
    salted_left = (
        left.join(hot, key, "left")
        # NULL never matches, so its rows may lie anywhere.
        .withColumn("__salt", F.when(F.col("__is_hot") | F.col(key).isNull(), spread).otherwise(0))
        .drop("__is_hot")
    )
    copies = F.when(F.col("__is_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    salted_right = (
        right.join(hot, key, "left").withColumn("__salt", F.explode(copies)).drop("__is_hot")
    )
    return salted_left.join(salted_right, [key, "__salt"], how).drop("__salt")


def derived_join(wide: DataFrame, table: DataFrame, key: str, derive: Callable[[DataFrame], DataFrame], how: str = "inner") -> DataFrame:
    """``derive(wide)`` joined to ``table`` on ``key``, without texts in an exchange.

    ``derive`` turns wide rows into narrow ones that keep the key, one for each. A table that
    fits is broadcast to the wide rows; beyond that only rows derived from them are shuffled, and
    for an inner join only from those that a bitmap of the table's keys lets through. Keys of
    ``table`` must be unique. ``how`` is ``inner``, ``left`` or ``left_anti``.
    """
    rows = table.count()
    if fits_broadcast(rows, rows * WIDEST_KEY_ROW):
        small = F.broadcast(table)
        if how == "left":
            return derive(wide).join(small, key, "left")
        if how == "left_anti":
            return derive(wide.join(small, key, "left_anti"))
        return derive(wide.join(F.broadcast(table.select(key)), key, "left_semi")).join(small, key)
    members = possible_members(wide, key, table.select(key)) if how == "inner" else wide
    return derive(members).join(table.hint("merge"), key, how)

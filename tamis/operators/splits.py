"""Train/test splits that do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tamis.session import materialize

PLACE_DIGITS = 48  # of a digest and a row hash
FEW_ROWS = 10_000  # so many hashes are ordered on the driver


def _digest(key: str) -> Column:
    return F.md5(F.col(key).cast("string"))


def in_share(key: str, share: float = 0.7) -> Column:
    """True for about ``share`` of the keys, false for a NULL key; a pure row expression."""
    return F.coalesce(F.substring(_digest(key), 1, 8) < f"{int(share * 2**32):08x}", F.lit(False))


def hash_split(df: DataFrame, key: str, share: float = 0.7) -> tuple[DataFrame, DataFrame]:
    chosen = in_share(key, share)
    return df.where(chosen), df.where(~chosen)


def random_split(df: DataFrame, share: float = 0.7, seed: int = 42) -> list[DataFrame]:
    """Spark's own split; its result changes with the partitioning of the input."""
    return df.randomSplit([share, 1 - share], seed=seed)


def _places(df: DataFrame, key: str) -> Column:
    """What an exact split orders rows by: the key's digest, then a hash of the whole row; NULL without a key."""
    return F.concat(_digest(key), F.lpad(F.lower(F.hex(F.xxhash64(*df.columns))), 16, "0"))


def exact_cutoff(places: DataFrame, wanted: int) -> tuple[str, int, int]:
    """The last ``place`` among the first ``wanted``, how many of its rows belong to them, and how many there are.

    A round counts the rows by their next four digits (65 536 numbers at most) and goes on with
    those rows alone whose digits the cut falls into. Few rows left are ordered at once.
    """
    prefix = ""
    while True:
        here = places.where(F.col("place").startswith(prefix)) if prefix else places
        counts = here.groupBy(F.substring("place", len(prefix) + 1, 4).alias("digits")).count().orderBy("digits").collect()
        for row in counts:
            if wanted <= row["count"]:
                break
            wanted -= row["count"]
        prefix += row["digits"]
        if len(prefix) == PLACE_DIGITS:
            return prefix, wanted, row["count"]
        if row["count"] <= FEW_ROWS:
            left = sorted(r.place for r in places.where(F.col("place").startswith(prefix)).collect())
            cut = left[wanted - 1]
            return cut, wanted - left.index(cut), left.count(cut)


def exact_split(df: DataFrame, key: str, share: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """Exactly ``int(share * n)`` of ``n`` rows with a key on the left, by its digest; rows without one go right.

    Keys may repeat: rows of the key that the cut falls on are told apart by a hash of their
    columns. Equal rows at the cut are as many copies of one on either side as needed. Texts are
    hashed where they lie; only the hashes are written and counted.
    """
    places = materialize(df.select(_places(df, key).alias("place")).where("place IS NOT NULL"), "places")
    wanted = int(share * places.count())
    if not wanted:
        return df.where(F.lit(False)), df
    cut, taken, there = exact_cutoff(places, wanted)
    place = _places(df, key)
    if taken == there:
        return df.where(place <= cut), df.where(place.isNull() | (place > cut))
    one = df.where(place == cut).limit(1)

    def copies(n: int) -> DataFrame:
        return one.crossJoin(df.sparkSession.range(n).withColumnRenamed("id", "__copy")).drop("__copy")

    return df.where(place < cut).unionByName(copies(taken)), df.where(place.isNull() | (place > cut)).unionByName(copies(there - taken))

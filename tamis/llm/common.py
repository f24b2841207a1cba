"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also where lambdas read it again and again."""
    return F.transform(F.array(value), use)[0]


def own_name(df: DataFrame, stem: str) -> str:
    """A column name no input column has."""
    taken = {c.lower() for c in df.columns}
    name = f"_{stem}"
    while name.lower() in taken:
        name = f"_{stem}_{uuid.uuid4().hex[:8]}"
    return name


def utf8(name: str) -> Column:
    """A text column as bytes; NULL stays NULL."""
    return F.col(name).cast("string").cast("binary")

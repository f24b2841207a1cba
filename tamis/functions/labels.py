"""Label expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def repair_label(label: Column) -> Column:
    """Missing or NaN becomes 0, one or more becomes 1, anything else 0."""
    number = label.cast("double")
    return (
        F.when(number.isNull() | F.isnan(number), 0).when(number >= 1, 1).otherwise(0).cast("int")
    )

"""Feature and vocabulary exports."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from tamis.sources.csv import write_csv


def sparse_json(features: str) -> Column:
    """A sparse vector as JSON with its size, indices and values."""
    raw = F.unwrap_udt(features)
    return F.to_json(F.struct(raw["size"].alias("size"), raw["indices"].alias("indices"), raw["values"].alias("values")))


def export_features(df: DataFrame, path: str, columns: list[str], features: str = "features",
                    dense: bool = False) -> str:
    """Write predictions with their features as CSV, arrays as JSON text.

    Vectors stay sparse unless ``dense`` asks for one number per vocabulary term.
    """
    array = F.to_json(vector_to_array(features)) if dense else sparse_json(features)
    return write_csv(df.select(*columns, array.alias("features_array")), path)


def export_vocabulary(vocabulary: DataFrame, path: str) -> str:
    """Write one ``term`` column whose row order is the feature index."""
    return write_csv(vocabulary.orderBy("idx").select("term"), path)

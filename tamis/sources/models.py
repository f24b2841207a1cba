"""Saved pipelines: a folder for each version, and a registry that says which one is live.

A registry line is a JSON object; the manifest holds one line for each model name. Saving writes
a new folder first and then publishes its line, so a reader sees the old model or the new one.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from tamis.session import remove
from tamis.sources.manifests import Manifests

REGISTRY = "model string, training_set string, rows long, params string, saved_at timestamp, path string"


def _lines(spark: SparkSession, root: str) -> tuple[int, dict[str, dict]]:
    version, lines = Manifests(spark, root).newest()
    return version, {entry["model"]: entry for entry in map(json.loads, lines)}


def save_model(model: PipelineModel, root: str, name: str, training_set: str, rows: int,
               params: dict | None = None, keep_old: bool = True) -> str:
    """Save a fitted pipeline as the live version of its name; the path of its folder.

    The folder of the version before stays, as a running job may still load from it, unless
    ``keep_old`` is false.
    """
    spark = SparkSession.active()
    path = f"{root}/spam_model_{name}-{uuid.uuid4().hex}"
    model.write().save(path)
    entry = {"model": name, "training_set": training_set, "rows": rows, "params": json.dumps(params or {}, sort_keys=True),
             "saved_at": datetime.now(timezone.utc).isoformat(), "path": path}
    before: list[str] = []

    def replaced(lines: list[str]) -> list[str]:
        others = [line for line in lines if json.loads(line)["model"] != name]
        before[:] = [json.loads(line)["path"] for line in lines if line not in others]
        return [*others, json.dumps(entry, sort_keys=True)]

    Manifests(spark, root).change(replaced)
    for old in [] if keep_old else before:
        remove(spark, old)
    return path


def model_path(spark: SparkSession, root: str, name: str) -> str:
    """The folder of the live version."""
    entries = _lines(spark, root)[1]
    if name not in entries:
        raise KeyError(f"no model {name} in {root}")
    return entries[name]["path"]


def load_model(root: str, name: str) -> PipelineModel:
    return PipelineModel.load(model_path(SparkSession.active(), root, name))


def registry(spark: SparkSession, root: str) -> DataFrame:
    """One row for each model name: the live version, what it was trained on and when it was saved."""
    rows = [(e["model"], e["training_set"], e["rows"], e["params"], datetime.fromisoformat(e["saved_at"]), e["path"]) for e in _lines(spark, root)[1].values()]
    return spark.createDataFrame(rows, REGISTRY)


class LiveModel:
    """The live version of a name, loaded anew when another one has been published.

    A stream asks for it at the start of each micro-batch: :meth:`get` costs one listing of the
    registry as long as nothing has changed.
    """

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.root, self.name = spark, root, name
        self._path, self._model = "", None

    def get(self) -> PipelineModel:
        path = model_path(self.spark, self.root, self.name)
        if path != self._path:
            self._path, self._model = path, PipelineModel.load(path)
        return self._model

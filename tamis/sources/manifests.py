"""Versions of a set of files, published one after the other in a single step each.

A manifest is a small file of lines below ``<root>/manifests``. Its name is the version. It is
written beside and then renamed to a name nothing has yet, so a reader sees all of it or
nothing, and of two writers that start from one version only one succeeds.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

ATTEMPTS = 20


class Manifests:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.folder = spark, f"{root.rstrip('/')}/manifests"

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _store(self):
        return self._path("any").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def newest(self) -> tuple[int, list[str]]:
        """The last published version and its lines; version 0 without lines if there is none."""
        store, folder = self._store(), self._path("any").getParent()
        if not store.exists(folder):
            return 0, []
        names = [f.getPath().getName() for f in store.listStatus(folder)]
        version = max((int(n) for n in names if n.isdigit()), default=0)
        if not version:
            return 0, []
        return version, [r.value for r in self.spark.read.text(f"{self.folder}/{version:012d}").collect()]

    def publish(self, version: int, lines: list[str]) -> bool:
        """Make ``lines`` the given version; False if somebody else has published it."""
        jvm, store = self.spark._jvm, self._store()
        draft, final = self._path(f"draft-{uuid.uuid4().hex}"), self._path(f"{version:012d}")
        out = store.create(draft, False)
        out.write(bytearray("\n".join(lines).encode()))
        out.close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(draft, final, options)
        except Py4JJavaError as problem:
            store.delete(draft, False)
            if "FileAlreadyExists" in problem.java_exception.getClass().getName():
                return False
            raise
        return True

    def change(self, edit: Callable[[list[str]], list[str]]) -> int:
        """Publish ``edit`` of the newest lines, from the start again if another writer was faster."""
        for _ in range(ATTEMPTS):
            version, lines = self.newest()
            if self.publish(version + 1, edit(lines)):
                return version + 1
        raise RuntimeError(f"{self.folder} changes all the time")

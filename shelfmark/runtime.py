"""Session helpers: shipping this package to executors, and scratch tables in the shared folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Python workers hold one Arrow batch at a time: keeps it small also where texts are long. Smaller settings of the session stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = (spark.conf.get(key, None) or "").rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def ship(spark: SparkSession) -> None:
    """Give executors this package, so that functions sent to Python workers can be imported there."""
    bound_batches(spark)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    if not os.path.isdir(root):  # already imported from a shipped archive
        return
    path = os.path.join(tempfile.mkdtemp(prefix="shelfmark-"), "shelfmark_pkg.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("shelfmark", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def scratch_root(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. One of our own only where that is unset and the session runs in this process alone; elsewhere executors could not see it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = getattr(scratch_root, "own", None)
    if own is None:
        folder = tempfile.mkdtemp(prefix="shelfmark-scratch-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        own = scratch_root.own = "file://" + folder
    return own


_scopes: list[list["Scratch"]] = []


@contextmanager
def cleared() -> Iterator[None]:
    """Whatever scratch tables are written in this block are removed at its end: all that reads them must have been written by then."""
    scope: list[Scratch] = []
    _scopes.append(scope)
    try:
        yield
    finally:
        _scopes.remove(scope)
        for scratch in scope:
            scratch.keep()


class Scratch:
    """Tables written to the shared folder: they cut lineage, and outlive any executor. What is not dropped before goes with the driver."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.n = spark, f"{scratch_root(spark).rstrip('/')}/shelfmark-{uuid.uuid4().hex}", 0
        self.paths: set[str] = set()
        path = self._path(self.base)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
        if _scopes:
            _scopes[-1].append(self)

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)

    def write(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        """The table, written (a folder for each value of the columns `by`) and to be read anew."""
        self.n += 1
        path = f"{self.base}/{self.n:03d}-{name}"
        df.write.mode("overwrite").parquet(path, partitionBy=list(by) or None)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self.paths.add(path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that nothing lazy reads any more."""
        self._remove(t._scratch_path for t in tables)

    def keep(self, *tables: DataFrame) -> None:
        """Remove all tables but these."""
        self._remove(self.paths - {t._scratch_path for t in tables})

    def _remove(self, paths: Iterable[str]) -> None:
        for name in list(paths):
            path = self._path(name)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            self.paths.discard(name)

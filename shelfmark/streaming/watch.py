"""Watching a tree: each settled batch of changed files becomes proposals.

Two ways to settle: micro-batches by trigger, of which each drops repeated paths, and a trailing gap exactly, where a burst ends once nothing
changed for `gap` seconds (a timer for the tree's key, restarted by every change).
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.search import watchable
from ..runtime import ship
from ..sources.vault import described, register


def changes(spark: SparkSession, path: str, content: bool = False, state: str | None = None) -> DataFrame:
    """New and changed documents as a stream. With `state`, a folder that all tasks share, tasks list the tree; else the driver does."""
    register(spark)
    rows = spark.readStream.format("vault").options(content=str(content).lower(), **({} if state is None else {"state": state})).load(path)
    return rows.where((F.col("kind") == "document") & watchable(F.col("rel_path")))


def watch(spark: SparkSession, path: str, propose: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = False, every: str = "2 seconds", gap: float | None = None, proposed: Callable[[int], None] | None = None) -> StreamingQuery:
    """Writes the proposals of each batch to `out` as JSON lines; they are never carried out.

    Only paths stream; tasks read the files of a batch. With a gap (seconds) a burst of changes is one batch once nothing changed for so long. `proposed` is told the number of each batch that was not empty.
    """

    def batch(rows: DataFrame, number: int) -> None:
        paths = rows.select("rel_path").distinct()
        if not paths.isEmpty():
            propose(described(paths, path)).write.mode("overwrite").json(f"{out}/batch={number}")
            if proposed is not None:
                proposed(number)

    plain = checkpoint.removeprefix("file://")
    rows = changes(spark, path, state=None if "://" in plain else f"{plain}.listings")
    if gap is not None:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        rows = settled(rows.select(F.lit(path).alias("tree"), "rel_path"), gap)
    writer = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def watch_once(spark: SparkSession, path: str, propose: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, gap: float, wait: float | None = None) -> bool:
    """Proposes the first burst of changes that settles, and ends: whether there was one within `wait` seconds (without a limit, if that is not given).

    What was there before the first run is a burst. The query stops when the burst's batch is committed, so the next run begins behind it.
    """
    settled_batch: list[int] = []

    def seen(number: int) -> None:
        settled_batch.append(number)

    query = watch(spark, path, propose, out, checkpoint, every=f"{max(50, int(gap * 250))} milliseconds", gap=gap, proposed=seen)
    until = None if wait is None else time.monotonic() + wait
    try:
        while query.isActive:
            if settled_batch and (query.lastProgress or {}).get("batchId", -1) >= settled_batch[0]:
                return True
            if not settled_batch and until is not None and time.monotonic() > until:
                return False
            time.sleep(0.05)
        if error := query.exception():
            raise error
        return bool(settled_batch)
    finally:
        query.stop()


class TrailingGap(StatefulProcessor):
    """Holds paths of a key until nothing came for `gap` milliseconds, then yields each once."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.paths = handle.getMapState("paths", "path string", "seen boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for path in frame["rel_path"]:
                self.paths.updateValue((path,), (True,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.gap)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        paths = sorted(k[0] for k in self.paths.keys())
        self.paths.clear()
        yield pd.DataFrame({"tree": [key[0]] * len(paths), "rel_path": paths})

    def close(self) -> None:
        pass


def settled(rows: DataFrame, gap_seconds: float, tree_col: str = "tree") -> DataFrame:
    """tree and rel_path of each burst of changes (columns tree and rel_path), once it has ended. Needs the RocksDB state store."""
    ship(rows.sparkSession)
    return rows.groupBy(tree_col).transformWithStateInPandas(TrailingGap(int(gap_seconds * 1000)), "tree string, rel_path string", "Append", "ProcessingTime")

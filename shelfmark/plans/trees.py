"""Queries that work on real folder trees: files are written out of the given tables, in tasks, below the shared folder."""

from __future__ import annotations

import os
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import executor, plan
from ..runtime import scratch_root, ship
from ..sources import vault
from .registry import query


def new_root(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see under one path."""
    shared = scratch_root(spark)
    if "://" in shared.removeprefix("file://"):
        raise ValueError("a folder tree needs a shared folder that is mounted as files")
    os.makedirs(root := f"{shared.removeprefix('file://').rstrip('/')}/tree-{uuid.uuid4().hex}")
    return root


def put_files(files: DataFrame, root: str) -> int:
    """Writes files (rel_path, text) in tasks, each whole or not at all, and returns their number."""
    ship(files.sparkSession)

    def run(batches):
        for batch in batches:
            for rel, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                os.makedirs(os.path.dirname(path := os.path.join(root, rel)), exist_ok=True)
                with open(tmp := f"{path}.{uuid.uuid4().hex}", "wb") as f:
                    f.write((text or "").encode())
                os.replace(tmp, path)
            yield pa.record_batch([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return files.select("rel_path", "text").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


@query("""SELECT doc_id, CASE WHEN k = 1 THEN 'out/' || substr(sha, 1, 2) || '/' || sha || '.txt' ELSE '-' END AS destination, k = 1 AS moved, k > 1 AS still_there, k = 1 AS content_is_there FROM (
    SELECT doc_id, sha, row_number() OVER (PARTITION BY sha ORDER BY 'in/' || doc_id % 50 || '/' || doc_id || '.txt') AS k FROM (SELECT doc_id, sha256(coalesce(text, '')) AS sha FROM documents))""")
def moves_carried_out(spark, sf):
    """Every document as a file is moved to a place named by its content, by tasks, and read back; a second copy of the same content is left where it is."""
    root = new_root(spark)
    rel = F.concat(F.lit("in/"), (F.col("doc_id") % 50).cast("string"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", rel.alias("rel_path"), "text")
    put_files(docs, root)
    full = lambda c: F.concat(F.lit(root + "/"), c)
    files = vault.read(spark, root, content=True)
    target = F.concat(F.lit("out/"), F.substring("sha256", 1, 2), F.lit("/"), F.col("sha256"), F.lit(".txt"))
    moves = files.select(full(F.col("rel_path")).alias("source"), full(target).alias("destination"), "sha256")
    planned = plan.planned(moves, spark.createDataFrame([], "path string, sha256 string"), "fail").join(moves.select("source", "sha256"), "source")
    _, outcome = executor.carry_out(planned, root)
    after = vault.read(spark, root, content=True).select("rel_path", "sha256")
    moved = outcome.where("status = 'moved'").select("source", "destination")
    short = F.substring("destination", len(root) + 2, 1 << 30)
    got = docs.select("doc_id", "rel_path", full(F.col("rel_path")).alias("source"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha")).join(moved.withColumn("destination", short), "source", "left")
    got = got.join(after.select("rel_path", F.lit(True).alias("there")), "rel_path", "left").join(after.select(F.col("rel_path").alias("destination"), F.col("sha256").alias("found")), "destination", "left")
    there = F.coalesce("there", F.lit(False))
    return got.select("doc_id", F.coalesce("destination", F.lit("-")).alias("destination"), F.col("destination").isNotNull().alias("moved"), there.alias("still_there"), F.coalesce(F.col("found") == F.col("sha"), F.lit(False)).alias("content_is_there"))

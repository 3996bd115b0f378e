"""Carrying out plans: the manifest first, then each file copied, checked and staged in tasks (see sources.moves); and undoing them."""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from ..sources import moves, records
from ..sources.moves import digest, put, stage  # noqa: F401

ROWS_A_TASK = 200


def copy_checked(source: str, destination: str, sha: str) -> None:
    """Copies a file to a place that must be free, whole or not at all."""
    put(source, destination, sha, os.path.join(os.path.dirname(destination), moves.WORK))
    os.rmdir(os.path.join(os.path.dirname(destination), moves.WORK))


def carried_out(rows: DataFrame, root: str, op: str, n: int) -> DataFrame:
    """What became of rows (source, destination, sha256, facts) that tasks move: source, destination, status, reason, sidecar."""
    spark = rows.sparkSession
    ship(spark)
    spark.dataSource.register(moves.Moves)
    parts = max(1, min(-(-n // ROWS_A_TASK), 4 * spark.sparkContext.defaultParallelism))
    facts = F.col("facts") if "facts" in rows.columns else F.lit(None)
    rows = rows.select("source", "destination", "sha256", facts.cast(moves.FACTS).alias("facts")).repartition(parts)
    rows.write.format("vault_moves").option("path", root).option("op", op).mode("append").save()
    return spark.read.schema(moves.OUTCOME).json(os.path.join(root, "manifests", f"{op}.outcome"))


def carry_out(plan: DataFrame, root: str, op: str = "move", now: dt.datetime | None = None) -> tuple[str, DataFrame]:
    """Moves what a plan (source, destination, sha256, perhaps facts; action = move) says, and returns the manifest's path and the outcome. Nothing is deleted: originals go to the staging folder.

    The manifest is written before anything moves, and what moves is read from it. A row whose place was taken or whose source went or changed meanwhile fails alone; a plan that names a place twice is refused.
    Rows with a null source, destination or digest cannot be moved and fail.
    """
    spark, now = plan.sparkSession, now or dt.datetime.now(dt.timezone.utc)
    rows = plan.where("action = 'move'")
    twice = rows.where("destination is not null").groupBy("destination").count().where("count > 1").first()
    if twice:
        raise FileExistsError(twice.destination)
    whole = "source is not null and destination is not null and sha256 is not null"
    said = ((r.destination, r.source, r.sha256) for r in rows.where(whole).select("source", "destination", "sha256").orderBy("source").toLocalIterator())
    manifest, n = records.write_manifest(os.path.join(root, "manifests"), op, said, now)
    listed = records.read_manifest(spark, manifest).select(F.col("original_path").alias("source"), F.col("current_path").alias("destination"), "sha256")
    if "facts" in rows.columns:
        listed = listed.join(rows.where(whole).select("source", "facts"), "source")
    outcome = carried_out(listed, root, os.path.basename(manifest).removesuffix(".csv"), n)
    lost = rows.where(f"not ({whole})").select("source", "destination", F.lit("failed").alias("status"), F.lit("source, destination or digest is missing").alias("reason"), F.lit(None).cast("string").alias("sidecar"))
    return manifest, outcome.unionByName(lost)


def execute(plan: DataFrame, root: str, op: str = "move", now: dt.datetime | None = None) -> dict:
    """Carries a plan out and tells the person who approved it: the manifest, what moved, and what did not and why."""
    manifest, outcome = carry_out(plan, root, op, now)
    return told(outcome, root, op, manifest)


def told(outcome: DataFrame, root: str, op: str, manifest: str) -> dict:
    """The outcome as a report, which goes to the audit log as well."""
    done, failed, sidecars = [], [], []
    for r in outcome.orderBy("source").toLocalIterator():
        if r.status == "failed":
            failed.append((r.source, r.reason))
            continue
        done.append(r.destination)
        sidecars += [r.sidecar] if r.sidecar else []
    records.append_audit(os.path.join(root, "audit.jsonl"), {"op": op, "actor": "shelfmark", "paths": done, "manifest": manifest, "confirmed": True, "detail": {str(s): e for s, e in failed}})
    return {"manifest": manifest, "moved": done, "failed": failed, "sidecars": sidecars}


def rollback(manifest: DataFrame, root: str) -> dict:
    """Puts files of a manifest back where they came from, in tasks. Rows whose file is missing, or whose old place is taken, stay; running it again changes nothing."""
    now = dt.datetime.now(dt.timezone.utc)
    rows = manifest.select(F.col("current_path").alias("source"), F.col("original_path").alias("destination"), "sha256")
    outcome = carried_out(rows, root, f"{now:%Y%m%dT%H%M%S%f}_rollback", rows.count())
    done, left = [], []
    for r in outcome.orderBy("source").toLocalIterator():
        (done if r.status == "moved" else left).append(r.source)
    records.append_audit(os.path.join(root, "audit.jsonl"), {"op": "rollback", "actor": "shelfmark", "paths": done, "confirmed": True})
    return {"restored": done, "left": left}

"""Repairs of what the rules found: one move a document, then its tags, at the place where it ends.

Where rules disagree about a document's place none of its moves is made, and where two documents would go to one place neither is; their tags are repaired where they are. All moves of a run are one plan with
one manifest, so that one rollback undoes them. A document whose move fails keeps its place, and its tags are repaired there. Findings that can't be repaired, or were not, come back as skipped.
"""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tags as G
from ..sources import records
from . import executor, filing, plan

NOT_FIXABLE, DISAGREE, SHARED = "can't be repaired", "rules disagree about its place", "another document would go there"


def composed(found: DataFrame) -> DataFrame:
    """One row for each document with anything to repair: path, move_to (null if it stays), add_tags, and why_not, if its move was given up. found: findings. A null path has no repairs."""
    some = found.where("path is not null and (move_to is not null or add_tag is not null)")
    one = some.groupBy("path").agg(F.min("move_to").alias("to"), F.max("move_to").alias("other"), F.array_sort(F.collect_set("add_tag")).alias("add_tags"))
    asked = one.where("to = other").groupBy(F.col("to").alias("place")).agg(F.count("*").alias("n")).where("n > 1").withColumn("shared", F.lit(True)).drop("n")
    rows = one.join(asked, F.col("to") == F.col("place"), "left")
    why = F.when(F.col("to") != F.col("other"), DISAGREE).when(F.coalesce("shared", F.lit(False)), SHARED)
    return rows.select("path", F.when(why.isNull(), F.col("to")).alias("move_to"), "add_tags", why.alias("why_not"))


def told(found: DataFrame, repairs: DataFrame, moved: DataFrame) -> DataFrame:
    """The findings with state (fixed or skipped), reason and final (where the document is now). moved: path and move_to of what moved."""
    at = repairs.join(moved.select("path", F.lit(True).alias("went")), "path", "left").select("path", F.coalesce("went", F.lit(False)).alias("went"), "why_not", F.col("move_to").alias("place"))
    rows = found.join(at, "path", "left")
    fixed = F.when(F.col("move_to").isNotNull(), F.coalesce("went", F.lit(False))).otherwise(F.col("add_tag").isNotNull())
    reason = F.when(fixed, F.lit(None)).when(F.col("move_to").isNull(), NOT_FIXABLE).otherwise(F.coalesce("why_not", F.lit("it could not be moved")))
    return rows.select(*found.columns, F.when(fixed, "fixed").otherwise("skipped").alias("state"), reason.alias("reason"), F.when(F.col("went"), F.col("place")).otherwise(F.col("path")).alias("final"))


def fix(documents: DataFrame, found: DataFrame, root: str, now: dt.datetime | None = None) -> dict:
    """Carries the repairs out: the manifest (or None), and the findings as `told`. documents: rel_path, sha256 and tags of all that is there."""
    spark = documents.sparkSession
    full = lambda c: filing.located(root, F.col(c))
    repairs = composed(found).cache()
    moves = repairs.where("move_to is not null").join(documents.select(F.col("rel_path").alias("path"), "sha256"), "path").select(full("path").alias("source"), full("move_to").alias("destination"), "sha256")
    manifest, moved = None, spark.createDataFrame([], "path string, move_to string")
    if not moves.isEmpty():
        planned = plan.planned(moves, documents.select(full("rel_path").alias("path"), "sha256"), "fail").join(moves.select("source", "sha256"), "source")
        manifest, outcome = executor.carry_out(planned, root, "lint-fix", now)
        at = len(root.rstrip("/")) + 2
        moved = outcome.where("status != 'failed'").select(F.substring("source", at, 1 << 30).alias("path"), F.substring("destination", at, 1 << 30).alias("move_to")).cache()
    before = documents.select(F.col("rel_path").alias("path"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))
    rows = repairs.select("path", "add_tags").join(before, "path").join(moved, "path", "left")
    after = rows.where(F.col("move_to").isNotNull() | (F.size("add_tags") > 0)).select(F.coalesce("move_to", "path").alias("rel_path"), G.normalize(F.array_union("tags", "add_tags")).alias("tags"))
    if not after.isEmpty():
        filing.write_tags(spark, root, after, gone=moved.select(F.col("path").alias("rel_path")))
    records.append_audit(os.path.join(root, "audit.jsonl"), {"op": "lint-fix", "actor": "shelfmark", "paths": [r.move_to for r in moved.orderBy("move_to").toLocalIterator()], "manifest": manifest, "confirmed": True})
    return {"manifest": manifest, "findings": told(found, repairs, moved)}

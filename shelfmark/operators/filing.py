"""Filing: proposals are checked once more, moved, described beside their new place, and tagged; and facts about filed documents are renewed in place.

Files are moved and described by tasks; the driver writes the manifest, which it streams, and the tags. No proposals change nothing. A proposal with a null destination is left where it is.
"""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import tags as G
from ..sources.moves import within  # noqa: F401
from . import executor, plan, search

FACTS = ("classifier", "doctype", "category", "confidence", "owners", "identifier", "year", "fields", "text")
TAGS = ".tags.parquet"
NOT_KNOWN = "not in the vocabulary"


def rechecked(proposals: DataFrame, config: Config, root: str) -> DataFrame:
    """Adds fault (why the destination can't be used, or null), and parts tags from dropped_tags (tag, reason): either may have been edited since they were proposed."""
    target = F.concat(F.lit(root.rstrip("/") + "/"), F.col("destination"))
    tags = G.normalize(F.col("tags"))
    dropped = F.transform(G.unknown(config, tags), lambda t: F.struct(t.alias("tag"), F.lit(NOT_KNOWN).alias("reason")))
    return proposals.withColumn("fault", search.destination_fault(target, root)).withColumn("dropped_tags", dropped).withColumn("tags", G.known(config, tags))


def located(root: str, path: Column) -> Column:
    """Where a path lies: below the root, but for one that is whole."""
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def facts_of(rows: DataFrame, now: dt.datetime | None) -> Column:
    """What a sidecar is to say."""
    day = F.lit(now.date().isoformat() if now else None).cast("string")
    return F.struct(day.alias("extracted_at"), F.lit(None).cast("string").alias("ocr_engine"), *[F.col(c) for c in FACTS if c != "text"], F.col("sha256").alias("source_sha256"), "text")


def file_proposals(proposals: DataFrame, taken: DataFrame, config: Config, root: str, on_collision: str = "suffix", now: dt.datetime | None = None) -> dict:
    """Carries proposals (path, destination, sha256, tags and FACTS) out: what moved, what was left and why, and the sidecars written at the new places. taken: path and sha256 of what is there, relative to the root as well.

    Tasks move the files and write the sidecars; tags of what moved are joined to it.
    """
    full = lambda c: located(root, F.col(c))
    rows = rechecked(proposals.where("destination is not null"), config, root).withColumn("source", full("path")).cache()
    left = [(r.path, r.fault) for r in rows.where("fault is not null").select("path", "fault").toLocalIterator()]
    good = rows.where("fault is null")
    moves = good.select("source", full("destination").alias("destination"), "sha256")
    planned = plan.planned(moves, taken.select(full("path").alias("path"), "sha256"), on_collision, plan.LAST_SUFFIX).join(good.select("source", "sha256", facts_of(good, now).alias("facts")), "source")
    manifest, outcome = executor.carry_out(planned, root, "ingest", now)
    moved = outcome.where("status != 'failed'").select("source", F.substring("destination", len(root.rstrip("/")) + 2, 1 << 30).alias("rel_path"))
    write_tags(proposals.sparkSession, root, moved.join(good.select("source", F.coalesce("tags", F.array()).alias("tags")), "source").select("rel_path", "tags"))
    done = executor.told(outcome, root, "ingest", manifest)
    rows.unpersist()
    return done | {"left": left}


def read_tags(spark: SparkSession, root: str) -> DataFrame:
    """rel_path and tags of the tagged documents."""
    path = os.path.join(root, TAGS)
    return spark.read.parquet(path) if os.path.exists(path) else spark.createDataFrame([], "rel_path string, tags array<string>")


def write_tags(spark: SparkSession, root: str, changed: DataFrame, gone: DataFrame | None = None) -> None:
    """Replaces the tags of the documents that are named, once each, and drops those of documents that are gone (rel_path); those of all others stay. The old table is there until the new one is whole."""
    before, path = read_tags(spark, root), os.path.join(root, TAGS)
    before = before if gone is None else before.join(gone.select("rel_path"), "rel_path", "left_anti")
    after = before.join(changed.select("rel_path"), "rel_path", "left_anti").unionByName(changed.select("rel_path", G.normalize(F.col("tags")).alias("tags")))
    new, old = f"{path}.new{os.getpid()}", f"{path}.old{os.getpid()}"
    after.write.mode("overwrite").parquet(new)
    if os.path.exists(path):
        os.rename(path, old)
    os.rename(new, path)
    if os.path.exists(old):
        import shutil

        shutil.rmtree(old)


def retag(documents: DataFrame, chosen: DataFrame, add: list[str], remove: list[str], config: Config) -> DataFrame:
    """rel_path, before, tags, added and removed of the chosen documents (rel_path). Tags that the vocabulary lacks are a ValueError."""
    spark = documents.sparkSession
    said = spark.createDataFrame([(add, remove)], "a array<string>, r array<string>").select(G.normalize(F.col("a")).alias("a"), G.normalize(F.col("r")).alias("r")).withColumn("odd", G.unknown(config, F.col("a"))).first()
    if said.odd:
        raise ValueError(f"{said.odd[0]} is {NOT_KNOWN}")
    plus, minus = (F.array(*map(F.lit, x)).cast("array<string>") for x in (said.a, said.r))
    rows = documents.join(chosen.select("rel_path").distinct(), "rel_path", "left_semi").select("rel_path", F.col("tags").alias("before"))
    return rows.select("rel_path", "before", G.apply(F.col("before"), plus, minus).alias("tags"), G.added(F.col("before"), plus).alias("added"), G.removed(F.col("before"), minus).alias("removed"))


def supersede(documents: DataFrame, old: str, new: str) -> DataFrame:
    """rel_path, before and tags of the document that gives way and the one that takes its place."""
    rows = documents.where(F.col("rel_path").isin(old, new)).select("rel_path", F.col("tags").alias("before"))
    if old == new or rows.count() != 2:
        raise ValueError(f"{old} and {new} are not two documents")
    return rows.withColumn("tags", F.when(F.col("rel_path") == old, G.superseded(F.col("before"))).otherwise(G.superseding(F.col("before"))))


def reindex(proposals: DataFrame, root: str, now: dt.datetime | None = None) -> dict:
    """Writes the facts beside each document where it is, in tasks; nothing moves. Documents that belong elsewhere are named."""
    rows = proposals.select(located(root, F.col("path")).alias("source"), F.lit(None).cast("string").alias("destination"), "sha256", facts_of(proposals, now).alias("facts"))
    outcome = executor.carried_out(rows, root, f"{now or dt.datetime.now(dt.timezone.utc):%Y%m%dT%H%M%S%f}_reindex", proposals.count())
    elsewhere = proposals.where("destination is not null and destination != path").select("path", "destination").orderBy("path")
    return {"sidecars": [r.sidecar for r in outcome.where("sidecar is not null").orderBy("source").toLocalIterator()], "elsewhere": [tuple(r) for r in elsewhere.toLocalIterator()]}

"""Exact dedup with a log-structured merge index, in DataFrame functions only.

Rows enter memtables by a hash of the identifier. Each memtable is flushed to a run: one entry a
digest, with the count and the best row, sorted by digest and written. Each run has a bitmap filter of its digests, sized from the number of entries. Compaction
merges FAN runs of a level to one of the next, until one run is left: entries that no other run's filter knows go there as they are,
and only the others are grouped by digest, where the smallest identifier among the rows with
the most code points stays. A last filter, over the digests that were met more than once, tells, while the
texts are scanned again, which rows can be hits; only those are moved, and each hit is compared with
the kept row byte for byte. Digests under which different bytes meet are grouped anew by the bytes.
Where more than HOT rows share a digest, they are dealt out by a salt, and what they are joined with is there once a salt.

Null texts count as empty, and empty texts equal each other. Rows are told apart by identifier, of any type that can be ordered: rows
that repeat an identifier and a text share one verdict and each counts in group_size. A null
identifier sorts after all others and is returned with kept = (keep_id is null). Other columns are
not read, so their names cannot clash. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import Scratch
from . import filters

WHITE = r"[\x20\x09-\x0D]+"
MEMTABLES, FAN = 8, 4
HOT, HOT_DIGESTS = 4096, 100_000  # rows of one digest to a salt; beyond so many hot digests, skewed partitions are split as they are met


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, "")


def entries(docs: DataFrame, id_col: str, text_col: str, digest_hex: int) -> DataFrame:
    """One index entry a row: identifier, length, text hash and the digest the index is sorted by."""
    text = F.col(text_col)
    return docs.select(
        F.col(id_col).alias("id"), F.char_length(F.coalesce(text, F.lit(""))).cast("long").alias("len"), F.sha2(normalised(text), 256).alias("sha")
    ).withColumn("digest", F.substring("sha", 1, digest_hex))


def best() -> Column:
    """Of rows the one with the most code points, then the smallest identifier."""
    return F.min(F.struct((-F.col("len")).alias("less"), F.col("id").isNull().alias("none"), F.col("id").alias("id"))).alias("best")


def flush(rows: DataFrame, memtables: int) -> DataFrame:
    """Runs: of each memtable one entry a digest, sorted."""
    entry = rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(memtables)).cast("int").alias("run"), "digest").agg(best(), F.count("*").alias("n"))
    return entry.sortWithinPartitions("run", "digest")


def compact(runs: DataFrame, fan: int) -> DataFrame:
    """Runs of the next level, each out of `fan` runs; sorted."""
    runs = runs.withColumn("to", (F.col("run") / fan).cast("int"))
    most = runs.groupBy("run").count().agg(F.coalesce(F.max("count"), F.lit(0)), F.count("*")).first()
    bits = filters.size_for(most[0])
    alone, meet = None, runs
    if bits * most[1] <= filters.MOST:  # else the filters are no longer small: all entries are merged
        slot = F.pmod("run", F.lit(fan))
        maps = filters.bitmaps(runs, "digest", bits, "to", "run").groupBy("to", "bucket").agg(*[F.max(F.when(slot == k, F.col("bits"))).alias(f"bits{k}") for k in range(fan)])
        bit = filters.bit_of("digest", bits)
        told = runs.withColumn("bucket", (bit / filters.BITMAP).cast("long")).join(F.broadcast(maps), ["to", "bucket"])
        other = reduce(lambda x, y: x | y, [(slot != k) & filters.is_set(F.col(f"bits{k}"), bit) for k in range(fan)])
        told = told.select("to", "digest", "best", "n", other.alias("met"))
        alone, meet = told.where("not met").drop("met"), told.where("met")
    merged = meet.groupBy("to", "digest").agg(F.min("best").alias("best"), F.sum("n").alias("n"))
    merged = merged if alone is None else merged.unionByName(alone)
    return merged.select(F.col("to").alias("run"), "digest", "best", "n").sortWithinPartitions("run", "digest")


def index(rows: DataFrame, memtables: int, fan: int, scratch: Scratch) -> DataFrame:
    """The one run that compaction ends with: digest, keep_id and n."""
    level, left = scratch.write(flush(rows, memtables), "level", "run"), memtables
    while left > 1:
        new, left = scratch.write(compact(level, fan), "level", "run"), -(-left // fan)
        scratch.drop(level)
        level = new
    return level.select("digest", F.col("best.id").alias("keep_id"), "n")


class Dealing:
    """Deals the rows of hot digests out by a salt."""

    def __init__(self, level: DataFrame, hot: int, scratch: Scratch):
        table = scratch.write(level.where(F.col("n") > hot).select("digest", F.ceil(F.col("n") / hot).cast("int").alias("salts")), "hot")
        n = table.count()
        self.hot = table if 0 < n <= HOT_DIGESTS else None

    def rows(self, rows: DataFrame) -> DataFrame:
        if self.hot is None:
            return rows.withColumn("salt", F.lit(0))
        return rows.join(F.broadcast(self.hot), "digest", "left").withColumn("salt", F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")  # HOT_DIGESTS at most

    def copies(self, rows: DataFrame) -> DataFrame:
        if self.hot is None:
            return rows.withColumn("salt", F.lit(0))
        return rows.join(F.broadcast(self.hot), "digest", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")


def regroup(texts: DataFrame) -> DataFrame:
    """Verdicts by the bytes themselves, for digests under which different bytes meet."""
    groups = texts.groupBy("digest", "norm").agg(best(), F.count("*").alias("group_size")).select("digest", "norm", F.col("best.id").alias("keep_id"), "group_size")
    return texts.join(groups, ["digest", "norm"]).select("id", "keep_id", "group_size", "sha", "digest")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, digest_hex: int = 64, memtables: int = MEMTABLES, fan: int = FAN, hot: int = HOT) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.write(entries(docs, id_col, text_col, digest_hex), "entries")
    level = scratch.write(index(rows, memtables, fan, scratch), "index")
    dealing, met = Dealing(level, hot, scratch), level.where("n > 1")

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = texts.withColumn("norm", normalised(F.col("text"))).withColumn("sha", F.sha2("norm", 256)).withColumn("digest", F.substring("sha", 1, digest_hex))
    texts = texts.withColumn("len", F.char_length(F.coalesce("text", F.lit(""))).cast("long")).drop("text")
    hits = filters.build(met, "digest").known(texts, "digest")
    chosen = met.select(F.col("digest").alias("to"), "keep_id")
    kept = hits.join(chosen, (F.col("digest") == F.col("to")) & F.col("id").eqNullSafe(F.col("keep_id")))  # by both, so a large group is dealt out
    kept = kept.groupBy("digest").agg(F.first("keep_id").alias("keep_id"), F.first("norm").alias("kept_norm"))
    compared = dealing.rows(hits).join(dealing.copies(kept), ["digest", "salt"])
    differ = scratch.write(compared.where(~F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("norm") != F.col("kept_norm"))).select("digest").distinct(), "differ")

    plain = dealing.rows(rows).join(dealing.copies(level), ["digest", "salt"]).select("id", "keep_id", F.col("n").alias("group_size"), "sha", "digest")
    if not differ.isEmpty():
        plain = plain.join(differ, "digest", "left_anti").unionByName(regroup(hits.join(differ, "digest", "left_semi").select("id", "len", "sha", "digest", "norm")))
    return plain.select(
        F.col("id").alias("doc_id"), "keep_id", F.col("group_size").cast("long").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns; of rows that repeat an identifier and a text, one. Rows go by identifier and text, so another text of a dropped identifier stays. Only rows that the filters know are moved."""
    scratch = Scratch(docs.sparkSession)
    verdict = scratch.write(exact_dedup(docs, id_col, text_col).select(F.col("doc_id").alias("id"), F.unhex("text_sha256").alias("sha"), "kept"), "verdict")
    sha = F.unhex(F.sha2(normalised(F.col(text_col)), 256))
    out = filters.without(docs, id_col, verdict.where("not kept").select("id", "sha"), second=sha)
    again = scratch.write(verdict.where("kept").groupBy("id").count().where("count > 1").select("id"), "again")
    if again.isEmpty():
        return out
    repeated, others = filters.build(again, "id").split(out, id_col)
    name = filters.fresh(out, "__sha")
    return others.unionByName(repeated.withColumn(name, sha).dropDuplicates([id_col, name]).drop(name))

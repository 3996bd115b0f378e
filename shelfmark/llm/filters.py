"""Bitmap filters over keys, with false positives and no false negatives.

A filter is sized from the number of its keys. Up to MOST bits it is broadcast, and rows are marked where they are. Beyond that it is no
longer small whatever the keys, so rows are joined with the keys themselves. Both ways tell the same, but for false positives.
An empty set of keys knows no row. A row with a null key may be marked as known, and is never found among the keys. Repeated keys and rows
make no difference. Names of columns that are added for a while avoid those of the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITMAP = 32768  # bits in one bitmap of Spark's bitmap functions
PER_KEY = 10
MOST = 1 << 28  # bits: 32 MiB


def fresh(rows: DataFrame, name: str) -> str:
    """A name that no column of the rows has."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def size_for(keys: int) -> int:
    """Bits for so many keys: a power of two, of PER_KEY bits a key or more."""
    return max(BITMAP, 1 << (PER_KEY * max(keys, 1) - 1).bit_length())


def bit_of(key: str | Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits))


def bitmaps(keys: DataFrame, key: str, bits: int, *by: str) -> DataFrame:
    """bucket and bits (for each of the columns `by`)."""
    bit = bit_of(key, bits)
    rows = keys.select(*by, (bit / BITMAP).cast("long").alias("bucket"), (bit % BITMAP).alias("at"))
    return rows.groupBy(*by, "bucket").agg(F.bitmap_construct_agg("at").alias("bits"))


def is_set(bits: Column, bit: Column) -> Column:
    """Whether a bitmap, which may be null, has the bit."""
    at = (bit % BITMAP).cast("int")
    byte = F.conv(F.hex(F.substring(bits, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, at % 8) == 1, F.lit(False))


@dataclass(frozen=True)
class Filter:
    keys: DataFrame
    key: str
    bits: int

    def marked(self, rows: DataFrame, key: str, flag: str) -> DataFrame:
        """The rows with a column that says whether the filter knows their key."""
        if self.bits > MOST:
            mark, other = F.lit(True).alias(flag), fresh(rows, "__key")
            keys = self.keys.select(F.col(self.key).alias(other)).where(F.col(other).isNotNull()).distinct().select(other, mark)
            return rows.join(keys, rows[key] == keys[other], "left").drop(other).withColumn(flag, F.coalesce(flag, F.lit(False)))
        bucket, bits, bit = fresh(rows, "__bucket"), fresh(rows, "__bits"), bit_of(key, self.bits)
        maps = bitmaps(self.keys, self.key, self.bits).select(F.col("bucket").alias(bucket), F.col("bits").alias(bits))
        joined = rows.withColumn(bucket, (bit / BITMAP).cast("long")).join(F.broadcast(maps), bucket, "left")  # MOST bits at most
        return joined.withColumn(flag, is_set(F.col(bits), bit)).drop(bucket, bits)

    def split(self, rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
        """The rows that the filter knows, and the others."""
        flag = fresh(rows, "__known")
        both = self.marked(rows, key, flag)
        return both.where(F.col(flag)).drop(flag), both.where(~F.col(flag)).drop(flag)

    def known(self, rows: DataFrame, key: str) -> DataFrame:
        return self.split(rows, key)[0]


def build(keys: DataFrame, key: str) -> Filter:
    """A filter of the keys, which are counted first (about)."""
    n = keys.agg(F.approx_count_distinct(key)).first()[0]
    return Filter(keys, key, size_for(n))


def without(rows: DataFrame, key: str, dropped: DataFrame, second: Column | None = None) -> DataFrame:
    """The rows whose key (with a second part, computed only of rows that the filter knows, if one is given) is not among the dropped ones (key, and the second part); only rows that the filter knows are moved. Rows with a null key stay."""
    maybe, sure = build(dropped, dropped.columns[0]).split(rows, key)
    names, columns = [key], rows.columns
    if second is not None:
        names.append(fresh(rows, "__second"))
        maybe = maybe.withColumn(names[1], second)
    return sure.unionByName(maybe.join(dropped.toDF(*names), names, "left_anti").select(*columns))

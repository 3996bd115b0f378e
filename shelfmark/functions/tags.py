"""Tags as sorted arrays of distinct lower-case words, and the controlled vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, slug

KINDS = ("person", "company", "area", "fiscal-year", "lifecycle")
YEARS = (1900, 2200)


def normalize_one(tag: Column) -> Column:
    """The first line, trimmed and lower-case."""
    return F.lower(F.trim(F.substring_index(tag, "\n", 1)))


def normalize(tags: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(tags, F.array().cast("array<string>")), normalize_one), lambda t: F.coalesce(t != "", F.lit(False)))))


def apply(before: Column, add: Column, remove: Column) -> Column:
    return normalize(F.array_union(F.array_except(before, remove), add))


def added(before: Column, add: Column) -> Column:
    return F.array_sort(F.array_except(add, before))


def removed(before: Column, remove: Column) -> Column:
    return F.array_sort(F.array_intersect(remove, before))


def superseded(before: Column) -> Column:
    return apply(before, F.array(F.lit("superseded")), F.array(F.lit("active")))


def superseding(before: Column) -> Column:
    return apply(before, F.array(F.lit("active")), F.array(F.lit("superseded")))


def has(tags: Column, tag: str) -> Column:
    return F.array_contains(tags, tag.strip().lower())


def explicit(config: Config) -> dict[str, str]:
    """Kinds of the configured tags; where a tag has two kinds the later of KINDS holds."""
    out = {p.tag: "person" for p in config.people}
    for kind, tags in (("company", config.companies), ("area", config.areas), ("fiscal-year", config.fiscal_years), ("lifecycle", config.lifecycle)):
        out |= {t.strip().lower(): kind for t in tags}
    return out


def vocabulary(spark: SparkSession, config: Config) -> DataFrame:
    """tag and kind of every known tag: the configured ones, and the calendar's fiscal years. A few hundred rows at most for each configuration."""
    known = {config.calendar.tag_of(y): "fiscal-year" for y in range(YEARS[0], YEARS[1] + 1)} | explicit(config)
    return spark.createDataFrame(sorted(known.items()), "tag string, kind string")


def kind(config: Config, tag: Column) -> Column:
    """The kind of one tag, or unknown."""
    known = {config.calendar.tag_of(y): "fiscal-year" for y in range(YEARS[0], YEARS[1] + 1)} | explicit(config)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in sorted(known.items()) for x in kv]), tag), F.lit("unknown"))


def of_kind(config: Config, kind: str) -> list[str]:
    return sorted(t for t, k in explicit(config).items() if k == kind)


def known(config: Config, tags: Column) -> Column:
    """The tags that the vocabulary knows: configured ones, and names of fiscal years by their form."""
    listed = F.array(*[F.lit(t) for t in sorted(set(explicit(config)) | {config.calendar.tag_of(y) for y in range(YEARS[0], YEARS[1] + 1)})])
    return F.array_intersect(tags, listed)


def unknown(config: Config, tags: Column) -> Column:
    return F.array_except(tags, known(config, tags))


def proposed(config: Config, owners: Column, year: Column, identifier: Column) -> Column:
    """Tags for a document: its owners', its fiscal year's, its identifier's and `active`; unknown ones are left out."""
    from . import text as T

    people = F.create_map(*[F.lit(x) for p in config.people for x in (p.name, p.tag)]) if config.people else F.lit(None).cast("map<string,string>")
    tags = F.concat(F.transform(owners, lambda o: F.try_element_at(people, o)), F.array(F.when(year != 0, config.calendar.tag(year)), T.slug(identifier), F.lit("active")))
    return normalize(known(config, F.filter(tags, lambda t: t.isNotNull())))


def resulting(config: Config, before: Column, new: Column) -> Column:
    """Tags after filing: those of before that the vocabulary knows, and the new ones."""
    return normalize(F.array_union(known(config, normalize(before)), new))


__all__ = ["added", "apply", "explicit", "has", "kind", "known", "normalize", "of_kind", "proposed", "removed", "resulting", "slug", "superseded", "superseding", "unknown", "vocabulary"]

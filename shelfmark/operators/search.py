"""Documents of a collection, and the find algebra over them.

A documents frame has rel_path, name, size, mod_time, tags (array) and what `hydrate` adds; facts from a sidecar stand in a struct `meta`
(doctype, owners, identifier, year, fields, text, source_sha256), null without one.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import STAGING, Config, slug
from ..functions import tags as G
from ..functions import text as T
from ..functions.fiscal import Period
from . import grammar
from .catalog import Catalog

META = "struct<doctype:string,owners:array<string>,identifier:string,year:int,fields:map<string,string>,text:string,source_sha256:string>"
PLUMBING = ("vault.yaml", "INDEX.md", "AGENTS.md", "README.md", "audit.jsonl")


def hydrate(files: DataFrame, config: Config) -> DataFrame:
    """Adds category (null outside any), doc (what the name says) and a normalised tag set."""
    name = F.col("name") if "name" in files.columns else T.basename(F.col("rel_path"))
    tags = G.normalize(F.col("tags")) if "tags" in files.columns else F.array().cast("array<string>")
    return files.withColumn("name", name).withColumn("tags", tags).withColumn("category", grammar.category_at(config, F.col("rel_path"))).withColumn("doc", grammar.parse(config, F.col("name")))


def attach_sidecars(documents: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Left joins each document's sidecar (doc_path, meta); one at most."""
    return documents.join(sidecars.select(F.col("doc_path").alias("rel_path"), "meta"), "rel_path", "left")


def orphans(documents: DataFrame, sidecar_paths: DataFrame, path_col: str = "path") -> DataFrame:
    """Sidecars whose document is gone."""
    named = sidecar_paths.withColumn("rel_path", T.document_of(F.col(path_col)))
    return named.join(documents.select("rel_path"), "rel_path", "left_anti").select(path_col)


def with_placeholders(documents: DataFrame, placeholders: DataFrame) -> DataFrame:
    """Adds a row (size 0, evicted) for each placeholder (column path) whose document is not there."""
    missing = placeholders.select(T.placeholder_of(F.col("path")).alias("rel_path")).where("rel_path is not null").join(documents.select("rel_path"), "rel_path", "left_anti").distinct()
    rows = missing.withColumn("size", F.lit(0).cast("bigint")).withColumn("evicted", F.lit(True))
    return documents.withColumn("evicted", F.lit(False)).unionByName(rows, allowMissingColumns=True)


def plumbing(rel_path: Column) -> Column:
    return rel_path.isin(*PLUMBING)


def watchable(rel_path: Column) -> Column:
    """Whether a changed path is a document: no hidden file or folder, no plumbing, nothing staged."""
    parts = F.split(rel_path, "/")
    return ~F.exists(parts, lambda p: p.startswith(".")) & ~plumbing(rel_path) & ~F.exists(parts, lambda p: p.isin("manifests", STAGING))


def destination_fault(path: Column, root: str) -> Column:
    """Why a file can't go to a path, or null."""
    inside = path.startswith(root.rstrip("/") + "/") & ~F.exists(F.split(path, "/"), lambda p: p == "..")
    rel = F.substring(path, len(root.rstrip("/")) + 2, 1 << 20)
    return (
        F.when(~path.startswith("/"), "not absolute").when(~inside, "outside the collection").when(F.exists(F.split(rel, "/"), lambda p: p.isin("manifests", STAGING)), "reserved folder")
        .when(T.is_sidecar(path), "a sidecar").when(path.endswith("/"), "a folder")
    )


def effective(what: str) -> Column:
    """doctype, owners or year: from the name, else from the sidecar."""
    if what == "owners":
        return F.when(F.size("doc.owners") > 0, F.col("doc.owners")).otherwise(F.coalesce("meta.owners", F.array().cast("array<string>")))
    return F.coalesce(F.col(f"doc.{what}"), F.nullif(F.col(f"meta.{what}"), F.lit(0 if what == "year" else "")))


@dataclass(frozen=True)
class Query:
    """Filters that all must hold; those unset hold always."""

    person: str | None = None
    company: str | None = None
    area: str | None = None
    doctype: str | None = None
    period: str | None = None
    tags: tuple[str, ...] = ()
    text: str | None = None
    active: bool = False

    @property
    def empty(self) -> bool:
        return self == Query()

    def column(self, config: Config) -> Column:
        parts: list[Column] = []
        if self.active:
            parts.append(G.has(F.col("tags"), "active"))
        parts += [G.has(F.col("tags"), t) for t in self.tags]
        if self.doctype:
            parts.append(F.coalesce(effective("doctype") == slug(self.doctype), F.lit(False)))
        if self.person:
            parts.append(person(config, self.person))
        if self.company:
            parts.append(company(self.company))
        if self.area:
            parts.append(G.has(F.col("tags"), slug(self.area)))
        if self.period:
            parts.append(in_period(config, config.calendar.parse(self.period)))
        if self.text and self.text.strip():
            parts.append(holds_text(self.text))
        return reduce(lambda a, b: a & b, parts, F.lit(True))


def person(config: Config, who: str) -> Column:
    """By owner, tag or a folder of that name; people are known by name or tag, whatever their case."""
    known = next((p for p in config.people if who.strip().lower() in (p.name.lower(), p.tag.lower())), None)
    name, tag = (known.name, known.tag) if known else (who, slug(who))
    word = grammar.py_word(config, name).lower()
    return F.exists(effective("owners"), lambda o: T.slug(o) == slug(name)) | G.has(F.col("tags"), tag) | F.exists(F.split("rel_path", "/"), lambda s: F.lower(s) == word)


def company(name: str) -> Column:
    want = slug(name)
    if not want:
        return F.lit(False)
    return G.has(F.col("tags"), want) | F.coalesce(T.slug(F.col("doc.identifier")) == want, F.lit(False)) | F.coalesce(T.slug(F.col("meta.identifier")) == want, F.lit(False))


def in_period(config: Config, period: Period) -> Column:
    """A document's year is a whole fiscal year; it need only overlap. Unknown years never do."""
    first, to = config.calendar.range(effective("year"))
    return F.coalesce(period.overlaps(first, to), F.lit(False))


def holds_text(text: str) -> Column:
    """A substring, whatever its case, of anything known about a document."""
    needle = F.lit(text.strip().lower())
    one = [F.col("name"), F.col("rel_path"), F.col("doc.doctype"), F.col("doc.identifier"), F.col("doc.modifier"), F.array_join("doc.owners", " "), F.array_join("tags", " "), F.col("meta.text"), F.col("meta.identifier"), F.col("meta.doctype"), F.array_join("meta.owners", " ")]
    found = [F.coalesce(F.contains(F.lower(c), needle), F.lit(False)) for c in one]
    found.append(F.coalesce(F.exists(F.map_values("meta.fields"), lambda v: F.contains(F.lower(v), needle)), F.lit(False)))
    return reduce(lambda a, b: a | b, found)


def find(documents: DataFrame, query: Query, config: Config, limit: int = 0) -> DataFrame:
    """Matching documents with the columns of a result. With a limit they are the first in path order, and count is the number before it; without one (0) they are in no order, and whoever shows them sorts."""
    found = documents.where(query.column(config))
    rows = found.select(
        "rel_path", "name", "category", effective("doctype").alias("doctype"), effective("owners").alias("owners"), F.col("doc.identifier").alias("identifier"), effective("year").alias("year"), F.col("doc.modifier").alias("modifier"),
        F.col("doc.parsed").alias("parsed"), F.col("doc.ambiguous").alias("owners_ambiguous"), "tags", F.col("meta").isNotNull().alias("has_sidecar"), *[c for c in ("size", "mod_time") if c in documents.columns],
    )
    if limit:
        total = found.agg(F.count("*").alias("count"))
        return rows.orderBy("rel_path").limit(limit).join(F.broadcast(total))  # one row
    return rows


def resolve_one(documents: DataFrame, query: Query, config: Config):
    """The one document that matches, else ValueError naming up to eight."""
    some = documents.where(query.column(config)).select("rel_path").orderBy("rel_path").limit(9).collect()
    if len(some) != 1:
        raise ValueError("no document matches" if not some else "several documents match: " + ", ".join(r.rel_path for r in some[:8]))
    return some[0].rel_path


def resolve_path(documents: DataFrame, query: Query, config: Config, root: str) -> str:
    """The document that a text names as a path, absolute or below the root; else the one document that matches the query."""
    if query.text:
        rel = query.text[len(root.rstrip("/")) + 1 :] if query.text.startswith(root.rstrip("/") + "/") else query.text
        if documents.where(F.col("rel_path") == rel).limit(1).count():
            return rel
    return resolve_one(documents, query, config)


def gated(tags: Column, unsupported: Column, config: Config) -> Column:
    """Whether a document may only be sent after confirmation; unknown tags count as confidential."""
    return F.lit(config.confirm_confidential) & (unsupported | G.has(tags, "confidential"))


def select(rows: DataFrame, chosen: list[int], index_col: str = "index") -> DataFrame:
    return rows.where(F.col(index_col).isin(chosen)) if chosen else rows.where("false")


def parse_selection(text: str, n: int) -> list[int]:
    """`all`, `none`, or numbers and ranges such as 1,3-5 of 1 to n; anything doubtful is a ValueError."""
    s = text.strip().lower()
    if s in ("all", "none"):
        return list(range(1, n + 1)) if s == "all" else []
    out: list[int] = []
    for item in s.split(","):
        ends = [e.strip() for e in item.split("-")]
        if not 1 <= len(ends) <= 2 or not all(e.isascii() and e.isdigit() for e in ends):
            raise ValueError(f"{item!r} is no number or range")
        a, b = int(ends[0]), int(ends[-1])
        if not 1 <= a <= b <= n:
            raise ValueError(f"{item.strip()} is not within 1 to {n}")
        out += range(a, b + 1)
    if len(set(out)) < len(out):
        raise ValueError("a number is named twice")
    return sorted(out)


def catalog_category(catalog: Catalog, rows: DataFrame) -> DataFrame:
    """Adds the catalog's category of the effective doctype: a lookup as large as the catalog."""
    return rows.withColumn("catalog_category", catalog.category_of(effective("doctype")))


def overlapping(left: DataFrame, right: DataFrame, left_range: tuple[str, str], right_range: tuple[str, str]) -> DataFrame:
    """All columns of both for each pair of rows whose ranges (columns of the first day and the first day after) share a day.

    Both sides are dealt out to the years that they touch, and joined by year; each pair counts in the first year that both touch, so it comes once, however many they share. Neither side
    need be small. Ranges with a null end or without a day share none. Columns of the two sides may not share names.
    """
    (a, b), (c, d) = left_range, right_range
    at, other = T.fresh(left, "in_year"), T.fresh(right, "of_year")
    years = lambda first, after: F.explode(F.sequence(F.year(first), F.year(F.date_sub(after, 1))))
    left, right = left.where(F.col(a) < F.col(b)), right.where(F.col(c) < F.col(d))
    left, right = left.select("*", years(a, b).alias(at)), right.select("*", years(c, d).alias(other))
    shared = (F.col(a) < F.col(d)) & (F.col(c) < F.col(b)) & (F.col(at) == F.greatest(F.year(a), F.year(c)))
    return left.join(right, (F.col(at) == F.col(other)) & shared).drop(at, other)


LEVELS = 32  # of blocks of 1, 2, 4 and so on days; as many bits has the number of any day


def blocks(first: Column, after: Column) -> Column:
    """The fewest blocks (level, block) that make up the days from one number up to another, at most two of a level; block b of level v has the days from b * 2^v on. None without a day."""

    def at(v: Column) -> Column:
        x, y = -F.call_function("shiftright", -first, v), F.call_function("shiftright", after, v)
        one = lambda odd, block: F.when((x < y) & (odd.bitwiseAND(F.lit(1)) == 1), F.struct(v.alias("level"), block.alias("block")))
        return F.array(one(x, x), one(y, y - 1))

    levels = F.sequence(F.lit(0), F.length(F.bin(F.greatest(after - first, F.lit(1)))) - 1)
    return F.filter(F.flatten(F.transform(levels, at)), lambda b: b.isNotNull())


def overlap_counts(left: DataFrame, right: DataFrame, left_range: tuple[str, str], right_range: tuple[str, str], of: str = "id") -> DataFrame:
    """The right side's rows that share a day with rows of the left, and of these n, the number, first and last, the least and the greatest `of`. Ranges as in `overlapping`.

    No pair is made: a range either begins within the other or before it and goes on. Beginnings are summed up by blocks of days of which each period takes a few; ranges are cut into such
    blocks, of which each day lies in one a level. Both are joined on blocks, of which each is one row there; their number goes with that of the days, not of the rows.
    """
    (a, b), (c, d) = left_range, right_range
    p, q = T.fresh(right, "from_day"), T.fresh(right, "to_day")
    day = lambda x: F.unix_date(F.col(x)).cast("long")
    merged = [F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last")]
    ranges = left.where(F.col(a) < F.col(b)).groupBy(day(a).alias("x"), day(b).alias("y")).agg(F.count("*").alias("n"), F.min(of).alias("first"), F.max(of).alias("last"))
    right = right.where(F.col(c) < F.col(d)).withColumn(p, day(c)).withColumn(q, day(d))
    periods = right.select(F.col(p).alias("p"), F.col(q).alias("q")).distinct()
    every = lambda rows, at: rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("level")).withColumn("block", F.call_function("shiftright", F.col(at), F.col("level")))
    begun = every(ranges.groupBy("x").agg(*merged), "x").groupBy("level", "block").agg(*merged)
    within = periods.select("p", "q", F.inline(blocks(F.col("p"), F.col("q")))).join(begun, ["level", "block"]).select("p", "q", "n", "first", "last")
    through = ranges.select("n", "first", "last", F.inline(blocks(F.col("x") + 1, F.col("y")))).groupBy("level", "block").agg(*merged)
    gone_on = every(periods.select("p").distinct(), "p").join(through, ["level", "block"]).groupBy("p").agg(*merged)
    found = within.unionByName(periods.join(gone_on, "p")).groupBy(F.col("p").alias(p), F.col("q").alias(q)).agg(*merged)
    return right.join(found, [p, q]).drop(p, q)

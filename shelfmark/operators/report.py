"""Aggregates over a collection, and its index as text."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import tags as G
from .catalog import Catalog
from .search import effective

OUTSIDE, UNRECOGNISED = "(outside any configured category)", "(unrecognised)"


def totals(documents: DataFrame, orphans: DataFrame) -> DataFrame:
    """One row: documents, those with a sidecar, parsed ones, categories in use, and orphans."""
    mine = documents.agg(F.count("*").alias("documents"), F.count_if(F.col("meta").isNotNull()).alias("sidecars"), F.count_if("doc.parsed").alias("parsed"), F.count_distinct("category").alias("categories"))
    return mine.join(F.broadcast(orphans.agg(F.count("*").alias("orphans"))))  # one row each


def by_category(documents: DataFrame, config: Config) -> DataFrame:
    """category, n: all configured ones, also those without documents, and what lies outside."""
    spark: SparkSession = documents.sparkSession
    found = documents.groupBy(F.coalesce("category", F.lit(OUTSIDE)).alias("category")).agg(F.count("*").alias("n"))
    known = spark.createDataFrame([(c.name,) for c in config.categories], "category string")
    return found.join(F.broadcast(known), "category", "full").select("category", F.coalesce("n", F.lit(0)).alias("n"))


def by_doctype(documents: DataFrame, catalog: Catalog) -> DataFrame:
    """doctype, category, n of the types that occur."""
    doctype = F.coalesce("doc.doctype", F.lit(UNRECOGNISED))
    return documents.groupBy(doctype.alias("doctype")).agg(F.count("*").alias("n")).withColumn("category", F.coalesce(catalog.category_of(F.col("doctype")), F.lit("—")))


def filed_by_doctype(documents: DataFrame, catalog: Catalog, built_in: set[str]) -> DataFrame:
    """doctype, category, source, n of all types of the catalog."""
    spark = documents.sparkSession
    table = spark.createDataFrame([(t.name, t.category, "built-in" if t.name in built_in else "vault") for t in catalog.types], "doctype string, category string, source string")
    found = documents.groupBy(effective("doctype").alias("doctype")).agg(F.count("*").alias("n"))
    return table.join(found, "doctype", "left").select("doctype", "category", "source", F.coalesce("n", F.lit(0)).alias("n"))


def tags_in_use(documents: DataFrame, config: Config) -> DataFrame:
    """tag, kind, n."""
    counted = documents.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    return counted.join(F.broadcast(G.vocabulary(documents.sparkSession, config)), "tag", "left").select("tag", F.coalesce("kind", F.lit("unknown")).alias("kind"), "n")


def harvest(documents: DataFrame) -> DataFrame:
    """tag: every tag that any document has, once, in order. Null and empty tag sets give none."""
    return documents.select(F.explode("tags").alias("tag")).distinct().orderBy("tag")


def index_lines(documents: DataFrame, orphans: DataFrame, config: Config, catalog: Catalog, title: str) -> Iterator[str]:
    """The lines of the index as Markdown. Its tables are as large as the configuration, but for that of the tags, which has every tag and comes a part at a time."""
    t = totals(documents, orphans).first()
    yield from [f"# {title}", "", f"{t.documents} documents, {t.sidecars} with a sidecar, {t.parsed} with a parsed name, {t.orphans} orphan sidecars.", "", "| category | documents |", "|---|---|"]
    rows = {r.category: r.n for r in by_category(documents, config).collect()}
    yield from [f"| {k} | {rows[k]} |" for k in sorted(rows, key=lambda k: (k == OUTSIDE, k))]
    yield from ["", "| type | category | documents |", "|---|---|---|"]
    yield from [f"| {r.doctype} | {r.category} | {r.n} |" for r in sorted(by_doctype(documents, catalog).collect(), key=lambda r: r.doctype)]
    yield from ["", "| tag | kind | documents |", "|---|---|---|"]
    for r in tags_in_use(documents, config).orderBy("tag").toLocalIterator():
        yield f"| `{r.tag}` | {r.kind} | {r.n} |"


def index_text(documents: DataFrame, orphans: DataFrame, config: Config, catalog: Catalog, title: str) -> str:
    """The index as Markdown; equal collections give equal bytes."""
    return "".join(line + "\n" for line in index_lines(documents, orphans, config, catalog, title))


def agents_lines(config: Config, catalog: Catalog, title: str) -> Iterator[str]:
    """The lines of a guide for programs that work with the collection: where things lie, how names are built, what is known, and how to ask. As large as the configuration."""
    yield from [f"# Guide to {title}", "", "Written by a program; edits are lost when it is written again.", "", "## Where documents lie", "", "| category | folder |", "|---|---|"]
    yield from [f"| {c.name} | `{c.path}` |" for c in sorted(config.categories, key=lambda c: c.name)]
    yield from ["", "## People", "", *[f"* {p.name} (tag `{p.tag}`)" for p in config.people], "", "## Types", "", *[f"* `{t.name}` ({t.category})" for t in catalog.types], "", "## Tags", ""]
    yield from [f"* `{tag}` ({kind})" for tag, kind in sorted(G.explicit(config).items())]
    yield from ["", "## Asking and changing", "", "* `find`, `resolve`, `lint`, `index`, `doctypes` and `log` only read.", "* `ingest`, `reindex`, `move`, `tag` and `supersede` say what they would do, and do it with `--yes`; nothing is ever deleted.", "* `rollback` undoes a manifest."]

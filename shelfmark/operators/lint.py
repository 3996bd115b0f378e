"""Rules about how documents are named, placed and tagged: each a frame of (rule, severity, path, message, fixable, move_to, add_tag)."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import tags as G
from ..functions import text as T
from . import grammar
from .catalog import Catalog, union
from .search import effective

SEVERITY = {
    "name-grammar": "error", "name-normalization": "warning", "unknown-doctype": "warning", "wrong-folder": "warning", "unknown-tag": "warning", "missing-lifecycle-tag": "warning",
    "multiple-active": "error", "password-in-filename": "error", "stale-sidecar": "warning", "orphan-sidecar": "info", "unfiled": "warning",
}


def finding(rule: str, condition: Column, message: Column, move_to: Column | None = None, add_tag: Column | None = None) -> Column:
    """A finding where the condition holds, else null."""
    none = F.lit(None).cast("string")
    move, tag = none if move_to is None else move_to, none if add_tag is None else add_tag
    return F.when(condition, F.struct(F.lit(rule).alias("rule"), F.lit(SEVERITY[rule]).alias("severity"), message.alias("message"), (move.isNotNull() | tag.isNotNull()).alias("fixable"), move.alias("move_to"), tag.alias("add_tag")))


def rows_of(rows: DataFrame, found: Column, path: str = "rel_path") -> DataFrame:
    """A row for each finding of an array."""
    return rows.select(F.col(path).alias("path"), F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f")).select("f.rule", "f.severity", "path", "f.message", "f.fixable", "f.move_to", "f.add_tag")


def prepared(documents: DataFrame, config: Config, catalog: Catalog) -> DataFrame:
    """Adds where each document belongs by its own name, and by its sidecar."""
    cat = catalog.category_of(F.col("doc.doctype"))
    own = grammar.path(config, F.col("doc.doctype"), F.col("doc.owners"), F.col("doc.identifier"), F.col("doc.year"), F.col("doc.modifier"), F.col("doc.ext"), cat)
    meta_owners = F.coalesce("meta.owners", F.array().cast("array<string>"))
    by_meta = grammar.path(config, F.col("meta.doctype"), meta_owners, F.col("meta.identifier"), F.col("meta.year"), F.lit(None).cast("string"), F.col("doc.ext"), catalog.category_of(F.col("meta.doctype")))
    out = documents.withColumn("canonical", F.when(F.col("doc.parsed") & catalog.has(F.col("doc.doctype")) & ~F.col("doc.ambiguous"), own)).withColumn("by_meta", F.when(~F.col("doc.parsed"), by_meta))
    return out.withColumn("by_meta", F.when(grammar.parse(config, T.basename(F.col("by_meta")))["parsed"], F.col("by_meta")))


def findings(documents: DataFrame, orphans: DataFrame, config: Config, catalog: Catalog, rules: Collection[str] = tuple(SEVERITY)) -> DataFrame:
    """Rules, all by default, over hydrated documents (with meta, sha256 and evicted where they are known) and orphan sidecars (path). Rules on one document share one pass; what only others need is not worked out."""
    if unknown := set(rules) - set(SEVERITY):
        raise ValueError(f"there is no rule {sorted(unknown)[0]}")
    d = prepared(documents, config, catalog)
    parsed, canonical = F.col("doc.parsed"), F.col("canonical")
    tagged = F.lit(True) if "tags_unsupported" not in d.columns else ~F.col("tags_unsupported")
    lifecycle = F.array(*map(F.lit, config.lifecycle))
    out = {
        "name-grammar": finding("name-grammar", ~parsed, F.concat("name", F.lit(" does not follow the grammar")), F.col("by_meta")),
        "name-normalization": finding("name-normalization", T.basename(canonical) != F.col("name"), F.concat(F.lit("should be named "), T.basename(canonical)), canonical),
        "unknown-doctype": finding("unknown-doctype", parsed & ~catalog.has(F.col("doc.doctype")), F.concat("doc.doctype", F.lit(" is not in the catalog"))),
        "wrong-folder": finding("wrong-folder", T.dirname(canonical) != T.dirname(F.col("rel_path")), F.concat(F.lit("belongs in "), T.dirname(canonical)), canonical),
        "unfiled": finding("unfiled", F.col("category").isNull(), F.lit("outside any category")),
    }
    if config.require_lifecycle:
        said = G.normalize(F.split(F.coalesce(F.try_element_at("meta.fields", F.lit("lifecycle")), F.lit("")), ","))
        one = F.array_intersect(said, lifecycle)
        out["missing-lifecycle-tag"] = finding("missing-lifecycle-tag", tagged & (F.size(F.array_intersect("tags", lifecycle)) == 0), F.lit("no lifecycle tag"), None, F.when(F.size(one) == 1, F.get(one, F.lit(0))))
    if not config.allow_passwords:
        token = T.password_token(F.col("name"))
        out["password-in-filename"] = finding("password-in-filename", token.isNotNull(), F.concat(F.lit("the name holds "), token))
    if "sha256" in d.columns:
        here = ~F.col("evicted") if "evicted" in d.columns else F.lit(True)
        out["stale-sidecar"] = finding("stale-sidecar", here & (F.coalesce("meta.source_sha256", F.lit("")) != "") & (F.col("meta.source_sha256") != F.col("sha256")), F.lit("the file changed since its facts were taken"))
    each = F.array(*[x for rule, x in out.items() if rule in rules] or [finding("unfiled", F.lit(False), F.lit(""))])
    if "unknown-tag" in rules:
        strange = F.transform(F.when(tagged, G.unknown(config, F.col("tags"))).otherwise(F.array().cast("array<string>")), lambda t: finding("unknown-tag", F.lit(True), F.concat(t, F.lit(" is not in the vocabulary"))))
        each = F.concat(each, strange)
    found = [rows_of(d, each)]
    if "multiple-active" in rules:
        found.append(multiple_active(documents.where(tagged), config))
    if "orphan-sidecar" in rules:
        found.append(rows_of(orphans, F.array(finding("orphan-sidecar", F.lit(True), F.lit("its document is gone"))), "path"))
    return union(found)


NAMED = 50  # paths in one message; the findings themselves are one a document, however many


def multiple_active(documents: DataFrame, config: Config) -> DataFrame:
    """Every active document of a watched type and owner of which there are two or more. Groups are counted before they are joined back, so none is gathered."""
    owner = F.explode(F.when(F.size(effective("owners")) > 0, effective("owners")).otherwise(F.array(F.lit(""))))
    rows = documents.where(G.has(F.col("tags"), "active") & effective("doctype").isin(list(config.single_active))).select("rel_path", effective("doctype").alias("doctype"), owner.alias("owner")).withColumn("owner", T.slug(F.col("owner")))
    group = Window.partitionBy("doctype", "owner").orderBy("rel_path")
    few = rows.withColumn("k", F.row_number().over(group)).where(F.col("k") <= NAMED)  # the sort of a group is Spark's, and stops mattering after so many
    many = rows.groupBy("doctype", "owner").agg(F.count("*").alias("n")).where("n > 1")
    names = few.groupBy("doctype", "owner").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "rel_path"))), lambda x: x["rel_path"]), ", ").alias("names"))
    more = F.when(F.col("n") > NAMED, F.concat(F.lit(" and "), (F.col("n") - NAMED).cast("string"), F.lit(" more"))).otherwise("")
    many = many.join(names, ["doctype", "owner"])
    message = F.concat(F.concat_ws(" ", F.col("n").cast("string"), F.lit("active"), "doctype", F.lit("documents of"), F.when(F.col("owner") == "", "nobody").otherwise(F.col("owner"))), F.lit(": "), "names", more)
    return rows_of(rows.join(many, ["doctype", "owner"]), F.array(finding("multiple-active", F.lit(True), message)))


def counts(found: DataFrame) -> DataFrame:
    """One row: findings by severity, and how many can be fixed."""
    return found.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("error", "warning", "info")], F.count_if("fixable").alias("fixable"))


def fixes(found: DataFrame) -> DataFrame:
    """One move per file, and none of two to one place: path, move_to."""
    moves = found.where("move_to is not null").groupBy("path").agg(F.min("move_to").alias("move_to"))
    taken = moves.groupBy("move_to").agg(F.count("*").alias("n"))
    return moves.join(taken.where("n = 1"), "move_to").select("path", "move_to")


def ordered(found: DataFrame) -> DataFrame:
    return found.orderBy("path", "rule", "message")


def numbered(found: DataFrame, by: str) -> DataFrame:
    return found.withColumn("index", F.row_number().over(Window.partitionBy(by).orderBy("path", "rule")))

"""The catalog of document types, scoring of texts against it, and extraction of fields.

Weight of a type: its keywords that occur (each once, between word edges, in lower-cased text), and three for each of its patterns. Types are ranked by weight,
then name. The first is taken if it has a pattern or two keywords; confidence is
least(0.95, w/(w+3) * (0.5 + 0.5 * (w - runner-up)/w)), in doubles.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, replace
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, DocType, slug
from ..functions import text as T
from ..functions.regex import java, phrase

UNCLASSIFIED = "unclassified"
PATTERN_WEIGHT = 3
EDGES = r"^\s+|\s+$"
DEFAULT = os.path.join(os.path.dirname(__file__), "doctypes.yaml")


def built_in(path: str = DEFAULT) -> list[DocType]:
    """Types out of a YAML file; an extract may name one of its templates."""
    import yaml

    with open(path, encoding="utf-8") as f:
        said = yaml.safe_load(f)
    shared = said.get("templates", {})
    return [DocType(k, v["category"], tuple(v.get("keywords", ())), tuple(v.get("patterns", ())), tuple((n, shared.get(x, x)) for n, x in v.get("extract", {}).items())) for k, v in said["doctypes"].items()]


@dataclass(frozen=True)
class Catalog:
    types: tuple[DocType, ...]

    @staticmethod
    def of(config: Config, path: str = DEFAULT) -> Catalog:
        """Built-in types whose category exists, and the configured ones, which replace those of the same name."""
        known = {c.name for c in config.categories}
        types = {t.name: t for t in built_in(path) if t.category in known} | {slug(t.name): replace(t, name=slug(t.name)) for t in config.doctypes}
        return Catalog(tuple(types[k] for k in sorted(types)))

    @property
    def names(self) -> list[str]:
        return [t.name for t in self.types]

    @property
    def spec(self) -> str:
        """What a model is told: name:category, in order."""
        return ",".join(f"{t.name}:{t.category}" for t in self.types)

    def category_of(self, doctype: Column) -> Column:
        pairs = ", ".join(T.quoted(x) for t in self.types for x in (t.name, t.category))
        return F.try_element_at(F.expr(f"map({pairs})"), doctype)

    def has(self, doctype: Column) -> Column:
        return F.coalesce(doctype.isin(self.names), F.lit(False))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(t.name, t.category) for t in self.types], "doctype string, category string")

    def evidence(self, text: str, low: str) -> Column:
        """An array of (doctype, keywords, patterns) of the types of which anything occurs; text and low, its lower-cased form, are columns. Patterns are literals, so each is compiled once."""
        return F.expr(evidence_sql(self, T.named(text), T.named(low)))


@lru_cache(64)
def evidence_sql(catalog: Catalog, text: str, low: str) -> str:
    total = lambda tests: " + ".join(f"if({x}, 1L, 0L)" for x in tests) or "0L"
    kinds = []
    for t in catalog.types:
        words = total(f"contains({low}, {T.quoted(k.lower())}) AND {low} RLIKE {T.quoted(phrase(k.lower()))}" for k in dict.fromkeys(t.keywords))
        kinds.append(f"named_struct('doctype', {T.quoted(t.name)}, 'keywords', {words}, 'patterns', {total(f'{text} RLIKE {T.quoted(java(p))}' for p in t.patterns)})")
    return f"filter(array({', '.join(kinds)}), k -> k.keywords > 0 OR k.patterns > 0)"


@lru_cache(64)
def fields_sql(catalog: Catalog) -> str:
    """The map of fields of x (doctype, text)."""
    parts = []
    for t in catalog.types:
        if t.extract:
            names = ", ".join(T.quoted(n) for n, _ in t.extract)
            values = ", ".join(f"regexp_replace(regexp_extract(x.text, {T.quoted(java(p))}, 1), {T.quoted(EDGES)}, '')" for _, p in t.extract)
            parts.append(f"WHEN {T.quoted(t.name)} THEN map_filter(map_from_arrays(array({names}), array({values})), (k, v) -> v != '')")
    return f"CASE x.doctype {' '.join(parts)} END" if parts else "cast(NULL AS map<string,string>)"


def hits(texts: DataFrame, catalog: Catalog, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, doctype, keywords and patterns that occur. Texts are looked through once each, in place; nothing moves. Null texts have no hits."""
    rows = texts.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("low", F.lower("text"))
    return rows.select("id", F.inline(catalog.evidence("text", "low")))


def scores(texts: DataFrame, catalog: Catalog, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Adds weight."""
    return hits(texts, catalog, id_col, text_col).withColumn("weight", F.col("keywords") + PATTERN_WEIGHT * F.col("patterns"))


def confidence(weight: Column, runner_up: Column) -> Column:
    w, r = weight.cast("double"), runner_up.cast("double")
    return F.least(F.lit(0.95), w / (w + 3.0) * (0.5 + 0.5 * ((w - r) / w)))


RESULTS = ("doctype", "category", "confidence", "accepted", "weight", "runner_up")


def classified(rows: DataFrame, catalog: Catalog, min_confidence: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows with doctype, category, confidence, accepted, weight and runner_up of their text; unclassified where the first type falls short, as with a null or empty text. No row moves.

    Columns of the rows that bear a result's name are replaced; the text's own may not be one of these.
    """
    rows = T.without(rows, *RESULTS)
    said, low, best = (T.fresh(rows, n) for n in ("said", "low", "ranked"))
    rows = rows.withColumn(said, F.coalesce(text_col, F.lit(""))).withColumn(low, F.lower(said))
    ranked = F.array_sort(F.transform(catalog.evidence(said, low), lambda k: F.struct((-(k["keywords"] + PATTERN_WEIGHT * k["patterns"])).alias("less"), k["doctype"].alias("doctype"), ((k["patterns"] > 0) | (k["keywords"] >= 2)).alias("enough"))))
    rows = T.once(rows, **{best: ranked}).drop(said, low)
    top, following = F.get(best, F.lit(0)), F.get(best, F.lit(1))
    enough, none = F.coalesce(top["enough"], F.lit(False)), F.lit(0).cast("long")
    rows = T.once(rows, doctype=F.when(enough, top["doctype"]).otherwise(UNCLASSIFIED), weight=F.when(enough, -top["less"]).otherwise(none), runner_up=F.when(enough, F.coalesce(-following["less"], none)).otherwise(none))
    sure = F.when(F.col("weight") > 0, confidence(F.col("weight"), F.col("runner_up"))).otherwise(F.lit(0.0))
    rows = rows.withColumn("category", catalog.category_of(F.col("doctype"))).withColumn("confidence", sure)
    return rows.withColumn("accepted", (F.col("weight") > 0) & (F.col("confidence") >= min_confidence)).drop(best)


def classify(texts: DataFrame, catalog: Catalog, min_confidence: float = 0.5, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, doctype, category, confidence, accepted, weight, runner_up: one row a text."""
    rows = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return classified(rows, catalog, min_confidence).select("id", "doctype", "category", "confidence", "accepted", "weight", "runner_up")


def extract_fields(catalog: Catalog, doctype: Column, text: Column) -> Column:
    """A map of the fields of a text's type: of each pattern's first match the first group, trimmed; null without any. Each pattern is tried once."""
    made = T.let_sql(F.struct(doctype.alias("doctype"), text.alias("text")), fields_sql(catalog))
    return T.let(made, lambda m: F.when(F.size(m) > 0, m))


def extract_one(catalog: Catalog, doctype: str, name: str, text: Column) -> Column:
    pattern = dict(next(t for t in catalog.types if t.name == doctype).extract)[name]
    return F.trim(F.regexp_extract(text, java(pattern), 1))


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)

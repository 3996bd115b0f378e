"""Tiers of classifiers in order: the first usable answer holds, and each attempt says what came of it.

An attempt is `answered`; `declined`, where the tier looked and found that no type fits; `unusable`, where it named no known type or was not sure enough; or `failed`, with its fault: then it
said nothing about the document, and the result says that it is degraded. Rules come last, and are always there; where they too fall short the document is unclassified.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import model
from . import text as T

RULES, UNCLASSIFIED = "rules", "unclassified"


@dataclass(frozen=True)
class Tier:
    """A tier by name; answers stand in a column as JSON. One that is not there is passed over, unless it is asked for by name."""

    name: str
    answers: str
    available: bool = True
    detail: str = ""


def ordered(tiers: Sequence[Tier], forced: str = "") -> list[Tier]:
    """The tiers that are asked, before rules: all that are there, or the one that is forced. One that is forced and is not there is a ValueError: another in its place would misreport who decided."""
    if forced in ("", RULES):
        return [] if forced else [t for t in tiers if t.available]
    found = [t for t in tiers if t.name == forced]
    if not found or not found[0].available:
        raise ValueError(f"tier {forced!r} is not available" + (f" ({found[0].detail})" if found and found[0].detail else ""))
    return found


def attempt(json: Column, catalog, min_confidence: float) -> Column:
    """status, reason and answer (doctype, category, confidence, fields) of one tier's reply."""
    why, good = model.fault(json), model.validated(json, catalog, min_confidence)
    said = T.slug(F.from_json(json, model.REPLY)["doctype"])
    parts = F.struct(why.alias("why"), good.alias("good"), said.alias("said"))

    def told(x: Column) -> Column:
        status = F.when(x["why"].isNotNull(), "failed").when(x["said"] == UNCLASSIFIED, "declined").when(x["good"].isNull(), "unusable").otherwise("answered")
        reason = F.coalesce(x["why"], F.when(x["said"] == UNCLASSIFIED, "no type fits").when(~catalog.has(x["said"]), "unknown type").when(x["good"].isNull(), "not sure enough"))
        return F.struct(status.alias("status"), reason.alias("reason"), F.when(status == "answered", x["good"]).alias("answer"))

    return T.let(parts, told)


def classified(tiers: Sequence[Tier], rules: Column, catalog, min_confidence: float, forced: str = "") -> Column:
    """doctype, category, confidence, tier, degraded (tier and reason of the first that failed, or null) and attempts (tier, status, reason), which end with the tier that decided. rules: a struct of doctype, category and confidence, perhaps null."""
    asked = ordered(tiers, forced)
    sure = F.coalesce(catalog.has(rules["doctype"]) & (rules["confidence"] >= min_confidence), F.lit(False))
    last = F.struct(
        F.when(sure, rules["doctype"]).otherwise(UNCLASSIFIED).alias("doctype"), F.when(sure, catalog.category_of(rules["doctype"])).alias("category"),
        F.when(sure, rules["confidence"]).otherwise(F.lit(0.0)).cast("double").alias("confidence"), F.lit(RULES).alias("tier"),
    )
    every = F.struct(*[attempt(F.col(t.answers), catalog, min_confidence).alias(f"t{k}") for k, t in enumerate(asked)], last.alias("last"), sure.alias("sure"))

    def decided(x: Column) -> Column:
        result, done = x["last"], F.lit(len(asked))
        for k, t in reversed(list(enumerate(asked))):
            a = x[f"t{k}"]["answer"]
            result = F.when(a.isNotNull(), F.struct(a["doctype"].alias("doctype"), a["category"].alias("category"), a["confidence"].alias("confidence"), F.lit(t.name).alias("tier"))).otherwise(result)
            done = F.when(a.isNotNull(), F.lit(k)).otherwise(done)
        one = lambda name, status, reason: F.struct(F.lit(name).alias("tier"), status.alias("status"), reason.cast("string").alias("reason"))
        tried = [one(t.name, x[f"t{k}"]["status"], x[f"t{k}"]["reason"]) for k, t in enumerate(asked)]
        tried.append(one(RULES, F.when(x["sure"], "answered").otherwise("unusable"), F.when(~x["sure"], "not sure enough")))
        both = F.struct(result.alias("result"), F.slice(F.array(*tried), F.lit(1), done + 1).alias("attempts"))
        failed = lambda y: F.get(F.filter(y["attempts"], lambda t: t["status"] == "failed"), F.lit(0))
        degraded = lambda y: T.let(failed(y), lambda f: F.when(f.isNotNull(), F.struct(f["tier"].alias("tier"), f["reason"].alias("reason"))))
        return T.let(both, lambda y: F.struct(*[y["result"][c].alias(c) for c in ("doctype", "category", "confidence", "tier")], degraded(y).alias("degraded"), y["attempts"].alias("attempts")))

    return T.let(every, decided)


def describe(spark: SparkSession, tiers: Sequence[Tier], forced: str = "") -> DataFrame:
    """name, available, detail, place (from 1 in the order in which tiers are asked, or null) and fault (of a forced tier that is not there) of each tier and of rules."""
    try:
        order, fault = [t.name for t in ordered(tiers, forced)], None
    except ValueError as e:
        order, fault = None, str(e)
    place = lambda name: None if order is None or name not in [*order, RULES] else [*order, RULES].index(name) + 1
    rows = [(t.name, t.available, t.detail, place(t.name), fault if t.name == forced else None) for t in tiers] + [(RULES, True, "built in", place(RULES), None)]
    return spark.createDataFrame(rows, "name string, available boolean, detail string, place int, fault string")

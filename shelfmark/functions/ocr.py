"""Answers of text recognisers: blocks put in reading order, and their confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEMA = "struct<contract:int,engine:string,confidence:double,pages:int,total_pages:int,truncated:boolean,blocks:array<struct<text:string,bbox:array<double>,confidence:double,page:int>>>"
CONTRACT = 1


def parsed(json: Column) -> Column:
    """The answer, or null where it is malformed or made for another contract."""
    said = F.from_json(json, SCHEMA)
    return F.when(said["contract"] == CONTRACT, said)


def ordered(blocks: Column) -> Column:
    """By page, then from top, then from left; equal ones stay in order."""
    keyed = F.transform(blocks, lambda b, i: F.struct(F.coalesce(b["page"], F.lit(0)).alias("p"), F.coalesce(F.get(b["bbox"], F.lit(1)), F.lit(0.0)).alias("y"), F.coalesce(F.get(b["bbox"], F.lit(0)), F.lit(0.0)).alias("x"), i.alias("i"), b.alias("b")))
    return F.transform(F.array_sort(F.transform(keyed, lambda k: F.struct(k["p"].alias("p"), k["y"].alias("y"), k["x"].alias("x"), k["i"].alias("i"), k["b"]["text"].alias("text")))), lambda k: k["text"])


def text(answer: Column) -> Column:
    return F.array_join(F.filter(F.transform(ordered(answer["blocks"]), lambda t: F.trim(t)), lambda t: t != ""), "\n")


def mean_confidence(answer: Column) -> Column:
    blocks = answer["blocks"]
    return F.when(F.size(blocks) > 0, F.aggregate(blocks, F.lit(0.0), lambda s, b: s + b["confidence"]) / F.size(blocks)).otherwise(F.lit(0.0))


def weighted_confidence(answer: Column) -> Column:
    """By the length of each block's text, to four places."""
    weight = lambda b: F.greatest(F.length(b["text"]), F.lit(1))
    top = F.aggregate(answer["blocks"], F.lit(0.0), lambda s, b: s + b["confidence"] * weight(b))
    return F.round(top / F.aggregate(answer["blocks"], F.lit(0), lambda s, b: s + weight(b)), 4)


def pages(answer: Column) -> Column:
    return F.aggregate(answer["blocks"], F.lit(0), lambda m, b: F.greatest(m, b["page"]))


def truncated(answer: Column) -> Column:
    return F.coalesce(answer["truncated"], answer["pages"] < answer["total_pages"], F.lit(False))

"""Answers of model tiers: decoding, validation against the catalog, and the fallback to rules. Names, end points and tool outputs around them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

REPLY = "struct<contract:int,engine:string,doctype:string,category:string,confidence:double,fields:map<string,string>,error:string,message:string>"
CONTRACT = 1


def first_object(answer: Column) -> Column:
    """The first balanced {...} of an answer, which may stand in prose or a fence; braces inside quoted text do not count. Null without one."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(0).alias("first"), F.lit(0).alias("last"))

    def step(s: Column, c: Column) -> Column:
        at, open_, shut = s["at"] + 1, ~s["quoted"] & (c == "{"), ~s["quoted"] & (c == "}") & (s["depth"] > 0)
        depth = F.when(open_, s["depth"] + 1).when(shut, s["depth"] - 1).otherwise(s["depth"])
        quoted = F.when(s["quoted"], (c != '"') | s["escaped"]).otherwise(c == '"')
        new = F.struct(
            at.alias("at"), depth.alias("depth"), quoted.alias("quoted"), (s["quoted"] & ~s["escaped"] & (c == "\\")).alias("escaped"),
            F.when(open_ & (s["depth"] == 0), at).otherwise(s["first"]).alias("first"), F.when(shut & (depth == 0), at).otherwise(F.lit(0)).alias("last"),
        )
        return F.when(s["last"] > 0, s).otherwise(new)

    return F.aggregate(F.split(answer, ""), start, step, lambda s: F.when(s["last"] > 0, F.substring(answer, s["first"], s["last"] - s["first"] + 1)))


def share(confidence: Column) -> Column:
    """A confidence, also one written as text or of a hundred, as 0 to 1 with four places; null for no number."""
    n = F.trim(confidence.cast("string")).try_cast("double")
    return F.round(F.least(F.greatest(F.when(n > 1, n / 100).otherwise(n), F.lit(0.0)), F.lit(1.0)), 4)


def loose_answer(answer: Column) -> Column:
    """(doctype, category, confidence, fields) that a small model's free answer holds; null where no object with a type can be read."""
    said = F.from_json(first_object(answer), "struct<doctype:string,category:string,confidence:string,fields:map<string,string>>")
    good = F.trim(F.coalesce(said["doctype"], F.lit(""))) != ""
    return F.when(good, F.struct(F.trim(said["doctype"]).alias("doctype"), said["category"].alias("category"), F.coalesce(share(said["confidence"]), F.lit(0.0)).alias("confidence"), said["fields"].alias("fields")))


def fault(json: Column) -> Column:
    """Why an answer can't be used: bad_response, unsupported_contract or the helper's own code; null for a good one."""
    said = F.from_json(json, REPLY)
    broken = said.isNull() | ~F.coalesce(F.trim(json).rlike(r"(?s)^\{.*\}$"), F.lit(False))
    return F.when(broken, "bad_response").when(F.coalesce(said["error"], F.lit("")) != "", said["error"]).when(F.coalesce(said["contract"], F.lit(0)) != CONTRACT, "unsupported_contract").when(F.trim(F.coalesce(said["doctype"], F.lit(""))) == "", "bad_response")


def validated(json: Column, catalog, min_confidence: float) -> Column:
    """(doctype, category, confidence, fields) of an answer that names a type of the catalog, surely enough; else null. The catalog's category holds."""
    from .text import slug

    said = F.when(fault(json).isNull(), F.from_json(json, REPLY))
    doctype, sure = slug(said["doctype"]), said["confidence"]
    clamped = F.least(F.greatest(sure, F.lit(0.0)), F.lit(1.0))
    good = catalog.has(doctype) & sure.isNotNull() & ~F.isnan(sure) & (F.abs(sure) < float("inf")) & (clamped >= min_confidence)
    return F.when(good, F.struct(doctype.alias("doctype"), catalog.category_of(doctype).alias("category"), clamped.alias("confidence"), said["fields"].alias("fields")))


def chosen(model: Column, rules: Column) -> Column:
    """The model's answer where there is one, else that of the rules, with the tier that gave it. Both are structs of doctype, category and confidence."""
    tier = lambda x, name: F.struct(x["doctype"].alias("doctype"), x["category"].alias("category"), x["confidence"].alias("confidence"), F.lit(name).alias("tier"))
    return F.when(model.isNotNull(), tier(model, "model")).otherwise(tier(rules, "rules"))


def model_basename(model: Column) -> Column:
    return F.substring_index(F.trim(model), "/", -1)


def normalized_model(model: Column) -> Column:
    """Without registry and tag, in lower case."""
    return F.lower(F.substring_index(F.substring_index(F.trim(model), ":", 1), "/", -1))


def is_local(endpoint: Column) -> Column:
    """Whether an end point stays on this machine; an empty one does, 0.0.0.0 is none."""
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(endpoint, "^.*?://", ""), "[/?#].*$", ""), "^.*@", "")
    host = F.lower(F.trim(F.regexp_replace(host, r":[^:\]]*$", ""), F.lit("[]")))
    return (endpoint == "") | host.isin("localhost", "127.0.0.1", "::1")


def require_local(endpoint: str) -> None:
    host = re.sub(r":[^:\]]*$", "", re.sub("^.*@", "", re.split("[/?#]", endpoint.split("://", 1)[-1])[0])).strip("[]").lower()
    if endpoint and host not in ("localhost", "127.0.0.1", "::1"):
        raise ValueError(f"{endpoint!r} is not on this machine")


def valid_repo(repo: Column) -> Column:
    """Whether a model's name is like org/name and no path."""
    parts = F.split(repo, "/")
    return (repo != "") & (F.trim(repo) == repo) & ~repo.rlike(r"^/|[\\:\x00]") & (F.size(parts) >= 2) & ~F.exists(parts, lambda p: p.isin("", ".", ".."))


def safe_relative(name: Column) -> Column:
    """Whether a file name from elsewhere stays below the folder it is written to."""
    return (name != "") & ~name.rlike(r"[\\\x00]") & ~name.startswith("/") & ~F.exists(F.split(name, "/"), lambda p: p.isin("..")) & (name != ".")


def info_pages(out: Column) -> Column:
    """The number of pages that a PDF tool reports in a line `Pages: n`, else 0."""
    n = F.regexp_extract(out, r"(?im)^[\t ]*pages[\t ]*:[\t ]*([0-9]+)[\t ]*$", 1).try_cast("int")
    return F.coalesce(F.when(n >= 1, n), F.lit(0))


def form_feed_pages(text: Column) -> Column:
    """Pages by form feeds: one at least, 0 without text."""
    blank = F.regexp_replace(text, r"\s+", "") == ""
    return F.when(blank, 0).otherwise(F.greatest(F.length(text) - F.length(F.replace(text, F.lit("\f"))), F.lit(1)))


def escaped(s: str) -> str:
    return re.sub(r"[\"\\'\n\r\t]", "", s.strip())


def desktop_query(tags: tuple[str, ...] = (), text: str = "", active: bool = False) -> str:
    """The search expression of a desktop index for tags and a text; reports print it."""
    names = list(dict.fromkeys(t for t in (x.strip().lower() for x in (*tags, *(["active"] if active else []))) if t))
    terms = [f'kMDItemUserTags == "{escaped(t)}"c' for t in names]
    if word := escaped(text):
        terms.append(f'(kMDItemTextContent == "*{word}*"cd || kMDItemDisplayName == "*{word}*"cd)')
    return " && ".join(terms)


def tag_query(tag: Column) -> Column:
    return F.concat(F.lit('kMDItemUserTags == "'), F.regexp_replace(F.trim(tag), r"[\"\\'\n\r\t]", ""), F.lit('"c'))

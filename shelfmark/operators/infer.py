"""Owner, year and identifier of a document, each with where it was found."""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Config
from ..functions import text as T

#: Fields that tell the year and the identifier, best first.
YEAR_FIELDS = ["date", "invoice_date", "issue_date", "statement_date", "effective_date", "pay_period", "tax_year"]
IDENTIFIER_FIELDS = ["issuer", "merchant", "vendor", "supplier", "company", "employer", "provider", "bank", "counterparty", "account_number", "policy_number", "registration_number", "licence_number", "passport_number", "visa_number", "employee_id", "invoice_number", "receipt_number", "po_number", "claim_number", "booking_reference", "ticket_number"]
UNTITLED = "Untitled"


def given_names(config: Config) -> dict[str, str]:
    """Of people with two names or more, the first one where nobody shares it and it has three letters."""
    first = {p.tag: p.name.split()[0] for p in config.people if len(p.name.split()) > 1 and len(p.name.split()[0]) >= 3}
    n = Counter(g.lower() for g in first.values())
    return {t: g for t, g in first.items() if n[g.lower()] == 1}


def owners(config: Config, name: Column, text: Column) -> Column:
    """An array of (value, source) in the configured order: people named in the file name, else anywhere in the text, by name, tag or a given name of their own."""
    if not config.people:
        return F.array().cast("array<struct<value:string,source:string>>")
    given = given_names(config)
    said = [[(p.name, None), (p.tag.replace("-", " "), "tag")] + ([(given[p.tag], "given-name")] if p.tag in given else []) for p in config.people]
    words = F.array(*[T.padded(T.normalize_for_match(F.lit(token))) for tokens in said for token, _ in tokens])  # a constant
    hay = F.struct(T.padded(T.normalize_for_match(T.stem(name))).alias("filename"), T.padded(T.normalize_for_match(text)).alias("document"), words.alias("words"))

    def found(x: Column) -> Column:
        out, at = [], 0
        for p, tokens in zip(config.people, said):
            source: Column = F.lit(None).cast("string")
            for field, where in (("document", "document-text"), ("filename", "filename")):
                for k, (_, how) in reversed(list(enumerate(tokens))):
                    word = F.get(x["words"], F.lit(at + k))
                    source = F.when(F.coalesce((word != T.PAD) & F.contains(x[field], word), F.lit(False)), how or where).otherwise(source)
            at += len(tokens)
            out.append(F.struct(F.lit(p.name).alias("value"), source.alias("source")))
        return F.filter(F.array(*out), lambda o: o["source"].isNotNull())

    return T.let(hay, found)


def year(fields: Column, modified: Column) -> Column:
    """(value, source): the first year in a field that tells it, else that of the last change."""
    said = F.coalesce(*[T.year_in(F.try_element_at(fields, F.lit(f))) for f in YEAR_FIELDS])
    both = F.struct(said.alias("said"), F.year(modified).alias("modified"))
    return T.let(both, lambda x: F.struct(F.coalesce(x["said"], x["modified"]).alias("value"), F.when(x["said"].isNotNull(), "extracted-field").otherwise("mtime").alias("source")))


def identifier(fields: Column, name: Column, doctype: Column, owner_names: Column) -> Column:
    """(value, source): the first usable field without the doctype at its end, else the file name's own words, else Untitled."""
    named = F.transform_keys(fields, lambda k, v: T.field_name(k))

    def first(found: Column) -> Column:
        ranked = F.filter(F.transform(F.expr(f"array({', '.join(map(T.quoted, IDENTIFIER_FIELDS))})"), lambda f: F.trim(F.try_element_at(found, f))), lambda v: F.coalesce(v != "", F.lit(False)) & ~T.refused(v))
        return F.get(F.filter(F.transform(ranked, lambda v: F.trim(T.trim_doctype(v, doctype))), lambda v: v != ""), F.lit(0))

    stem = F.nullif(T.clean_stem(T.stem(name), doctype, owner_names), F.lit(""))
    source = lambda x: F.when(x["said"].isNotNull(), "extracted-field").when(x["stem"].isNotNull(), "filename").otherwise("none")
    both = lambda said: F.struct(said.alias("said"), F.when(said.isNull(), stem).alias("stem"))
    return T.let(T.let(T.let(named, first), both), lambda x: F.struct(F.coalesce(x["said"], x["stem"], F.lit(UNTITLED)).alias("value"), source(x).alias("source")))


def guessed(owner_reasons: Column, year_reason: Column, identifier_reason: Column) -> Column:
    """Whether any part rests on a guess."""
    parts = [year_reason["source"] == "mtime", identifier_reason["source"] == "none", F.exists(owner_reasons, lambda r: r["source"] == "given-name")]
    return reduce(lambda a, b: a | b, parts)


def merged(sure: Column, model: Column, text: Column) -> tuple[Column, Column]:
    """Fields found by patterns together with those a model gave: patterns win, and a model's value must occur in the text.

    Returns the merged map, and a map of what was dropped to why.
    """
    from ..functions.ground import grounded, words

    empty = F.create_map().cast("map<string,string>")
    sure, model = F.coalesce(sure, empty), F.coalesce(model, empty)
    fresh = F.map_filter(model, lambda k, v: ~F.map_contains_key(sure, k))
    good = F.map_filter(fresh, lambda k, v: grounded(text, v))
    bad = F.map_filter(fresh, lambda k, v: ~grounded(text, v))
    other = F.map_filter(model, lambda k, v: F.coalesce(words(F.try_element_at(sure, k)) != words(v), F.lit(False)))
    return F.map_concat(sure, good), F.map_concat(F.transform_values(other, lambda k, v: F.lit("superseded")), F.transform_values(bad, lambda k, v: F.lit("ungrounded")))


def merged_over(primary: Column, extra: Column) -> Column:
    """The fields of a stated type over those found before; null without any."""
    empty = F.create_map().cast("map<string,string>")
    primary, extra = F.coalesce(primary, empty), F.coalesce(extra, empty)
    both = F.map_concat(primary, F.map_filter(extra, lambda k, v: ~F.map_contains_key(primary, k)))
    return F.when(F.size(both) > 0, both)

"""The functions on names, texts and fiscal dates for SQL: register(spark) makes temporary functions, which Spark puts in place as expressions.

After that `SELECT slug(name), fy_label(day) FROM t` says what the Columns of `text` and `fiscal` say. Nulls give nulls.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import SparkSession

from . import regex
from . import text as T
from .fiscal import Calendar

q = T.quoted


def trimmed(s: str, pattern: str, by: str) -> str:
    return f"trim(BOTH {q(by)} FROM regexp_replace({s}, {q(pattern)}, {q(by)}))"


def normalised(s: str) -> str:
    one = {c: k for k, v in T.FOLDS.items() if len(k) == 1 for c in v}
    folded = f"translate(lower({s}), {q(''.join(one))}, {q(''.join(one.values()))})"
    folded = reduce(lambda x, kv: f"replace({x}, {q(kv[1])}, {q(kv[0])})", [(k, c) for k, v in T.FOLDS.items() if len(k) > 1 for c in v], folded)
    return trimmed(folded, r"[^\p{L}\p{Nd}]+", " ")


def definitions(calendar: Calendar) -> dict[str, tuple[str, str, str]]:
    """Arguments, type and expression of each function."""
    text = lambda body: ("s STRING", "STRING", body)
    begin = f"add_months(d, {1 - calendar.start_month})"
    year, end = "y", f"(y + {0 if calendar.start_month == 1 else 1})"
    two = lambda y: f"lpad(cast({y} % 100 AS STRING), 2, '0')"
    marks = {"{yyyy1}": f"lpad(cast({year} AS STRING), 4, '0')", "{yyyy2}": f"lpad(cast({end} AS STRING), 4, '0')", "{yy1}": two(year), "{yy2}": two(end)}
    label = reduce(lambda x, kv: f"replace({x}, {q(kv[0])}, {kv[1]})", marks.items(), q(calendar.format))
    quarter = f"cast(floor(pmod(month(d) - {calendar.start_month}, 12) / 3) + 1 AS INT)"
    return {
        "slug": text(trimmed("lower(s)", "[^a-z0-9]+", "-")),
        "name_word": text(f"regexp_replace(regexp_replace(regexp_replace(s, {q(r'[ \t\n_/\\]+')}, '-'), '-{{2,}}', '-'), '^-+|-+$', '')"),
        "title_words": text("array_join(transform(split(s, '-'), p -> concat(upper(substring(p, 1, 1)), substring(p, 2))), '-')"),
        "normalize_for_match": text(normalised("s")),
        "field_name": text(trimmed("lower(s)", r"[^\p{L}\p{Nd}]+", "_")),
        "file_name": text("substring_index(s, '/', -1)"),
        "folder_name": text(f"regexp_extract(s, {q('^(.*)/[^/]*$')}, 1)"),
        "file_extension": text(f"regexp_extract(s, {q(r'(\.[^./]*)$')}, 1)"),
        "file_stem": text(f"regexp_replace(substring_index(s, '/', -1), {q(r'\.[^./]*$')}, '')"),
        "sidecar_path": text(f"regexp_replace(s, '([^/]+)$', {q('.$1.meta.yaml')})"),
        "document_of": text(f"regexp_replace(s, {q(r'\.([^/]+)\.meta\.yaml$')}, '$1')"),
        "is_sidecar": ("s STRING", "BOOLEAN", f"substring_index(s, '/', -1) RLIKE {q(r'^\..+\.meta\.yaml$')}"),
        "year_in": ("s STRING", "INT", f"try_cast(regexp_extract(s, {q(regex.java(r'\b((?:19|20|21)[0-9]{2})\b'))}, 1) AS INT)"),
        "contains_words": ("hay STRING, needle STRING", "BOOLEAN", f"{normalised('hay')} != '' AND {normalised('needle')} != '' AND contains(concat(' ', {normalised('hay')}, ' '), concat(' ', {normalised('needle')}, ' '))"),
        "fy_year": ("d DATE", "INT", f"year({begin})"),
        "fy_year_label": ("y INT", "STRING", label),
        "fy_label": ("d DATE", "STRING", f"fy_year_label(year({begin}))"),
        "fy_tag": ("d DATE", "STRING", f"slug(regexp_replace(fy_label(d), {q('[ \t\n\r]+')}, ''))"),
        "fy_quarter": ("d DATE", "INT", quarter),
        "fy_start": ("y INT", "DATE", f"make_date(y, {calendar.start_month}, 1)"),
        "fy_end": ("y INT", "DATE", f"add_months(make_date(y, {calendar.start_month}, 1), 12)"),
    }


def register(spark: SparkSession, calendar: Calendar = Calendar()) -> list[str]:
    """Makes the functions in this session, and returns their names. Those of the same names are replaced."""
    found = definitions(calendar)
    for name, (arguments, kind, body) in found.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    return list(found)

"""The file name grammar: parsing, rendering and placing, as Columns built from a configuration.

Parsed names are structs (parsed, doctype, owners, identifier, year, modifier, ext, ambiguous); absent parts are null, and owners an empty array.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Config, parse_pattern
from ..functions import text as T

YEAR = "^(19|2[0-9])[0-9]{2}$"


def spaced(config: Config, s: Column) -> Column:
    return F.replace(s, F.lit(config.word_sep), F.lit(" "))


def is_shared_label(config: Config, s: Column) -> Column:
    labels = sorted({c.shared for c in config.categories if c.shared})
    if not labels:
        return F.lit(False)
    w = F.lower(T.word(s, config.word_sep, config.field_sep))
    return reduce(lambda a, b: a | b, [w == F.lower(T.word(F.lit(x), config.word_sep, config.field_sep)) for x in labels])


def resolve_owners(config: Config, owners: Column) -> tuple[Column, Column]:
    """Names of known people for words of a file name, and whether these can be read in more than one way.

    Names are only doubtful where owners and words have one separator; then the longest known name is taken first, again and again.
    """
    people = sorted(((py_word(config, p.name), p.name) for p in config.people if py_word(config, p.name)), key=lambda x: (-len(x[0]), x[0]))
    if not people:
        return owners, F.lit(False)
    known = {}
    for w, name in people:
        known.setdefault(w.lower(), name)
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    found = F.transform(owners, lambda o: F.try_element_at(table, F.lower(T.word(o, config.word_sep, config.field_sep))))
    all_found = F.forall(found, lambda x: x.isNotNull())
    if config.owner_sep != config.word_sep:
        return F.when(all_found, found).otherwise(owners), F.lit(False)
    sep = config.owner_sep
    token = F.array_join(F.transform(owners, lambda o: T.word(o, config.word_sep, config.field_sep)), sep)

    def step(state: Column, _: Column) -> Column:
        rest = F.lower(state["rest"])
        out = state
        for w, name in reversed(people):
            low = w.lower()
            starts = (rest == low) | rest.startswith(low + sep)
            tail = F.substring(state["rest"], len(w) + len(sep) + 1, 1 << 30)
            out = F.when(starts, F.struct(tail.alias("rest"), F.array_append(state["out"], F.lit(name)).alias("out"))).otherwise(out)
        return out

    start = F.struct(token.alias("rest"), F.array().cast("array<string>").alias("out"))
    steps = F.sequence(F.lit(1), F.greatest(F.size(F.split(token, sep)), F.lit(1)))
    done = F.aggregate(steps, start, step)
    good = (done["rest"] == "") & (F.size(done["out"]) > 0)
    plain = all_found | (F.size(owners) == 0)
    return F.when(all_found, found).when(good, done["out"]).otherwise(owners), ~plain & ~good


def py_word(config: Config, s: str) -> str:
    import re

    out = re.sub("[" + re.escape(" \t\n_/\\" + config.field_sep) + "]+", config.word_sep, s)
    return re.sub(f"(?:{re.escape(config.word_sep)}){{2,}}", config.word_sep, out).strip(config.word_sep)


def parse(config: Config, name: Column) -> Column:
    """The struct behind a file name."""
    segments = parse_pattern(config.pattern)
    required, optional = [s for s in segments if not s.optional], [s for s in segments if s.optional]
    parts = F.split(T.stem(name), F.lit(f"\\Q{config.field_sep}\\E"), -1)
    n = F.size(parts)
    value: dict[str, Column] = {s.field: F.get(parts, F.lit(i)) for i, s in enumerate(required)}
    used: Column = F.lit(len(required))
    for s in optional:
        part = F.get(parts, used)
        take = (used < n) & (part.rlike(YEAR) if s.field == "Year" else F.lit(True))
        value[s.field] = F.when(take, part)
        used = used + take.cast("int")
    null = F.lit(None).cast("string")
    names = value.get("Names", null)
    given = F.when(F.coalesce(names == "", F.lit(True)) | is_shared_label(config, names), F.array().cast("array<string>")).otherwise(F.transform(F.split(names, F.lit(f"\\Q{config.owner_sep}\\E"), -1), lambda o: spaced(config, o)))
    owners, ambiguous = resolve_owners(config, given)
    doctype = T.slug(value.get("DocType", null))
    good = n.between(len(required), len(segments)) & (used == n) & F.coalesce(doctype != "", F.lit(False))
    blank = lambda c: F.when(good & (c != ""), c)
    return F.struct(
        good.alias("parsed"), blank(doctype).alias("doctype"), F.when(good, owners).otherwise(F.array().cast("array<string>")).alias("owners"), blank(spaced(config, value.get("Identifier", null))).alias("identifier"),
        F.when(good, value.get("Year", null).try_cast("int")).alias("year"), blank(spaced(config, value.get("Modifier", null))).alias("modifier"), T.extension(name).alias("ext"), (good & ambiguous).alias("ambiguous"),
    )


def ordered(config: Config, owners: Column) -> Column:
    if config.owner_order != "alphabetical":
        return owners
    return F.transform(F.array_sort(F.transform(owners, lambda o: F.struct(F.lower(o).alias("k"), o.alias("o")))), lambda x: x["o"])


def render_owners(config: Config, owners: Column) -> Column:
    return F.array_join(F.transform(ordered(config, owners), lambda o: T.word(o, config.word_sep, config.field_sep)), config.owner_sep)


def by_category(config: Config, category: Column, attribute: str) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for c in config.categories for x in (c.name, getattr(c, attribute))]), category)


def render(config: Config, doctype: Column, owners: Column, identifier: Column, year: Column, modifier: Column, ext: Column, category: Column) -> Column:
    """A file name, or null where a required field is missing; documents of nobody go under their category's shared word."""
    w = lambda c: T.word(c, config.word_sep, config.field_sep)
    nobody = F.size(owners) == 0
    names = F.when(nobody, w(by_category(config, category, "shared"))).otherwise(render_owners(config, owners))
    value = {"DocType": w(T.title_case(doctype)), "Names": names, "Identifier": w(identifier), "Year": F.when(year != 0, year.cast("string")), "Modifier": w(modifier)}
    segments = parse_pattern(config.pattern)
    kept = [F.nullif(F.when(nobody, F.lit("")).otherwise(value["Names"]) if s.field == "Names" and s.optional else value[s.field], F.lit("")) for s in segments]
    missing = reduce(lambda a, b: a | b, [k.isNull() for k, s in zip(kept, segments) if not s.optional], F.lit(False))
    ext = F.when(ext.isNull() | (ext == ""), F.lit("")).otherwise(F.concat(F.lit("."), F.regexp_replace(ext, r"^\.", "")))
    return F.when(~missing, F.concat(F.concat_ws(config.field_sep, *kept), ext))


def owner_folder(config: Config, owners: Column, category: Column) -> Column:
    shared = F.nullif(by_category(config, category, "shared"), F.lit(""))
    return F.when(F.size(owners) == 0, F.coalesce(shared, F.lit(""))).when(F.size(owners) == 1, T.word(F.get(owners, F.lit(0)), config.word_sep, config.field_sep)).otherwise(F.coalesce(shared, render_owners(config, owners)))


def folder(config: Config, owners: Column, year: Column, category: Column) -> Column:
    """Where a document of a category belongs, below the root; null for unknown categories."""
    owner = F.nullif(owner_folder(config, owners, category), F.lit(""))
    fiscal = F.when(year != 0, config.calendar.label(year))
    layouts: dict[str, list[str]] = {}
    for c in config.categories:
        layouts.setdefault(c.layout, []).append(c.name)
    base, out = by_category(config, category, "path"), F.lit(None).cast("string")
    for layout, names in layouts.items():
        out = F.when(category.isin(names), F.concat_ws("/", base, *[{"{Owner}": owner, "{FY}": fiscal}[s] for s in layout.split("/") if s])).otherwise(out)
    return out


def path(config: Config, doctype: Column, owners: Column, identifier: Column, year: Column, modifier: Column, ext: Column, category: Column) -> Column:
    return F.concat(folder(config, owners, year, category), F.lit("/"), render(config, doctype, owners, identifier, year, modifier, ext, category))


def category_at(config: Config, rel_path: Column) -> Column:
    """The category whose folder holds a path: the longest folder, then the smaller name; null if none."""
    order = sorted(config.categories, key=lambda c: (-len(c.path.encode()), c.name))
    return F.coalesce(*[F.when(rel_path.startswith(c.path + "/"), F.lit(c.name)) for c in order], F.lit(None).cast("string"))

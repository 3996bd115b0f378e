"""Configuration of a collection: people, companies, structure, calendar, names, tags and document types."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, fields
from typing import Any

from .functions.fiscal import Calendar

#: Default categories by folder, folder layout and tags.
CATEGORIES = {"personal": "Personal", "company": "Company", "financial": "Financial", "travel": "Travel", "identity": "Identity", "insurance": "Insurance", "medical": "Medical", "legal": "Legal", "property": "Property", "vehicles": "Vehicles", "utility": "Utilities"}
BY_YEAR = ("financial", "company", "utility")
LIFECYCLE = ("active", "superseded", "encrypted", "confidential", "to-action", "dont-touch")
PATTERN = "{DocType}_{Names}_{Identifier}[_{Year}][_{Modifier}]"
FIELDS = ("DocType", "Names", "Identifier", "Year", "Modifier")
STAGING = "_To-Delete-After-Verification"


class ConfigError(ValueError):
    pass


def slug(s: str) -> str:
    return re.sub("[^a-z0-9]+", "-", s.lower()).strip("-")


@dataclass(frozen=True)
class Person:
    name: str
    tag: str


@dataclass(frozen=True)
class Category:
    name: str
    path: str
    layout: str = "{Owner}"
    shared: str = "_Shared"


@dataclass(frozen=True)
class DocType:
    name: str
    category: str
    keywords: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()
    extract: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Config:
    root: str = ""
    people: tuple[Person, ...] = ()
    companies: tuple[str, ...] = ()
    areas: tuple[str, ...] = ()
    fiscal_years: tuple[str, ...] = ()
    lifecycle: tuple[str, ...] = LIFECYCLE
    require_lifecycle: bool = False
    start_month: int = 1
    label_format: str | None = None
    pattern: str = PATTERN
    word_sep: str = "-"
    field_sep: str = "_"
    owner_sep: str = "+"
    owner_order: str = "alphabetical"
    categories: tuple[Category, ...] = tuple(Category(k, v, "{Owner}/{FY}" if k in BY_YEAR else "{Owner}") for k, v in CATEGORIES.items())
    doctypes: tuple[DocType, ...] = ()
    min_confidence: float = 0.5
    single_active: tuple[str, ...] = ()
    allow_passwords: bool = False
    confirm_confidential: bool = True

    @property
    def calendar(self) -> Calendar:
        return Calendar(self.start_month, self.label_format)

    def validate(self) -> Config:
        faults = []
        if not 1 <= self.start_month <= 12:
            faults.append("the fiscal year starts in no month")
        if len({self.field_sep, self.word_sep}) < 2 or self.owner_sep == self.field_sep:
            faults.append("separators must differ")
        if "{DocType}" not in self.pattern:
            faults.append("the pattern lacks {DocType}")
        if self.owner_order not in ("alphabetical", "as-given"):
            faults.append("owners are ordered alphabetical or as-given")
        if not 0 <= self.min_confidence <= 1:
            faults.append("min_confidence lies between 0 and 1")
        tags = [p.tag for p in self.people]
        if len(set(tags)) < len(tags) or "" in tags:
            faults.append("people need tags of their own")
        for p in self.people:
            if not p.name.strip() or re.search(r"[/\\\x00-\x1f]", p.name) or p.name.startswith("."):
                faults.append(f"{p.name!r} can't be a name")
        for c in self.categories:
            if c.path.startswith("/") or ".." in c.path.split("/") or not c.path:
                faults.append(f"category {c.name} needs a path inside the collection")
            if set(re.findall(r"[^/]+", c.layout)) - {"{Owner}", "{FY}"}:
                faults.append(f"category {c.name} has an unknown layout")
        names = {c.name for c in self.categories}
        faults += [f"document type {d.name} names no known category" for d in self.doctypes if d.category not in names]
        faults += [f"a pattern of {d.name} captures nothing" for d in self.doctypes for _, x in d.extract if not re.compile(x).groups]
        parse_pattern(self.pattern)
        if faults:
            raise ConfigError("; ".join(faults))
        return self


@dataclass(frozen=True)
class Segment:
    field: str
    optional: bool


def parse_pattern(pattern: str) -> tuple[Segment, ...]:
    """The fields of a file name pattern; those in brackets are optional and come last."""
    out: list[Segment] = []
    optional = False
    for m in re.finditer(r"\{([^{}]*)\}|[\[\]{}]", pattern):
        if m[0] == "[":
            if optional:
                raise ConfigError("brackets in brackets")
            optional = True
        elif m[0] == "]":
            if not optional:
                raise ConfigError("a bracket closes that is not open")
            optional = False
        elif m[1] is None:
            raise ConfigError("a brace is not closed")
        elif m[1] not in FIELDS:
            raise ConfigError(f"unknown field {m[0]}")
        elif not optional and any(s.optional for s in out):
            raise ConfigError("required fields come before optional ones")
        else:
            out.append(Segment(m[1], optional))
    if optional:
        raise ConfigError("a bracket is not closed")
    if not out:
        raise ConfigError("a pattern without fields")
    return tuple(out)


def find(start: str) -> str:
    """The nearest vault.yaml at or above a folder."""
    folder = os.path.abspath(start)
    while True:
        if os.path.isfile(path := os.path.join(folder, "vault.yaml")):
            return path
        if (up := os.path.dirname(folder)) == folder:
            raise ConfigError(f"no vault.yaml at or above {start}")
        folder = up


def load(path: str) -> Config:
    with open(path, encoding="utf-8") as f:
        return parse(f.read(), os.path.dirname(os.path.abspath(path)))


KNOWN = {
    "": "version vault_root fiscal_year people owner_group filename structure tags doctypes engine rules",
    "fiscal_year": "start_month label_format",
    "owner_group": "separator_filename separator_folder order",
    "filename": "pattern word_separator field_sep",
    "tags": "companies areas fiscal_years lifecycle",
    "engine": "classify min_confidence",
    "rules": "single_active lifecycle_tag_required allow_passwords_in_filenames confirm_confidential",
}


def section(raw: dict, name: str) -> dict[str, Any]:
    part = raw if name == "" else raw.get(name) or {}
    if not isinstance(part, dict):
        raise ConfigError(f"{name or 'the file'} must be a mapping")
    if unknown := set(part) - set(KNOWN[name].split()):
        raise ConfigError(f"unknown key {sorted(map(str, unknown))[0]} in {name or 'the file'}")
    return part


def parse(text: str, root: str = "") -> Config:
    """A configuration out of YAML; unknown keys are errors."""
    import yaml

    raw = section(yaml.safe_load(text) or {}, "")
    if int(raw.get("version", 1)) > 1:
        raise ConfigError("made for a later version")
    names, tags, rules, fiscal, group = (section(raw, k) for k in ("filename", "tags", "rules", "fiscal_year", "owner_group"))
    engine = section(raw, "engine")
    structure = raw.get("structure")
    categories = Config.__dataclass_fields__["categories"].default if structure is None else tuple(Category(k, **({"path": v} if isinstance(v, str) else v)) for k, v in structure.items())
    types = tuple(DocType(slug(k), v["category"], tuple(v.get("keywords", ())), tuple(v.get("patterns", ())), tuple((v.get("extract") or {}).items())) for k, v in (raw.get("doctypes") or {}).items())
    said = {
        "root": raw.get("vault_root") or root, "people": tuple(Person(p["name"], p.get("tag") or slug(p["name"])) for p in raw.get("people") or ()),
        "companies": tags.get("companies"), "areas": tags.get("areas"), "fiscal_years": tags.get("fiscal_years"), "lifecycle": tags.get("lifecycle"),
        "start_month": fiscal.get("start_month"), "label_format": fiscal.get("label_format"), "pattern": names.get("pattern"), "word_sep": names.get("word_separator"), "field_sep": names.get("field_sep"),
        "owner_sep": group.get("separator_filename"), "owner_order": group.get("order"), "categories": categories, "doctypes": types, "min_confidence": engine.get("min_confidence") or None,
        "single_active": rules.get("single_active"), "require_lifecycle": rules.get("lifecycle_tag_required"), "allow_passwords": rules.get("allow_passwords_in_filenames"), "confirm_confidential": rules.get("confirm_confidential"),
    }
    known = {f.name for f in fields(Config)}
    return Config(**{k: tuple(v) if isinstance(v, list) else v for k, v in said.items() if v is not None and k in known}).validate()

"""Sidecars in YAML, manifests in CSV and the audit log in JSON lines."""

from __future__ import annotations

import csv
import datetime as dt
import json
import os
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..runtime import ship

TEXT_CAP = 256 * 1024
FIELDS = "extracted_at ocr_engine classifier doctype category confidence owners identifier year fields source_sha256 text_truncated text".split()
META = "extracted_at string, ocr_engine string, classifier string, doctype string, category string, confidence double, owners array<string>, identifier string, year int, fields map<string,string>, source_sha256 string, text_truncated boolean, text string"
MANIFEST = "current_path string, original_path string, sha256 string"
AUDIT = "time string, op string, actor string, paths array<string>, manifest string, confirmed boolean, detail map<string,string>"


def meta_of(raw: bytes | None) -> dict | None:
    """The facts in a sidecar, or None where it is malformed."""
    import yaml

    try:
        said = yaml.safe_load((raw or b"").decode())
        if not isinstance(said, dict):
            return None
        text = lambda k: None if said.get(k) is None else str(said[k])
        return {
            **{k: text(k) for k in ("extracted_at", "ocr_engine", "classifier", "doctype", "category", "identifier", "source_sha256", "text")},
            "confidence": None if said.get("confidence") is None else float(said["confidence"]), "owners": [str(x) for x in said.get("owners") or []], "year": int(said.get("year") or 0) or None,
            "fields": {str(k): str(v) for k, v in (said.get("fields") or {}).items()}, "text_truncated": bool(said.get("text_truncated", False)),
        }
    except (yaml.YAMLError, UnicodeDecodeError, ValueError, TypeError, AttributeError):
        return None


def sidecars(files: DataFrame) -> DataFrame:
    """path, doc_path and meta of the sidecars among files (read with their content); malformed ones are left out."""
    ship(files.sparkSession)

    @F.pandas_udf(META)
    def parse(raw: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([meta_of(x) or dict.fromkeys(FIELDS) for x in raw], columns=FIELDS)

    rows = files.where("kind = 'sidecar'").select(F.col("rel_path").alias("path"), T.document_of(F.col("rel_path")).alias("doc_path"), parse("content").alias("meta"))
    return rows.where("meta.owners is not null")


def write_sidecar(document: str, meta: dict) -> str:
    """Writes the facts beside a document and returns the path; the text is cut at a byte limit."""
    import yaml

    said = {k: meta[k] for k in FIELDS if meta.get(k) not in (None, [], {}, "")}
    said.setdefault("extracted_at", dt.date.today().isoformat())
    raw = (said.get("text") or "").encode()
    if len(raw) > TEXT_CAP:
        said["text"], said["text_truncated"] = raw[:TEXT_CAP].decode(errors="ignore"), True
    path = os.path.join(os.path.dirname(document), f".{os.path.basename(document)}.meta.yaml")
    replace(path, ("# Facts about the document beside this file. Written by a program; edits may be lost.\n" + yaml.safe_dump({k: said[k] for k in FIELDS if k in said}, sort_keys=False, allow_unicode=True)).encode())
    return path


def remove_sidecar(document: str) -> bool:
    path = os.path.join(os.path.dirname(document), f".{os.path.basename(document)}.meta.yaml")
    if os.path.exists(path):
        os.remove(path)
        return True
    return False


def replace(path: str, raw: bytes | Iterable[bytes]) -> None:
    """Writes a file, also one that comes in parts, whole or not at all."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(tmp := f"{path}.tmp{os.getpid()}", "wb") as f:
        f.writelines([raw] if isinstance(raw, bytes) else raw)
        f.flush()
        os.fsync(f.fileno())
    os.replace(tmp, path)


def write_manifest(folder: str, op: str, rows: Iterable[tuple[str, str, str]], now: dt.datetime) -> tuple[str, int]:
    """Writes a manifest, whole or not at all, and returns its path and number of rows. Rows stream. A manifest of the same second gets the next free number."""
    os.makedirs(folder, exist_ok=True)
    names = (os.path.join(folder, f"{now:%Y%m%dT%H%M%S}{'' if k == 1 else f'-{k}'}_{op}.csv") for k in range(1, 10_000))
    path = next(p for p in names if not os.path.exists(p))
    n = 0
    with open(tmp := path + ".tmp", "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow(["current_path", "original_path", "sha256"])
        for row in rows:
            out.writerow(row)
            n += 1
        f.flush()
        os.fsync(f.fileno())
    os.replace(tmp, path)
    return path, n


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a manifest; another header is an error."""
    return spark.read.option("mode", "FAILFAST").option("enforceSchema", "false").option("escape", '"').csv(path, header=True, schema=MANIFEST)


def op_of(path: Column) -> Column:
    """What a manifest is of: its name after the first underscore."""
    return F.regexp_extract(T.basename(path), r"^[^_]*_(.*)\.csv$", 1)


def append_audit(path: str, entry: dict) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps({"time": dt.datetime.now(dt.timezone.utc).isoformat(timespec="seconds"), **entry}, ensure_ascii=False) + "\n")
        f.flush()
        os.fsync(f.fileno())


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Entries of the log with their line; broken lines are left out. The log is one file, so lines count up within it."""
    lines = spark.read.text(path, wholetext=False).withColumn("line", F.monotonically_increasing_id())
    return lines.withColumn("e", F.from_json("value", AUDIT)).where("e.op is not null").select("line", "e.*")


def envelope(command: str, payload: object, status: str = "ok", warnings: list[str] | None = None) -> str:
    """A result as JSON with sorted keys; a payload may not use the envelope's own."""
    said = {"command": command, "schema_version": 1, "status": status, "warnings": warnings or []}
    body = payload if isinstance(payload, dict) else {"data": payload}
    if used := set(said) & set(body):
        raise ValueError(f"{sorted(used)[0]} is a key of the envelope")
    return json.dumps(said | body, sort_keys=True, indent=2, ensure_ascii=False, default=str)

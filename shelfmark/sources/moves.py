"""Carrying out plans in tasks: the `vault_moves` sink.

Rows: source, destination, sha256 and facts (what the sidecar beside the document is to say; null leaves sidecars as they are). A task copies each file to a work folder, compares its digest, links it to its
destination, where it never replaces anything, moves its sidecar along, and sets the original aside. With a null destination only the facts are written, beside the source.
What became of each row goes to a file of the task's own. Only what committed tasks said counts: commit gathers their files as the outcome; commit and abort remove the work folder with all that
killed tasks left there. A task that runs again, after a lost executor, finds what it had done before: a destination with the digest, whose source is set aside, is `again`.
The tree must be under the same path on every executor.
"""

from __future__ import annotations

import errno
import hashlib
import json
import os
import shutil
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..config import STAGING
from . import records

FACTS = "struct<extracted_at: string, ocr_engine: string, classifier: string, doctype: string, category: string, confidence: double, owners: array<string>, identifier: string, year: int, fields: map<string,string>, source_sha256: string, text: string>"
SCHEMA = f"source string, destination string, sha256 string, facts {FACTS}"
OUTCOME = "source string, destination string, status string, reason string, sidecar string"
WORK = ".moving"


def digest(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            h.update(part)
    return h.hexdigest()


def within(root: str, path: str) -> bool:
    """Whether a path, with symbolic links followed as far as it exists, stays below the root."""
    top, at = os.path.realpath(root), os.path.realpath(path)
    return at.startswith(top.rstrip("/") + "/")


def sidecar_of(path: str) -> str:
    return os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.meta.yaml")


def put(source: str, destination: str, sha: str, work: str) -> None:
    """Copies a file to a place that must be free, whole or not at all; half copies are only in the work folder."""
    os.makedirs(work, exist_ok=True)
    os.makedirs(os.path.dirname(destination), exist_ok=True)
    tmp = os.path.join(work, hashlib.sha256(destination.encode()).hexdigest())
    try:
        shutil.copy2(source, tmp)
        if digest(tmp) != sha:
            raise OSError(f"{source} changed while it was copied")
        try:
            os.link(tmp, destination)  # unlike a renaming, never replaces
        except FileExistsError:
            raise
        except OSError:  # no links on this file system
            if os.path.exists(destination):
                raise FileExistsError(errno.EEXIST, "taken", destination) from None
            os.rename(tmp, destination)
    finally:
        if os.path.exists(tmp):
            os.remove(tmp)


def stage(path: str, root: str) -> str:
    """Sets a file aside, under a name that is free."""
    base = os.path.join(root, STAGING, os.path.relpath(path, root) if path.startswith(root.rstrip("/") + "/") else os.path.basename(path))
    stem, ext = os.path.splitext(base)
    target = next(p for k in range(1, 1000) if not os.path.exists(p := base if k == 1 else f"{stem}_{k}{ext}"))
    os.makedirs(os.path.dirname(target), exist_ok=True)
    os.replace(path, target)
    return target


def move(root: str, work: str, source: str, destination: str | None, sha: str | None, facts: dict | None) -> tuple[str, str | None, str | None]:
    """status (moved, again, described, failed), why it failed, and the sidecar that was written."""
    try:
        if destination is None:
            return ("described", None, records.write_sidecar(source, facts)) if facts is not None and os.path.exists(source) else ("failed", "no destination", None)
        if not within(root, destination):
            return "failed", f"leads outside {root}", None
        there, here = os.path.exists(destination), os.path.exists(source)
        status = "moved"
        if there:
            if digest(destination) != sha:
                return "failed", "the destination is taken", None
            status = "moved" if here else "again"
        elif here:
            put(source, destination, sha, work)
        else:
            return "failed", "the source is gone", None
        side = sidecar_of(source)
        if os.path.exists(side):
            if facts is None and not os.path.exists(sidecar_of(destination)):
                put(side, sidecar_of(destination), digest(side), work)
            stage(side, root)
        written = records.write_sidecar(destination, facts) if facts is not None else None
        if here:
            stage(source, root)
        return status, None, written
    except OSError as e:
        return "failed", str(e), None


@dataclass
class Told(WriterCommitMessage):
    """Where a task wrote what became of its rows."""

    path: str


class MoveWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.root, self.name = options["path"], options["op"]
        self.work = os.path.join(self.root, WORK, self.name)
        self.outcome = os.path.join(self.root, "manifests", f"{self.name}.outcome")

    def write(self, rows: Iterator) -> Told:
        from pyspark import TaskContext

        context = TaskContext.get()
        own = os.path.join(self.work, f"task-{context.partitionId()}-{context.taskAttemptId()}")
        os.makedirs(own, exist_ok=True)
        with open(path := f"{own}.jsonl", "w", encoding="utf-8") as f:
            for r in rows:
                facts = r.facts.asDict(recursive=True) if r.facts is not None else None
                status, reason, sidecar = self.one(own, r.source, r.destination, r.sha256, facts)
                if status == "again" and context.attemptNumber() > 0:
                    status = "moved"  # by the attempt before
                f.write(json.dumps({"source": r.source, "destination": r.destination, "status": status, "reason": reason, "sidecar": sidecar}) + "\n")
            f.flush()
            os.fsync(f.fileno())
        return Told(path)

    def one(self, own: str, *row) -> tuple[str, str | None, str | None]:
        return move(self.root, own, *row)

    def commit(self, messages: list) -> None:
        os.makedirs(self.outcome, exist_ok=True)
        for k, told in enumerate(m for m in messages if m is not None):  # a short path for each task
            os.replace(told.path, os.path.join(self.outcome, f"part-{k:05d}.jsonl"))
        shutil.rmtree(self.work, ignore_errors=True)

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.work, ignore_errors=True)


class Moves(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vault_moves"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return MoveWriter(self.options)

"""A folder tree as a table: the `vault` data source, batch and streaming.

Spark's own file sources hide names that begin with a dot or an underscore; here sidecars and shared folders are wanted.
Rows: rel_path, name, size, mod_time, sha256 and content (each only read if asked for by option `content` = true), kind (document, sidecar, placeholder).
A folder that can't be read gives one row of kind unreadable, whose name says why. Hidden folders, manifests and staged files are left out.

The driver lists at most LISTED folders, level by level, and only their names. Of a folder that it has listed tasks take slices of about SLICE names; a folder that it has not is a task's with all below it.
Small ones share a task. The options `kinds`, `prefix` and `only` prune: folders that can't hold such paths are not opened, and files of other kinds not looked at. (They are options, as filters that
Spark 4.1 pushes to a Python source stay with the frame, and so would hold for its other uses as well.)
The tree must be readable by every executor under the same path.

As a stream the source needs the option `state`, a folder that all tasks share, where they keep what they have listed (VaultChanges). Without it the driver lists the tree (VaultStream).
"""

from __future__ import annotations

import contextlib
import datetime as dt
import hashlib
import json
import os
import time
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

from pyspark.errors import PySparkNotImplementedError
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "rel_path string, name string, size bigint, mod_time timestamp, kind string, sha256 string, content binary"
RESERVED = ("manifests", "_To-Delete-After-Verification")
PLUMBING = ("vault.yaml", "INDEX.md", "AGENTS.md", "README.md", "audit.jsonl")


def kind_of(name: str) -> str | None:
    if name.startswith(".") and name.endswith(".meta.yaml"):
        return "sidecar"
    if name.startswith(".") and name.endswith(".icloud"):
        return "placeholder"
    return None if name.startswith(".") else "document"


def entries(root: str, folder: str) -> tuple[list[str], list[str]]:
    """Names of the files and of the folders to look into, of a folder given relative to the root; sorted. Raises OSError."""
    names, folders = [], []
    with os.scandir(os.path.join(root, folder)) as found:
        for e in found:
            if e.is_dir():
                if not e.name.startswith(".") and e.name not in RESERVED and not (folder and e.is_symlink()):
                    folders.append(e.name)
            elif kind_of(e.name) is not None and (folder or e.name not in PLUMBING):
                names.append(e.name)
    return sorted(names), sorted(folders)


def walk(root: str, top: str) -> Iterator[tuple[str, os.stat_result]]:
    """Files below a folder of the root, or those that lie in the root itself for an empty one. Folders that can't be read are passed over."""
    waiting = [top]
    while waiting:
        folder = waiting.pop()
        try:
            names, folders = entries(root, folder)
        except OSError:
            continue
        waiting += [os.path.join(folder, f) for f in reversed(folders)] if top else []
        for name in names:
            rel = os.path.join(folder, name)
            try:
                yield rel, os.stat(os.path.join(root, rel))
            except OSError:  # gone meanwhile
                continue


def row(root: str, rel: str, stat: os.stat_result, content: bool) -> tuple:
    raw = None
    if content:
        with open(os.path.join(root, rel), "rb") as f:
            raw = f.read()
    name = os.path.basename(rel)
    return rel, name, stat.st_size, dt.datetime.fromtimestamp(stat.st_mtime, dt.timezone.utc), kind_of(name), hashlib.sha256(raw).hexdigest() if content else None, raw


@dataclass(frozen=True)
class Piece:
    """Of a folder, the names whose hash is `part` of `parts`; with `deep` also all folders below."""

    folder: str
    part: int = 0
    parts: int = 1
    deep: bool = False


class Pieces(InputPartition):
    def __init__(self, pieces: list[Piece]):
        super().__init__(pieces)
        self.pieces = pieces


class Wanted:
    """What the options `kinds`, `prefix` and `only` (paths; lists are JSON) leave."""

    def __init__(self, options: dict):
        listed = lambda name: frozenset(json.loads(options[name])) if name in options else None
        self.kinds, self.paths, self.prefix = listed("kinds"), listed("only"), options.get("prefix", "")

    def folder(self, folder: str) -> bool:
        """Whether a wanted path may lie in the folder or below."""
        inside = f"{folder}/" if folder else ""
        near = inside.startswith(self.prefix) or self.prefix.startswith(inside)
        return near and (self.paths is None or any(p.startswith(inside) for p in self.paths))

    def file(self, rel: str, name: str) -> bool:
        return (self.kinds is None or kind_of(name) in self.kinds) and (self.paths is None or rel in self.paths) and rel.startswith(self.prefix)


class VaultReader(DataSourceReader):
    LISTED, SLICE = 2048, 2000

    def __init__(self, options: dict):
        self.root, self.content = options["path"], options.get("content", "false").lower() == "true"
        self.wanted = Wanted(options)

    def partitions(self) -> list[InputPartition]:
        return cut(self.root, self.wanted, self.LISTED, self.SLICE)

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for piece in partition.pieces:
            waiting = [piece.folder]
            while waiting:
                folder = waiting.pop()
                try:
                    names, folders = entries(self.root, folder)
                except OSError as e:
                    if self.wanted.kinds is None or "unreadable" in self.wanted.kinds:
                        yield folder, e.strerror or str(e), None, None, "unreadable", None, None
                    continue
                if piece.deep:
                    waiting += [f for f in (os.path.join(folder, x) for x in reversed(folders)) if self.wanted.folder(f)]
                for name in names:
                    rel = os.path.join(folder, name)
                    if piece.parts > 1 and crc32(os.fsencode(name)) % piece.parts != piece.part or not self.wanted.file(rel, name):
                        continue
                    try:
                        yield row(self.root, rel, os.stat(os.path.join(self.root, rel)), self.content)
                    except FileNotFoundError:  # gone meanwhile
                        continue


def cut(root: str, wanted: Wanted, listed: int, size: int) -> list[Pieces]:
    """Partitions of the tree: folders of the first `listed` in slices of about `size` names, deeper ones with all below them."""
    waiting, pieces, seen = deque([""]), [], 0
    while waiting and seen < listed:
        folder = waiting.popleft()
        seen += 1
        try:
            names, folders = entries(root, folder)
        except OSError:
            pieces.append((1, Piece(folder)))  # its task says so
            continue
        parts = max(1, -(-len(names) // size))
        pieces += [(max(1, -(-len(names) // parts)), Piece(folder, k, parts)) for k in range(parts)]
        waiting.extend(f for f in (os.path.join(folder, x) for x in folders) if wanted.folder(f))
    pieces += [(size, Piece(f, deep=True)) for f in waiting]
    out: list[Pieces] = []
    room = 0
    for weight, piece in pieces:
        if weight > room:
            out.append(Pieces([]))
            room = size
        out[-1].pieces.append(piece)
        room -= weight
    return out or [Pieces([])]


class Listings:
    """What a stream has seen of each folder: a file for each listing that differs from the one before, named by its instant, in a folder that all tasks share."""

    def __init__(self, state: str):
        self.state = state

    def at(self, piece: Piece, folder: str, instant: int) -> tuple[int, dict] | None:
        """The latest listing up to an instant: its own, and inode and ctime of each file and (with ctime 0) folder."""
        top = self.place(piece, folder)
        try:
            found = max(n for n in map(int, (x for x in os.listdir(top) if x.isdigit())) if n <= instant)
            with open(os.path.join(top, str(found)), encoding="utf-8") as f:
                return found, json.load(f)
        except (OSError, ValueError):  # none
            return None

    def put(self, piece: Piece, folder: str, instant: int, said: dict, done: int) -> None:
        """Writes a listing, whole or not at all, and removes those that the one of `done` or before has replaced."""
        os.makedirs(top := self.place(piece, folder), exist_ok=True)
        tmp = os.path.join(top, f"{instant}.{os.getpid()}.{time.time_ns()}")
        with open(tmp, "w", encoding="utf-8") as f:
            json.dump(said, f)
        os.replace(tmp, os.path.join(top, str(instant)))
        past = sorted(int(x) for x in os.listdir(top) if x.isdigit() and int(x) <= done)
        for old in past[:-1]:
            with contextlib.suppress(FileNotFoundError):
                os.remove(os.path.join(top, str(old)))

    def place(self, piece: Piece, folder: str) -> str:
        name = hashlib.sha256(os.fsencode(folder)).hexdigest()
        return os.path.join(self.state, name[:2], name)


class Span(InputPartition):
    def __init__(self, pieces: list[Piece], start: int, end: int):
        super().__init__(pieces)
        self.pieces, self.start, self.end = pieces, start, end


class VaultChanges(DataSourceStreamReader):
    """Files that are new or changed between two instants, in partitions.

    The offset is an instant (ms) and nothing else. Tasks list their folders and compare them with what the `state` folder holds of the listing before: a file is new if its inode or ctime (which every write,
    copy and rename moves on) is not the one listed, or if its folder was not there; so files that were moved or renamed with their folder are delivered too. The new listing is written before any row is
    returned. A batch that is read again, after a failure or a restart, gives the difference of the same two listings. Changes of the last TICK are left to the next batch, as later ones could bear the same
    ctime. With the option `limit` a task delivers that many files of a batch and leaves the others out of its listing, for the batches to come.
    """

    TICK = 50  # ms, more than the steps of a file system's clock
    LISTED, SLICE = 512, 2000

    def __init__(self, options: dict):
        self.root, self.content = options["path"], options.get("content", "false").lower() == "true"
        self.listings, self.limit = Listings(options["state"]), int(options.get("limit", 0))

    def initialOffset(self) -> dict:
        return {"ms": 0}

    def latestOffset(self) -> dict:
        return {"ms": time.time_ns() // 1_000_000}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        pieces = cut(self.root, Wanted({}), self.LISTED, self.SLICE)
        whole = {p.folder: Piece(p.folder, deep=p.deep) for part in pieces for p in part.pieces}  # one task a folder's listing
        out: list[Span] = []
        for part in pieces:
            mine = [whole.pop(p.folder) for p in part.pieces if p.folder in whole]
            if mine:
                out.append(Span(mine, start["ms"], end["ms"]))
        return out

    def read(self, partition: Span) -> Iterator[tuple]:
        left = self.limit or None
        for piece in partition.pieces:
            waiting = [piece.folder]
            while waiting:
                folder = waiting.pop()
                try:
                    names, folders = entries(self.root, folder)
                except OSError:  # gone, or not to be read
                    continue
                if piece.deep:
                    waiting += [os.path.join(folder, x) for x in reversed(folders)]
                found = self.changed(piece, folder, names, folders, partition.start, partition.end, left)
                left = None if left is None else left - len(found)
                for rel in found:
                    try:
                        yield row(self.root, rel, os.stat(os.path.join(self.root, rel)), self.content)
                    except FileNotFoundError:  # gone meanwhile
                        continue

    def changed(self, piece: Piece, folder: str, names: list[str], folders: list[str], start: int, end: int, limit: int | None) -> list[str]:
        """The folder's files that the listing of the end has otherwise than that of the start."""
        before = self.listings.at(piece, folder, start)
        known = before[1] if before and self.was_there(piece, folder, start) else {}
        after = self.listings.at(piece, folder, end)
        if after is None or after[0] <= start:
            passed, said = time.time_ns() - self.TICK * 1_000_000, {}
            room = len(names) if limit is None else limit
            for name, is_folder in [(x, True) for x in folders] + [(x, False) for x in names]:
                try:
                    stat = os.stat(os.path.join(self.root, folder, name))
                except OSError:  # gone meanwhile
                    continue
                mark = [stat.st_ino, 0 if is_folder else stat.st_ctime_ns]
                if is_folder or known.get(name) == mark:
                    said[name] = mark
                elif stat.st_ctime_ns <= passed and room > 0:
                    said[name] = mark
                    room -= 1
            if before is None or said != before[1] or known != before[1]:
                self.listings.put(piece, folder, end, said, start)
        else:
            said = after[1]
        return [os.path.join(folder, name) for name, mark in said.items() if mark[1] and known.get(name) != mark]

    def was_there(self, piece: Piece, folder: str, start: int) -> bool:
        """Whether the folder above listed this one, under this inode."""
        if not folder:
            return True
        above = self.listings.at(piece, os.path.dirname(folder), start)
        try:
            return above is not None and above[1].get(os.path.basename(folder), [None])[0] == os.stat(os.path.join(self.root, folder)).st_ino
        except OSError:
            return False

    def commit(self, end: dict) -> None:
        pass


class VaultStream(SimpleDataSourceStreamReader):
    """Files that are new or changed since the offset, also those moved or copied in with an old mtime, and those in folders that were moved or renamed.

    A file's instant is its ctime, which no program sets and which every write, copy and rename moves on. The offset holds the latest instant
    seen (ns), the paths seen at it, and the folders with files (path and inode): a folder's move leaves its files' ctimes alone, so all files of one that is
    not known are new. Only instants that have passed when a listing starts are seen, so that no later change can bear one of them.
    """

    TICK = 0.05  # seconds, more than the steps of a file system's clock

    def __init__(self, options: dict):
        self.root, self.content = options["path"], options.get("content", "false").lower() == "true"

    def initialOffset(self) -> dict:
        return {"ns": -1, "paths": [], "folders": []}

    def listed(self) -> list[tuple[str, os.stat_result, str]]:
        """Each file with its folder's name in the offset."""
        tops = ["", *sorted(e.name for e in os.scandir(self.root) if e.is_dir() and not e.name.startswith(".") and e.name not in RESERVED)]
        names: dict[str, str] = {}
        out = []
        for top in tops:
            for rel, stat in walk(self.root, top):
                folder = os.path.dirname(rel)
                if folder not in names:
                    try:
                        names[folder] = f"{folder}:{os.stat(os.path.join(self.root, folder)).st_ino}"
                    except OSError:  # gone meanwhile
                        continue
                out.append((rel, stat, names[folder]))
        return out

    @staticmethod
    def seen(offset: dict, rel: str, stat: os.stat_result, folder: str) -> bool:
        """Whether the file as it is now had been seen at the offset."""
        known = "folders" not in offset or folder in offset["folders"]
        return known and (stat.st_ctime_ns < offset["ns"] or stat.st_ctime_ns == offset["ns"] and ("paths" not in offset or rel in offset["paths"]))

    def rows(self, found: list[tuple[str, os.stat_result]]) -> Iterator[tuple]:
        out = []
        for rel, stat in found:
            try:
                out.append(row(self.root, rel, stat, self.content))
            except FileNotFoundError:  # gone meanwhile
                continue
        return iter(out)

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        passed = time.time_ns()
        time.sleep(self.TICK)
        start = lookup(start)
        every = [(rel, s, d) for rel, s, d in self.listed() if s.st_ctime_ns <= passed]
        found = [(rel, s) for rel, s, d in every if not self.seen(start, rel, s, d)]
        ns = max([start["ns"], *(s.st_ctime_ns for _, s in found)])
        paths = {rel for rel, s in found if s.st_ctime_ns == ns} | (set(start.get("paths", ())) if ns == start["ns"] else set())
        return self.rows(found), {"ns": ns, "paths": sorted(paths), "folders": sorted({d for _, _, d in every})}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        start, end = lookup(start), lookup(end)
        return self.rows([(rel, s) for rel, s, d in self.listed() if not self.seen(start, rel, s, d) and self.seen(end, rel, s, d)])

    def commit(self, end: dict) -> None:
        pass


def lookup(offset: dict) -> dict:
    """The offset with sets in place of lists; offsets of earlier versions have neither."""
    return {k: frozenset(v) if isinstance(v, list) else v for k, v in offset.items()}


class Vault(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vault"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return VaultReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        if "state" not in self.options:  # the simple reader, which lists on the driver
            raise PySparkNotImplementedError(errorClass="NOT_IMPLEMENTED", messageParameters={"feature": "streamReader without the option state"})
        return VaultChanges(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return VaultStream(self.options)


def register(spark) -> None:
    from ..runtime import ship

    ship(spark)
    spark.dataSource.register(Vault)


def read(spark, path: str, content: bool = False, kinds: list[str] | None = None, prefix: str = "", paths: list[str] | None = None):
    """The tree, or what is of some kinds, begins with a prefix or has one of some paths (relative to the root)."""
    register(spark)
    some = {k: json.dumps(list(v)) for k, v in (("kinds", kinds), ("only", paths)) if v is not None}
    return spark.read.format("vault").options(content=str(content).lower(), prefix=prefix, **some).load(path)


def described(paths, root: str):
    """The rows of files with their content, out of their paths (rel_path). Tasks read them, one file at a time. Null paths and files that are gone meanwhile are left out; repeated paths give repeated rows."""
    from ..runtime import ship

    ship(paths.sparkSession)

    def run(batches):
        import pyarrow as pa

        kinds = [pa.string(), pa.string(), pa.int64(), pa.timestamp("us", tz="UTC"), pa.string(), pa.string(), pa.binary()]
        for batch in batches:
            for rel in batch.column(0).to_pylist():
                try:
                    found = row(root, rel, os.stat(os.path.join(root, rel)), True) if rel else None
                except OSError:
                    continue
                if found:
                    yield pa.record_batch([pa.array([x], k) for x, k in zip(found, kinds)], names=["rel_path", "name", "size", "mod_time", "kind", "sha256", "content"])

    return paths.select("rel_path").mapInArrow(run, SCHEMA)


def resolved(root: str, paths: list[str]) -> tuple[list[str], list[str]]:
    """Folders and files that are named, by real path; relative ones below the root. What stands twice, or in a folder that is named too, counts once. Raises FileNotFoundError with all that are missing."""
    places = [os.path.join(root, p) for p in paths]
    if missing := [p for p, at in zip(paths, places) if not os.path.exists(at)]:
        raise FileNotFoundError(", ".join(missing))
    real = sorted({os.path.realpath(p) for p in places})
    folders: list[str] = []
    for p in (p for p in real if os.path.isdir(p)):
        if not any(p.startswith(f.rstrip("/") + "/") for f in folders):
            folders.append(p)
    return folders, [p for p in real if not os.path.isdir(p) and not any(p.startswith(f.rstrip("/") + "/") for f in folders)]


def collected(spark, root: str, paths: list[str]):
    """Documents with their content out of any files and folders: rel_path is relative to the root below it, else the whole path. Folders are read as a tree is; named files whatever their names, but for sidecars and placeholders."""
    from pyspark.sql import functions as F

    top = os.path.realpath(root)
    folders, files = resolved(root, paths)

    def short(path):
        return F.when(F.startswith(path, F.lit(top + "/")), F.substring(path, len(top) + 2, 1 << 30)).otherwise(path)

    names = spark.createDataFrame([(f,) for f in files], "rel_path string")
    out = described(names, top).where("kind = 'document' or kind is null")
    out = out.withColumn("rel_path", short(F.col("rel_path")))
    for folder in folders:
        if folder == top or not folder.startswith(top + "/"):
            rows = read(spark, folder, content=True, kinds=["document"])
            rows = rows if folder == top else rows.withColumn("rel_path", F.concat(F.lit(folder.rstrip("/") + "/"), "rel_path"))
        else:
            rows = read(spark, top, content=True, kinds=["document"], prefix=folder[len(top) + 1 :] + "/")
        out = out.unionByName(rows)
    return out

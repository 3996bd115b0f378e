"""Command line: python -m shelfmark COMMAND --root FOLDER. Each prints one JSON envelope; nothing is moved without --yes."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config
from .operators import catalog as C
from .operators import doctor, executor, filing, lint, plan, repair, report, search
from .sources import extract, records, vault
from .streaming import watch


def collection(spark: SparkSession, root: str, cfg: config.Config, hashed: bool = False) -> tuple[DataFrame, DataFrame]:
    """Documents with their sidecars, and orphan sidecars. Bytes are read of sidecars only, unless digests are asked for. Tags stand in .tags.parquet (rel_path, tags), where there is one."""
    files = vault.read(spark, root, content=hashed)
    side = records.sidecars(files if hashed else vault.described(files.where("kind = 'sidecar'"), root))
    docs = files.where("kind = 'document'").drop("content", "kind")
    docs = docs.join(filing.read_tags(spark, root), "rel_path", "left")
    docs = search.with_placeholders(docs, files.where("kind = 'placeholder'").select(F.col("rel_path").alias("path")))
    meta = F.struct(*[F.col(f"meta.{k}") for k in ("doctype", "owners", "identifier", "year", "fields", "text", "source_sha256")])
    docs = search.attach_sidecars(search.hydrate(docs, cfg), side.select("doc_path", meta.alias("meta")))
    return docs, search.orphans(docs, side)


def proposed(spark: SparkSession, root: str, cfg: config.Config, files: DataFrame) -> DataFrame:
    facts = files.select(F.col("rel_path").alias("path"), "sha256", F.col("mod_time").alias("modified"))
    return plan.numbered(plan.proposals(extract.texts(files).where("fault is null").join(facts, "path"), cfg, C.Catalog.of(cfg)))


def places(spark: SparkSession, root: str, chosen: DataFrame) -> DataFrame:
    """path of every file, and its sha256 where one of the chosen documents is to go: bytes are read of these only."""
    every = vault.read(spark, root).where("kind in ('document', 'sidecar')").select("rel_path")
    asked = every.join(chosen.select(F.col("destination").alias("rel_path")).distinct(), "rel_path", "left_semi")
    return every.join(vault.described(asked, root).select("rel_path", "sha256"), "rel_path", "left").select(F.col("rel_path").alias("path"), "sha256")


def main(args: list[str]) -> int:
    p = argparse.ArgumentParser(prog="shelfmark", description=__doc__)
    p.add_argument("command", choices="find resolve lint doctor index doctypes ingest reindex move tag supersede rollback log watch".split())
    p.add_argument("--root", default=".")
    for name in ("person", "company", "area", "doctype", "period", "text"):
        p.add_argument(f"--{name}")
    p.add_argument("--tag", action="append", default=[])
    p.add_argument("--active", action="store_true")
    p.add_argument("--limit", type=int, default=0)
    p.add_argument("--folder", default="Inbox", help="where new files lie (ingest)")
    p.add_argument("--select", default="all")
    p.add_argument("--manifest")
    p.add_argument("--out", default="proposals")
    p.add_argument("--path", action="append", default=[], help="a document (move, tag, supersede: the one that gives way), or a file or folder anywhere (ingest)")
    p.add_argument("--by", help="the document that takes its place (supersede)")
    p.add_argument("--add", action="append", default=[])
    p.add_argument("--remove", action="append", default=[])
    p.add_argument("--for-send", action="store_true", help="confidential documents need --yes (resolve)")
    p.add_argument("--gap", type=float, default=2.0, help="seconds without a change that end a burst (watch)")
    p.add_argument("--fix", action="store_true", help="repair what can be repaired (lint)")
    p.add_argument("--once", action="store_true", help="end after the first burst (watch)")
    p.add_argument("--wait", type=float, help="seconds to wait for a burst (watch --once)")
    p.add_argument("--yes", action="store_true")
    a = p.parse_args(args)
    cfg = config.load(config.find(a.root))
    root = os.path.abspath(os.path.dirname(config.find(a.root)))
    spark = SparkSession.builder.appName("shelfmark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    catalog = C.Catalog.of(cfg)
    code, rows = 0, lambda d: [r.asDict(recursive=True) for r in d.collect()]
    if a.command == "find":
        query = search.Query(a.person, a.company, a.area, a.doctype, a.period, tuple(a.tag), a.text, a.active)
        docs = collection(spark, root, cfg)[0]
        total = docs.where(query.column(cfg)).count()
        found = rows(search.find(docs, query, cfg, a.limit).orderBy("rel_path"))
        said: object = {"count": total, "documents": found, "truncated": len(found) < total, "unreadable": rows(vault.read(spark, root, kinds=["unreadable"]).select("rel_path", F.col("name").alias("reason")).orderBy("rel_path"))}
    elif a.command == "lint" and a.fix:
        docs, orphans = collection(spark, root, cfg, hashed=True)
        found = lint.findings(docs, orphans, cfg, catalog)
        if a.yes:
            done = repair.fix(docs.select("rel_path", "sha256", "tags"), found.cache(), root)
            said = {"manifest": done["manifest"], "findings": rows(done["findings"].orderBy("path", "rule", "message"))}
        else:
            said, code = {"repairs": rows(repair.composed(found).orderBy("path")), "confirmation": "required"}, 3
    elif a.command == "lint":
        found = lint.findings(*collection(spark, root, cfg, hashed=True), cfg, catalog)
        said = {"findings": rows(lint.ordered(found)), **lint.counts(found).first().asDict()}
        code = 4 if said["error"] else 0
    elif a.command == "index":
        docs, orphans = collection(spark, root, cfg)
        records.replace(path := os.path.join(root, "INDEX.md"), ((line + "\n").encode() for line in report.index_lines(docs, orphans, cfg, catalog, os.path.basename(root))))
        records.replace(guide := os.path.join(root, "AGENTS.md"), ((line + "\n").encode() for line in report.agents_lines(cfg, catalog, os.path.basename(root))))
        said = {"path": path, "guide": guide}
    elif a.command == "doctypes":
        said = rows(report.filed_by_doctype(collection(spark, root, cfg)[0], catalog, {t.name for t in C.built_in()}).orderBy("doctype"))
    elif a.command == "ingest":
        files = vault.collected(spark, root, a.path) if a.path else vault.read(spark, root, content=True, kinds=["document"], prefix=a.folder.rstrip("/") + "/")
        found = proposed(spark, root, cfg, files).cache()
        if a.yes:
            chosen = search.select(found, search.parse_selection(a.select, found.count()))
            said = filing.file_proposals(chosen, places(spark, root, chosen), cfg, root)
        else:
            said, code = {"proposals": rows(found.drop("text", "modified").orderBy("index")), "confirmation": "required"}, 3
    elif a.command == "doctor":
        found = doctor.checks(spark, cfg, root)
        said = {"checks": rows(found), **doctor.counts(found).first().asDict()}
        code = 4 if said["fail"] else 0
    elif a.command == "reindex":
        files = vault.read(spark, root, content=True, kinds=["document"], paths=a.path or None)
        found = proposed(spark, root, cfg, files).where(F.col("path").isin(a.path) if a.path else F.lit(True))
        said, code = (filing.reindex(found, root), 0) if a.yes else ({"documents": rows(found.select("path", "doctype", "destination").orderBy("path")), "confirmation": "required"}, 3)
    elif a.command == "move":
        docs, orphans = collection(spark, root, cfg, hashed=True)
        fixes = lint.fixes(lint.findings(docs, orphans, cfg, catalog).where("rule in ('wrong-folder', 'name-normalization')")).where(F.col("path").isin(a.path) if a.path else F.lit(True))
        if a.yes:
            full = lambda c: F.concat(F.lit(root + "/"), F.col(c))
            moves = fixes.join(docs.select(F.col("rel_path").alias("path"), "sha256"), "path").select(full("path").alias("source"), full("move_to").alias("destination"), "sha256")
            planned = plan.planned(moves, docs.select(full("rel_path").alias("path"), "sha256"), last=plan.LAST_SUFFIX).join(moves.select("source", "sha256"), "source")
            said = executor.execute(planned, root)
        else:
            said, code = {"moves": rows(fixes.orderBy("path")), "confirmation": "required"}, 3
    elif a.command in ("tag", "supersede"):
        docs = collection(spark, root, cfg)[0]
        changed = filing.supersede(docs, a.path[0], a.by) if a.command == "supersede" else filing.retag(docs, spark.createDataFrame([(x,) for x in a.path], "rel_path string"), a.add, a.remove, cfg)
        said, code = {"documents": rows(changed.orderBy("rel_path"))}, 0
        if a.yes:
            filing.write_tags(spark, root, changed)
            records.append_audit(os.path.join(root, "audit.jsonl"), {"op": a.command, "actor": "shelfmark", "paths": [d["rel_path"] for d in said["documents"]], "confirmed": True})
        else:
            said, code = said | {"confirmation": "required"}, 3
    elif a.command == "resolve":
        docs = collection(spark, root, cfg)[0]
        path = search.resolve_path(docs, search.Query(a.person, a.company, a.area, a.doctype, a.period, tuple(a.tag), a.text, a.active), cfg, root)
        tags = docs.where(F.col("rel_path") == path).select(F.coalesce("tags", F.array().cast("array<string>")).alias("tags")).first().tags
        held = a.for_send and cfg.confirm_confidential and "confidential" in tags and not a.yes
        said, code = ({"path": path, "confirmation": "required", "reason": "tagged confidential"}, 3) if held else ({"path": path}, 0)
    elif a.command == "rollback":
        said = executor.rollback(records.read_manifest(spark, a.manifest), root)
    elif a.command == "log":
        said = rows(plan.tail(records.read_audit(spark, os.path.join(root, "audit.jsonl")), a.limit).orderBy("line"))
    else:
        propose = lambda files: proposed(spark, root, cfg, files).drop("text")
        if a.once:
            said = {"settled": watch.watch_once(spark, root, propose, a.out, a.out + ".checkpoint", a.gap, a.wait), "out": a.out}
        else:
            watch.watch(spark, root, propose, a.out, a.out + ".checkpoint", gap=a.gap).awaitTermination()
            said = {}
    print(records.envelope(a.command, said))
    return code


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

"""A small tree end to end: source, sidecars, finding, rules, proposals, moves, rollback, audit, watching."""

import datetime as dt
import io
import os
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from shelfmark import config
from shelfmark.operators import catalog as C
from shelfmark.operators import doctor, executor, filing, lint, plan, report, search
from shelfmark.sources import extract, records, vault
from shelfmark.sources.extract import legacy, plain
from shelfmark.streaming import watch

YAML = """
people:
  - {name: Nora Field, tag: nora-field}
  - {name: Omar Field}
tags: {companies: [acme-corp]}
rules: {single_active: [passport]}
"""


@pytest.fixture()
def tree(tmp_path):
    files = {
        "vault.yaml": YAML, "Financial/Nora-Field/FY 2026/Invoice_Nora-Field_Acme-Corp_2026.txt": "TAX INVOICE for Acme Corp\nInvoice number: A-1\n", "Financial/Nora-Field/FY 2026/old notes.txt": "nothing", "Financial/_Shared/FY 2025/Receipt_Shared_Globex_2025.txt": "receipt",
        "Identity/Nora-Field/Passport_Nora-Field_Office_2024.txt": "PASSPORT", ".hidden/x.txt": "no", "manifests/a.csv": "no", "Travel/.x.pdf.icloud": "",
    }
    for rel, text in files.items():
        path = tmp_path / rel
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    invoice = tmp_path / "Financial/Nora-Field/FY 2026/Invoice_Nora-Field_Acme-Corp_2026.txt"
    records.write_sidecar(str(invoice), {"doctype": "invoice", "fields": {"invoice_number": "A-1"}, "source_sha256": executor.digest(str(invoice)), "text": "tax invoice"})
    records.write_sidecar(str(tmp_path / "Financial/_Shared/FY 2025/Receipt_Shared_Globex_2025.txt"), {"doctype": "receipt", "source_sha256": "stale"})
    records.write_sidecar(str(tmp_path / "Travel/gone.txt"), {"doctype": "ticket"})
    (tmp_path / "Travel/.bad.txt.meta.yaml").write_text("a: [")
    return tmp_path


@pytest.fixture()
def loaded(spark, tree):
    cfg = config.load(str(tree / "vault.yaml"))
    files = vault.read(spark, str(tree), content=True)
    side = records.sidecars(files)
    docs = search.hydrate(files.where("kind = 'document'").drop("content", "kind").withColumn("tags", F.array().cast("array<string>")), cfg)
    meta = side.select("doc_path", F.struct("meta.doctype", "meta.owners", "meta.identifier", "meta.year", "meta.fields", "meta.text", "meta.source_sha256").alias("meta"))
    return cfg, files, side, search.attach_sidecars(docs, meta)


def test_scan_find_and_rules(spark, tree, loaded):
    cfg, files, side, docs = loaded
    assert sorted(r.rel_path for r in docs.collect()) == ["Financial/Nora-Field/FY 2026/Invoice_Nora-Field_Acme-Corp_2026.txt", "Financial/Nora-Field/FY 2026/old notes.txt", "Financial/_Shared/FY 2025/Receipt_Shared_Globex_2025.txt", "Identity/Nora-Field/Passport_Nora-Field_Office_2024.txt"]
    assert {r.kind for r in files.collect()} == {"document", "sidecar", "placeholder"}
    names = lambda q: sorted(os.path.basename(r.rel_path).split("_")[0] for r in search.find(docs, q, cfg).collect())
    assert names(search.Query(text="a-1")) == ["Invoice"]
    assert names(search.Query(person="nora field")) == ["Invoice", "Passport", "old notes.txt"]
    assert names(search.Query(period="FY2025")) == ["Receipt"] and names(search.Query(company="ACME corp")) == ["Invoice"]
    assert search.resolve_one(docs, search.Query(doctype="passport"), cfg).endswith("Office_2024.txt")
    with pytest.raises(ValueError, match="several"):
        search.resolve_one(docs, search.Query(), cfg)
    catalog = C.Catalog.of(cfg)
    orphans = search.orphans(docs, side)
    found = lint.findings(docs, orphans, cfg, catalog)
    assert sorted((r.rule, os.path.basename(r.path)) for r in found.collect()) == [("name-grammar", "old notes.txt"), ("orphan-sidecar", ".gone.txt.meta.yaml"), ("stale-sidecar", "Receipt_Shared_Globex_2025.txt")]
    assert lint.counts(found).first().asDict() == {"error": 1, "warning": 1, "info": 1, "fixable": 0}
    text = report.index_text(docs, orphans, cfg, catalog, "Papers")
    assert "4 documents, 2 with a sidecar, 3 with a parsed name, 1 orphan sidecars." in text and "| financial | 3 |" in text and text == report.index_text(docs, orphans, cfg, catalog, "Papers")


def test_index_has_every_tag(spark, loaded):
    cfg, _, side, docs = loaded
    tags = [f"tag-{k:04d}" for k in range(1500)]
    tagged = docs.withColumn("tags", F.transform(F.sequence(F.lit(0), F.lit(1499)), lambda k: F.concat(F.lit("tag-"), F.lpad(k.cast("string"), 4, "0"))))
    text = report.index_text(tagged, search.orphans(docs, side), cfg, C.Catalog.of(cfg), "Papers")
    assert [line.split("`")[1] for line in text.splitlines() if line.startswith("| `")] == tags


def test_propose_move_and_roll_back(spark, tree, loaded):
    cfg = loaded[0]
    inbox = tree / "Inbox"
    inbox.mkdir()
    (inbox / "scan 2024-03-02 acme.txt").write_text("TAX INVOICE\nInvoice Number: INV-9\nBill To: Omar Field\nDate: 12/03/2024\nTotal: 12.50\n")
    raw = vault.read(spark, str(tree), content=True).where("rel_path like 'Inbox/%'")
    files = extract.texts(raw).join(raw.select(F.col("rel_path").alias("path"), "sha256", F.col("mod_time").alias("modified")), "path")
    got = plan.proposals(files, cfg, C.Catalog.of(cfg)).first()
    assert (got.doctype, got.owners, got.year, got.identifier, got.confidence) == ("invoice", ["Omar Field"], 2024, "INV-9", 0.5)
    assert got.destination == "Financial/Omar-Field/FY 2024/Invoice_Omar-Field_INV-9_2024.txt" and set(got.tags) == {"omar-field", "fy2024", "active"} and not got.guessed
    over = plan.proposals(files, cfg, C.Catalog.of(cfg), {"doctype": "Receipt", "owners": ["nora-field"], "year": 2020}).first()
    assert (over.classifier, over.confidence, over.destination) == ("human", 0.0, "Financial/Nora-Field/FY 2020/Receipt_Nora-Field_INV-9_2020.txt")
    for bad in ({"doctype": "invoce"}, {"owners": ["Nobody"]}, {"category": "legal"}, {"year": 3}):
        with pytest.raises(ValueError):
            plan.checked(cfg, C.Catalog.of(cfg), bad)
    source, target = str(inbox / "scan 2024-03-02 acme.txt"), str(tree / got.destination)
    moves = plan.planned(spark.createDataFrame([(source, target, got.sha256)], "source string, destination string, sha256 string"), spark.createDataFrame([], "path string, sha256 string"))
    done = executor.execute(moves.join(spark.createDataFrame([(source, got.sha256)], "source string, sha256 string"), "source"), str(tree), now=dt.datetime(2026, 5, 1))
    assert os.path.exists(target) and not os.path.exists(source) and os.path.exists(tree / config.STAGING / "Inbox" / os.path.basename(source))
    manifest = records.read_manifest(spark, done["manifest"])
    assert [tuple(r) for r in manifest.collect()] == [(target, source, got.sha256)]
    assert manifest.select(records.op_of(F.lit(done["manifest"])).alias("op")).first().op == "move"
    assert executor.rollback(manifest, str(tree))["restored"] == [target] and os.path.exists(source)
    assert executor.rollback(manifest, str(tree))["restored"] == []
    with open(tree / "audit.jsonl", "a") as f:
        f.write("broken\n")
    assert [r.op for r in plan.tail(records.read_audit(spark, str(tree / "audit.jsonl")), 2).collect()] == ["rollback", "rollback"]


def test_watch_once(spark, tree):
    out = tree.parent / "out"
    query = watch.watch(spark, str(tree), lambda rows: rows.select("rel_path", "size"), str(out), str(tree.parent / "checkpoint"), once=True)
    query.awaitTermination(120)
    assert spark.read.json(str(out)).count() == 4
    (tree / "Travel/new.txt").write_text("x")
    watch.watch(spark, str(tree), lambda rows: rows.select("rel_path", "size"), str(out), str(tree.parent / "checkpoint"), once=True).awaitTermination(120)
    assert {r.rel_path for r in spark.read.json(str(out)).collect()} >= {"Travel/new.txt"}


def test_stream_sees_moved_copied_and_renamed_files(tree):
    stream = vault.VaultStream({"path": str(tree)})
    aside = tree.parent / "aside"
    (aside / "Old").mkdir(parents=True)
    for path in (aside / "a.txt", aside / "b.txt", aside / "Old/c.txt"):
        path.write_text("x")
        os.utime(path, (1e9, 1e9))
    names = lambda rows: sorted(r[0] for r in rows)
    first, at = stream.read(stream.initialOffset())
    assert len(names(first)) == 9 and names(stream.read(at)[0]) == [] and stream.read(at)[1] == at

    def step(change):
        nonlocal at
        change()
        rows, end = stream.read(at)
        got = names(rows)
        assert names(stream.readBetweenOffsets(at, end)) == got
        at = end
        assert names(stream.read(at)[0]) == []
        return got

    import shutil
    import time

    settle = lambda f: lambda: (f(), time.sleep(0.03))
    assert step(settle(lambda: os.rename(aside / "a.txt", tree / "Travel/a.txt"))) == ["Travel/a.txt"]
    assert step(settle(lambda: shutil.copy2(aside / "b.txt", tree / "Travel/b.txt"))) == ["Travel/b.txt"]
    assert step(settle(lambda: os.rename(tree / "Travel/b.txt", tree / "Travel/d.txt"))) == ["Travel/d.txt"]
    assert step(settle(lambda: os.rename(aside / "Old", tree / "Travel/Old"))) == ["Travel/Old/c.txt"]
    assert step(settle(lambda: os.rename(tree / "Travel/Old", tree / "Travel/New"))) == ["Travel/New/c.txt"]
    last = os.stat(tree / "Travel/a.txt").st_ctime_ns  # a file of the offset's own instant that was not seen yet
    assert names(stream.read({**at, "ns": last, "paths": []})[0])[0] == "Travel/a.txt" and "Travel/a.txt" not in names(stream.read({**at, "ns": last, "paths": ["Travel/a.txt"]})[0])
    (tree / "Travel/future.txt").write_text("x")
    os.utime(tree / "Travel/future.txt", (4e9, 4e9))
    assert step(lambda: time.sleep(0.03)) == ["Travel/future.txt"]
    assert step(settle(lambda: (tree / "Travel/after.txt").write_text("x"))) == ["Travel/after.txt"]


def package(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_office_packages():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    doc = package({"word/document.xml": f"<w:document {w}><w:body><w:p><w:r><w:t>One</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:p><w:r><w:t>three</w:t><w:br/></w:r></w:p></w:body></w:document>"})
    assert extract.extracted("a.docx", doc)[:2] == ("One\ttwo\nthree", "ooxml")
    sheet = lambda c: f'<worksheet><sheetData><row><c t="s"><v>0</v></c><c><v>{c}</v></c><c t="s"><v>9</v></c></row></sheetData></worksheet>'
    book = package({"xl/sharedStrings.xml": "<sst><si><t>name</t><rPh><t>x</t></rPh></si></sst>", "xl/worksheets/sheet10.xml": sheet(10), "xl/worksheets/sheet2.xml": sheet(2)})
    assert extract.extracted("a.XLSX", book)[0] == "name\t2\nname\t10"
    slides = package({f"ppt/slides/slide{k}.xml": f'<p:sld xmlns:p="p" xmlns:a="a"><a:p><a:r><a:t>s{k}</a:t></a:r></a:p></p:sld>' for k in (10, 9)})
    assert extract.extracted("a.pptx", slides)[0] == "s9\ns10"
    assert extract.extracted("a.docx", b"junk")[2].startswith("BadZipFile") and extract.extracted("a.exe", b"")[2] == "no reader for .exe"


def compound(name, stream):
    """A compound file with one stream, padded beyond the small ones."""
    stream = stream.ljust(4096, b"\0")
    n = -(-len(stream) // 512)
    entry = lambda s, kind, start, size: s.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HBB", 2 * len(s) + 2, kind, 0) + b"\xff" * 12 + b"\0" * 36 + struct.pack("<III", start, size, 0)
    directory = (entry("Root Entry", 5, 0xFFFFFFFE, 0) + entry(name, 2, 2, len(stream))).ljust(512, b"\0")
    fat = [0xFFFFFFFD, 0xFFFFFFFE, *range(3, 2 + n), 0xFFFFFFFE]
    head = bytes.fromhex("D0CF11E0A1B11AE1") + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 6 + struct.pack("<9I", 0, 1, 1, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0) + struct.pack("<109I", 0, *[0xFFFFFFFF] * 108)
    return head + struct.pack(f"<{len(fat)}I", *fat).ljust(512, b"\xff") + directory + stream.ljust(512 * n, b"\0")


def test_older_office_files():
    rec = lambda kind, body: struct.pack("<HH", kind, len(body)) + body
    one = b"\x05\x00\x00hello" + b"\x06\x00\x00sp"
    book = rec(0x809, struct.pack("<HH", 0x600, 5) + b"\0" * 12) + rec(0x85, b"\0" * 6 + b"\x03\x00Tab") + rec(0xFC, struct.pack("<II", 2, 2) + one) + rec(0x3C, b"\x01" + "lité".encode("utf-16-le")) + rec(0x0A, b"")
    book += rec(0x809, struct.pack("<HH", 0x600, 0x10) + b"\0" * 12) + rec(0xFD, struct.pack("<HHHI", 1, 0, 0, 1)) + rec(0xFD, struct.pack("<HHHI", 0, 1, 0, 0)) + rec(0x27E, struct.pack("<HHHI", 0, 0, 0, (1234 << 2) | 3)) + rec(0x203, struct.pack("<HHHd", 1, 1, 0, 2.0)) + rec(0x0A, b"")
    assert legacy.xls(compound("Workbook", book)) == "Sheet: Tab\n12.34\thello\nsplité\t2"
    with pytest.raises(ValueError, match="password"):
        legacy.xls(compound("Workbook", rec(0x809, b"\0" * 16) + rec(0x2F, b"\0\0")))
    atom = lambda flags, kind, body: struct.pack("<HHI", flags, kind, len(body)) + body
    show = atom(0xF, 1000, atom(0, 0x0FA0, "Süß".encode("utf-16-le")) + atom(0, 0x0FA8, b"plain"))
    assert legacy.ppt(compound("PowerPoint Document", show)) == "Süß\nplain"
    good = compound("Workbook", book)
    for k in range(0, len(good), 37):
        extract.extracted("a.xls", good[:k] + b"\xfe\xff\xff" + good[k + 3 :])
        extract.extracted("a.xls", good[:k])


def test_plain_text():
    assert plain.text("é".encode() * (1 << 19)) == "é" * (1 << 19)
    assert plain.text(b"a" + "é".encode() * (1 << 19)) == "a" + "é" * ((1 << 19) - 1)
    for bad in (b"a\0b", b"\xff\xfe"):
        with pytest.raises(ValueError):
            plain.text(bad)


def test_selection():
    assert search.parse_selection("1,3-5", 5) == [1, 3, 4, 5] and search.parse_selection("ALL", 3) == [1, 2, 3] and search.parse_selection("none", 3) == []
    for bad in ("", "0", "6", "3-1", "1,1", "1,2-3,3", "all,1", "-1", "+1", "1-2-3", "x"):
        with pytest.raises(ValueError):
            search.parse_selection(bad, 5)


def test_command_line(spark, tree, capsys):
    import json

    from shelfmark.__main__ import main

    assert main(["find", "--root", str(tree), "--person", "Nora Field", "--limit", "2"]) == 0
    said = json.loads(capsys.readouterr().out)
    assert said["count"] == 3 and len(said["documents"]) == 2 and said["truncated"] and said["schema_version"] == 1
    assert main(["lint", "--root", str(tree)]) == 4
    assert json.loads(capsys.readouterr().out)["error"] == 2  # old notes, and a file that lies elsewhere
    (tree / "Inbox").mkdir()
    (tree / "Inbox/a.txt").write_text("TAX INVOICE\nInvoice Number: INV-9\nBill To: Omar Field\nDate: 12/03/2024\n")
    assert main(["ingest", "--root", str(tree)]) == 3
    assert json.loads(capsys.readouterr().out)["proposals"][0]["destination"] == "Financial/Omar-Field/FY 2024/Invoice_Omar-Field_INV-9_2024.txt"
    assert main(["ingest", "--root", str(tree), "--yes"]) == 0
    manifest = json.loads(capsys.readouterr().out)["manifest"]
    assert main(["rollback", "--root", str(tree), "--manifest", manifest]) == 0 and (tree / "Inbox/a.txt").exists()
    assert main(["log", "--root", str(tree), "--limit", "1"]) == 0 and json.loads(capsys.readouterr().out.split("\n}\n")[-2] + "\n}")["data"][0]["op"] == "rollback"
    assert main(["index", "--root", str(tree)]) == 0 and (tree / "INDEX.md").read_text().startswith("# ")


def test_every_source_survives_suffixes(spark, tmp_path):
    """Destinations that equal names made by a suffix, and sidecars among them."""
    sources = {f"in/{k}": f"content {k}" for k in range(6)}
    for rel, text in sources.items():
        (tmp_path / rel).parent.mkdir(exist_ok=True)
        (tmp_path / rel).write_text(text)
    names = ["a.txt", "a.txt", "a_2.txt", ".a.txt.meta.yaml", ".a.txt.meta.yaml", "a_2.txt"]
    rows = [(str(tmp_path / rel), str(tmp_path / "out" / name), executor.digest(str(tmp_path / rel))) for rel, name in zip(sources, names)]
    moves = spark.createDataFrame(rows, "source string, destination string, sha256 string")
    got = plan.planned(moves, spark.createDataFrame([], "path string, sha256 string"))
    assert [os.path.basename(r.destination) for r in got.orderBy("source").collect()] == ["a.txt", "a_3.txt", "a_2.txt", ".a.txt.meta.yaml", ".a_2.txt.meta.yaml", "a_2_2.txt"]
    done = executor.execute(got.join(moves.select("source", "sha256"), "source"), str(tmp_path), now=dt.datetime(2026, 5, 1))
    assert not done["failed"] and {(tmp_path / "out" / os.path.basename(p)).read_text() for p in done["moved"]} == set(sources.values())
    twice = moves.select(F.col("source"), F.lit(str(tmp_path / "out/b.txt")).alias("destination"), "sha256", F.lit("move").alias("action"))
    with pytest.raises(FileExistsError):
        executor.execute(twice, str(tmp_path))
    (tmp_path / "there").write_text("old")
    with pytest.raises(FileExistsError):
        executor.copy_checked(str(tmp_path / "out/a.txt"), str(tmp_path / "there"), executor.digest(str(tmp_path / "out/a.txt")))
    assert (tmp_path / "there").read_text() == "old"


def test_filing_tags_and_reindex(spark, tree, loaded):
    cfg, _, _, docs = loaded
    root, catalog = str(tree), C.Catalog.of(cfg)
    (tree / "Inbox").mkdir()
    for k in (1, 2):
        (tree / f"Inbox/scan {k}.txt").write_text(f"TAX INVOICE {k}\nInvoice Number: INV-9\nBill To: Omar Field\nDate: 12/03/2024\nTotal: 12.50\n")
    raw = vault.read(spark, root, content=True).where("rel_path like 'Inbox/%'")
    files = extract.texts(raw).join(raw.select(F.col("rel_path").alias("path"), "sha256", F.col("mod_time").alias("modified")), "path")
    found = plan.proposals(files, cfg, catalog)
    edited = found.withColumn("tags", F.concat("tags", F.array(F.lit("made-up"))))
    assert [x.tag for x in filing.rechecked(edited, cfg, root).first().dropped_tags] == ["made-up"]
    bad = found.withColumn("destination", F.when(F.col("path") == "Inbox/scan 2.txt", "manifests/x.txt").otherwise(F.col("destination")))
    done = filing.file_proposals(bad, vault.read(spark, root, content=True).select(F.col("rel_path").alias("path"), "sha256"), cfg, root, now=dt.datetime(2026, 5, 1))
    assert done["left"] == [("Inbox/scan 2.txt", "reserved folder")] and len(done["moved"]) == 1 == len(done["sidecars"])
    meta = records.meta_of(open(done["sidecars"][0], "rb").read())
    assert (meta["doctype"], meta["owners"], meta["year"], meta["fields"]["invoice_number"]) == ("invoice", ["Omar Field"], 2024, "INV-9") and meta["source_sha256"] == executor.digest(done["moved"][0])
    rel = os.path.relpath(done["moved"][0], root)
    assert {r.rel_path: r.tags for r in filing.read_tags(spark, root).collect()} == {rel: ["active", "fy2024", "omar-field"]}
    names = sorted(r.rel_path for r in docs.collect())
    got = filing.retag(docs, spark.createDataFrame([(names[0],), (names[0],)], "rel_path string"), ["Active", "acme-corp"], [], cfg).collect()
    assert [(r.rel_path, r.before, r.tags, r.added) for r in got] == [(names[0], [], ["acme-corp", "active"], ["acme-corp", "active"])]
    with pytest.raises(ValueError):
        filing.retag(docs, docs, ["made-up"], [], cfg)
    turned = filing.supersede(docs.withColumn("tags", F.array(F.lit("active"))), names[0], names[1])
    filing.write_tags(spark, root, turned)
    assert {r.rel_path: r.tags for r in filing.read_tags(spark, root).collect()} == {rel: ["active", "fy2024", "omar-field"], names[0]: ["superseded"], names[1]: ["active"]}
    with pytest.raises(ValueError):
        filing.supersede(docs, names[0], "nowhere")
    again = filing.reindex(found.where("path = 'Inbox/scan 2.txt'"), root, dt.datetime(2026, 5, 1))
    assert again["elsewhere"][0][0] == "Inbox/scan 2.txt" and os.path.exists(again["sidecars"][0])
    assert search.resolve_path(docs, search.Query(text=f"{root}/{names[1]}"), cfg, root) == names[1]
    os.symlink("/tmp", tree / "out")
    assert filing.within(root, f"{root}/new/x.txt") and not filing.within(root, f"{root}/out/x.txt")
    assert any("passport" in line for line in report.agents_lines(cfg, catalog, "Papers"))


def test_free_answers(spark):
    from shelfmark.functions import model
    from shelfmark.operators import infer

    answers = ['Sure!\n```json\n{"doctype": "invoice", "confidence": 85, "fields": {"a": "}{"}}\n``` {"x": 1}', '{"doctype":"visa","confidence":"0.7"}', "none", "} { no end", '{"doctype": " "}', None, '{"doctype":"a \\" {","confidence":null}']
    got = spark.createDataFrame([(k, a) for k, a in enumerate(answers)], "k int, a string").select("k", model.first_object(F.col("a")).alias("o"), model.loose_answer(F.col("a")).alias("s")).orderBy("k").collect()
    assert got[0].o == '{"doctype": "invoice", "confidence": 85, "fields": {"a": "}{"}}' and [r.o is None for r in got] == [False, False, True, True, False, True, False]
    assert [(r.s.doctype, r.s.confidence) if r.s else None for r in got] == [("invoice", 0.85), ("visa", 0.7), None, None, None, None, ('a " {', 0.0)]
    m = spark.sql("SELECT map('a', '1', 'b', '2') AS p, map('b', '3', 'c', '4') AS e").select(infer.merged_over(F.col("p"), F.col("e")).alias("m"), infer.merged_over(F.lit(None).cast("map<string,string>"), F.lit(None).cast("map<string,string>")).alias("n")).first()
    assert m.m == {"a": "1", "b": "2", "c": "4"} and m.n is None


def test_a_burst_is_one_batch(spark, tree):
    import time

    out = tree.parent / "bursts"
    query = watch.watch(spark, str(tree), lambda rows: rows.select("rel_path", "sha256"), str(out), str(tree.parent / "gap"), every="200 milliseconds", gap=1.0)
    try:
        for k in range(3):
            (tree / f"Travel/burst {k}.txt").write_text(f"{k}")
            time.sleep(0.1)
        deadline = time.time() + 90
        while time.time() < deadline and (not out.exists() or not any(p.name == "_SUCCESS" for p in out.rglob("*"))):
            time.sleep(0.3)
    finally:
        query.stop()
    got = spark.read.json(str(out)).collect()
    assert {f"Travel/burst {k}.txt" for k in range(3)} <= {r.rel_path for r in got} and len({r.rel_path for r in got}) == len(got)
    assert next(r.sha256 for r in got if r.rel_path == "Travel/burst 1.txt") == executor.digest(str(tree / "Travel/burst 1.txt"))


def test_doctor(spark, tree, loaded):
    found = {r.name: r.status for r in doctor.checks(spark, loaded[0], str(tree)).collect()}
    assert found["root"] == "ok" and found["category financial"] == "ok" and found["category legal"] == "warn"
    assert doctor.counts(spark.createDataFrame([("ok",), ("ok",), ("fail",), (None,), ("?",)], "status string")).first().asDict() == {"ok": 2, "warn": 0, "fail": 1}

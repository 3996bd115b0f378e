"""The tree as a table: slices, filters, folders that can't be read; and watching for one burst."""

import json
import os
import shutil
import time

import pytest
from pyspark.sql import functions as F

from shelfmark.sources import vault
from shelfmark.streaming import watch


def grown(root, files):
    for rel in files:
        path = root / rel
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(rel)
    return root


def read_all(reader):
    return sorted(r[0] for p in reader.partitions() for r in reader.read(p))


FILES = ["a.txt", "vault.yaml", "One/b.txt", "One/.b.txt.meta.yaml", "One/Deep/c.txt", "One/Deep/Down/d.txt", "Two/e.txt", "Two/.e.icloud", "Two/.hidden/x", "manifests/m.csv", "_Shared/f.txt", "One/manifests/no.csv"]
SEEN = sorted(["a.txt", "One/b.txt", "One/.b.txt.meta.yaml", "One/Deep/c.txt", "One/Deep/Down/d.txt", "Two/e.txt", "Two/.e.icloud", "_Shared/f.txt"])


@pytest.mark.parametrize("listed, slice_", [(2048, 2000), (1, 2000), (3, 1), (2048, 1)])
def test_every_file_once_however_the_tree_is_cut(tmp_path, monkeypatch, listed, slice_):
    monkeypatch.setattr(vault.VaultReader, "LISTED", listed)
    monkeypatch.setattr(vault.VaultReader, "SLICE", slice_)
    grown(tmp_path, FILES)
    assert read_all(vault.VaultReader({"path": str(tmp_path)})) == SEEN
    assert sorted(r for top in ("", "One", "Two", "_Shared") for r, _ in vault.walk(str(tmp_path), top)) == SEEN
    assert read_all(vault.VaultReader({"path": str(grown(tmp_path / "void", []))})) == [] if (tmp_path / "void").mkdir() is None else None


def test_one_large_folder_is_read_by_several_tasks(spark, tmp_path):
    grown(tmp_path, [f"Big/{k}.txt" for k in range(7000)])
    reader = vault.VaultReader({"path": str(tmp_path)})
    sizes = [sum(1 for _ in reader.read(p)) for p in reader.partitions()]
    assert sum(sizes) == 7000 and len([n for n in sizes if n]) == 4 and max(sizes) < 2200
    assert vault.read(spark, str(tmp_path)).groupBy(F.spark_partition_id().alias("p")).count().count() == 4


def test_filters_open_fewer_folders(spark, tmp_path, monkeypatch):
    grown(tmp_path, FILES)
    opened, scandir = [], os.scandir

    def counting(path):
        opened.append(os.path.relpath(path, tmp_path))
        return scandir(path)

    monkeypatch.setattr(os, "scandir", counting)

    def found(**options):
        reader = vault.VaultReader({"path": str(tmp_path), **options})
        opened.clear()
        return read_all(reader), set(opened)

    assert found(prefix="One/Deep") == (["One/Deep/Down/d.txt", "One/Deep/c.txt"], {".", "One", "One/Deep", "One/Deep/Down"})
    assert found(only='["Two/e.txt", "nowhere"]') == (["Two/e.txt"], {".", "Two"})
    assert found(kinds='["sidecar", "placeholder"]') == (["One/.b.txt.meta.yaml", "Two/.e.icloud"], {".", "One", "One/Deep", "One/Deep/Down", "Two", "_Shared"})
    assert found(kinds="[]")[0] == [] == found(prefix="No")[0] and found(prefix="One/b.txt")[0] == ["One/b.txt"]
    monkeypatch.undo()
    docs = vault.read(spark, str(tmp_path), kinds=["document"], prefix="One/")
    assert sorted(r.rel_path for r in docs.where("size > 0").collect()) == ["One/Deep/Down/d.txt", "One/Deep/c.txt", "One/b.txt"]
    assert docs.where("kind = 'sidecar'").count() == 0 and docs.where("rel_path = 'One/b.txt'").count() == 1
    assert vault.read(spark, str(tmp_path), content=True, paths=["a.txt"]).first().content == b"a.txt"


def test_folders_that_cannot_be_read(tmp_path, monkeypatch):
    grown(tmp_path, FILES)
    scandir = os.scandir

    def refusing(path):
        if str(path).endswith("Deep"):
            raise PermissionError(13, "Permission denied")
        return scandir(path)

    monkeypatch.setattr(os, "scandir", refusing)
    reader = vault.VaultReader({"path": str(tmp_path)})
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert [r[:5] for r in rows if r[4] == "unreadable"] == [("One/Deep", "Permission denied", None, None, "unreadable")] and len(rows) == len(SEEN) - 1
    reader = vault.VaultReader({"path": str(tmp_path), "kinds": '["document"]'})
    assert all(r[4] == "document" for p in reader.partitions() for r in reader.read(p))


def test_watch_ends_after_one_burst(spark, tmp_path):
    tree, out, checkpoint = grown(tmp_path / "tree", ["In/a.txt", "In/b.txt"]), str(tmp_path / "out"), str(tmp_path / "checkpoint")
    propose = lambda rows: rows.select("rel_path")
    assert watch.watch_once(spark, str(tree), propose, out, checkpoint, gap=0.5, wait=120)
    assert sorted(r.rel_path for r in spark.read.json(out).collect()) == ["In/a.txt", "In/b.txt"]
    assert not watch.watch_once(spark, str(tree), propose, out, checkpoint, gap=0.5, wait=6)
    grown(tree, ["In/c.txt"])
    assert watch.watch_once(spark, str(tree), propose, out, checkpoint, gap=0.5, wait=120)
    assert sorted(r.rel_path for r in spark.read.json(out).collect()) == ["In/a.txt", "In/b.txt", "In/c.txt"]


def step(reader, start, change=lambda: None):
    change()
    time.sleep(0.12)
    end = reader.latestOffset()
    got = [r[0] for p in reader.partitions(start, end) for r in reader.read(p)]
    assert sorted(got) == sorted(r[0] for p in reader.partitions(start, end) for r in reader.read(p))  # a batch read again
    assert len(json.dumps(end)) < 40 and len(got) == len(set(got))
    return sorted(got), end


@pytest.mark.parametrize("listed", [512, 1])
def test_changes_in_partitions(tmp_path, monkeypatch, listed):
    monkeypatch.setattr(vault.VaultChanges, "LISTED", listed)
    tree = grown(tmp_path / "tree", FILES)
    (tmp_path / "aside/Old").mkdir(parents=True)
    for rel in ("a1.txt", "b1.txt", "Old/c1.txt"):
        (tmp_path / "aside" / rel).write_text("x")
        os.utime(tmp_path / "aside" / rel, (1e9, 1e9))
    make = lambda: vault.VaultChanges({"path": str(tree), "state": str(tmp_path / "state")})
    reader = make()
    got, at = step(reader, reader.initialOffset())
    assert got == SEEN
    assert step(reader, at)[0] == []

    def then(change):
        nonlocal at
        got, at = step(make(), at, change)  # a new reader, as after a restart
        return got

    assert then(lambda: os.rename(tmp_path / "aside/a1.txt", tree / "Two/a1.txt")) == ["Two/a1.txt"]
    assert then(lambda: shutil.copy2(tmp_path / "aside/b1.txt", tree / "Two/b1.txt")) == ["Two/b1.txt"]
    assert then(lambda: os.rename(tree / "Two/b1.txt", tree / "Two/d1.txt")) == ["Two/d1.txt"]
    assert then(lambda: os.rename(tmp_path / "aside/Old", tree / "Two/Old")) == ["Two/Old/c1.txt"]
    assert then(lambda: os.rename(tree / "Two/Old", tree / "Two/New")) == ["Two/New/c1.txt"]
    assert then(lambda: os.rename(tree / "Two/New", tree / "Two/Old")) == ["Two/Old/c1.txt"]
    assert then(lambda: (tree / "One/b.txt").write_text("other")) == ["One/b.txt"]
    assert then(lambda: os.remove(tree / "One/b.txt")) == []
    assert then(lambda: grown(tree, ["One/b.txt", "New/Deep/x.txt"])) == ["New/Deep/x.txt", "One/b.txt"]
    assert then(lambda: None) == []


def test_a_limit_of_files_a_batch(tmp_path):
    tree = grown(tmp_path / "tree", [f"In/{k}.txt" for k in range(25)])
    reader = vault.VaultChanges({"path": str(tree), "state": str(tmp_path / "state"), "limit": "10"})
    seen, at = [], reader.initialOffset()
    for size in (10, 10, 5, 0):
        got, at = step(reader, at)
        assert len(got) == size
        seen += got
    assert sorted(seen) == sorted(f"In/{k}.txt" for k in range(25))


def test_many_folders_need_no_large_offset(spark, tmp_path):
    tree = grown(tmp_path / "tree", [f"F{k}/x.txt" for k in range(700)])
    reader = vault.VaultChanges({"path": str(tree), "state": str(tmp_path / "state")})
    end = reader.latestOffset()
    assert len(json.dumps(end)) < 40 and len(reader.partitions(reader.initialOffset(), end)) > 100
    spans = reader.partitions(reader.initialOffset(), end)
    assert sum(1 for p in spans for _ in reader.read(p)) in (699, 700)  # the last one may be a tick too young


def test_files_and_folders_from_anywhere(spark, tmp_path):
    root, other = grown(tmp_path / "root", FILES), grown(tmp_path / "other", ["x.txt", "Sub/y.txt", "Sub/.y.txt.meta.yaml"])
    os.symlink(root / "One", tmp_path / "link")
    got = vault.collected(spark, str(root), ["One/Deep", "One", str(tmp_path / "link"), "a.txt", str(root / "a.txt"), "One/b.txt", str(other / "Sub"), str(other / "Sub/y.txt"), "Two/.e.icloud"])
    assert sorted(r.rel_path for r in got.collect()) == sorted(["One/b.txt", "One/Deep/c.txt", "One/Deep/Down/d.txt", "a.txt", str(other / "Sub/y.txt")])
    assert {r.content for r in got.where("rel_path in ('a.txt', 'One/b.txt')").collect()} == {b"a.txt", b"One/b.txt"}
    assert vault.collected(spark, str(root), ["."]).count() == len([f for f in SEEN if "/." not in f])
    with pytest.raises(FileNotFoundError, match="gone.txt, Nowhere"):
        vault.collected(spark, str(root), ["a.txt", "gone.txt", "Nowhere"])


def test_active_documents_are_all_named(spark):
    from shelfmark.config import Config, Person
    from shelfmark.operators import lint

    rows = [(f"p{k:03}.pdf", "passport", ["active"], ["Nora Field"]) for k in range(60)] + [("q1", "passport", ["active"], ["Omar Field"]), ("q2", "passport", ["active"], ["Omar Field"]), ("r", "passport", [], ["Omar Field"])]
    docs = spark.createDataFrame(rows, "rel_path string, doctype string, tags array<string>, owners array<string>")
    docs = docs.select("rel_path", "tags", F.struct("doctype", "owners").alias("doc"), F.struct(F.lit(None).cast("string").alias("doctype"), F.array().cast("array<string>").alias("owners")).alias("meta"))
    found = {r.path: r.message for r in lint.multiple_active(docs, Config(people=(Person("Nora Field", "nora-field"),), single_active=("passport",))).collect()}
    assert len(found) == 62 and found["q1"] == found["q2"] == "2 active passport documents of omar-field: q1, q2"
    assert found["p000.pdf"].startswith("60 active passport documents of nora-field: p000.pdf, p001.pdf, ") and found["p059.pdf"].endswith("p049.pdf and 10 more")

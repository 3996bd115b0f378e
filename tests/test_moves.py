"""Plans carried out by tasks."""

import datetime as dt
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import executor, plan
from shelfmark.runtime import ship
from shelfmark.sources import moves, records

NOW = dt.datetime(2026, 5, 1)


def files_under(root):
    return {os.path.relpath(os.path.join(d, n), root): open(os.path.join(d, n), "rb").read() for d, _, names in os.walk(root) for n in names}


def planned(spark, root, n):
    for k in range(n):
        path = root / f"in/{k % 20}/{k}.txt"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"content {k}")
    rows = [(f"{root}/in/{k % 20}/{k}.txt", f"{root}/out/{k % 7}/new {k}.txt", hashlib.sha256(f"content {k}".encode()).hexdigest(), "move") for k in range(n)]
    return spark.createDataFrame(rows, "source string, destination string, sha256 string, action string")


def test_many_files_by_several_tasks_and_back(spark, tmp_path):
    n = 2000
    wanted = planned(spark, tmp_path, n)
    before = files_under(tmp_path)
    records.write_sidecar(f"{tmp_path}/in/3/3.txt", {"doctype": "visa"})
    manifest, outcome = executor.carry_out(wanted, str(tmp_path), now=NOW)
    assert len(os.listdir(f"{manifest.removesuffix('.csv')}.outcome")) > 4  # a part a task
    assert outcome.groupBy("status").count().collect() == [("moved", n)]
    after = files_under(tmp_path)
    assert {k for k in after if k.startswith("in/")} == set() and all(after[f"out/{k % 7}/new {k}.txt"] == f"content {k}".encode() for k in range(n))
    assert b"visa" in after["out/3/.new 3.txt.meta.yaml"] and not os.path.exists(tmp_path / moves.WORK / os.path.basename(manifest).removesuffix(".csv"))
    said = executor.rollback(records.read_manifest(spark, manifest), str(tmp_path))
    assert len(said["restored"]) == n and not said["left"]
    restored = files_under(tmp_path)
    assert {k: v for k, v in restored.items() if k in before} == before and not any(k.startswith("out/") for k in restored)
    assert executor.rollback(records.read_manifest(spark, manifest), str(tmp_path))["restored"] == []


def test_a_killed_task_leaves_no_half_file(spark, tmp_path):
    wanted = planned(spark, tmp_path, 60)

    class Dying(moves.MoveWriter):
        def one(self, own, source, destination, sha, facts):
            if source.endswith("/37.txt"):
                os.makedirs(own, exist_ok=True)
                with open(os.path.join(own, "half"), "wb") as f:
                    f.write(b"cont")
                os._exit(1)
            return super().one(own, source, destination, sha, facts)

    class Dies(moves.Moves):
        def writer(self, schema, overwrite):
            return Dying(self.options)

    ship(spark)
    spark.dataSource.register(Dies)
    rows = wanted.select("source", "destination", "sha256", F.lit(None).cast(moves.FACTS).alias("facts")).coalesce(1)
    with pytest.raises(Exception, match="abort"):
        rows.write.format("vault_moves").option("path", str(tmp_path)).option("op", "try").mode("append").save()
    spark.dataSource.register(moves.Moves)
    found = files_under(tmp_path)
    places = {f"out/{k % 7}/new {k}.txt": f"content {k}".encode() for k in range(60)}
    assert all(places[k] == v for k, v in found.items() if k.startswith("out/")) and not os.path.exists(tmp_path / moves.WORK / "try")
    assert not os.path.exists(tmp_path / "manifests/try.outcome") and f"in/{37 % 20}/37.txt" in found
    _, outcome = executor.carry_out(wanted, str(tmp_path), now=NOW)  # what the killed task had done is found
    states = {r.status for r in outcome.collect()}
    assert states <= {"moved", "again"} and "again" in states
    assert {k: v for k, v in files_under(tmp_path).items() if k.startswith("out/")} == places


def test_rows_that_cannot_move_fail_alone(spark, tmp_path):
    wanted = planned(spark, tmp_path, 6).collect()
    os.makedirs(tmp_path / "out/1")
    (tmp_path / "out/1/new 1.txt").write_text("someone else's")
    os.remove(tmp_path / "in/2/2.txt")
    (tmp_path / "in/3/3.txt").write_text("changed")
    os.symlink("/tmp", tmp_path / "away")
    rows = [tuple(r) for r in wanted if not r.source.endswith("/4.txt")] + [(f"{tmp_path}/in/4/4.txt", f"{tmp_path}/away/x.txt", wanted[4].sha256, "move"), (f"{tmp_path}/in/9.txt", None, "x", "move"), (None, "y", "x", "move"), ("z", "z", "z", "skip")]
    done = executor.execute(spark.createDataFrame(rows, "source string, destination string, sha256 string, action string"), str(tmp_path), now=NOW)
    why = {os.path.basename(s or "-"): r for s, r in done["failed"]}
    assert set(why) == {"1.txt", "2.txt", "3.txt", "4.txt", "9.txt", "-"} and len(done["moved"]) == 2
    assert why["1.txt"] == "the destination is taken" and why["2.txt"] == "the source is gone" and "changed" in why["3.txt"] and "outside" in why["4.txt"]
    assert (tmp_path / "out/1/new 1.txt").read_text() == "someone else's" and (tmp_path / "in/3/3.txt").read_text() == "changed"
    assert executor.execute(spark.createDataFrame(rows[:0], "source string, destination string, sha256 string, action string"), str(tmp_path), now=NOW)["moved"] == []


def test_moves_without_a_destination_fail(spark):
    moves_ = spark.createDataFrame([("a", None, "1"), ("b", None, "1"), ("c", "x", "2"), (None, "x", "3")], "source string, destination string, sha256 string")
    for how in ("suffix", "skip", "fail"):
        got = {(r.source, r.action) for r in plan.planned(moves_, spark.createDataFrame([], "path string, sha256 string"), how).collect()}
        assert {("a", "fail"), ("b", "fail"), (None, "fail")} <= got


def test_repairs_move_first_and_tags_follow(spark, tmp_path):
    from shelfmark.operators import filing, repair

    names = ["a.txt", "b.txt", "c.txt", "d.txt", "e.txt", "f.txt"]
    for name in names:
        (tmp_path / name).write_text(name)
    (tmp_path / "New").mkdir()
    (tmp_path / "New/taken.txt").write_text("other")
    root = str(tmp_path)
    filing.write_tags(spark, root, spark.createDataFrame([("a.txt", ["tax"]), ("f.txt", ["old"])], "rel_path string, tags array<string>"))
    rows = [("a.txt", "New/a.txt", None), ("a.txt", None, "active"), ("b.txt", "New/b.txt", None), ("b.txt", "Else/b.txt", None), ("b.txt", None, "active"), ("c.txt", "New/x.txt", None), ("d.txt", "New/x.txt", None), ("d.txt", None, "active"), ("e.txt", "New/taken.txt", None), ("e.txt", None, "active"), ("f.txt", None, None)]
    found = spark.createDataFrame([("rule", *r) for r in rows], "rule string, path string, move_to string, add_tag string")
    sha = [(n, hashlib.sha256((tmp_path / n).read_bytes()).hexdigest()) for n in [*names, "New/taken.txt"]]
    docs = spark.createDataFrame(sha, "rel_path string, sha256 string").join(filing.read_tags(spark, root), "rel_path", "left")
    done = repair.fix(docs.cache(), found, root, NOW)
    assert sorted((r.path, r.move_to or r.add_tag, r.state) for r in done["findings"].where("path < 'f'").collect()) == sorted((p, m or t, "fixed" if t or p == "a.txt" else "skipped") for p, m, t in rows[:-1])
    assert (tmp_path / "New/a.txt").read_text() == "a.txt" and not (tmp_path / "a.txt").exists() and all((tmp_path / n).exists() for n in names[1:])
    assert (tmp_path / "New/taken.txt").read_text() == "other"
    assert {r.rel_path: r.tags for r in filing.read_tags(spark, root).collect()} == {"New/a.txt": ["active", "tax"], "b.txt": ["active"], "d.txt": ["active"], "e.txt": ["active"], "f.txt": ["old"]}
    assert done["findings"].where("state = 'skipped' and path = 'b.txt'").first().reason == repair.DISAGREE and done["findings"].where("path = 'f.txt'").first().reason == repair.NOT_FIXABLE
    executor.rollback(records.read_manifest(spark, done["manifest"]), root)
    assert (tmp_path / "a.txt").read_text() == "a.txt"

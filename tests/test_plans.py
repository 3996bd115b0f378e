"""Registered queries against their SQL."""

import os
import random

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import plan
from shelfmark.plans import plans
from shelfmark.plans.registry import ORACLE

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_merged_fields_of_all_kinds_of_text(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in ("orders", "customer"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    got = sorted(map(tuple, plans.infer_merged_fields_all_kinds(spark, SF).collect()))
    assert got == sorted(con.sql(ORACLE["infer_merged_fields_all_kinds"]).fetchall())
    assert len(got) == spark.read.parquet(f"{SF}/orders.parquet").count() and {r[0] % 5 for r in got} == {0, 1, 2, 3, 4}


def test_blocks_of_one_place_stay_in_the_order_of_the_table(spark, tmp_path):
    """The larger file is read first, but stands last."""
    lines = "l_orderkey long, l_linenumber int, l_quantity double, l_discount double, l_returnflag string"
    (tmp_path / "lineitem.parquet").mkdir()
    for name, flag, more in (("a", "R", 0), ("b", "A", 5000)):
        rows = [(1, 3, 5.0, 0.5, flag)] + [(100 + k, 1, k / 7, 0.0, "N") for k in range(more)]
        spark.createDataFrame(rows, lines).coalesce(1).write.parquet(str(tmp_path / name))
        part = next((tmp_path / name).glob("part-*"))
        part.rename(tmp_path / "lineitem.parquet" / f"{name}.parquet")
    spark.createDataFrame([(1,), (2,)], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    assert [tuple(r) for r in plans.ocr_assembly(spark, str(tmp_path)).collect()] == [(1, "R-3\nA-3", 0.5, 0)]


def test_more_moves_onto_one_place_than_a_thousand(spark):
    """Every one gets a place of its own, the lowest that is free, unless a last number is stated."""
    dice = random.Random(5)
    wanted = ["out/a.txt"] * 1300 + [f"out/a_{k}.txt" for k in sorted(dice.sample(range(2, 1500), 200))] + ["out/a_99999999999999999999.txt"]
    moves = spark.createDataFrame([(f"{k:05d}", d, str(k)) for k, d in enumerate(wanted)], "source string, destination string, sha256 string")
    taken = spark.createDataFrame([("out/a_3.txt", "x"), ("out/a_3.txt", "y"), ("out/a_7.txt", "z")], "path string, sha256 string")
    there, free, want = {r.path for r in taken.collect()}, iter(range(2, 9999)), ["out/a.txt"]
    claimed = set(wanted) | there
    while len(want) < 1300:
        if (name := f"out/a_{next(free)}.txt") not in claimed:
            want.append(name)
    got = [tuple(r) for r in plan.planned(moves, taken).orderBy("source").collect()]
    assert [d for _, d, _ in got[:1300]] == want and {a for _, _, a in got} == {"move"} and len({d for _, d, _ in got} - there) == len(got) == len(wanted)
    bound = plan.planned(moves, taken, last=plan.LAST_SUFFIX).orderBy("source").collect()
    assert [r.action for r in bound[:1300]] == ["move" if d == "out/a.txt" or int(d[6:-4]) <= 999 else "fail" for d in want]


def test_numbers_follow_the_order_however_ranges_are_cut(spark):
    """Ranges are put together by their size, which is another one where only their rows are counted."""
    names = [f"{k:06d}" for k in range(20000)]
    rows = spark.createDataFrame([(n,) for n in names], "path string").repartition(8).select("path", F.concat(*[F.sha2(F.concat("path", F.lit(str(k))), 256) for k in range(8)]).alias("more"))
    cut = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {k: spark.conf.get(k) for k in cut}
    try:
        for k, v in cut.items():
            spark.conf.set(k, v)
        got = plan.numbered(rows).collect()
        assert sorted((r.path, r["index"]) for r in got) == [(n, k + 1) for k, n in enumerate(names)] and plan.numbered(rows.where("false")).count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_named_rules_are_worked_out_alone(spark):
    from shelfmark.operators import lint, search
    from shelfmark.plans import files

    docs, gone = files.documents(spark, SF), search.orphans(files.files(spark, SF), files.sidecars(spark, SF))
    every = [tuple(r) for r in lint.findings(docs, gone, files.CONFIG, files.CATALOG).collect()]
    for rules in (("wrong-folder", "name-normalization"), ("unknown-tag", "orphan-sidecar"), ("multiple-active",)):
        some = lint.findings(docs, gone, files.CONFIG, files.CATALOG, rules)
        assert sorted(map(repr, map(tuple, some.collect()))) == sorted(repr(r) for r in every if r[0] in rules) != []
    assert "multiple-active" not in files.lint_fixes(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    with pytest.raises(ValueError):
        lint.findings(docs, gone, files.CONFIG, files.CATALOG, ("no-such-rule",))


def test_names_of_people_are_normalised_once(spark):
    """Not in each row: the plan has them as constants."""
    from shelfmark.operators import infer

    rows = spark.createDataFrame([("scan.pdf", "for Nora Field"), ("x.pdf", "NÓRA  FIELD"), ("iris-vane.pdf", None)], "name string, text string")
    found = rows.select(infer.owners(plans.CONFIG, F.col("name"), F.col("text")).alias("o"))
    assert " nora field " in found._jdf.queryExecution().optimizedPlan().toString()
    assert [[o.value for o in r.o] for r in found.collect()] == [["Nora Field"], ["Nora Field"], ["Iris Vane"]]


def test_people_are_looked_for_in_whole_texts(spark, tmp_path):
    """Names that stand behind the first 256 KiB, in plain texts and in folded ones, against the SQL."""
    duckdb = pytest.importorskip("duckdb")
    orders = [(4, 1, "note " * 60000), (9, 1, "nöte " * 50000), (14, 1, "3-MEDIUM"), (24, 1, "naïve fields " * 30000)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string").selectExpr("*", "timestamp_ntz'2020-05-05' AS o_orderdate", "1.5D AS o_totalprice").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(1, "Somebody")], "c_custkey long, c_name string").write.parquet(str(tmp_path / "customer.parquet"))
    for unused in ("lineitem", "part"):
        spark.range(1).write.parquet(str(tmp_path / f"{unused}.parquet"))
    con = duckdb.connect()
    for name in ("orders", "customer"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = sorted(map(tuple, plans.plan_proposals_over_clashing_columns(spark, str(tmp_path)).collect()))
    assert got == sorted(con.sql(ORACLE["plan_proposals_over_clashing_columns"]).fetchall())
    assert len(got) == len(orders) and {r[3] for r in got} == {"Omar Field"}

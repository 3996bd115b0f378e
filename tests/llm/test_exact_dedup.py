import hashlib

import pytest

from shelfmark.llm import filters
from shelfmark.llm.exact_dedup import exact_dedup, kept_rows

ROWS = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, None), (5, ""), (6, " \t\r\n\x0b\x0c"), (7, "c"), (8, "a b"), (9, "x" * 100000), (10, "x" * 50000 + " " + "x" * 50000), (2, "ab"), (11, "c ")]


def brute(rows):
    norm = lambda t: "".join(c for c in (t or "") if c not in " \t\n\x0b\x0c\r")
    out = []
    for i, t in rows:
        same = [(j, u) for j, u in rows if norm(u) == norm(t)]
        keep = min(same, key=lambda x: (-len(x[1] or ""), x[0]))[0]
        out.append((i, keep, len(same), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("digest_hex", [64, 1])  # with one digit many texts share a digest: bytes decide
def test_against_brute_force(spark, digest_hex):
    docs = spark.createDataFrame([(i, t, "x") for i, t in ROWS], "doc_id long, text string, digest string").repartition(3)
    got = exact_dedup(docs, digest_hex=digest_hex)
    assert sorted(map(tuple, got.collect())) == brute(ROWS)


def test_empty(spark):
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("most", [1 << 28, 1])  # filters that are broadcast, and joins in their place
def test_hot_digests_levels_and_names(spark, monkeypatch, most):
    monkeypatch.setattr(filters, "MOST", most)
    rows = ROWS + [(100 + k, "hot" + " " * (k % 7)) for k in range(90)] + [(-(2**63), "c"), (300, "hotter")]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, __known string, __bits string").repartition(3)
    assert sorted(map(tuple, exact_dedup(docs, memtables=9, fan=2, hot=8).collect())) == brute(rows)
    kept = kept_rows(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({keep for _, keep, *_ in brute(rows)})


def test_string_identifiers(spark):
    rows = [("b", "x y"), ("a", "xy"), ("c", "x  y"), (None, "q"), ("z", "q"), ("0", "r")]
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {("a", "c", 3, False), ("b", "c", 3, False), ("c", "c", 3, True), (None, "z", 2, False), ("z", "z", 2, True), ("0", "0", 1, True)}

import random

import numpy as np
import pyarrow as pa
import pytest

from shelfmark.llm import shingles
from shelfmark.llm.components import components
from shelfmark.llm.near_dedup import DEPTH, MISS, kept_rows, links_of_node, meets, missed, near_dedup, trees_for
from shelfmark.runtime import Scratch


def plain_set(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in "\t\n\x0b\x0c\r" else c for c in (text or "")).split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute(rows, percent):
    sets = {i: plain_set(t) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if sets[i] and sets[j] and min(len(sets[i]), len(sets[j])) * 100 >= percent * max(len(sets[i]), len(sets[j])):
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    a, b = sorted((root(i), root(j)))
                    parent[b] = a
    return {i: root(i) for i in ids}


def vocabulary(rng):
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(500)]


def changed(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice("xyz") * 4
    return words


def fixture():
    rng = random.Random(5)
    voc, rows = vocabulary(rng), []
    for i in range(60):
        rows.append([rng.choice(voc) for _ in range(rng.randint(1, 150))])
    passage = [rng.choice(voc) for _ in range(80)]
    for i in range(90):  # one passage in many documents
        rows.append(passage + [rng.choice(voc) for _ in range(rng.randint(20, 60))])
    chain = [rng.choice(voc) for _ in range(120)]
    for i in range(150):  # each near to the one before
        chain = changed(rng, chain, 1)
        rows.append(chain)
    star = [rng.choice(voc) for _ in range(150)]
    rows.append(star)
    for i in range(120):  # near to one original, less so to each other
        rows.append(changed(rng, star, 2))
    same = [rng.choice(voc) for _ in range(90)]
    rows += [same] * 100
    texts = [(i * 7 + 3, " ".join(w)) for i, w in enumerate(rows)]
    rng.shuffle(texts)
    return texts + [(5000, None), (5001, ""), (5002, " \t\n"), (5003, "Two Words"), (5004, "two\twords"), (5005, "aa  bb cc dd\nee"), (5006, "AA bb cc dd ee"), (5007, "É " * 30000), (5008, "é " * 30000)]


@pytest.mark.parametrize("percent", [80, 85])
def test_against_brute_force(spark, percent):
    rows = fixture()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, rep string").repartition(5)
    got = near_dedup(docs, percent=percent, leaf=16, depth=3).collect()
    want = brute(rows, percent)
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got} == want
    sizes = {i: len(plain_set(t)) for i, t in rows}
    assert all(r.n_shingles == sizes[r.doc_id] and r.kept == (r.doc_id == r.component_id) for r in got)


def test_edges(spark):
    schema = "doc_id long, text string"
    assert near_dedup(spark.createDataFrame([], schema)).count() == 0
    got = near_dedup(spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (1, "q r")], schema)).collect()
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in got) == [(0, None, True), (1, 1, True), (2, 2, True), (2, 2, True)]


def test_sets_against_plain_shingles():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    for t in texts:
        assert len(shingles.shingle_set(t)) == len(plain_set(t))
    a, b = texts[10], texts[20]
    assert shingles.overlap(shingles.shingle_set(a), shingles.shingle_set(b))[0] == len(plain_set(a) & plain_set(b))
    sets = [shingles.shingle_set(" ".join(str(x) for x in range(k, k + 400))) for k in (0, 40)]
    both, union = shingles.overlap(*sets)
    assert abs((shingles.sketch(sets[0]) == shingles.sketch(sets[1])).mean() - both / union) < 0.15
    assert (np.diff(sets[0].astype(object)) > 0).all()


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 200)] + [(500, 900), (900, 501), (7, 7), (3000, 3001), (3001, 3000)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long"), Scratch(spark)).collect()}
    assert got == {i: 1 for i in range(2, 201)} | {501: 500, 900: 500, 3001: 3000}


def test_recall_with_a_shared_passage(spark):
    """Production parameters: all documents share a passage (unlike ones have 0.75 in common), so nodes are large; each two are linked with 0.852, just more than asked for."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(6))
    passage, rows = [word() for _ in range(176)], []
    for k in range(2000):
        head = [word() for _ in range(12)]
        rows += [(2 * k + m, " ".join(passage + head + [word() for _ in range(16)])) for m in (0, 1)]
    got = {r.doc_id: r.component_id for r in near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), percent=85).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}  # eight trees missed 6 pairs, ten missed 3


def test_trees_for_the_deepest_level():
    for percent in (60, 80, 85, 95):
        s, rng = percent / 100, np.random.default_rng(percent)
        lines = np.ones(20000, np.int64)  # the nodes of one tree in which a pair is together, by level
        for _ in range(DEPTH + 1):
            lines = rng.binomial(lines + rng.binomial(lines, 1 / s - 1), s)
        assert abs((lines > 0).mean() - meets(s, DEPTH + 1)) < 0.02
        assert (1 - meets(s, DEPTH + 1)) ** trees_for(s) <= MISS
    assert trees_for(1.0) == 1 and missed(0.85, 9, 8) > 5 * missed(0.85, 9, trees_for(0.85))


def test_words_that_collide_in_polynomial_hashes(spark):
    """Thue-Morse words collide modulo 2^64 whatever the base; sets of such words must not be linked."""
    one = "0"
    for _ in range(12):
        one += one.translate(str.maketrans("01", "10"))
    other = one.translate(str.maketrans("01", "10"))
    sets = [shingles.shingle_set(f"p q r s {x}") for x in (one, other)]
    assert shingles.overlap(*sets) == (0, 2) and shingles.set_key(sets[0]) != shingles.set_key(sets[1])
    rows = [(1, f"p q r s {one}"), (2, f"p q r s {other}"), (3, f"a {one} b c d {other}"), (4, f"a {other} b c d {one}")]
    got = near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i for i, _ in rows}


def test_columns_of_any_name_and_repeated_identifiers(spark):
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(1, base, "x", "p", "q"), (2, base + " more", "y", "r", "s"), (3, "quite another text of some words here", "z", "t", "u"), (3, base + " end", "v", "m", "n"), (3, "quite another text of some words here", "w", "k", "l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __id string, __text string, __first string")
    got = kept_rows(docs)
    assert got.columns == docs.columns
    kept = sorted(tuple(r) for r in got.collect())
    assert set(kept) <= set(rows) and {r[2] for r in kept} >= {"x"} and "y" not in {r[2] for r in kept} and "v" not in {r[2] for r in kept}
    assert [tuple(r) for r in kept_rows(docs.where("__id in ('x', 'y', 'w')")).orderBy("__id").collect()] == [rows[4], rows[0]]


@pytest.mark.parametrize("most_bytes", [3000])
def test_nodes_in_blocks_of_bytes(spark, most_bytes):
    rng = random.Random(8)
    base = [f"w{rng.randrange(400)}" for _ in range(90)]
    rows = [(k, " ".join(changed(rng, base, rng.choice((0, 1, 2))))) for k in range(40)] + [(100 + k, " ".join(f"v{rng.randrange(99)}" for _ in range(70))) for k in range(10)]
    got = {r.doc_id: r.component_id for r in near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), most_bytes=most_bytes).collect()}
    assert got == brute(rows, 80)


def test_links_are_confirmed_on_words(spark, monkeypatch):
    """Where hashes say too much, words decide."""
    one, other = " ".join(f"a{k}" for k in range(50)), " ".join(f"b{k}" for k in range(50))
    rows = pa.table({"node": [7, 7], "rep": [1, 2], "own": [1, 2], "text": [one, other]})
    monkeypatch.setattr(shingles, "shingle_set", lambda text, words=5: np.arange(46, dtype=np.uint64))
    assert not any(b.num_rows for b in [links_of_node(rows.to_batches(), 80)])
    same = pa.table({"node": [7, 7], "rep": [1, 2], "own": [1, 2], "text": [one, one + " x"]})
    assert links_of_node(same.to_batches(), 80).to_pylist() == [{"a": 1, "b": 2}]
    assert shingles.word_shingles("A b  C d e f") == {(b"a", b"b", b"c", b"d", b"e"), (b"b", b"c", b"d", b"e", b"f")}
    assert shingles.word_shingles("x y") == {(b"x", b"y")} and shingles.word_shingles(None) == set()

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from shelfmark.llm import periodic
from shelfmark.llm.periodic import Extensions, digests, find, periodic_runs, planted, runs_of


def brute(words):
    found = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q) and not any(s <= i and j + q <= s + n for s, n, _ in found):
                found.append((i, j - i + q, q))
            i = j + 1
    return sorted(found)


def words_of(rng):
    kinds = rng.choice([1, 2, 3, 5])
    words = [rng.randrange(kinds) for _ in range(rng.randrange(0, 60))]
    if rng.random() < 0.6 and words:
        root = [rng.randrange(kinds) for _ in range(rng.randrange(1, 8))]
        words[rng.randrange(len(words)) :] = (root * 50)[: rng.randrange(5, 50)]
    return words


@pytest.mark.parametrize("group", [1 << 16, 64, 1])
def test_runs_against_brute_force(monkeypatch, group):
    monkeypatch.setattr(periodic, "GROUP", group)
    rng = random.Random(group)
    for _ in range(400):
        texts = [words_of(rng) for _ in range(rng.randrange(1, 5))]
        ids = np.array([w for t in texts for w in t], np.int64)
        got = find(ids, np.repeat(np.arange(len(texts)), [len(t) for t in texts]))
        want, at = [], 0
        for t in texts:
            want += [(s + at, n, q) for s, n, q in brute(t)]
            at += len(t)
        assert [tuple(x) for x in got.tolist()] == want


def test_trees_without_the_filter():
    """Runs of whole sequences, and common extensions, without step 1."""
    rng = random.Random(7)
    for _ in range(200):
        words = words_of(rng) + [99]
        assert [tuple(x) for x in runs_of(np.array(words)).tolist()] == brute(words)
        ext = Extensions(words)
        for _ in range(10):
            i, j = rng.randrange(len(words)), rng.randrange(len(words))
            if i != j:
                plain = next(k for k in range(len(words)) if words[i + k : i + k + 1] != words[j + k : j + k + 1])
                assert ext(np.array([i]), np.array([j]))[0] == plain
        assert ext.rank.tolist() == [sorted(words[k:] for k in range(len(words))).index(words[i:]) for i in range(len(words))]


def plain_row(doc_id, text):
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + int(Fraction(n - a, 3 + g % 8))
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, best[0] is not None and 1000 * best[1] // best[2] or None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_against_a_plain_version(spark):
    rng = random.Random(11)
    texts = [None, "", " \n ", "a", "a " * 5, "a " * 6, "x\x85y z " * 8, "ab ab\tab\nab\rab\x0bab\x0cab", "A a " * 9] + [" ".join(f"w{x}" for x in words_of(rng)) for _ in range(80)] + [" ".join(f"w{rng.randrange(900)}" for _ in range(n)) for n in (90, 400, 701)]
    rows = [(k, t, 1) for k, t in enumerate(texts)] + [(k + 3000, t, 2) for k, t in enumerate(texts)] + [(None, "b " * 9, 3), (5, texts[5], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int").repartition(3)
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted((tuple(r) for r in digests(periodic_runs(docs, rewrite=planted)).collect()), key=key) == sorted((plain_row(a, b) for a, b, _ in rows), key=key)


def test_long_text_real_output_and_empty_table(spark):
    text = "start " + "one two three " * 30000 + "end"
    docs = spark.createDataFrame([("x", text), ("y", "no runs here")], "name string, body string")
    got = {r.doc_id: r for r in periodic_runs(docs, "name", "body").collect()}
    assert [tuple(r) for r in got["x"].runs] == [(1, 90000, 3)] and got["x"].collapsed == "start one two three end" and got["x"].n_words == 90002
    assert got["y"].runs == [] and got["y"].collapsed == "no runs here"
    assert digests(periodic_runs(docs.limit(0), "name", "body")).count() == 0

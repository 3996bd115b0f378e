import math
import random
import re
import zlib

import pytest

from shelfmark.llm.quality import BLANKS, most_allowed, quality
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    eights = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {i + k for i, e in enumerate(eights) if eights.count(e) > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if x.strip(BLANKS)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def text_of(rng):
    pool = [rng.choice(["a", "bé", "#x", "𝄞c", "&&", "d|e", "Zz", "f"]) for _ in range(rng.choice([2, 30]))]
    kind = rng.random()
    if kind < 0.4:
        return "".join(rng.choice(pool) + rng.choice(["\n", " ", "  ", "\t", "\r\n", " ", " "]) for _ in range(rng.randrange(0, 60)))
    block = " ".join(rng.choice(pool) for _ in range(rng.randrange(1, 20)))
    return "\n".join([block] * rng.randrange(1, 4) + ["", " "] + [block + " x"] * rng.randrange(0, 3))


def test_counts_against_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", " \n\t", "a", "\n\n", "x " * 30, "y " * 20000] + [text_of(rng) for _ in range(150)]
    docs = spark.createDataFrame([(k, t, "l", 1, "n") for k, t in enumerate(texts)], "doc_id long, text string, lang string, n_words int, stratum string").repartition(3)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality(docs, labels).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        r = got[k]
        want = brute(t) if k != 6 else (20000, 20000, 0, 0, 20000)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert r.kept == (not r.base_failed)  # without labels no cutoff is shown to be safe


@pytest.mark.parametrize("n, rate, error", [(0, 0.05, 0.05), (10, 0.01, 0.05), (500, 0.01, 0.01), (900, 0.05, 0.001), (20000, 0.05, 0.002)])
def test_binomial_bound(spark, n, rate, error):
    below = lambda k: sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(rate) + (n - i) * math.log(1 - rate)) for i in range(k + 1))
    k = spark.range(1).select(most_allowed(F.lit(n).cast("long"), F.lit(rate), error)).first()[0]
    assert k == -1 or below(k) <= error
    assert n == 0 or below(k + 1) > error


def prose(rng, n=40):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def marked(text, n):
    """The text with n of its letters turned to symbols, every third one."""
    chars = list(text.replace(" ", ""))
    chars[: 3 * n : 3] = "#" * n
    return " ".join("".join(chars[i : i + 5]) for i in range(0, len(chars), 5))


def plain_cutoff(rows, alpha, delta, cost):
    """The verdict's symbols cutoff of one stratum with one useful rule, by trying all cutoffs one by one."""
    fit = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 0]
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3]
    goods, bads = sum(r[2] for r in fit), sum(not r[2] for r in fit)
    gain = lambda c: sum(not g and v > c for _, v, g in fit) * goods - cost * sum(g and v > c for _, v, g in fit) * bads
    best = max(range(1001), key=lambda c: (gain(c), c))
    n, last = sum(g for _, _, g in held), None
    for c in range(1000, best - 1, -1):
        k = sum(g and v > c for _, v, g in held)
        if sum(math.comb(n, i) * alpha**i * (1 - alpha) ** (n - i) for i in range(k + 1)) > delta:
            break
        last = c
    return last


@pytest.mark.parametrize("noise", [0, 4, 40])
def test_cutoffs_against_a_plain_search(spark, noise):
    rng = random.Random(noise)
    rows, docs, labels = [], [], []
    for k in range(900):
        good = k % 3 > 0
        n = rng.randrange(30, 60) if not good or rng.randrange(1000) < noise else rng.randrange(0, 25)
        docs.append((k, marked(prose(rng), n), "xx" if k % 2 else None))
        labels.append((k, int(good), 0))
        rows.append((k, 5 * n, good))
    labels += [(0, 0, 0), (5000, 1, 0), (None, 1, 0), (7, None, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in quality(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), alpha=0.05, delta=0.1).collect()}
    assert {x for r in found.values() for x in r.rejected_by} <= {"symbols"}
    for odd in (0, 1):
        part = [r for r in rows if r[0] % 2 == odd]
        cut = plain_cutoff(part, 0.05, 0.1 / 2, 20)  # one rule in each of two strata
        want = {k for k, v, _ in part if cut is not None and v > cut}
        near = {k for k, v, _ in part if cut is not None and abs(v - cut) <= 4}
        assert {k for k, r in found.items() if k % 2 == odd and not r.kept} - near == want - near
        lost = [k for k, _, g in part if g and not found[k].kept]
        assert len(lost) <= 0.05 * sum(g for _, _, g in part)
        if not noise:
            assert not lost and len(want) >= 0.9 * sum(not g for _, _, g in part)


def test_few_labels_reject_nothing_and_empty_tables(spark):
    rng = random.Random(1)
    docs = spark.createDataFrame([(k, prose(rng) + (" ####################" if k % 2 else ""), "de") for k in range(30)] + [(None, prose(rng), None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1 - k % 2, 0) for k in range(30)], "doc_id long, quality int, toxic int")
    assert all(r.kept for r in quality(docs, labels).collect())
    assert quality(docs.limit(0), labels).count() == 0
    assert quality(docs, labels.limit(0), stratum_col=None).where("kept").count() == 31

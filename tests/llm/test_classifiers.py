import random
import zlib
from collections import Counter

import numpy as np

from shelfmark.llm import langid, toxicity


def is_held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def words(rng, n, letters="abcdefgh"):
    return [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n))][0]


def test_toxicity_on_held_out_rows(spark):
    rng, docs, labels = random.Random(1), [], []
    for i in range(600):
        bad = i % 3 == 0
        text = words(rng, rng.randint(5, 80)) + (" you zquidiot and zquscum " if bad else " ") + words(rng, 20)
        docs.append((i, text, 9.0))
        labels.append((i, int(bad)))
    docs += [(9001, None, 0.0), (9002, "", 0.0), (None, "zquidiot zquscum", 0.0), (9003, "ok " * 50000, 0.0)]
    labels += [(1, None), (2, 7), (None, 1), (5, 1), (5, 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, score double")
    got = {r.doc_id: r for r in toxicity.toxicity(d, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert len(got) == len(docs)
    test = [i for i in range(600) if is_held(i)]
    assert all(got[i].held_out for i in test) and not any(got[i].held_out for i in range(600) if not is_held(i))
    assert np.mean([got[i].predicted == int(i % 3 == 0) for i in test]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    assert toxicity.toxicity(d.limit(0), spark.createDataFrame([], "doc_id long, toxic int")).count() == 0
    assert {r.predicted for r in toxicity.toxicity(d, spark.createDataFrame([], "doc_id long, toxic int")).collect()} == {0}


def test_distinct_equals_a_set():
    text = "the cat sat on the mat " * 40
    parts = toxicity.ngrams(text)
    assert sorted(toxicity.Distinct()(parts)) == sorted(set(np.concatenate(parts).tolist()))
    squeezed = f" {' '.join(text.split())} "
    assert len(np.concatenate(parts)) == sum(len(squeezed) - n + 1 for n in toxicity.SIZES)


def test_blocks_make_no_difference(monkeypatch):
    text = "Überall liegen kleine Wörter herum " * 30
    a, b = np.sort(np.concatenate(toxicity.ngrams(text))), langid.counts(text)
    monkeypatch.setattr(toxicity, "BLOCK", 97)
    monkeypatch.setattr(langid, "BLOCK", 97)
    assert sorted(set(np.concatenate(toxicity.ngrams(text)).tolist())) == sorted(set(a.tolist()))
    assert all((x == y).all() for x, y in zip(langid.counts(text), b))


def test_profile_against_plain_counting():
    text = "abra cadabra ab"
    grams, n = langid.counts(text)
    plain = Counter(f" {text} "[i : i + k] for k in range(1, 5) for i in range(len(text) + 3 - k))
    assert sorted(n.tolist()) == sorted(plain.values()) and len(set(grams)) == len(grams)
    top = langid.ranked(grams, n, 5)
    assert [n[list(grams).index(g)] for g in top] == sorted(plain.values(), reverse=True)[:5]


def plain_hash(gram):
    h = 0
    for c in gram:
        h = (h * 0x100000001B3 + ord(c)) % 2**64
    return ((h ^ len(gram)) * 0x9E3779B97F4A7C15) % 2**64 >> 1


def plain_ranks(texts, top):
    n = Counter()
    for text in texts:
        line = f" {' '.join(''.join(c if c.isalpha() else ' ' for c in text.lower()).split())} "
        n.update(line[i : i + k] for k in range(1, 5) for i in range(len(line) + 1 - k))
    return sorted(n, key=lambda g: (-n[g], plain_hash(g)))[:top]


def test_out_of_place_distance_against_brute_force(spark):
    rng = random.Random(8)
    alphabets = {"aa": "abcdefaaee", "bb": "abmnoabrii", "cc": "éèabuabstu"}
    docs = [(i, words(rng, rng.randint(1, 80), alphabets[lang]), lang) for i in range(120) for lang in ["abc"[i % 3] * 2]]
    learned = {lang: plain_ranks([t for i, t, x in docs if x == lang and not is_held(i)], langid.PROFILE) for lang in alphabets}
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}
    for i, text, _ in docs:
        own = plain_ranks([text], langid.TOP)
        far = sorted((sum(abs(p.index(g) - k) if g in p else langid.PROFILE for k, g in enumerate(own)), lang) for lang, p in learned.items())
        assert got[i].lang_pred == far[0][1] and abs(got[i].score - (0.5 + 0.5 * (far[1][0] - far[0][0]) / far[1][0])) < 1e-12


def test_langid_on_held_out_rows(spark):
    rng, docs = random.Random(2), []
    alphabets = {"aa": "abcdefaaee", "bb": "mnopqrooii", "cc": "éèçàùstuvw"}
    for i in range(300):
        lang = "abc"[i % 3] * 2
        docs.append((i, words(rng, rng.randint(3, 60), alphabets[lang]), lang))
    docs += [(7001, None, "aa"), (7002, "", "aa"), (7003, "123 !!", "bb"), (7004, "abc def", None), (None, "abc def aea", "aa"), (7005, "mono " * 40000, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(d).collect()}
    assert len(got) == len(docs)
    assert all(got[i].lang_pred == "abc"[i % 3] * 2 for i in range(300) if is_held(i))
    assert [got[i].lang_pred for i in (7001, 7002, 7003, 7004, 7005, None)] == ["und", "und", "und", "aa", "bb", "aa"]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.identify(d.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(d.withColumn("lang", d.lang.substr(9, 1)).where("false").union(d.selectExpr("doc_id", "text", "cast(null as string)"))).collect()} == {"und"}


def test_fit_against_a_plain_version():
    """The same steps over dense arrays, n-gram by n-gram."""
    rng = np.random.default_rng(4)
    features = [np.unique(rng.integers(0, 64, rng.integers(1, 30))).astype(np.int32) for _ in range(80)]
    labels = np.array([float(5 in f or rng.random() < 0.2) for f in features])
    weights, bias = toxicity.fit(features, labels, bits=6)
    x = np.zeros((80, 64))
    for i, f in enumerate(features):
        x[i, f] = 1
    r = np.zeros(64)
    for j in range(64):
        rows, ones = x[:, j].sum(), x[labels == 1, j].sum()
        ratio = np.log((ones + 1) / (labels.sum() + 2)) - np.log((rows - ones + 1) / (80 - labels.sum() + 2))
        r[j] = ratio if rows >= toxicity.LEAST_ROWS and abs(ratio) >= toxicity.LEAST_RATIO else 0
    theta, b, m, s, mb, sb = np.zeros(64), 0.0, np.zeros(64), np.zeros(64), 0.0, 0.0
    each = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (80 - labels.sum()))
    for t in range(1, 41):
        miss = (1 / (1 + np.exp(-(x * r @ theta + b))) - labels) * each
        g, gb = 30 / 80 * theta + (x * r).T @ miss, miss.sum()
        m, s, mb, sb = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g**2, 0.9 * mb + 0.1 * gb, 0.99 * sb + 0.01 * gb**2
        theta = theta - toxicity.RATE * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + toxicity.EPS)
        b -= 10 * toxicity.RATE * (mb / (1 - 0.9**t)) / (np.sqrt(sb / (1 - 0.99**t)) + toxicity.EPS)
    assert np.allclose(weights, theta * r, atol=1e-4) and abs(bias - b) < 1e-6


def test_the_best_point_scores_the_threshold():
    z, y = np.array([3.0, 2.0, 1.0, -1.0, -2.0]), np.array([1, 1, 1, 0, 0])
    a, c = toxicity.calibrated(z, y, (20.0, 3.0))
    score = 1 / (1 + np.exp(-(a * z + c)))
    assert a > 0 and (score >= toxicity.THRESHOLD).tolist() == [True, True, True, False, False]
    assert toxicity.calibrated(z, np.ones(5), (0.0, 5.0)) == (1.0, 0.0)

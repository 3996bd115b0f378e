import numpy as np
from pyspark.sql import functions as F

from shelfmark.llm import ann


def brute(vectors, query, k=10):
    q = vectors[query]
    return sorted((float(np.sqrt(((v - q) ** 2).sum())), i) for i, v in vectors.items() if i != query)[:k]


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(3)
    vectors = {i: rng.normal(size=32) for i in range(3000)}
    centre = rng.normal(size=32)
    vectors |= {i: centre + 0.01 * rng.normal(size=32) for i in range(3000, 4000)}  # a dense group
    vectors |= {i: vectors[0].copy() for i in range(4000, 4020)}  # ties
    rows = [(i, [float(x) for x in v], "q") for i, v in vectors.items()]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, codes string").repartition(4)
    got = ann.search(d, F.col("vec_id") % 100 == 0, shortlist=300, block=16).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(by) == {i for i in vectors if i % 100 == 0}
    hits = 0
    for q, found in by.items():
        found.sort()
        want = brute(vectors, q)
        assert [r for r, _, _ in found] == list(range(1, 11))
        assert all(abs(s - np.sqrt(((vectors[i] - vectors[q]) ** 2).sum())) < 1e-12 for _, i, s in found)
        assert [(s, i) for _, i, s in found] == sorted((s, i) for _, i, s in found)
        hits += len({i for _, i, _ in found} & {i for _, i in want})
    assert hits / (10 * len(by)) >= 0.95
    assert [i for _, i, _ in by[0]] == list(range(4000, 4010))


def test_edges(spark):
    schema = "vec_id long, embedding array<float>"
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 2.0, 3.0]), (8, []), (None, [1.0, 1.0]), (100, [1.0, 1.0])]
    got = ann.search(spark.createDataFrame(rows, schema), F.col("vec_id") % 100 == 0).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in got) == [(0, 1, 100, 1.0), (0, 2, 1, 1.414214), (100, 1, 0, 1.0), (100, 2, 1, 1.0)]
    assert ann.search(spark.createDataFrame([], schema), F.col("vec_id") % 100 == 0).count() == 0


def test_tables_give_the_distance_to_the_approximation():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 16))
    q = ann.Quantiser(x)
    own, codes, gain, norm = q.encode(x)
    near = q.centres[own] + gain[:, None] * sum(q.books[m][codes[:, m]] for m in range(ann.BOOKS))
    far = ann.distances(q.tables(x[:5]), own, codes, gain, norm) + (x[:5] ** 2).sum(1)[:, None]
    assert np.allclose(far, ((x[:5, None, :] - near) ** 2).sum(2), atol=1e-3)
    assert ((x - near) ** 2).sum(1).mean() < 0.2 * (x**2).sum(1).mean()

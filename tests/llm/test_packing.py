import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfmark.llm import bpe, packing


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 1023), max_size=60))
def test_windows_hold_every_piece_once(sizes):
    found = packing.windows(sizes)
    assert sorted(i for w in found for i in w) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in w) <= 1024 for w in found)


def test_differencing_balances_and_window_count_rises():
    sums = sorted(sum(w) for w in ([[8, 7, 6, 5, 4][i] for i in x] for x in packing.differencing([8, 7, 6, 5, 4], 2)))
    assert sums == [14, 16]  # the known result of two-way differencing
    assert len(packing.windows([600, 600, 600])) == 3


def test_pack(spark):
    words = "the quick brown fox "
    rows = [(i, words * (i * 37 % 700)) for i in range(60)] + [(7, "again"), (7, "again"), (100, None), (101, "")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, start int")
    got = packing.pack(docs).toPandas()
    coder = bpe.loaded(bpe.default_vocabulary())
    want = defaultdict(list)
    for i, t in rows:
        want[i].append([*coder.encode_batch([t or ""])[0], 0])
    for i, g in got.groupby("doc_id"):
        left = list(want[i])
        assert g.length.sum() == sum(map(len, left))
        for r in g.itertuples():
            ids = next(x for x in left if len(x) == r.doc_tokens)
            assert zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1].tolist()] and g.length.sum() <= 1024
    assert packing.pack(docs.limit(0)).count() == 0

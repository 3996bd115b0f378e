import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shelfmark.llm import bpe

PATH = bpe.default_vocabulary()
LIB = Tokenizer.from_file(PATH)


def expected(text):
    return LIB.encode(text, add_special_tokens=False).ids


runs = st.one_of(
    st.text(max_size=30),
    st.builds(lambda c, n: c * n, st.sampled_from(["a", "ab", " ", "\n", " \n", "é", "1", "!", "'", "'s", "日", "🙂", "the ", "x'll "]), st.integers(1, 300)),
    st.sampled_from(["<|endoftext|>", "don't", "  x", " ", "　a", "we're ", "aGVsbG8gd29ybGQ="]),
)


@settings(max_examples=250, deadline=None)
@given(st.lists(runs, max_size=6).map("".join), st.sampled_from([5, 17, 64, 200]))
def test_tree_equals_library(text, leaf):
    coder = bpe.loaded(PATH, leaf)
    ids = coder.encode_batch([text])[0]
    assert ids == expected(text)
    assert coder.decode(ids) == LIB.decode(ids, skip_special_tokens=False) == text


@pytest.mark.parametrize("text", ["a" * 70000, " " * 9000 + "x", "ab" * 30000, "é" * 20000, "0123456789" * 3000, "!?" * 9000, "ththeraner" * 4000, "\n" * 9001, "'" * 9000 + "s", "日本" * 9000])
def test_long_unsplit_text(text):
    coder = bpe.loaded(PATH, 1000)
    joined = []
    plain = coder._in_run
    coder._in_run = lambda *a: joined.append(plain(*a)) or joined[-1]
    try:
        assert coder.encode_batch([text])[0] == expected(text)
    finally:
        del coder._in_run
    assert any(x is not None for x in joined)


def test_frames(spark):
    rows = [(1, "Hello  world"), (2, None), (3, ""), (3, ""), (4, "x" * 30000)]
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in bpe.digests(docs).collect()}
    for i, t in rows:
        ids = expected(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs)).collect()}
    assert back == {1: "Hello  world", 2: "", 3: "", 4: "x" * 30000}
    assert bpe.digests(docs.limit(0)).count() == 0


@pytest.mark.parametrize("sign", ["\U00011db0", "\U00011de0", "࢏", "\U000323b0"])
def test_characters_of_newer_unicode(sign):
    """Letters and digits that `regex` knows and the encoder does not."""
    for text in (f"0{sign}'s00", f"ab{sign}cd{sign}12", f"!!{sign}'re {sign}'ll", f"  {sign}\n{sign}" * 3, sign * 700, f"a{sign}" * 200 + "'s"):
        for leaf in (1, 2, 3, 5, 17):
            assert bpe.loaded(PATH, leaf).encode_batch([text])[0] == expected(text)

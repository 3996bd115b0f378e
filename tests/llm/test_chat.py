import hashlib

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfmark.llm import chat


def render(source, **scope):
    return list(chat.compiled(source)(scope, False))


def joined(source, **scope):
    return "".join(x for x, _ in render(source, **scope))


def test_language():
    assert joined("a{{ 1 + 2 }}{# note #}{{ 'x' ~ 2 | upper }}") == "a3x2"
    assert joined("{% for m in ms %}{{ loop.index }}{{ m.a }}{% if not loop.last %},{% endif %}{% endfor %}", ms=[{"a": "p"}, {"a": "q"}]) == "1p,2q"
    assert joined("{% set s = 'in' %}{% if s in 'thing' and (1 < 2 or x.y.z) %}yes{% elif true %}no{% else %}never{% endif %}") == "yes"
    assert joined("{{ nothing }}{{ none }}{{ x.missing }}{{ '\\n\\'' }}", x={}) == "\n'"
    assert render("p{% generation %}{{ t }}{% endgeneration %}q", t="v") == [("p", False), ("v", True), ("q", False)]


def test_constants_are_folded():
    tree = chat.fold(chat.parse("a{{ 'b' | upper }}{% if 1 == 2 %}c{% else %}d{% endif %}{{ x }}{% if false %}e{% endif %}f"))
    assert tree == [("text", "aBd"), ("out", ("name", "x")), ("text", "f")]


@pytest.mark.parametrize("bad", ["{{ x.__class__ }}", "{{ x() }}", "{% for %}", "{% if x %}", "{% endfor %}", "{{ x | system }}", "{{ 'a }}", "{{ }}", "{% import os %}", "{{ (1 }}", "{{ 1 2 }}"])
def test_sandbox_and_faults(bad):
    with pytest.raises(chat.TemplateError):
        chat.compiled(bad)


hard = st.lists(st.one_of(st.sampled_from(["###", "####", "</turn>", "\\", "\n", "### assistant\n", "<", "#", "</turn>\n### user\n", "é", "<</turn>"]), st.text(max_size=5)), max_size=6).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant"]), hard), hard), max_size=5), st.integers(1, 60))
def test_round_trip(turns, limit):
    found = list(chat.segments(chat.compiled(chat.TEMPLATE)({"messages": [{"role": r, "text": t} for r, t in turns]}, False), limit))
    read = chat.Reader()
    assert [x for text, _ in found for x in read(text)] == turns and read.rest == ""
    assert "".join(chat.unescape(text[a:b]) for text, spans in found for a, b in spans) == "".join(t for r, t in turns if r == "assistant")


def test_frame(spark):
    text = r"\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", text, "z"), (-7, 1, "assistant", text, "z"), (1, 2, "assistant", None, "z"), (1, 1, None, "q", "z"), (None, 0, "user", "n", "z"), (2, 0, "assistant", "a" * 3_000_000, "z"), (2, 1, "assistant", "b", "z"), (2, 1, "assistant", "b", "z")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(turns)).collect()}
    assert set(got) == {-7, 1, None, 2}
    for conv, r in got.items():
        own = sorted(((t, role or "", x or "") for c, t, role, x, _ in rows if c == conv))
        loss = "".join(x for _, role, x in own if role == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(own), len(loss))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{x}\n" for _, role, x in own).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.digests(chat.format_conversations(turns.limit(0))).count() == 0


def test_batches_are_let_go_by_their_bytes():
    big = [pa.record_batch([pa.array(["x" * (1 << 20)])], names=["t"]) for _ in range(60)]
    given = iter(big)
    out = chat.merged(lambda batches: given)(None)
    next(out)
    assert sum(1 for _ in given) >= 60 - 17

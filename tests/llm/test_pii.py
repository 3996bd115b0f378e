import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfmark.llm import pii


def brute(text):
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 12 <= len(d) <= 19 and (sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])) % 10 == 0:
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda x: (x[0], pii.BASE.index(x[2])))


bits = st.one_of(st.sampled_from(["a.b@c.de", "@", ".", "-", "+", " ", "x@y.z@w.v", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (017) 555-7713", "+49.30.1234567", "(555) 123-4567", "é", "(at)", "0", "00.0.0.0"]), st.text("0123456789.+- @ab()", max_size=12))


@settings(max_examples=500, deadline=None)
@given(st.lists(bits, max_size=10).map("".join))
def test_base_spans(text):
    base, _, _ = pii.candidates(text)
    assert base == brute(text)


def test_long_runs_are_linear():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a" * 200_000 + "@" * 1000, "+1" + " " * 300_000, "1 " * 150_000):
        pii.candidates(text)


def test_em_finds_the_poor_labeler():
    rng = np.random.default_rng(0)
    truth = rng.random(20000) < 0.5
    said = np.stack([np.where(rng.random(20000) < q, truth, ~truth) for q in (0.95, 0.9, 0.9, 0.85, 0.5)], axis=1).astype(int)
    p, table = pii.reliabilities(np.zeros(20000, int), said, np.ones(20000))
    assert ((p > 0.5) == truth).mean() > 0.96
    assert abs(table[0, 0, 1, 1] - 0.95) < 0.02 and abs(table[0, 4, 1, 1] - 0.5) < 0.03


def test_the_model_alone_knows_planted_spans_from_decoys():
    """Trained without truth on one half of the texts; on the other half it accepts base spans and secrets, and rejects decoys."""
    rng = np.random.default_rng(6)
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    hexes = lambda n: "".join(rng.choice(list("0123456789abcdef"), n))
    words = ["tor", "elm", "the", "sand", "of", "ever", "lume", "hath", "on", "quite"]
    filler = lambda: " ".join(rng.choice(words, 6))
    true = [lambda: f"{filler()} mail {rng.choice(words)}.{rng.choice(words)}@{rng.choice(words)}.com {filler()}", lambda: f"{filler()} call +1 ({digits(3)}) 555-{digits(4)} {filler()}", lambda: f"{filler()} host 10.{rng.integers(1, 250)}.{rng.integers(1, 250)}.7 {filler()}",
            lambda: f'{filler()} api token = "{hexes(40)}" {filler()}', lambda: f"{filler()} {rng.choice(words)}@{rng.choice(words)}.org {filler()}"]
    decoy = [lambda: f"{filler()} commit{hexes(33)} is commit {hexes(37)}, {filler()}", lambda: f"{filler()} order {digits(3)}-{digits(3)}-{digits(4)}, {filler()}"]
    texts = [(k, make()) for _ in range(150) for k, makes in ((1, true), (0, decoy)) for make in makes]

    def spans(part):
        out = []
        for k, t in part:
            _, loose, base = pii.candidates(t)
            out += [(k, c, f) for c, f in base] + [(k, c, f) for _, _, _, c, f in loose]
        return out

    learn, test = spans(texts[::2]), spans(texts[1::2])
    codes, n = np.unique([c for _, c, _ in learn], return_counts=True)
    target = pii.probabilities(codes, n)
    w = pii.trained([f for _, _, f in learn], np.array([target[c] for _, c, _ in learn]))
    accepted = lambda k: np.mean([pii.likelihood(w, f) >= 0.5 for t, _, f in test if t == k])
    assert accepted(1) >= 0.95 and accepted(0) <= 0.05


def test_frames(spark):
    words = "the order of the day is long and no one knows "
    rows = [(i, words + "mail me: jo.x@mail4.example.com or +1 (017) 555-7713, api token = \"f3ef4d6b2755a36d7d9c25bd72c4d5f67e061234\" ok", "k") for i in range(30)]
    rows += [(100, "write to jo [at] example [dot] com now", "k"), (101, None, "k"), (102, "", "k"), (103, words * 5000, "k"), (103, words * 5000, "k"), (None, "9.8.7.6", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base string")
    got = pii.private_spans(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t, _ in rows:
        base = brute(t or "")
        assert by[i].base_sha256 == hashlib.sha256(pii.said(base).encode()).hexdigest()
        assert (by[i].n_email, by[i].n_ip, by[i].n_card, by[i].n_phone) == tuple(sum(k == x for _, _, k in base) for x in pii.BASE)
        assert set(pii.said(base).split(",")) - {""} <= set(by[i].spans.split(","))
    assert "secret:" in by[0].spans and "email_loose:" in by[100].spans
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[0].endswith('mail me: [EMAIL] or [PHONE], api token = "[SECRET]" ok')
    assert clean[101] is None and clean[102] == "" and clean[103] == words * 5000 and clean[None] == "[IP]"
    assert pii.private_spans(docs.limit(0)).count() == 0 and pii.redact(docs.limit(0)).count() == 0

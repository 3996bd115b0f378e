"""Personal data by weak supervision.

Candidates are the spans of the base patterns (email, ip, card, phone) and of looser forms of each kind
(addresses written with "at" and "dot", IPv6 addresses, cards inside longer runs of digits, phone numbers without a
country code, long hexadecimal secrets). Labelers vote on each candidate: for, against, or not at all. They look at
its form (regular expressions), at lists (gazetteers of top-level domains, issuer prefixes, reserved
networks), at checks, at its edges and at the words before it (context). All candidates of all documents are counted
by kind and votes; expectation-maximisation on these counts estimates, for each family of kinds on its own, how often each labeler is right. A vote for is never
taken as evidence against, and a small share of pseudo-counts holds labelers to be better than chance. On the resulting probabilities a logistic span classifier is
trained, whose features are not the votes but the span and what stands around it: its shape, length and edges, the words before and after it, and n-grams before it (hashed). It
is fitted on about `sample` candidates of each kind. It decides on the looser spans; base spans
always stay. A looser span that overlaps a base span is dropped.

Offsets are code points, ends exclusive. Null texts count as empty. Rows that repeat are found each on
its own. What reaches the driver are counts of the at most 9 * 3^5 kinds of votes, and the sample's features. An empty table gives an empty
result, and no candidates leave a model that accepts nothing. Identifiers are cast to long. Of the caller's columns only those named are read; `redact` returns them all.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..runtime import Scratch, ship
from .bpe import texts_of

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "email_loose", "ip_loose", "card_loose", "phone_loose", "secret")
LABELERS = 5
FAMILY = {k: k.removesuffix("_loose") for k in KINDS}
FAMILIES = (*BASE, "secret")
FAMILY_OF = np.array([FAMILIES.index(FAMILY[k]) for k in KINDS])
BITS, SAMPLE = 14, 4000  # of the span classifier: hashed features, and candidates a kind that it is fitted on
HELD = 0.04  # pseudo-counts for labelers that are right, as a share of a family's candidates

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
EMAIL_LOOSE = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[(] ?dot ?[\])]) ?[A-Za-z0-9-]{1,63}){1,6}", re.I)
IP_LOOSE = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
PHONE_LOOSE = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9-])")
SECRET = re.compile(r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,64}(?![0-9A-Za-z])")
DIGITS = re.compile(r"[0-9]+")

#: Gazetteers.
DOMAINS = frozenset("com net org edu gov mil int info biz name io dev app ai co me tv eu uk us ca au nz ie de at ch fr be nl lu es pt it gr se no dk fi is pl cz sk hu ro bg hr si rs ru ua tr il in cn jp kr tw hk sg th vn id my ph br mx ar cl pe za ng ke eg ma".split())
ISSUERS = ("4", "51", "52", "53", "54", "55", "2221", "23", "24", "25", "26", "27", "34", "37", "6011", "65", "35", "36", "38", "30", "62", "50")
RESERVED = frozenset(["0", "127", "255"])
#: Words that, shortly before a span, speak for or against its kind.
FOR = {
    "email": "mail email e-mail contact write courriel correo kontakt",
    "ip": "ip address host server login adresse dirección",
    "card": "card visa mastercard credit debit iban karte carte tarjeta payment",
    "phone": "phone tel telephone call mobile fax cell telefon téléphone teléfono",
    "secret": "token secret key password passwd pwd api apikey auth bearer",
}
AGAINST = "version release order isbn issn commit sha md5 checksum build page chapter section serial part"
CUES = {k: re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, v.split()))})(?!\w)", re.I) for k, v in {**FOR, "": AGAINST}.items()}


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(d - 9 if (d := 2 * int(x)) > 9 else d for x in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the email pattern, in linear time: each belongs to one @ and the run before it."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int]]]:
    """Spans of the base kinds by start and kind, and the runs of digits that are no card."""
    out = [(a, b, "email") for a, b in emails(text)] if "@" in text else []
    failed = []
    if DIGITS.search(text):
        for m in IP.finditer(text):
            if all(len(p := x.lstrip("0")) < 3 or len(p) == 3 and p <= "255" for x in m[0].split(".")):
                out.append((m.start(), m.end(), "ip"))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
            elif len(digits) > 12:
                failed.append(m.span())
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2]))), failed


def loose_spans(text: str, failed: list[tuple[int, int]], base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans of the looser forms that overlap no base span and none of each other."""
    low = text.lower() if "[" in text or "(" in text else ""
    found = []
    if "at)" in low or "at]" in low or "at )" in low or "at ]" in low:
        found += [(*m.span(), "email_loose") for m in EMAIL_LOOSE.finditer(text)]
    if ":" in text:
        found += [(*m.span(), "ip_loose") for m in IP_LOOSE.finditer(text)]
    for a, b in failed:
        found += [(*m.span(), "card_loose") for m in DIGITS.finditer(text, a, b) if 13 <= m.end() - m.start() <= 19 and luhn(m[0])]
    if DIGITS.search(text):
        found += [(*m.span(), "phone_loose") for m in PHONE_LOOSE.finditer(text)]
        found += [(*m.span(), "secret") for m in SECRET.finditer(text) if not m[0].isdigit()]
    out, taken = [], sorted((a, b) for a, b, _ in base)
    at = last = 0
    for a, b, kind in sorted(found, key=lambda x: (x[0], KINDS.index(x[2]))):
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        i = at
        while i < len(taken) and taken[i][0] < b and taken[i][1] <= a:
            i += 1
        if a >= last and (i == len(taken) or taken[i][0] >= b):
            out.append((a, b, kind))
            last = b
    return out


def votes(text: str, a: int, b: int, kind: str) -> tuple[int, ...]:
    """Each labeler's vote on a span: 1 for, 0 against, 2 none."""
    span, family = text[a:b], FAMILY[kind]
    before, after = text[a - 1 : a], text[b : b + 1]
    if family == "email":
        last = re.split(r"[^A-Za-z0-9-]+", span.rstrip("])"))[-1].lower()
        listed, checked = int(last in DOMAINS), int(".." not in span and not span.startswith((".", "-")))
    elif family == "ip":
        parts = span.split(".")
        listed = 2 if ":" in span else int(parts[0] not in RESERVED and int(parts[0][-3:]) < 224)
        checked = int(":" in span or not any(len(p) > 1 and p[0] == "0" for p in parts))
    elif family == "card":
        digits = re.sub(r"[^0-9]", "", span)
        listed, checked = int(digits.startswith(ISSUERS)), int(luhn(digits) and len(set(digits)) > 2)
    elif family == "phone":
        digits = re.sub(r"[^0-9]", "", span)
        listed, checked = (int(digits[0] != "0") if kind == "phone" else 2), int(len(digits) >= 10 and len(set(digits)) > 2)
    else:
        letters = sum(c.isalpha() for c in span)
        listed, checked = 2, int(len(span) in (32, 40, 64) and 0.1 < letters / len(span) < 0.9)
    near = text[max(0, a - 32) : a]
    context = 1 if CUES[family].search(near) else 0 if CUES[""].search(near) else 2
    edges = int(not (before.isalnum() or after.isalnum()))
    case = 2 if family not in ("email", "secret") else int(span == span.lower() or span == span.upper())
    return listed, checked, context, edges, case


CLASSES = str.maketrans({**{c: "a" for c in "abcdefghijklmnopqrstuvwxyz"}, **{c: "A" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{c: "9" for c in "0123456789"}})


def features(text: str, a: int, b: int, kind: str) -> list[int]:
    """Hashed features of a span: its shape, length and edges, words and n-grams around it."""
    family, before, after = FAMILY[kind], text[max(0, a - 32) : a].lower(), text[b : b + 16].lower()
    shape = re.sub(r"(.)\1+", r"\1+", text[a:b].translate(CLASSES))
    said = [kind, f"shape {kind} {shape[:24]}", f"signs {family} {''.join(sorted(set(shape)))}", f"length {kind} {(b - a) // 4}"]
    said += [f"edges {before[-1:].translate(CLASSES)} {after[:1].translate(CLASSES)}"]
    said += [f"before {family} {w}" for w in re.findall(r"\w+", before)[-3:]] + [f"after {family} {w}" for w in re.findall(r"\w+", after)[:1]]
    said += [f"near {family} {before[i : i + 3]}" for i in range(max(0, len(before) - 12), max(0, len(before) - 2))]
    return [zlib.crc32(x.encode()) & ((1 << BITS) - 1) for x in said]


def code(kind: str, said: tuple[int, ...]) -> int:
    n = KINDS.index(kind)
    for v in said:
        n = 3 * n + v
    return n


def decoded(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kinds and votes behind codes."""
    said, rest = [], codes.copy()
    for _ in range(LABELERS):
        said.append(rest % 3)
        rest //= 3
    return rest, np.stack(said[::-1], axis=1) if len(codes) else np.zeros((0, LABELERS), int)


def reliabilities(kinds: np.ndarray, said: np.ndarray, n: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over counted votes: the probability that each kind of votes is personal data, and of each family and labeler the table of votes given the truth."""
    fors, against = (said == 1).sum(1), (said == 0).sum(1)
    p = (fors + 1) / (fors + against + 2)  # from the majority
    family = FAMILY_OF[kinds]
    table = np.full((len(FAMILIES), LABELERS, 2, 3), 1 / 3)
    for f in np.unique(family):
        own = np.flatnonzero(family == f)
        votes_, m, q, kind = said[own], n[own], p[own], kinds[own]
        held = HELD * m.sum() + 1
        for _ in range(rounds):
            for j in range(votes_.shape[1]):
                for v in range(3):
                    of = votes_[:, j] == v
                    table[f, j, 1, v] = (m[of] * q[of]).sum() + held * (0.8, 0.2)[v != 1] * (v != 2) + 1
                    table[f, j, 0, v] = (m[of] * (1 - q[of])).sum() + held * (0.8, 0.2)[v != 0] * (v != 2) + 1
            t = table[f] / table[f].sum(axis=2, keepdims=True)
            for v, wrong in ((1, t[:, 1, 1] < t[:, 0, 1]), (0, t[:, 1, 0] > t[:, 0, 0])):  # a vote never speaks for the contrary
                mean = (t[:, 0, v] + t[:, 1, v]) / 2
                t[:, 0, v], t[:, 1, v] = np.where(wrong, mean, t[:, 0, v]), np.where(wrong, mean, t[:, 1, v])
            table[f] = t
            prior = {k: ((m * q)[kind == k].sum() + 1) / (m[kind == k].sum() + 2) for k in np.unique(kind)}
            z = np.array([np.log(prior[k] / (1 - prior[k])) for k in kind])
            for j in range(votes_.shape[1]):
                z = z + np.log(t[j, 1, votes_[:, j]]) - np.log(t[j, 0, votes_[:, j]])
            q = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        p[own] = q
    return p, table


def probabilities(codes: np.ndarray, n: np.ndarray) -> dict[int, float]:
    """The label model: how likely each kind of votes that was met is personal data."""
    if not len(codes):
        return {}
    kinds, said = decoded(codes)
    return dict(zip(codes.tolist(), reliabilities(kinds, said, n.astype(float))[0].tolist()))


def trained(rows: list[list[int]], target: np.ndarray, steps: int = 80, l2: float = 1e-4) -> np.ndarray:
    """The span classifier: weights of hashed features, the intercept last; Adam over all rows."""
    w = np.zeros((1 << BITS) + 1)
    w[-1] = -1e-9
    if not rows:
        w[-1] = -30.0
        return w
    ids = np.concatenate([np.asarray([*r, 1 << BITS]) for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r) + 1 for r in rows])
    m, s = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        miss = (1 / (1 + np.exp(-np.clip(np.bincount(row, weights=w[ids], minlength=len(rows)), -30, 30))) - target) / len(rows)
        grad = np.bincount(ids, weights=miss[row], minlength=len(w)) + l2 * w / len(rows)
        m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad**2
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
    return w


def likelihood(w: np.ndarray, found: list[int]) -> float:
    """How likely a span of these features is personal data, by the classifier."""
    return float(1 / (1 + np.exp(-np.clip(w[found].sum() + w[-1], -30, 30))))


def candidates(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str, int, list[int]]], list[tuple[int, list[int]]]]:
    """Base spans, looser spans with their codes and features, and the codes and features of the base spans."""
    base, failed = base_spans(text)
    both = lambda a, b, k: (code(k, votes(text, a, b, k)), features(text, a, b, k))
    loose = [(a, b, k, *both(a, b, k)) for a, b, k in loose_spans(text, failed, base)]
    return base, loose, [both(*x) for x in base]


def said(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]))))


LOOSE = "loose array<struct<start:long,end:long,kind:string,code:long,features:array<int>>>"
FOUND = f"doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, {LOOSE}, own array<struct<code:long,features:array<int>>>"


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Base spans and candidates of each row."""
    ship(docs.sparkSession)
    features_type = ("features", pa.list_(pa.int32()))
    loose_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("code", pa.int64()), features_type]))
    own_type = pa.list_(pa.struct([("code", pa.int64()), features_type]))

    def run(batches):
        for batch in batches:
            found = [candidates(t) for t in texts_of(batch, "text")]
            counts = [pa.array([sum(k == kind for _, _, k in base) for base, _, _ in found], pa.int64()) for kind in BASE]
            loose = pa.array([[dict(zip(("start", "end", "kind", "code", "features"), x)) for x in own] for _, own, _ in found], loose_type)
            base = pa.array([[{"code": c, "features": f} for c, f in own] for _, _, own in found], own_type)
            yield pa.record_batch([batch.column(0), *counts, pa.array([said(base) for base, _, _ in found], pa.string()), loose, base], names=["doc_id", *(f"n_{k}" for k in BASE), "base", "loose", "own"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, FOUND)


def model(found: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """The span classifier: the label model on all candidates, counted by kind and votes, then the fit on about `sample` of each kind."""
    each = found.select(F.explode(F.concat("own", F.transform("loose", lambda x: F.struct(x["code"].alias("code"), x["features"].alias("features"))))).alias("c")).select("c.code", "c.features")
    counted = each.groupBy("code").count().toArrow().sort_by("code")
    codes, n = counted.column("code").to_numpy(), counted.column("count").to_numpy()
    target, kinds = probabilities(codes, n), codes // 3**LABELERS
    share = F.lit(0.0)
    for k in np.unique(kinds):  # one a kind, nine at most
        share = F.when((F.col("code") / 3**LABELERS).cast("long") == int(k), min(1.0, sample / int(n[kinds == k].sum()))).otherwise(share)
    chosen = each.where(F.pmod(F.xxhash64("code", "features"), F.lit(1 << 20)) < share * (1 << 20)).groupBy("code", "features").count().toArrow()
    rows = sorted(zip(chosen.column("code").to_pylist(), chosen.column("features").to_pylist()))
    return trained([f for _, f in rows], np.array([target[c] for c, _ in rows]))


def private_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans."""
    found = Scratch(docs.sparkSession).write(scan(docs, id_col, text_col), "candidates")
    weights = model(found, sample)

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            spans = [said([(int(a), int(b), k) for k, a, b in (x.split(":") for x in r["base"].split(",") if x)] + [(x["start"], x["end"], x["kind"]) for x in r["loose"] if likelihood(weights, x["features"]) >= threshold]) for r in rows]
            digest = [hashlib.sha256(r["base"].encode()).hexdigest() for r in rows]
            yield pa.record_batch([*batch.columns[:5], pa.array(digest, pa.string()), pa.array(spans, pa.string())], names=[*batch.schema.names[:5], "base_sha256", "spans"])

    return found.drop("own").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted_text(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span, and spans that overlap as one, replaced by the mark of the first one's family."""
    out, at = [], 0
    for a, b, kind in sorted(spans):
        if a >= at:
            out += [text[at:a], f"[{FAMILY[kind].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """The same rows and columns, with personal data in the text replaced by marks such as [EMAIL]. Null texts stay null."""
    scratch = Scratch(docs.sparkSession)
    found = scratch.write(scan(docs, id_col, text_col).select("own", "loose"), "candidates")
    weights = model(found, sample)
    scratch.drop(found)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            new = []
            for text in batch.column(at).to_pylist():
                if text:
                    base, loose, _ = candidates(text)
                    spans = base + [(a, b, k) for a, b, k, _, f in loose if likelihood(weights, f) >= threshold]
                    text = redacted_text(text, spans) if spans else text
                new.append(text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    schema = StructType([StructField(f.name, StringType(), True) if i == at else f for i, f in enumerate(docs.schema.fields)])
    return docs.mapInArrow(run, schema)

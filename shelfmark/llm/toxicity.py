"""Toxicity: a linear classifier of character n-grams, scaled by naive Bayes log-count ratios.

A text is lower-cased, white space squeezed, and turned into the set of its hashed character n-grams.
From labelled rows come the smoothed log-count ratio r of each n-gram between the classes and then a
logistic model over features scaled by r. A score is the model's probability over the whole text.

The model is fitted from at most `per_class` labelled rows of class 1 and twice as many of class 0, those with
the smallest hash of their identifier. Executors count n-grams by class, keep those that tell the classes apart, and fit: one model over all
chosen rows, and one for each of FOLDS parts of them that leaves the part out. How the models score what they left out sets the slope, and the
point at which a score is THRESHOLD: that of the best F1, with classes weighted as often as they occur among the labels. The driver gets
one model and one number a chosen row.

Null labels, and labels other than 0 and 1, are left out; of
several labels for one identifier the largest holds. Rows whose remainder is 1 (see held_out) are never learned from. With labels of
one class only, or none, each score is that class's, for every text (0 without labels). Null
texts count as empty: they score by the intercept alone. A row with a null identifier is scored too
and counts as held out. Rows that repeat are scored each on its own. Of the caller's columns only those named are read, and `clean`
returns them all as they are. Identifiers may be of any type.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StructField, StructType

from ..runtime import Scratch, ship
from .bpe import texts_of

BITS = 20
SIZES = (4, 6)
PER_CLASS = 1500
FOLDS = 4
THRESHOLD = 0.7
LEAST_ROWS, LEAST_RATIO = 3, 0.5  # n-grams of fewer rows, or with a log-count ratio nearer to 0, get no weight
RATE, EPS = 0.02, 1e-4  # of the optimiser
BLOCK = 1 << 20  # code points hashed at once


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(True))


def ngrams(text: str, sizes: tuple[int, ...] = SIZES, bits: int = BITS) -> list[np.ndarray]:
    """Hashes of a text's n-grams, with repeats, in blocks that overlap by the longest n-gram."""
    text = f" {' '.join(text.lower().split())} "
    out, last = [], max(sizes)
    for at in range(0, len(text), BLOCK):
        c = np.frombuffer(text[at : at + BLOCK + last - 1].encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        h = c
        for n in range(2, last + 1):
            if len(h) < 2:
                break
            h = h[:-1] * np.uint64(0x100000001B3) + c[n - 1 :]
            if n in sizes:
                out.append((((h ^ np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int32))
    return out


class Distinct:
    """Distinct values among hashes, without sorting: of equal ones, that which a scratch table remembers last."""

    def __init__(self, bits: int = BITS):
        self.table = np.zeros(1 << bits, np.int32)

    def __call__(self, parts: list[np.ndarray]) -> np.ndarray:
        if not parts:
            return np.zeros(0, np.int32)
        x = np.concatenate(parts)
        at = np.arange(len(x), dtype=np.int32)
        self.table[x] = at
        return x[self.table[x] == at]


def ratios(rows: np.ndarray, ones: np.ndarray, n: float, pos: float) -> np.ndarray:
    """Log-count ratios of n-grams that are in so many rows, and so many rows of class 1; 0 where they tell little."""
    r = np.log((ones + 1) / (pos + 2)) - np.log((rows - ones + 1) / (n - pos + 2))
    return np.where((rows < LEAST_ROWS) | (np.abs(r) < LEAST_RATIO), 0.0, r)


def fit(features: list[np.ndarray], labels: np.ndarray, bits: int = BITS, l2: float = 30.0, steps: int = 40) -> tuple[np.ndarray, float]:
    """Weights of the hashed n-grams and the intercept; classes weigh alike."""
    n, size = len(labels), 1 << bits
    pos = float(labels.sum())
    if pos in (0.0, n):
        return np.zeros(size, np.float32), 30.0 if n and pos else -30.0
    every, row = np.concatenate(features), np.repeat(np.arange(n, dtype=np.int32), [len(f) for f in features])
    r = ratios(np.bincount(every, minlength=size), np.bincount(every, weights=labels[row], minlength=size), n, pos)
    used = np.flatnonzero(r)
    slot = np.zeros(size, np.int32)
    slot[used] = np.arange(len(used))
    some = r[every] != 0
    ids, row = slot[every[some]], row[some]
    value, each = r[used][ids], np.where(labels == 1, 0.5 / pos, 0.5 / (n - pos))
    theta, bias = np.zeros(len(used)), 0.0
    m, s, mb, sb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for step in range(1, steps + 1):  # Adam over all rows
        z = np.bincount(row, weights=value * theta[ids], minlength=n) + bias
        miss = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) * each
        grad, gb = l2 / n * theta + np.bincount(ids, weights=value * miss[row], minlength=len(used)), miss.sum()
        m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad**2
        mb, sb = 0.9 * mb + 0.1 * gb, 0.99 * sb + 0.01 * gb**2
        a, b = 1 - 0.9**step, 1 - 0.99**step
        theta -= RATE * (m / a) / (np.sqrt(s / b) + EPS)
        bias -= 10 * RATE * (mb / a) / (np.sqrt(sb / b) + EPS)
    out = np.zeros(size, np.float32)
    out[used] = theta * r[used]
    return out, float(bias)


def slope(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The slope of a logistic fit of y to z, by Newton's steps."""
    size = max(float(np.abs(z).max()), 1e-9)
    x, at = np.stack([z / size, np.ones(len(z))], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        gap = x.T @ (weight * (p - y)) + 1e-3 * at
        at -= np.clip(np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), gap), -3, 3)
    return float(np.clip(at[0] / size, 0.05, 20))


def calibrated(z: np.ndarray, y: np.ndarray, counts: tuple[float, float]) -> tuple[float, float]:
    """Slope and shift of the sums z of rows with labels y, of classes that are so frequent (0, 1): the point of the best F1, or the middle of such points, scores THRESHOLD."""
    if not 0 < y.sum() < len(y):
        return 1.0, 0.0
    weight = np.where(y == 1, counts[1] / y.sum(), counts[0] / (1 - y).sum())
    order = np.argsort(-z, kind="stable")
    hit = np.cumsum((weight * y)[order])
    f1 = 2 * hit / (np.cumsum(weight[order]) + counts[1])
    good = np.flatnonzero(f1 >= f1.max() - 0.002)
    k = good[len(good) // 2]
    point = z[order[k]] - 1.0 if k + 1 == len(z) else (z[order[k]] + z[order[k + 1]]) / 2
    a = slope(z, y, weight / weight.mean())
    return a, math.log(THRESHOLD / (1 - THRESHOLD)) - a * point


def training(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_class: int) -> tuple[DataFrame, tuple[float, float]]:
    """label, part and features of the rows to learn from (at most 3 * per_class), and how many labelled rows there are of class 0 and 1."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    known = known.where(~held_out("id")).groupBy("id").agg(F.max("label").alias("label"))
    counts = {r["label"]: float(r["count"]) for r in known.groupBy("label").count().collect()}
    first = lambda k: known.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit((2 - k) * per_class)
    chosen = F.broadcast(first(1).unionAll(first(0)))  # at most 3 * per_class rows of two numbers
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(chosen, "id").select("id", "label", "text")

    def run(batches):
        distinct = Distinct()
        for batch in batches:
            yield pa.record_batch([*batch.columns[:2], pa.array([distinct(ngrams(t)).tobytes() for t in texts_of(batch, "text")], pa.binary())], names=["id", "label", "f"])

    found = rows.mapInArrow(run, StructType([rows.schema["id"], rows.schema["label"], StructField("f", BinaryType())]))
    found = found.groupBy("id").agg(F.max("label").alias("label"), F.min("f").alias("f"))
    return found.select("label", F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("part")), F.lit(FOLDS)).cast("int").alias("part"), "f"), (counts.get(0, 0.0), counts.get(1, 0.0))


def telling(features: DataFrame) -> np.ndarray:
    """A table of the hashed n-grams that tell the classes apart; counted on executors, so at most 1 << BITS numbers reach the driver."""

    def run(batches):
        rows, ones = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
        for batch in batches:
            for f, y in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist()):  # each n-gram once a row
                at = np.frombuffer(f, np.int32)
                rows[at] += 1
                ones[at] += y
        at = np.flatnonzero(rows)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(rows[at]), pa.array(ones[at])], names=["gram", "n", "ones"])

    n, pos = features.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    counted = features.select("label", "f").mapInArrow(run, "gram int, n long, ones long").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")).where(F.col("n") >= LEAST_ROWS)
    ratio = F.log((F.col("ones") + 1) / (pos + 2.0)) - F.log((F.col("n") - F.col("ones") + 1) / (n - pos + 2.0))
    out = np.zeros(1 << BITS, bool)
    out[counted.where(F.abs(ratio) >= LEAST_RATIO).select("gram").toArrow().column("gram").to_numpy()] = True
    return out


def fitted(t: pa.Table) -> pa.Table:
    """The model that leaves one part out (without a part: none): the sums of the rows left out and their labels, or else the model itself."""
    out = t.column("model")[0].as_py()
    f = [np.frombuffer(x, np.int32) for x in t.column("f").to_pylist()]
    y, left = t.column("label").to_numpy().astype(float), t.column("part").to_numpy() == out
    weights, bias = fit([x for x, k in zip(f, left) if not k], y[~left])
    z = np.array([weights[x].sum(dtype=np.float64) + bias for x, k in zip(f, left) if k])
    at = np.flatnonzero(weights) if out == FOLDS else np.zeros(0, np.int64)
    return pa.table({"model": pa.array([out], pa.int32()), "bias": [bias], "grams": pa.array([at.astype(np.int32).tobytes()], pa.binary()), "weights": pa.array([weights[at].tobytes()], pa.binary()), "z": pa.array([z], pa.list_(pa.float64())), "y": pa.array([y[left]], pa.list_(pa.float64()))})


def learned(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_class: int) -> tuple[np.ndarray, float]:
    """Weights and intercept of the calibrated model."""
    scratch = Scratch(docs.sparkSession)
    rows, counts = training(docs, labels, id_col, text_col, label_col, per_class)
    if not all(counts):
        return np.zeros(1 << BITS, np.float32), 30.0 if counts[1] else -30.0
    features = scratch.write(rows, "features")
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(telling(features)))  # (1 << BITS) / 8 bytes

    def run(batches):
        known = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            own = [np.frombuffer(x, np.int32) for x in batch.column(2).to_pylist()]
            yield batch.set_column(2, "f", pa.array([x[known[x]].tobytes() for x in own], pa.binary()))

    few = scratch.write(features.mapInArrow(run, features.schema), "telling")
    models = few.withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(FOLDS)))).repartition(8 * (FOLDS + 1), "model")
    table = scratch.write(models.groupBy("model").applyInArrow(fitted, "model int, bias double, grams binary, weights binary, z array<double>, y array<double>"), "models")
    found = table.toArrow().to_pylist()
    scratch.drop(features, few, table)
    weights, bias = np.zeros(1 << BITS, np.float32), -30.0
    for m in found:
        if m["model"] == FOLDS:
            weights[np.frombuffer(m["grams"], np.int32)], bias = np.frombuffer(m["weights"], np.float32), m["bias"]
    parts = sorted((m for m in found if m["model"] < FOLDS), key=lambda m: m["model"])
    a, c = calibrated(*(np.array([x for m in parts for x in m[k]]) for k in ("z", "y")), counts)
    return weights * np.float32(a), a * bias + c


def score(docs: DataFrame, weights: np.ndarray, bias: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id and score of each row."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float32), bias))  # 4 << BITS bytes

    def run(batches):
        w, b = shared.value
        distinct = Distinct()
        for batch in batches:
            z = [float(w[distinct(ngrams(t))].sum(dtype=np.float64)) + b for t in texts_of(batch, "text")]
            yield pa.record_batch([batch.column(0), pa.array([1 / (1 + math.exp(-max(-30.0, min(30.0, x)))) for x in z], pa.float64())], names=["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, StructType([rows.schema["id"], StructField("score", DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *, per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted."""
    ship(docs.sparkSession)
    weights, bias = learned(docs, labels, id_col, text_col, label_col, per_class)
    scored = score(docs, weights, bias, id_col, text_col)
    return scored.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *, per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, whose score is below the threshold."""
    ship(docs.sparkSession)
    weights, bias = learned(docs, labels, id_col, text_col, label_col, per_class)
    shared = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float32), bias))  # 4 << BITS bytes
    least = math.log(threshold / (1 - threshold))

    def run(batches):
        w, b = shared.value
        distinct = Distinct()
        for batch in batches:
            z = [float(w[distinct(ngrams(t))].sum(dtype=np.float64)) + b for t in texts_of(batch, text_col)]
            yield batch.filter(pa.array([x < least for x in z], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

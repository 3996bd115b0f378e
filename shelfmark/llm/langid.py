"""Language identification by rank-order profiles.

A profile ranks the most frequent n-grams (of 1 to 4 code points, words set off by a space; told apart by 63-bit hashes) of all texts
learned from in one language. A document's own most frequent n-grams are ranked alike over its whole text, and
its distance to a profile is the sum of how far each n-gram is out of place there, or the profile's
length where the profile lacks it. The nearest profile names the language; ties go to the smaller name.

The score is the relative lead over the next nearest profile, mapped to 0.5 to 1 (1 with one profile
only). A text that is null or holds no letter is `und` with score 0. Profiles are learned from at most
`per_lang` documents of each language, those with the smallest hash of their identifier, never from rows that are held
out (crc32 of the identifier mod 3 is 1, or a null identifier). Without any profile all is `und`. Ties of frequency go by hash. Identifiers are cast to
long; rows that repeat are predicted each on its own; columns not named are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import ship
from .bpe import texts_of
from .toxicity import held_out

TOP, PROFILE = 300, 400
PER_LANG = 2000
LONGEST = 4
BLOCK = 1 << 20
MERGED = 1 << 18  # counted n-grams that a task holds of one language before it adds them up
LETTER = regex.compile(r"\p{L}")
OTHER = regex.compile(r"[^\p{L}\p{M}]+")


def added_up(grams: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams in order, and the sums of their counts."""
    order = np.argsort(grams, kind="stable")
    grams, n = grams[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1]))) if len(grams) else np.zeros(0, np.int64)
    return grams[first], np.add.reduceat(n, first) if len(first) else n


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The hashed n-grams of a text's words, and how often each occurs."""
    text = f" {OTHER.sub(' ', text.lower()).strip()} "
    parts = []
    for at in range(0, len(text), BLOCK):
        c = np.frombuffer(text[at : at + BLOCK + LONGEST - 1].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        h, own, found = c, len(c) if at + BLOCK >= len(text) else BLOCK, []
        for n in range(1, LONGEST + 1):
            if n > 1:
                h = h[:-1] * np.uint64(0x100000001B3) + c[n - 1 :]
            if len(h) == 0:
                break
            found.append((((h[:own] ^ np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(1)).astype(np.int64))
        x = np.sort(np.concatenate(found))
        first = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
        parts.append((x[first], np.diff(np.append(first, len(x)))))
    return parts[0] if len(parts) == 1 else added_up(*(np.concatenate([p[k] for p in parts]) for k in (0, 1)))


def ranked(grams: np.ndarray, n: np.ndarray, top: int) -> np.ndarray:
    """The most frequent n-grams, first the most frequent; ties by hash."""
    if len(n) > top:
        some = n >= np.partition(n, len(n) - top)[len(n) - top]
        grams, n = grams[some], n[some]
    return grams[np.argsort(-n, kind="stable")][:top]


def profiles(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int) -> dict[str, np.ndarray]:
    """The ranked n-grams of each language, counted and ranked on executors: PROFILE rows a language reach the driver."""
    known = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    known = known.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("id"))
    sized = known.groupBy("lang").agg(F.count("*").alias("of"))  # a row a language
    known = known.join(F.broadcast(sized), "lang").where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < per_lang / F.col("of") * (1 << 20))

    def run(batches):
        held: dict[str, list] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), texts_of(batch, "text")):
                own = held.setdefault(lang, [])
                own.append(counts(text))
                if sum(len(n) for _, n in own[1:]) > MERGED:
                    held[lang] = [added_up(*(np.concatenate([p[k] for p in own]) for k in (0, 1)))]
        found = {lang: added_up(*(np.concatenate([p[k] for p in own]) for k in (0, 1))) for lang, own in held.items()}
        for lang, (grams, n) in found.items():
            yield pa.record_batch([pa.array([lang] * len(grams)), pa.array(grams), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    summed = known.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best = summed.withColumn("place", place).where(F.col("place") <= PROFILE).toArrow().sort_by([("lang", "ascending"), ("place", "ascending")])
    langs, grams = best.column("lang").to_pylist(), best.column("gram").to_numpy()
    return {lang: grams[[k for k, x in enumerate(langs) if x == lang]] for lang in sorted(set(langs))}


class Places:
    """The rank of an n-gram in each language's profile."""

    def __init__(self, found: dict[str, np.ndarray]):
        self.names = sorted(found)
        self.grams = np.unique(np.concatenate([*found.values(), np.zeros(0, np.int64)]))
        self.rank = np.full((len(found), len(self.grams)), -1, np.int16)
        for k, name in enumerate(self.names):
            self.rank[k, np.searchsorted(self.grams, found[name])] = np.arange(len(found[name]))

    def distances(self, own: np.ndarray) -> np.ndarray:
        """How far a document's ranked n-grams are out of place in each profile, in all."""
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        place = np.where(self.grams[at] == own, self.rank[:, at], -1).astype(np.int64)
        return np.where(place < 0, PROFILE, np.abs(place - np.arange(len(own)))).sum(axis=1)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, per_lang: int = PER_LANG) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score."""
    spark = docs.sparkSession
    ship(spark)
    found = profiles(docs, id_col, text_col, lang_col, per_lang)
    shared = spark.sparkContext.broadcast(Places(found))  # PROFILE numbers a language

    def run(batches):
        places = shared.value
        names = places.names
        for batch in batches:
            lang, score = [], []
            for text in texts_of(batch, "text"):
                if not names or not LETTER.search(text):
                    lang.append("und")
                    score.append(0.0)
                    continue
                far = places.distances(ranked(*counts(text), TOP))
                order = np.argsort(far, kind="stable")
                lang.append(names[order[0]])
                second = far[order[1]] if len(order) > 1 else 0
                score.append(0.5 + 0.5 * float(second - far[order[0]]) / float(second) if second else 1.0 if len(order) == 1 else 0.5)
            yield pa.record_batch([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double").select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")

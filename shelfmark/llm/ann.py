"""Approximate nearest neighbours by additive quantisation.

A vector is approximated as a centre plus a gain times the sum of one word from each of several
codebooks, all of full dimension. Codebooks are trained on residuals, one after another, over a bounded
sample (`sample` vectors, those with the smallest hash of their identifier). Encoding keeps a beam of the best partial sums. The index
holds, for every vector, its words, the gain and the norm of the approximation. A query's inner products with
all words make lookup tables, from which each code's distance is summed. Each query keeps a shortlist of the nearest
approximations, ties by smaller identifier, and the shortlist is ranked again by exact
distances in double precision. A query looks at the codes of its `probes` nearest centres only, and of more where these hold fewer than `shortlist` codes.
Codes and queries meet by centre in one job: the codes of a centre are dealt out to chunks, its queries to blocks, and each task holds a chunk and a block. The gain makes precision relative to how far a vector lies from its centre, so that
vectors in a dense group are told apart as well as others.

Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do those
of another length than most have, or with a null identifier. Rows that repeat an identifier are one
candidate (nearest row) and one query. Identifiers are cast to long. No queries and no vectors give no rows. The driver holds the sample and the numbers of codes and queries of each centre;
a query never returns itself. With fewer candidates than asked for, all are returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Scratch, ship

BOOKS, WORDS, CENTRES, BEAM = 24, 128, 64, 8
SAMPLE, SHORTLIST, ROWS = 4096, 200, 2048
PROBES, CHUNK, BLOCK = 64, 1 << 16, 1024  # all centres: on vectors without groups, 48 of 64 found 0.97 of the nearest ten, and 32 found 0.88


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and v (array of double) of the vectors that take part."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(finite & F.exists("v", lambda x: x != 0))


def matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, size)


def nearest_word(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.argmin((words**2).sum(1) - 2 * x @ words.T, axis=1)


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    words = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        own = nearest_word(x, words)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(words)
        np.add.at(sums, own, x)
        words[n > 0] = sums[n > 0] / n[n > 0, None]
    return words


class Quantiser:
    """Centres and codebooks, trained on a sample."""

    def __init__(self, sample: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        x = sample.astype(np.float32)
        self.centres = k_means(x, min(CENTRES, len(x)), rng)
        left = self.directions(x)[1]
        self.books = np.zeros((BOOKS, WORDS, x.shape[1]), np.float32)
        for m in range(BOOKS):
            self.books[m] = k_means(left, WORDS, rng)
            left = left - self.books[m][nearest_word(left, self.books[m])]

    def directions(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = nearest_word(x, self.centres)
        off = x - self.centres[own]
        size = np.linalg.norm(off, axis=1)
        return own, off / np.where(size > 0, size, 1)[:, None], size

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Centre, words, gain and squared norm of the approximation of each row."""
        x = x.astype(np.float32)
        n, d = x.shape
        own, unit, size = self.directions(x)
        left, codes = unit[:, None, :], np.zeros((n, 1, 0), np.uint8)  # residuals and words of the beam
        for m in range(BOOKS):
            words = self.books[m]
            far = (left**2).sum(2)[:, :, None] + (words**2).sum(1) - 2 * left @ words.T
            flat = far.reshape(n, -1)
            best = np.argpartition(flat, BEAM - 1, axis=1)[:, :BEAM] if flat.shape[1] > BEAM else np.tile(np.arange(flat.shape[1]), (n, 1))
            row, word = best // WORDS, best % WORDS
            left = np.take_along_axis(left, row[:, :, None], axis=1) - words[word]
            codes = np.concatenate([np.take_along_axis(codes, row[:, :, None], axis=1), word[:, :, None].astype(np.uint8)], axis=2)
        best = np.argmin((left**2).sum(2), axis=1)
        made = unit - left[np.arange(n), best]
        gain = size * (unit * made).sum(1) / np.maximum((made**2).sum(1), 1e-12)
        near = self.centres[own] + gain[:, None] * made
        return own.astype(np.uint8), codes[np.arange(n), best], gain.astype(np.float32), (near**2).sum(1).astype(np.float32)

    def tables(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inner products of the queries with the centres and with all words."""
        q = queries.astype(np.float32)
        return q @ self.centres.T, np.einsum("qd,mkd->mqk", q, self.books)


def distances(tables: tuple[np.ndarray, np.ndarray], own: np.ndarray, codes: np.ndarray, gain: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """Approximate squared distances less the query's own square, queries by codes, from lookup tables."""
    centre, words = tables
    total = words[0][:, codes[:, 0]]
    for m in range(1, codes.shape[1]):
        total += words[m][:, codes[:, m]]
    return norm - 2 * (centre[:, own] + gain * total)


def shortest(far: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of one query, ties by smaller identifier."""
    if len(far) > k:
        some = np.flatnonzero(far <= np.partition(far, k - 1)[k - 1])
        far, ids = far[some], ids[some]
    order = np.lexsort((ids, far))[:k]
    return far[order], ids[order]


def index(rows: DataFrame, quantiser: Quantiser, size: int) -> DataFrame:
    """vec_id, cell (its centre), words (as bytes), gain and norm of every vector."""
    shared = rows.sparkSession.sparkContext.broadcast(quantiser)  # fixed size: the codebooks

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                own, codes, gain, norm = shared.value.encode(matrix(part.column(1), size))
                yield pa.record_batch([part.column(0), pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(gain), pa.array(norm)], names=["vec_id", "cell", "codes", "gain", "norm"])

    return rows.mapInArrow(run, "vec_id long, cell int, codes binary, gain float, norm float")


def probed(queries: DataFrame, quantiser: Quantiser, size: int, counts: np.ndarray, probes: int, least: int) -> DataFrame:
    """query_id, v and cell: the cells each query looks at, the nearest ones until there are `probes` that hold codes, and `least` codes."""
    shared = queries.sparkSession.sparkContext.broadcast((quantiser.centres, counts))  # fixed size

    def run(batches):
        centres, counts = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                q = matrix(part.column(1), size).astype(np.float32)
                order = np.argsort((centres**2).sum(1) - 2 * q @ centres.T, axis=1, kind="stable")
                n = counts[order]
                before_cells, before_codes = np.cumsum(n > 0, axis=1) - (n > 0), np.cumsum(n, axis=1) - n
                row, place = np.nonzero((n > 0) & ((before_cells < probes) | (before_codes < least)))
                own = part.take(pa.array(row))
                yield pa.record_batch([own.column(0), own.column(1), pa.array(order[row, place].astype(np.int32))], names=["query_id", "v", "cell"])

    return queries.mapInArrow(run, "query_id long, v array<double>, cell int")


SHORT = "query_id long, far array<float>, ids array<long>"


def scan(quantiser: Quantiser, size: int, shortlist: int, spark):
    """Of a chunk of codes and a block of queries, the shortlist of each query."""
    shared = spark.sparkContext.broadcast(quantiser)  # fixed size: the codebooks

    def run(codes: pa.Table, queries: pa.Table) -> pa.Table:
        names, all_ids = queries.column("query_id").to_numpy(), codes.column("vec_id").to_numpy()
        words = np.frombuffer(b"".join(codes.column("codes").to_pylist()), np.uint8).reshape(len(all_ids), BOOKS)
        own, gain, norm = (codes.column(c).to_numpy() for c in ("cell", "gain", "norm"))
        out = []
        for low in range(0, len(names), 128):
            some = names[low : low + 128]
            tables = shared.value.tables(matrix(queries.column("v").slice(low, 128), size))
            best = [(np.zeros(0, np.float32), np.zeros(0, np.int64))] * len(some)
            for at in range(0, len(all_ids), ROWS):
                here = slice(at, at + ROWS)
                ids = all_ids[here]
                far = distances(tables, own[here], words[here], gain[here], norm[here])
                for q, name in enumerate(some):
                    other = ids != name
                    best[q] = shortest(np.concatenate([best[q][0], far[q][other]]), np.concatenate([best[q][1], ids[other]]), shortlist)
            out += [(n, *b) for n, b in zip(some, best) if len(b[0])]
        return pa.table([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.list_(pa.float32())), pa.array([o[2] for o in out], pa.list_(pa.int64()))], names=["query_id", "far", "ids"])

    return run


def joined_lists(shortlist: int):
    """Of each query, the shortlist out of all tasks' ones."""

    def run(t: pa.Table) -> pa.Table:
        far = np.concatenate([np.asarray(x.values) for x in t.column("far")])
        ids = np.concatenate([np.asarray(x.values) for x in t.column("ids")])
        _, ids = shortest(far, ids, shortlist)
        return pa.table({"query_id": pa.array([t.column("query_id")[0].as_py()] * len(ids), pa.int64()), "vec_id": pa.array(ids, pa.int64())})

    return run


def euclidean(a: str, b: str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", *, k: int = 10, shortlist: int = SHORTLIST, sample: int = SAMPLE, probes: int = PROBES, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance) of the nearest of each row that is_query (over vec_id) picks."""
    spark = vectors.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    valid = usable(vectors, id_col, vector_col)
    sizes = valid.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if sizes is None:
        return empty
    size = sizes["size"]
    rows = valid.where(F.size("v") == size)
    learned = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    quantiser = Quantiser(matrix(learned.column("v"), size))
    codes = scratch.write(index(rows, quantiser, size), "index")
    queries = scratch.write(rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")).withColumnRenamed("vec_id", "query_id"), "queries")
    counts = np.zeros(len(quantiser.centres), np.int64)
    for r in codes.groupBy("cell").count().collect():  # CENTRES rows at most
        counts[r["cell"]] = r["count"]
    asked = scratch.write(probed(queries, quantiser, size, counts, probes, shortlist + 1), "probes")
    cells = asked.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).join(codes.groupBy("cell").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks")), "cell")
    cells = F.broadcast(cells)  # CENTRES rows at most
    there = codes.join(cells, "cell").withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("chunks", "blocks")
    here = asked.join(cells, "cell").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks", "blocks")
    meet = ("cell", "chunk", "block")
    found = there.groupBy(*meet).cogroup(here.groupBy(*meet)).applyInArrow(scan(quantiser, size, shortlist, spark), SHORT)
    pairs = found.groupBy("query_id").applyInArrow(joined_lists(shortlist), "query_id long, vec_id long")
    exact = pairs.join(rows, "vec_id").join(queries.select("query_id", F.col("v").alias("q")), "query_id")
    exact = exact.groupBy("query_id", "vec_id").agg(F.min(euclidean("v", "q")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))  # a shortlist each, never more
    return exact.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

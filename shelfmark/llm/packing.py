"""Packing token ids into sequences by Karmarkar-Karp multiway differencing.

Each document's ids are cut into full windows, which fill a sequence each, and a tail, which is cut into
fragments of falling size. Fragments are dealt by a hash to groups that hold about as many as `group_docs`
documents have. In a group, each fragment starts as a partial partition: the sums of as many windows as the
group's ids need, all but one of them empty. Again and again the two partitions with the widest imbalance
are merged, the largest sums of one with the smallest of the other, until one partition is left, whose
windows are nearly equal. If one holds more than a sequence takes, the number of windows rises and
the differencing begins anew.

Null texts count as empty; each document has one id at least, the end mark. Rows that repeat a
document are packed each on its own. Identifiers are cast to long; columns not named are not read; an empty table gives no pieces. Groups hold a bounded number of fragments, whatever is hot, and
only their lengths, never ids.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Scratch, ship
from . import bpe

CAPACITY = 1024
GROUP_DOCS = 512
END_ID = 0


def cuts(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of a document of n ids: full windows, then fragments of a half, a quarter and so on."""
    full, rest = divmod(n, capacity)
    out = [capacity] * full
    for _ in range(5):
        if rest < 4:
            break
        out.append(rest - rest // 2)
        rest //= 2
    return [*out, rest] if rest else out


def differencing(sizes: list[int], ways: int) -> list[list[int]]:
    """Multiway Karmarkar-Karp: the indexes of sizes in each of `ways` windows."""
    if ways == 1:
        return [list(range(len(sizes)))]
    # a partial partition: sums of its filled windows, rising, and for each a tree of indexes; windows not listed are empty
    heap = [(-s, i, [s], [i]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, a, ta = heapq.heappop(heap)
        _, _, b, tb = heap[0]
        over = len(a) + len(b) - ways
        if over <= 0:  # every filled window meets an empty one
            sums, trees = a + b, ta + tb
        else:  # the `over` smallest of each meet, the smallest of one with the largest of those of the other
            sums = [x + y for x, y in zip(a[:over], b[over - 1 :: -1])] + a[over:] + b[over:]
            trees = [(x, y) for x, y in zip(ta[:over], tb[over - 1 :: -1])] + ta[over:] + tb[over:]
        order = sorted(range(len(sums)), key=sums.__getitem__)
        low = sums[order[0]] if len(sums) == ways else 0
        sums = [sums[i] - low for i in order]
        trees = [trees[i] for i in order]
        serial += 1
        heapq.heapreplace(heap, (-sums[-1], serial, sums, trees))
    out = []
    for tree in heap[0][3] if heap else []:
        window, todo = [], [tree]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                todo += x
            else:
                window.append(x)
        out.append(sorted(window))
    return out


def windows(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows of at most `capacity`, near-equal; their number rises whenever one is exceeded."""
    total = sum(sizes)
    ways = max(1, -(-total // capacity))
    while True:
        found = differencing(sizes, ways)
        worst = max((sum(sizes[i] for i in w) for w in found), default=0)
        if worst <= capacity:
            return found
        ways = max(ways + 1, -(-total // max(1, 2 * capacity - worst)) if worst < 2 * capacity else ways + 1)


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, id_col: str, text_col: str, vocabulary: str | None) -> DataFrame:
    """One row per piece of each document's ids and end mark."""
    ship(docs.sparkSession)
    path = vocabulary or bpe.default_vocabulary()

    def run(batches):
        coder = bpe.loaded(path)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            cols: list[list] = [[], [], [], [], []]
            for doc_id, found in zip(ids, coder.encode_batch(bpe.texts_of(batch, "text"))):
                found.append(END_ID)
                raw, at = np.asarray(found, dtype="<u4").tobytes(), 0
                for size in cuts(len(found)):
                    for col, x in zip(cols, (doc_id, at, size, zlib.crc32(raw[4 * at : 4 * (at + size)]), len(found))):
                        col.append(x)
                    at += size
            yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECE)


def pack_group(t: pa.Table) -> pa.Table:
    """Sequence and offset for each fragment of a group."""
    t = t.sort_by("piece")
    sizes, group = t.column("length").to_pylist(), t.column("group_no")[0].as_py()
    sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for w, window in enumerate(windows(sizes)):
        at = 0
        for i in window:
            sequence[i], offset[i] = 2 * ((group << 20) + w), at
            at += sizes[i]
    out = t.drop_columns(["piece", "group_no"])
    return out.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, vocabulary: str | None = None, group_docs: int = GROUP_DOCS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    cut = pieces(docs, id_col, text_col, vocabulary).withColumn("piece", F.monotonically_increasing_id())
    table = Scratch(docs.sparkSession).write(cut.withColumn("tail", F.col("length") < CAPACITY), "pieces")
    tails = table.where("tail")
    n = tails.where("start + length = doc_tokens").count()
    groups = max(1, -(-n // group_docs))
    full = table.where("not tail").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("piece") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    dealt = tails.drop("tail").withColumn("group_no", F.pmod(F.xxhash64("piece"), F.lit(groups)))
    packed = dealt.groupBy("group_no").applyInArrow(pack_group, PIECE + ", sequence_id long, offset long")
    return full.unionByName(packed)

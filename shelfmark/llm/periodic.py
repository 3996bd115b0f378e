"""Periodic runs of words, by suffix trees.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) that is LEAST words and TIMES periods long or longer, and that no neighbouring word extends.
Texts are split into words `[^\\x20\\x09-\\x0D]+`. All texts of an Arrow batch are looked through together:

1. Only stretches can hold a run in which each three words in a row come three times or more, and each five twice or more: TIMES periods hold so many. What else there is goes,
   by counts in hashed slots (which can only keep too much), again within what is left, until nothing goes.
2. Stretches are joined by symbols of their own, up to GROUP words (or one longer stretch), and Ukkonen's suffix trees of them and of their reversal are built. Over an Euler tour
   of a tree the lowest common ancestor of two leaves, and so the longest common extension of two places, takes constant time.
3. The longest Lyndon word that starts at a place ends where the next suffix of lower rank starts; for the reversed order of symbols, that of higher rank. Every run has such a word for its
   root, so each is a candidate, extended in both directions. Lyndon words have no shorter period, so periods are smallest.

Memory goes with a batch of texts, and with the longest stretch of one text that step 1 leaves (about 0.5 KB a word of it). Nothing is shuffled. Null and empty texts have no words
and no runs. A null identifier, repeated rows and empty tables need no care: each row gives a row. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import ship

LEAST, TIMES = 6, 4
GROUP = 1 << 16
BLOCK = 32
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def suffix_tree(s: list[int]) -> tuple[dict[int, int], list[int], list[int], int]:
    """Ukkonen's tree of a sequence whose last symbol is met there only: edges (node * width + symbol to node), starts and ends of the edges into the nodes, and width. Edges that end with the sequence have end -1."""
    width = max(s) + 1
    start, end, link, go = [0], [0], [0], {}
    active = edge = length = waiting = 0
    for i, c in enumerate(s):
        unlinked = -1
        waiting += 1
        while waiting:
            if not length:
                edge = i
            key = active * width + s[edge]
            to = go.get(key)
            if to is None:
                go[key] = len(start)
                start.append(i)
                end.append(-1)
                link.append(0)
                if unlinked >= 0:
                    link[unlinked] = active
                    unlinked = -1
            else:
                at, stop = start[to], end[to]
                own = (stop if stop >= 0 else i + 1) - at
                if length >= own:
                    active = to
                    edge += own
                    length -= own
                    continue
                if s[at + length] == c:
                    length += 1
                    if unlinked >= 0:
                        link[unlinked] = active
                    break
                split = len(start)
                go[key] = split
                go[split * width + c] = split + 1
                go[split * width + s[at + length]] = to
                start += (at, i)
                end += (at + length, -1)
                link += (0, 0)
                start[to] = at + length
                if unlinked >= 0:
                    link[unlinked] = split
                unlinked = split
            waiting -= 1
            if active == 0 and length:
                length -= 1
                edge = i - waiting + 1
            else:
                active = link[active]
    return go, start, end, width


class Extensions:
    """Longest common extensions to the right of any two places of a sequence whose last symbol is met there only."""

    def __init__(self, s: list[int]):
        go, start, end, width = suffix_tree(s)
        nodes = len(start)
        keys = np.fromiter(go.keys(), np.int64, len(go))
        child = np.fromiter(go.values(), np.int64, len(go))[order := np.argsort(keys)]
        below = np.bincount(keys // width, minlength=nodes)
        first = (np.cumsum(below) - below).tolist()
        last = np.cumsum(below).tolist()
        del go, keys, order
        child = child.tolist()
        depth, parent, tour, places, leaves = [0] * nodes, [0] * nodes, [0], [], []
        n, v = len(s), 0
        while True:  # the Euler tour, children in the order of symbols
            at = first[v]
            if at < last[v]:
                first[v] = at + 1
                to = child[at]
                if end[to] < 0:  # a leaf
                    size = depth[v] + n - start[to]
                    leaves.append(n - size)
                    places.append(len(tour))
                    tour += (size, depth[v])
                else:
                    size = depth[to] = depth[v] + end[to] - start[to]
                    parent[to] = v
                    tour.append(size)
                    v = to
            elif v:
                v = parent[v]
                tour.append(depth[v])
            else:
                break
        leaves = np.array(leaves)
        self.rank, self.place = np.empty(n, np.int64), np.empty(n, np.int64)
        self.rank[leaves] = np.arange(n)
        self.place[leaves] = places
        most = np.iinfo(np.int32).max
        self.tour = np.full(-(-len(tour) // BLOCK) * BLOCK, most, np.int32)
        self.tour[: len(tour)] = tour
        blocks = self.tour.reshape(-1, BLOCK)
        self.before = np.minimum.accumulate(blocks, axis=1).ravel()
        self.after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        self.levels = [np.append(blocks.min(axis=1), most)]
        while 2 << len(self.levels) <= 2 * len(blocks):
            half, low = 1 << len(self.levels) - 1, self.levels[-1]
            self.levels.append(np.minimum(low, np.append(low[half:], np.full(half, most, np.int32))))
        self.levels = np.array(self.levels)

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How far the sequence goes on alike from i and from j (which differ)."""
        out = np.empty(len(i), np.int64)
        for at in range(0, len(i), GROUP):
            a, b = self.place[i[at : at + GROUP]], self.place[j[at : at + GROUP]]
            out[at : at + GROUP] = self.least(np.minimum(a, b), np.maximum(a, b))
        return out

    def least(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The least depth between two places of the tour: of whole blocks by doubling, and of the two parts at the ends."""
        low = np.minimum(self.after[a], self.before[b])
        first, blocks = a // BLOCK + 1, b // BLOCK - a // BLOCK - 1
        level = np.frexp(np.maximum(blocks, 1))[1] - 1
        many = np.minimum(self.levels[level, np.minimum(first, self.levels.shape[1] - 1)], self.levels[level, np.maximum(first + blocks - (1 << level), 0)])
        low = np.where(blocks > 0, np.minimum(low, many), low)
        near = np.flatnonzero(blocks < 0)  # both in one block
        spots = a[near, None] + np.arange(BLOCK)
        inside = spots <= b[near, None]
        low[near] = np.where(inside, self.tour[np.where(inside, spots, 0)], np.iinfo(np.int32).max).min(axis=1, initial=np.iinfo(np.int32).max)
        return low


def next_lower(rank: list[int]) -> np.ndarray:
    """For each place the next one of lower rank, or the length."""
    out, open_ = [len(rank)] * len(rank), []
    for i, r in enumerate(rank):
        while open_ and rank[open_[-1]] > r:
            out[open_.pop()] = i
        open_.append(i)
    return np.array(out)


def runs_of(s: np.ndarray) -> np.ndarray:
    """start, length and period of each run of a sequence whose last symbol is met there only, by start and period."""
    n = len(s)
    s = np.unique(s, return_inverse=True)[1] + 1
    right, left = Extensions(s.tolist()), Extensions([*s[::-1].tolist(), 0])
    found = []
    for rank in (right.rank, n - 1 - right.rank):
        j = next_lower(rank.tolist())
        i = np.flatnonzero(j < n)
        j = j[i]
        ahead, back = right(i, j), np.zeros(len(i), np.int64)
        inner = np.flatnonzero(i > 0)
        back[inner] = left(n - i[inner], n - j[inner])
        length = j - i + ahead + back
        long = length >= np.maximum(LEAST, TIMES * (j - i))
        found.append(np.stack([i - back, length, j - i], axis=1)[long])
    return np.unique(np.concatenate(found), axis=0)[:, :3] if n else np.zeros((0, 3), np.int64)


def repeated(ids: np.ndarray, own: np.ndarray, words: int, least: int) -> np.ndarray:
    """Which places lie in runs of so many words, within one owner, that come `least` times or more there (or more often: by hashed slots)."""
    out = np.zeros(len(ids), bool)
    n = len(ids) - words + 1
    if n <= 0:
        return out
    key = own[:n].astype(np.uint64) * MIX[1]
    for k in range(words):
        key = (key ^ ids[k : n + k].astype(np.uint64)) * MIX[0]
        key ^= key >> np.uint64(29)
    bits = max(8, int(4 * n).bit_length())
    slot = (key * MIX[1] >> np.uint64(64 - bits)).astype(np.int64)
    whole = own[:n] == own[words - 1 :]
    often = whole & (np.bincount(slot[whole], minlength=1 << bits)[slot] >= least)
    for k in range(words):
        out[k : n + k] |= often
    return out


def stretches(ids: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places that can lie in a run, and the number of the stretch that each is in. own: the text of each word."""
    places = np.arange(len(ids))
    while len(places):
        likely = repeated(ids, own, 3, 3) & repeated(ids, own, 5, 2)
        kept = np.flatnonzero(likely)
        new = np.cumsum((np.diff(kept, prepend=-2) != 1) | (np.diff(own[kept], prepend=-1) != 0)) - 1
        long = np.bincount(new, minlength=1)[new] >= LEAST if len(new) else np.zeros(0, bool)
        kept, new = kept[long], new[long]
        same = len(kept) == len(places)
        places, ids, own = places[kept], ids[kept], new
        if same:
            break
    return places, own


def find(ids: np.ndarray, own: np.ndarray) -> np.ndarray:
    """place, length and period of each run in texts laid end to end, by place and period."""
    places, stretch = stretches(ids, own)
    found = []
    edges = np.flatnonzero(np.diff(stretch, prepend=-1, append=-1))
    at = 0
    while at < len(edges) - 1:
        upto = max(at + 1, int(np.searchsorted(edges, edges[at] + GROUP, "right")) - 1)
        part = slice(edges[at], edges[upto])
        number = stretch[part] - np.searchsorted(edges[at:upto], edges[at:upto])[0]
        number = np.cumsum(np.diff(number, prepend=number[0]) != 0)
        spots = np.arange(len(number)) + number  # a symbol of its own after each stretch
        s = -1 - np.arange(len(number) + number[-1] + 1)
        s[spots] = ids[places[part]]
        runs = runs_of(s)
        back = np.zeros(len(s), np.int64)
        back[spots] = places[part]
        runs[:, 0] = back[runs[:, 0]]
        found.append(runs)
        at = upto
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def dropped(runs: np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie in a run after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:-1]) > 0


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words, of each tenth document (by a hash of its identifier) with a periodic end."""
    h = crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    root = words[a : a + p]
    return words[:a] + (root * (1 + (n - a) // p))[: n - a]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, rewrite: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed (the words that no run repeats, joined by spaces) of each row. `rewrite` changes the words first."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[bytes, int] = {}
            fresh = count()
            said = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = (text or "").encode().split()
                said.append(words if rewrite is None else rewrite(doc_id, words))
            sizes = np.array([len(w) for w in said])
            starts = np.cumsum(sizes) - sizes
            ids = np.concatenate([np.fromiter(map(known.setdefault, w, fresh), np.int64, len(w)) for w in said]) if len(said) else np.zeros(0, np.int64)
            found = find(ids, np.repeat(np.arange(len(said)), sizes))
            cuts = np.searchsorted(found[:, 0], np.append(starts, sizes.sum()))
            runs, collapsed = [], []
            for k, words in enumerate(said):
                own = found[cuts[k] : cuts[k + 1]] - (starts[k], 0, 0)
                runs.append([{"start": a, "length": b, "period": c} for a, b, c in own.tolist()])
                collapsed.append(b" ".join([w for w, gone in zip(words, dropped(own, len(words)).tolist()) if not gone] if len(own) else words).decode())
            shape = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(runs, shape), pa.array(collapsed, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind.simpleString()}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def strongest(runs: Column | str) -> Column:
    """The run that repeats most often, as an exact fraction; then that which starts first, then that with the smaller period."""

    def better(x: Column, y: Column) -> Column:
        a, b = x["length"] * y["period"], y["length"] * x["period"]
        return F.when(a != b, F.signum(b - a)).when(x["start"] != y["start"], F.signum(x["start"] - y["start"])).otherwise(F.signum(x["period"] - y["period"])).cast("int")

    return F.get(F.array_sort(runs, better), F.lit(0))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the strongest run (start, length, period, exponent_milli) and digests of all runs and of the collapsed text."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    best = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), strongest("runs").alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return best.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")

"""Near-duplicate documents by the chosen-path set similarity join.

A document's set is that of its distinct shingles of five words. Equal sets are joined first,
and one document stands for them. A minwise sketch of each set has 128 tokens. `trees` independent trees begin with all
sets in one node. A node picks, by its own hash, one or two of the sketch's positions (1 / similarity on average), and its
members branch by their tokens there. Nodes of at most `leaf` members are compared exhaustively by
finer sketches; larger ones branch again. Any two sets as similar as asked for are expected in as many children
of a node as in the node itself, while others thin out.

Only connections matter, so pairs inside a component that is known already are never looked at again. The
finer sketches tell which members of a small node have a likely partner there; these are compared on their full sets, in blocks of bounded bytes, and the node yields
a forest that spans its links. Each of these is confirmed on the shingles' words. (Equal sets are told by a name of 128 bits.) Large nodes are dealt out to small ones first, and yield the links of their members with the first one, which
connects most of a dense group. Large nodes whose members are all connected end there. Where few are left outside the largest component, or at
the greatest depth, these are compared with all of the node, in blocks; other nodes branch again. Nodes with the same members are compared once.

Null and empty texts, and texts without words, have empty sets and are linked with nothing. Rows
with a null identifier are linked with nothing, and their component is null. Rows that repeat an identifier share its component. The result
depends on no order of rows. Identifiers are cast to long; columns not named are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Scratch, cleared, ship
from . import filters, shingles
from .bpe import texts_of
from .components import components

EMPTY = pa.record_batch([pa.array([], pa.int64())] * 3, names=["node", "rep", "own"])
LEAF, DEPTH = 1024, 8
NODE_BYTES = 8 << 20  # texts of one node in a task: about twice as many at most, or two texts
MISS = 1e-4  # how many of the pairs at the threshold may meet in no tree, where nodes branch to the deepest level
SLACK = 0.06  # a pair is likely if its bins say so much less than asked for; 5 standard deviations at least


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, set_key and sketch (empty sets have neither) of each row."""

    def run(batches):
        for batch in batches:
            sizes, keys, made = [], [], []
            for text in texts_of(batch, "text"):
                first, second = shingles.halves(text)
                sizes.append(len(first))
                keys.append(shingles.set_key(first, second) if len(first) else None)
                made.append(shingles.sketch(first).tobytes() if len(first) else None)
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(made, pa.binary())], names=["doc_id", "n_shingles", "set_key", "sketch"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, sketch binary")


def branches(rows: DataFrame, similarity: float) -> DataFrame:
    """Children (node, rep) of rows (node, rep, sketch): by the tokens at the positions that the node's hash chooses."""
    place = lambda k: F.pmod(F.xxhash64("node", F.lit(k)), F.lit(shingles.SKETCH))
    child = lambda k: F.xxhash64("node", F.lit(k), F.substring("sketch", (4 * place(k) + 1).cast("int"), F.lit(4)))
    second = F.pmod(F.xxhash64("node", F.lit("second")), F.lit(1 << 20)) < (1 / similarity - 1) * (1 << 20)
    return rows.select("rep", F.explode(F.when(second, F.array(child(0), child(1))).otherwise(F.array(child(0)))).alias("node"))


def gathered(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Members (node, rep, n, lead) of nodes with two members at least; of nodes with equal members one stays."""
    nodes = rows.groupBy("node").agg(F.count("*").alias("n"), F.min("rep").alias("lead"), F.bit_xor(F.xxhash64("rep")).alias("x")).where("n > 1")
    nodes = scratch.write(nodes.groupBy("n", "lead", "x").agg(F.min("node").alias("node")).drop("x"), "nodes")
    return filters.build(nodes, "node").known(rows, "node").join(nodes, "node").select("node", "rep", "n", "lead")


def meets(similarity: float, level: int, agree: float | None = None) -> float:
    """How likely a pair stays together in some node of one tree that many levels down, if `agree` of its sketch's positions are equal (all that is asked for, by default)."""
    agree, second, lost = similarity if agree is None else agree, 1 / similarity - 1, 0.0
    for _ in range(level):
        line = 1 - agree + agree * lost
        lost = (1 - second) * line + second * line * line
    return 1 - lost


def missed(similarity: float, level: int, trees: int) -> float:
    """How many pairs at the threshold meet in none of the trees, over the spread of what one sketch, which all trees share, says of them."""
    n = shingles.SKETCH
    return sum(comb(n, k) * similarity**k * (1 - similarity) ** (n - k) * (1 - meets(similarity, level, k / n)) ** trees for k in range(n + 1))


def trees_for(similarity: float, depth: int = DEPTH) -> int:
    """The trees of which a pair at the threshold meets in one with 1 - MISS at the deepest level, depth + 1."""
    return 1 if similarity >= 1 else ceil(log(MISS) / log(1 - meets(similarity, depth + 1)))


def stars(members: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """Likely pairs of each member of a large node with its first one."""
    pairs = members.where("rep != lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    joined = pairs.join(reps.select(F.col("rep").alias("a"), F.col("wide").alias("x")), "a").join(reps.select(F.col("rep").alias("b"), F.col("wide").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, shingles.BINS) for i in (2, 3))
                yield batch.select([0, 1]).filter(pa.array(shingles.likeness(x, y) >= least))

    return joined.mapInArrow(run, "a long, b long")


def root(parent: dict[int, int], x: int) -> int:
    while parent.setdefault(x, x) != x:
        parent[x] = x = parent[parent[x]]
    return x


def by_node(batches, run) -> Iterator:
    """Calls run with the columns of each node's rows; batches hold nodes in order, the node first."""
    held: list[pa.RecordBatch] = []
    node = None
    for batch in batches:
        if not batch.num_rows:
            continue
        nodes = batch.column(0).to_numpy()
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(nodes)) + 1, [len(nodes)]))
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and nodes[a] != node:
                yield run(held)
                held = []
            node = nodes[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield run(held)


def promising(members: DataFrame, wide: DataFrame, own: DataFrame | None, least: float) -> DataFrame:
    """Members of small nodes that have a likely partner of another component there, by the bins."""
    rows = owned(packed(members.select("node", "rep")).join(wide, "rep"), own).select("rep", "own", "wide", F.inline("each")).select("node", "rep", "own", "wide")

    def of_node(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        mine = t.column("own").to_numpy()
        bins = np.frombuffer(b"".join(t.column("wide").to_pylist()), np.uint8).reshape(-1, shingles.BINS)
        keep = np.zeros(len(mine), bool)
        for i in range(len(mine) - 1):
            good = (shingles.likeness(bins[i], bins[i + 1 :]) >= least) & (mine[i + 1 :] != mine[i])
            if good.any():
                keep[i] = True
                keep[i + 1 :] |= good
        return t.select(["node", "rep", "own"]).filter(pa.array(keep)).combine_chunks().to_batches(max_chunksize=None)[0] if keep.any() else EMPTY

    return rows.repartition("node").sortWithinPartitions("node", "rep").mapInArrow(lambda b: by_node(b, of_node), "node long, rep long, own long")


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each two sets."""
    every = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, n = np.unique(every, return_inverse=True, return_counts=True)
    shared = n[place] > 1
    row, (_, place) = row[shared], np.unique(place[shared], return_inverse=True)
    out = np.zeros((len(sets), len(sets)), np.float64)
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    for at in range(0, int(place[-1]) + 1 if len(place) else 0, 8192):
        a, b = np.searchsorted(place, (at, at + 8192))
        m = np.zeros((len(sets), 8192), np.float32)
        m[row[a:b], place[a:b] - at] = 1
        out += m @ m.T
    return out.astype(np.int64)


def in_bytes(rows: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """The rows (node, rep, own) of small nodes; where a node's texts have more bytes than `most`, it is dealt out to nodes for each two of its blocks of so many bytes."""
    order = Window.partitionBy("node").orderBy("rep")
    block = F.floor((F.sum("bytes").over(order) - F.col("bytes")) / most).cast("int")
    blocks = rows.join(sizes, "rep").withColumn("block", block).withColumn("last", F.max("block").over(Window.partitionBy("node")))
    pair = lambda x: F.xxhash64("node", F.least("block", x), F.greatest("block", x))
    return blocks.select("rep", "own", F.explode(F.when(F.col("last") == 0, F.array("node")).otherwise(F.transform(F.sequence(F.lit(0), F.col("last")), pair))).alias("node"))


def links_of_node(held: list[pa.RecordBatch], percent: int) -> pa.RecordBatch:
    """A forest (a, b) that spans what is linked in a node (node, rep, own, text) and not connected yet. Pairs are found by the hashes of their full sets, and each link is confirmed on the shingles' words."""
    t = pa.Table.from_batches(held)
    reps, mine, said = t.column("rep").to_pylist(), t.column("own").to_pylist(), t.column("text")
    sets = [shingles.shingle_set(x.as_py()) for x in said]
    both, size = intersections(sets), np.array([len(s) for s in sets])
    i, j = np.nonzero(np.triu(100 * both >= percent * (size[:, None] + size[None, :] - both), 1))
    parent: dict[int, int] = {}
    links = []
    known, whole = None, set()
    for x, y in zip(i.tolist(), j.tolist()):
        p, q = root(parent, mine[x]), root(parent, mine[y])
        if p != q:
            if known != x:
                known, whole = x, shingles.word_shingles(said[x].as_py())
            if shingles.alike(whole, shingles.word_shingles(said[y].as_py()), percent):
                parent[max(p, q)] = min(p, q)
                links.append((reps[x], reps[y]))
    return pa.record_batch([pa.array([k[c] for k in links], pa.int64()) for c in (0, 1)], names=["a", "b"])


def linked(rows: DataFrame, texts: DataFrame, percent: int, most: int) -> DataFrame:
    """Links inside small nodes."""
    joined = in_bytes(rows, texts.groupBy("rep").agg(F.sum(F.octet_length("text")).alias("bytes")), most).join(texts, "rep").select("node", "rep", "own", "text")
    return joined.repartition("node").sortWithinPartitions("node", "rep").mapInArrow(lambda b: by_node(b, lambda held: links_of_node(held, percent)), "a long, b long")


def packed(rows: DataFrame) -> DataFrame:
    """One row for each rep, with what else its rows hold in `each`: a rep stands in few nodes (by trees and depth), so joins on it are made once, not once a node."""
    return rows.groupBy("rep").agg(F.collect_list(F.struct(*[c for c in rows.columns if c != "rep"])).alias("each"))


def owned(reps: DataFrame, own: DataFrame | None) -> DataFrame:
    """Adds each rep's component so far."""
    if own is None:
        return reps.withColumn("own", F.col("rep"))
    return reps.join(own.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("own", F.coalesce("component", "rep")).drop("component")


def with_own(rows: DataFrame, own: DataFrame | None) -> DataFrame:
    """Adds the component so far of each row's rep."""
    return owned(packed(rows), own).select("rep", "own", F.inline("each"))


def undecided(members: DataFrame, own: DataFrame) -> DataFrame:
    """Members of nodes that still hold different components."""
    mixed = with_own(members, own).groupBy("node").agg(F.min("own").alias("p"), F.max("own").alias("q")).where("p != q").select("node")
    return members.join(mixed, "node", "left_semi")


def in_blocks(members: DataFrame, leaf: int) -> DataFrame:
    """A quarter of the large nodes dealt out to small ones by a hash, each member to one. Dense groups stand in many nodes and connect by these; whatever is left is compared later."""
    block = F.pmod(F.xxhash64("rep", "node"), F.ceil(F.col("n") / leaf))
    return members.where(F.pmod("node", F.lit(4)) == 0).select(F.xxhash64("node", F.lit("block"), block).alias("node"), "rep")


def with_main(members: DataFrame, own: DataFrame, scratch: Scratch) -> DataFrame:
    """Members of large nodes that hold different components, with their own one, the node's largest (main) and how many are in others. Counts only, so no node is gathered."""
    rows = scratch.write(with_own(members, own), "own")
    sizes = rows.groupBy("node", "own").agg(F.count("*").alias("c"))
    nodes = sizes.groupBy("node").agg(F.max(F.struct("c", "own")).alias("m"), F.sum("c").alias("all"))
    return rows.join(nodes.select("node", F.col("m.own").alias("main"), (F.col("all") - F.col("m.c")).alias("others")).where("others > 0"), "node")


def against_all(rows: DataFrame, leaf: int) -> DataFrame:
    """Small nodes that bring each member outside a large node's main component together with each other member: one for each block of all and block of these."""
    half = leaf // 2
    alls, others = F.ceil(F.col("n") / half).cast("int"), F.ceil(F.col("others") / half).cast("int")
    i, j = F.pmod(F.xxhash64("rep"), alls.cast("long")).cast("int"), F.pmod(F.xxhash64("rep", F.lit("other")), others.cast("long")).cast("int")
    each = rows.select("node", "rep", i.alias("i"), F.explode(F.sequence(F.lit(0), others - 1)).alias("j"))
    outside = rows.where("own != main").select("node", "rep", F.explode(F.sequence(F.lit(0), alls - 1)).alias("i"), j.alias("j"))
    return each.unionByName(outside).select(F.xxhash64("node", F.lit("all"), "i", "j").alias("node"), "rep").distinct()


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough: 100 * intersection >= percent * union."""
    joined = pairs.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("rep").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches):
        for batch in batches:
            keep = [shingles.alike(shingles.word_shingles(x.as_py()), shingles.word_shingles(y.as_py()), percent) for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(run, "a long, b long")


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, frames)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, percent: int = 80, trees: int | None = None, leaf: int = LEAF, depth: int = DEPTH, most_bytes: int = NODE_BYTES) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept. The trees follow from the similarity and the depth, unless given."""
    ship(docs.sparkSession)
    scratch, similarity = Scratch(docs.sparkSession), percent / 100
    least = max(0.0, similarity - SLACK)
    trees = trees or trees_for(similarity, depth)
    every = scratch.write(sketches(docs, id_col, text_col), "sketches")
    some = every.where("set_key is not null and doc_id is not null")
    reps = scratch.write(some.groupBy("set_key").agg(F.min(F.struct("doc_id", "sketch")).alias("m")).select("set_key", F.col("m.doc_id").alias("rep"), F.col("m.sketch").alias("sketch")), "reps")
    grown = branches(reps.withColumn("tree", F.explode(F.sequence(F.lit(1), F.lit(trees)))).withColumn("node", F.xxhash64("tree")), similarity)
    members = scratch.write(gathered(grown, scratch), "members")
    named = scratch.write(reps.select("set_key", "rep"), "named")
    scratch.drop(reps)
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).cast("string").alias("text"))
    near = scratch.write(finer(filters.build(members, "rep").known(texts, "rep")), "near")
    wide = near.select("rep", "wide")
    own: DataFrame | None = None

    def connect(members: DataFrame, pairs: DataFrame | None = None) -> None:
        """Finds the links inside small nodes, confirms pairs, and adds both to the components."""
        nonlocal own
        rows = scratch.write(promising(members, wide, own, least), "promising")
        ids, used = rows.select("rep"), [rows]
        if pairs is not None:
            pairs = scratch.write(pairs, "pairs")
            ids, used = ids.unionAll(pairs.select(F.explode(F.array("a", "b")))), [rows, pairs]
        said = scratch.write(filters.build(ids, "rep").known(texts, "rep"), "texts")
        links = linked(rows, said, percent, most_bytes)
        links = scratch.write(links if pairs is None else links.unionAll(confirmed(pairs, said, percent)), "confirmed")
        scratch.drop(said, *used)
        if own is None:
            own = components(links, scratch)
        elif not links.isEmpty():
            before = own
            own = components(links.unionAll(before.select(F.col("id").alias("a"), F.col("component").alias("b"))), scratch)
            scratch.drop(before)
        scratch.drop(links)

    small, large = members.where(F.col("n") <= leaf), members.where(F.col("n") > leaf)
    connect(small.select("node", "rep").unionAll(in_blocks(large, leaf)), stars(large, wide, least))
    leaves, frontier = [], large
    for level in range(depth + 1):
        frontier = scratch.write(with_main(frontier, own, scratch), "large")
        if frontier.isEmpty():
            break
        ends = F.lit(level == depth) | (F.col("others") <= leaf)
        leaves.append(against_all(frontier.where(ends), leaf))
        grown = scratch.write(gathered(branches(frontier.where(~ends).join(near.select("rep", "sketch"), "rep"), similarity), scratch), "members")
        leaves.append(undecided(grown.where(F.col("n") <= leaf), own).select("node", "rep"))
        frontier = grown.where(F.col("n") > leaf)
    if leaves:
        connect(union(leaves))

    scratch.keep(every, named, own)
    found = owned(named, own).select("set_key", F.col("own").alias("found"))
    joined = every.join(found, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def finer(texts: DataFrame) -> DataFrame:
    """rep, sketch and wide (the bins) of each text."""

    def run(batches):
        for batch in batches:
            made, wide = [], []
            for text in texts_of(batch, "text"):
                hashes = shingles.shingle_set(text)
                made.append(shingles.sketch(hashes).tobytes())
                wide.append(shingles.bins(hashes).tobytes())
            yield pa.record_batch([batch.column(0), pa.array(made, pa.binary()), pa.array(wide, pa.binary())], names=["rep", "sketch", "wide"])

    return texts.mapInArrow(run, "rep long, sketch binary, wide binary")


def told_apart(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> tuple[DataFrame, str]:
    """The rows with one more column, and its name: the identifier, but a hash of 62 bits with the next one set for all texts of a repeated identifier save one."""
    name, said, first = (filters.fresh(docs, x) for x in ("__id", "__text", "__first"))
    own, text = F.col(id_col).cast("long"), F.sha2(F.col(text_col).cast("string"), 256)
    again = scratch.write(docs.where(own.isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("n")).where("n > 1").select("id"), "again")
    if again.isEmpty():
        return docs.withColumn(name, own), name
    again = again.withColumnRenamed("id", id_col)
    some, others = filters.build(again, id_col).split(docs, id_col)
    some = some.withColumn(said, F.coalesce(text, F.lit("")))
    least = scratch.write(some.join(again, id_col, "left_semi").groupBy(id_col).agg(F.min(said).alias(first)), "first")
    other = F.xxhash64(own, F.col(said)).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    some = some.join(least, id_col, "left").withColumn(name, F.when(F.col(said) != F.col(first), other).otherwise(own))
    return others.withColumn(name, own).unionByName(some.select(*docs.columns, name)), name


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows that stay, with all their columns, whatever their names: one identifier of each component. Texts that share an identifier are told apart."""
    scratch = Scratch(docs.sparkSession)
    rows, name = told_apart(docs, id_col, text_col, scratch)
    with cleared():
        dropped = scratch.write(near_dedup(rows, name, text_col, **options).where("not kept").select(F.col("doc_id").alias(name)), "dropped")
    return filters.without(rows, name, dropped).select(*docs.columns)

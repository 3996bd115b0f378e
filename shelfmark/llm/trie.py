"""The trie of conversation prefixes, and sums over its subtrees by centroid decomposition.

Each distinct sequence of the first d turns is a node, named by a chain of SHA-256 digests over its turns. Conversations that start with it are its members, and the smallest of them names it.

Members never grow in number from a node to its children. So nodes fall into bands by the power of FAN that holds their members, and a band into pieces: connected parts, each with a top
node; they are also cut where the depth passes a multiple of BLOCK. As the nodes of one depth share no members, a piece has fewer than FAN nodes of a depth, and fewer than
FAN * BLOCK in all, whatever the data. Nodes with one member need no piece: they lead to one leaf and save nothing.

Pieces are rolled up from the lowest band on, those of a band in parallel, and their tops' totals go to the nodes above. In a piece the forest of parent edges is decomposed by
centroids: a component's centroid splits it into the part above and those below its children; the total of what hangs at the centroid within the component is added along the path from
it to the component's top; and each part goes on by itself. So each node gets its subtree's total in O(n log n) additions however deep the piece.

A conversation's turns are ordered in one task (Spark sorts them outside memory), and only their digests are chained there, one after the other. Rows are ordered by turn (null first), then role, then text; null
roles and texts count as empty, repeated rows are turns of their own. Rows without a conversation are left out. Other columns are not read. An empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Scratch, ship
from .chat import rows_of

FAN, BLOCK = 256, 4096
ROOT = hashlib.sha256(b"").digest()
NONE = hashlib.sha256(b"").hexdigest()
GROUP, TURNS = 5, 9  # conversations that share a start, and one more than the turns they share at most


def ordered(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, place (from 1), said (a digest of role and text) and size (of the text, in UTF-8) of each turn."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text"))
    said = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    return rows.select("conv_id", place.cast("long").alias("place"), said.alias("said"), F.octet_length("text").cast("long").alias("size"))


def grafted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that start alike: of each conversation c the first turns are those of c - c % GROUP, as many as a hash of c says (fewer than TURNS). Rows as `ordered` gives them; and conv_id and the number of turns of every conversation."""
    shared = (F.crc32(F.col("conv_id").cast("string")) % TURNS).cast("long")
    own = rows.groupBy("conv_id").agg(F.count("*").alias("own"))
    hosts = own.select(F.col("conv_id").alias("host"), F.col("own").alias("there"))
    convs = own.withColumn("h", shared).withColumn("host", F.col("conv_id") - F.col("conv_id") % GROUP).join(hosts, "host", "left")
    convs = convs.select("conv_id", "host", "h", "own", F.least("h", F.coalesce("there", F.lit(0).cast("long"))).alias("taken"))
    first = rows.where(F.col("place") < TURNS).withColumnRenamed("conv_id", "host")
    start = convs.join(first, "host").where("place <= h").select("conv_id", "place", "said", "size")
    end = rows.join(convs.select("conv_id", "h", "taken"), "conv_id").where("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "said", "size")
    return start.unionAll(end), convs.select("conv_id", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("turns"))


def chained(rows: DataFrame) -> DataFrame:
    """conv_id, depth, key and parent (digests of the turns up to here, and up to the one before), size, and whether it is the conversation's last turn."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, key, held = None, ROOT, None
        for batch in batches:
            out = [] if held is None else [held]
            for c, depth, said, size in zip(*(col.to_pylist() for col in batch.columns)):
                if c != conv:
                    if out:
                        out[-1][-1] = True
                    conv, key = c, ROOT
                before, key = key, hashlib.sha256(key + said).digest()
                out.append([c, depth, key, before, size, False])
            held = out.pop() if out else None
            if out:
                yield batch_of(out)
        if held is not None:
            held[-1] = True
            yield batch_of([held])

    names = ("conv_id", "depth", "key", "parent", "size", "last")
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_())
    batch_of = lambda rows: pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
    rows = rows.select("conv_id", "place", "said", "size").repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return rows.mapInArrow(run, "conv_id long, depth long, key binary, parent binary, size long, last boolean")


def joined_ids(ends: DataFrame) -> DataFrame:
    """key and ends_sha256: the digest of the conversations (conv_id) under each key, ascending, joined by commas. They stream through in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, found = [], []
        for key, rows in itertools.groupby(rows_of(batches), key=lambda r: r[0]):
            sha, comma = hashlib.sha256(), b""
            for _, conv in rows:
                sha.update(comma + b"%d" % conv)
                comma = b","
            keys.append(key)
            found.append(sha.hexdigest())
            if len(keys) == 2000:
                yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(found)], names=["key", "ends_sha256"])
                keys, found = [], []
        if keys:
            yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(found)], names=["key", "ends_sha256"])

    return ends.select("key", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(run, "key binary, ends_sha256 string")


def subtree_sums(parent: list[int], values: list[tuple[int, ...]]) -> list[list[int]]:
    """Of each node of a forest the sums of the values in its subtree, by centroid decomposition. Roots have parent -1."""
    kids: list[list[int]] = [[] for _ in parent]
    tops = []
    for v, p in enumerate(parent):
        (tops if p < 0 else kids[p]).append(v)
    width = range(len(values[0])) if values else ()
    sums, there = [[0] * len(width) for _ in parent], [True] * len(parent)
    while tops:
        top = tops.pop()
        component = [top]
        for v in component:
            component += [c for c in kids[v] if there[c]]
        size: dict[int, int] = {}
        for v in reversed(component):
            size[v] = 1 + sum(size[c] for c in kids[v] if there[c])
        centroid = top
        while heavy := next((c for c in kids[centroid] if there[c] and 2 * size[c] > len(component)), None):
            centroid = heavy
        below = [centroid]
        for v in below:
            below += [c for c in kids[v] if there[c]]
        total = [sum(values[v][k] for v in below) for k in width]
        v = centroid
        while True:  # from the centroid to the top
            for k in width:
                sums[v][k] += total[k]
            if v == top:
                break
            v = parent[v]
        there[centroid] = False
        tops += [c for c in kids[centroid] if there[c]]
        if centroid != top:
            tops.append(top)
    return sums


def rolled_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, leaves and saved of the nodes of whole pieces, which come one after the other (piece, key, parent, leaves, saved)."""
    out: list[tuple] = []
    for _, rows in itertools.groupby(rows_of(batches), key=lambda r: r[0]):
        rows = list(rows)  # a piece is of bounded size
        place = {r[1]: k for k, r in enumerate(rows)}
        sums = subtree_sums([place.get(r[2], -1) for r in rows], [r[3:] for r in rows])
        out += [(r[1], *s) for r, s in zip(rows, sums)]
        while len(out) >= 2000:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out[:2000]), (pa.binary(), pa.int64(), pa.int64()))], names=["key", "leaves", "saved"])
            del out[:2000]
    if out:
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), (pa.binary(), pa.int64(), pa.int64()))], names=["key", "leaves", "saved"])


def band(members: Column, fan: int) -> Column:
    """0 for one member, k for at most fan ** k."""
    return sum(((members > F.lit(fan**k)).cast("int") for k in range(1, 64) if fan**k < 1 << 62), (members > 1).cast("int"))


def rollup(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """key, parent, leaves and saved over the subtrees of shared nodes. nodes: key, parent, piece, band, block, leaves and saved of its own; written by block and band."""
    order = sorted(((r.block, r.band) for r in nodes.select("block", "band").distinct().collect()), key=lambda x: (-x[0], x[1]))  # at most 62 bands for each BLOCK of depth
    done: DataFrame | None = None
    for block, level in order:
        part = nodes.where((F.col("block") == block) & (F.col("band") == level)).select("piece", "key", "parent", "leaves", "saved")
        if done is not None:
            came = done.where("top").groupBy(F.col("parent").alias("key")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
            part = part.join(came, "key", "left").select("piece", "key", "parent", (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"))
        part = part.repartition("piece").sortWithinPartitions("piece")
        sums = part.mapInArrow(rolled_up, "key binary, leaves long, saved long")
        own = nodes.where((F.col("block") == block) & (F.col("band") == level)).select("key", "parent", (F.col("piece") == F.col("key")).alias("top"))
        new = scratch.write(sums.join(own, "key"), "sums")
        done = new if done is None else done.unionAll(new)
    return done


def prefix_trie(rows: DataFrame, conversations: DataFrame, *, fan: int = FAN, block: int = BLOCK) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of each node. rows: as `ordered` gives them; conversations: conv_id and turns of each, also of those without turns."""
    spark = rows.sparkSession
    scratch = Scratch(spark)
    paths = scratch.write(chained(rows), "paths")
    nodes = paths.groupBy("key").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.first("size").alias("size"))
    nodes = scratch.write(nodes, "nodes")
    root = scratch.write(conversations.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0"), "root")
    kids = scratch.write(nodes.groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("single")), "kids")

    # where each conversation's nodes stand: their parents, and the tops of their pieces
    own = Window.partitionBy("conv_id").orderBy("depth")
    told = paths.select("conv_id", "depth", "key").join(nodes.select("key", "n_convs", F.col("conv_id").alias("of")), "key").withColumn("band", band(F.col("n_convs"), fan)).withColumn("block", F.floor(F.col("depth") / block))
    told = told.withColumn("parent_conv_id", F.lag("of").over(own)).withColumn("piece", F.first("key").over(Window.partitionBy("conv_id", "band", "block").orderBy("depth")))
    told = told.where("of = conv_id").select("key", "band", "block", "parent_conv_id", "piece")
    full = nodes.join(told, "key").join(kids, "key", "left").select(
        "key", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "piece", "band", "block",
        (F.coalesce("single", F.lit(0)) + F.when(F.col("n_children").isNull(), 1).otherwise(0)).alias("leaves"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved"),
    )
    full = scratch.write(full, "full")
    shared = scratch.write(full.where("n_convs > 1").select("key", "parent", "piece", "band", "block", "leaves", "saved"), "shared", "block", "band")
    sums = rollup(shared, scratch)
    empty = spark.createDataFrame([], "key binary, leaves long, saved long, parent binary, top boolean")
    sums = empty if sums is None else sums.select("key", "leaves", "saved", "parent", "top")

    turnless = conversations.where("turns = 0").select(F.lit(ROOT).alias("key"), "conv_id")
    ends = joined_ids(paths.where("last").select("key", "conv_id").unionAll(turnless))
    name = root.select(F.col("conv_id").alias("root_conv_id"))
    above = sums.where(F.col("top") & (F.col("parent") == F.lit(ROOT))).agg(F.coalesce(F.sum("leaves"), F.lit(0)).alias("leaves"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved"))
    at_root = kids.where(F.col("key") == F.lit(ROOT)).agg(F.coalesce(F.sum("n_children"), F.lit(0)).alias("n_children"), F.coalesce(F.sum("single"), F.lit(0)).alias("single"))
    top = root.crossJoin(above).crossJoin(at_root).select(  # one row each
        F.lit(ROOT).alias("key"), "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children",
        F.when(F.col("n_children") == 0, 1).otherwise(F.col("leaves") + F.col("single")).cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
    )
    rest = full.select("key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children").join(sums.select("key", "leaves", "saved"), "key", "left").crossJoin(name)
    rest = rest.select("key", "conv_id", "depth", F.when(F.col("depth") == 1, F.col("root_conv_id")).otherwise(F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs", "n_children", F.coalesce("leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved", F.lit(0)).alias("saved_tokens"))
    out = rest.unionByName(top).join(ends, "key", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NONE)).alias("ends_sha256"))

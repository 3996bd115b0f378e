import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from shelfmark.llm.trie import grafted, ordered, prefix_trie, subtree_sums


def plain(conversations):
    """The rows of the trie, node by node. conversations: turns (role, text) by conversation."""
    nodes = defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for path in nodes:
        if path:
            kids[path[:-1]].append(path)
    rows = []
    for path, members in nodes.items():
        below, leaves, saved = [path], 0, 0
        for p in below:
            below += kids[p]
            leaves += not kids[p]
            saved += (len(nodes[p]) - 1) * len(p[-1][1].encode()) if p else 0
        ends = ",".join(map(str, sorted(c for c in members if len(conversations[c]) == len(path))))
        rows.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(kids[path]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows)


def turns_by_conversation(rows):
    out = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            out[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(ts)] for c, ts in out.items()}


def rebuilt(conversations):
    out = {}
    for c, turns in conversations.items():
        h = zlib.crc32(str(c).encode()) % 9
        host = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = conversations.get(host, [])[:h] + turns[h:]
    return out


def random_rows(rng, most):
    rows = []
    for c in rng.sample(range(-12, 60), 45):
        for t in range(rng.randrange(1, most)):
            rows.append((c, rng.choice([t, t, t, None, 2]), rng.choice(["u", "a", None, "ü"]), rng.choice(["x", "", None, "yö", "x"])))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, said int, depth int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("fan, block, most", [(256, 4096, 9), (2, 3, 12), (3, 1, 4)])
def test_against_a_plain_trie(spark, fan, block, most):
    rows = random_rows(random.Random(fan), most) + [(None, 1, "u", "lost")]
    turns = ordered(frame(spark, rows))
    got = prefix_trie(*grafted(turns), fan=fan, block=block)
    assert sorted(map(tuple, got.collect())) == plain(rebuilt(turns_by_conversation(rows)))
    if most == 12:
        alone = turns.groupBy("conv_id").count().withColumnRenamed("count", "turns")
        assert sorted(map(tuple, prefix_trie(turns, alone, fan=fan, block=block).collect())) == plain(turns_by_conversation(rows))


def test_deep_and_wide(spark):
    """Two copies of a long conversation, many that part at once, and many that are the same."""
    rows = [(c, t, "u", f"{t % 7}") for c in (3, 4) for t in range(600)] + [(100 + c, 0, "u", f"own {c}") for c in range(300)] + [(1000 + c, 0, "a", "same") for c in range(300)]
    turns = ordered(frame(spark, rows))
    counts = turns.groupBy("conv_id").count().withColumnRenamed("count", "turns")
    assert sorted(map(tuple, prefix_trie(turns, counts, fan=16, block=256).collect())) == plain(turns_by_conversation(rows))


def test_turnless_and_empty(spark):
    only = next(c for c in range(1, 500) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)  # shares more turns than it has with a conversation that is not there
    got = prefix_trie(*grafted(ordered(frame(spark, [(only, 1, "u", "x")])))).collect()
    assert [tuple(r) for r in got] == [(only, 0, None, 1, 0, 1, 0, hashlib.sha256(str(only).encode()).hexdigest())]
    assert prefix_trie(*grafted(ordered(frame(spark, [])))).count() == 0


def test_subtree_sums():
    rng = random.Random(2)
    for n in (0, 1, 2, 3, 50, 400):
        for bend in (1, 3, n or 1):
            parent = [-1 if i == 0 or rng.random() < 0.02 else max(0, i - rng.randrange(1, bend + 1)) for i in range(n)]
            values = [(rng.randrange(9), 1) for _ in range(n)]
            want = [list(v) for v in values]
            for i in reversed(range(n)):
                if parent[i] >= 0:
                    want[parent[i]] = [a + b for a, b in zip(want[parent[i]], want[i])]
            assert subtree_sums(parent, values) == want
    path = subtree_sums([i - 1 for i in range(20000)], [(1,)] * 20000)
    assert path[0] == [20000] and path[-1] == [1]

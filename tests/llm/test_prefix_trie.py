"""The prefix trie against nodes counted one by one, with shards so small that most nodes are shared."""
import hashlib
import random
import zlib

import numpy as np
import pytest

SCHEMA = "conv_id long, turn long, role string, text string, path int, key string"


def brute(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    nodes = {}
    full = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple(own.get(c - c % 100, [])[:h] + mine[h:])
        full[c] = path
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append(c)
    kids = {p: [q for q in nodes if len(q) == len(p) + 1 and q[:len(p)] == p] for p in nodes}
    out = set()
    for p, members in nodes.items():
        below = [q for q in nodes if q[:len(p)] == p]
        ends = ",".join(str(c) for c in sorted(members) if full[c] == p)
        out.add((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids[p]), sum(not kids[q] for q in below),
                 sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in below if q), hashlib.sha256(ends.encode()).hexdigest()))
    return out


def conversations():
    r = random.Random(3)
    rows = []
    for c in range(230):
        if c in (100, 7):
            continue
        for t in range(r.randrange(0, 9)):
            text = r.choice(["hello", "hello", "hello", "so?", "é😀", None, ""]) if t < 3 else r.choice(["a", "b", "yes, indeed"])
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", text, 1, "x"))
    rows += [(c, t, None, "same", 1, "x") for c in range(500, 560) for t in range(8)]
    rows += [(600, t, "user", str(t % 3), 1, "x") for t in range(120)] + [(601, t, "user", str(t % 3), 1, "x") for t in range(120)]
    rows += [(None, 0, "user", "nobody", 1, "x"), (7, None, "system", "first", 1, "x"), (7, 0, "user", "second", 1, "x"), (7, 0, "user", "second", 1, "x"), (300, 3, None, None, 1, "x")]
    return rows


@pytest.mark.parametrize(("shard_turns", "fan"), [(100_000, 64), (40, 2), (300, 3)])
def test_nodes_match_brute_force(spark, shard_turns, fan):
    from newsgauge.llm.prefix_trie import rebuilt, trie_nodes
    rows = conversations()
    got = trie_nodes(rebuilt(spark.createDataFrame(rows, SCHEMA)), shard_turns, fan).collect()
    want = brute(rows)
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_no_conversations(spark):
    from newsgauge.llm.prefix_trie import rebuilt, trie_nodes
    empty = spark.createDataFrame([], SCHEMA)
    assert trie_nodes(rebuilt(empty)).collect() == []
    one = spark.createDataFrame([(5, 0, "user", "x", 1, "y")], SCHEMA)
    assert {tuple(r) for r in trie_nodes(rebuilt(one)).collect()} == brute([(5, 0, "user", "x")])


def test_double_array_keeps_children_apart():
    from newsgauge.llm.prefix_trie import DoubleArray
    r = random.Random(8)
    paths = sorted({tuple(r.randrange(1, 9) for _ in range(r.randrange(6))) for _ in range(400)})
    codes, lens = np.array([c for p in paths for c in p], np.int64), np.array([len(p) for p in paths])
    trie = DoubleArray(codes, lens)
    states, at, seen = trie.walk(codes, lens), 0, {}
    for p in paths:
        for d in range(len(p) + 1):
            assert seen.setdefault(p[:d], states[at + d]) == states[at + d]
        at += len(p) + 1
    assert len(set(seen.values())) == len(seen)
    with pytest.raises(ValueError):
        trie.walk(np.array([9, 9, 9]), np.array([3]))


def test_slots_stay_near_the_number_of_nodes():
    """Thousands of states with several children each, as hot first turns give."""
    import pyarrow as pa
    from newsgauge.llm.prefix_trie import DoubleArray, level_codes
    r = random.Random(1)
    paths = sorted([f"a{r.randrange(3000)}".encode(), f"b{r.randrange(10 ** 6)}".encode(), f"c{r.randrange(5)}".encode()] for _ in range(20_000))
    lens = np.full(len(paths), 3)
    codes = level_codes(pa.array([k for p in paths for k in p]), lens)
    trie = DoubleArray(codes, lens)
    nodes = len({tuple(p[:d]) for p in paths for d in range(4)})
    assert len(np.unique(trie.walk(codes, lens))) == nodes and len(trie.check) < 2 * nodes + len(paths)

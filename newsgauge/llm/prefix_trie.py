"""Conversation prefix trie: what conversations share from their first turn on, by double-array tries over shards of sorted conversations.

Conversations that are the same throughout are one path with a count. Paths are ranged by their turns, so a shard holds neighbours in that
order and a hot first turn is spread over many shards. A shard numbers its turns densely, packs a double-array trie (the child of
state s by turn code c is the state BASE[s] + c, if CHECK there is s) and walks it for its nodes. Only nodes on a shard's first and last path can be in
other shards too. Those two paths go on, with the sums of what hangs off them, to a trie over many shards' paths, and so on until one trie is left.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsgauge.session import cut_point

SHARD_TURNS = 100_000      # turns of a shard, about
FAN = 64                   # shards whose outer paths meet in one trie
BLOCK_BITS = 12            # conversations that end alike are listed in blocks of 2^12 ids
WINDOW = 512               # slots that are tried at a time for the children of a state
NEVER = np.iinfo(np.int64).max
STRAND = "path array<binary>, lens array<long>, n array<long>, conv array<long>, leaves array<long>, saved array<long>, kids array<long>, ends array<string>"
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, key binary, up binary"
BOTH = f"shard int, side int, {STRAND}, {NODE}"
NO_ONE = hashlib.sha256(b"").hexdigest()


class DoubleArray:
    """BASE and CHECK over dense turn codes from 1 on; state 0 is the root."""

    def __init__(self, codes: np.ndarray, lens: np.ndarray):
        self.base, self.check, self.low = np.zeros(1, np.int64), np.full(1, -2, np.int64), 1
        starts, state = np.cumsum(lens) - lens, np.zeros(len(lens), np.int64)
        wide = int(codes.max(initial=0)) + 1
        for d in range(int(lens.max(initial=0))):
            on = np.flatnonzero(lens > d)
            code = codes[starts[on] + d]
            pairs = np.unique(state[on] * wide + code)
            self.place(pairs // wide, pairs % wide)
            state[on] = self.base[state[on]] + code

    def grow(self, size: int) -> None:
        if size > len(self.base):
            more = max(size, len(self.base) * 5 // 4) - len(self.base)
            self.base, self.check = np.append(self.base, np.zeros(more, np.int64)), np.append(self.check, np.full(more, -1, np.int64))

    def place(self, parents: np.ndarray, codes: np.ndarray) -> None:
        """Give each of these parents, none of which has children yet, slots for all its children (sorted by parent)."""
        open_slots = np.flatnonzero(self.check[self.low:] == -1)
        self.low = self.low + int(open_slots[0]) if len(open_slots) else len(self.check)
        first = np.flatnonzero(np.append(True, parents[1:] != parents[:-1]))
        sizes = np.diff(np.append(first, len(parents)))
        scan = self.low
        for a, n in zip(first[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            mine = codes[a:a + n] - codes[a]
            while True:                                                      # what a window has no room for is left to only children
                self.grow(scan + WINDOW + int(mine[-1]) + 1)
                free = scan + np.flatnonzero(self.check[scan:scan + WINDOW] == -1)
                fits = free[(self.check[free[:, None] + mine] == -1).all(axis=1)]
                if len(fits):
                    break
                scan += WINDOW
            x = int(fits[0])
            self.base[parents[a]] = x - codes[a]
            self.check[x + mine] = parents[a]
        alone = first[sizes == 1]                                            # an only child fits into any slot
        free = self.low + np.flatnonzero(self.check[self.low:] == -1)
        if len(free) < len(alone):
            self.grow(len(self.check) + len(alone) - len(free))
            free = self.low + np.flatnonzero(self.check[self.low:] == -1)
        free = free[:len(alone)]
        self.base[parents[alone]] = free - codes[alone]
        self.check[free] = parents[alone]

    def walk(self, codes: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """The states along each path, the root included: one after the other, a path's len + 1 of them."""
        starts, ends = np.cumsum(lens) - lens, np.cumsum(lens + 1) - lens - 1
        states, state = np.zeros(int((lens + 1).sum()), np.int64), np.zeros(len(lens), np.int64)
        for d in range(int(lens.max(initial=0))):
            on = np.flatnonzero(lens > d)
            to = self.base[state[on]] + codes[starts[on] + d]
            if not (self.check[to] == state[on]).all():
                raise ValueError("a path that the trie does not hold")
            state[on] = to
            states[ends[on] + d + 1] = to
        return states


def chained(path: list[bytes]) -> list[bytes]:
    """A name for each node along a path that depends on all turns up to it."""
    out = [b""]
    for k in path:
        out.append(hashlib.sha256(out[-1] + k).digest()[:16])
    return out


def level_codes(keys: pa.Array, lens: np.ndarray) -> np.ndarray:
    """Dense codes from 1 on, given level by level: turns that follow the same path get neighbouring codes, which pack tightly."""
    order = np.argsort(np.arange(len(keys)) - np.repeat(np.cumsum(lens) - lens, lens), kind="stable")
    codes = np.empty(len(keys), np.int64)
    codes[order] = keys.take(pa.array(order)).dictionary_encode().indices.to_numpy() + 1
    return codes


def flat(column: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    return column.flatten(), np.diff(column.offsets.to_numpy())


def merged(t: pa.Table, shard: int, last_round: bool, named: bool) -> pa.Table:
    """The nodes that no other shard has, and the first and last path with what they still lack. Rows are in the order of their paths.

    `named` tells that the nodes may be asked for by their names, which holds for all that came from an outer path.
    """
    keys, lens = flat(t.column("path").combine_chunks())
    col = {c: flat(t.column(c).combine_chunks())[0].to_numpy() for c in ("n", "conv", "leaves", "saved", "kids")}
    codes = level_codes(keys, lens)
    trie = DoubleArray(codes, lens)
    states = trie.walk(codes, lens)
    size = len(trie.base)
    begin = np.cumsum(lens + 1) - lens - 1
    depth = np.zeros(size, np.int64)
    depth[states] = np.arange(len(states)) - np.repeat(begin, lens + 1)
    chars = np.zeros(size, np.int64)
    inner = np.ones(len(states), bool)
    inner[begin] = False
    chars[states[inner]] = flat(t.column("lens").combine_chunks())[0].to_numpy()
    n, leaves, saved, kids, conv = (np.zeros(size, np.int64) for _ in range(5))
    for into, c in ((n, "n"), (leaves, "leaves"), (saved, "saved"), (kids, "kids")):
        np.add.at(into, states, col[c])
    conv[:] = NEVER
    np.minimum.at(conv, states, col["conv"])
    ends: dict[int, str] = {}
    for s, e in zip(states.tolist(), flat(t.column("ends").combine_chunks())[0].to_pylist(), strict=True):
        if e is not None:
            ends[s] = e
    outer = [states[begin[k]:begin[k] + lens[k] + 1] for k in sorted({0, t.num_rows - 1})]
    done = np.zeros(size, bool)
    done[states] = True
    if not last_round:
        for o in outer:
            done[o] = False
    every = np.unique(states)
    every = every[np.argsort(-depth[every], kind="stable")]
    edge = np.flatnonzero(np.append(True, np.diff(depth[every]) != 0))
    for a, z in zip(edge, [*edge[1:], len(every)], strict=True):             # from the deepest level up; what is done is added to the parent
        mine = every[a:z]
        mine = mine[done[mine]]
        leaves[mine] += kids[mine] == 0
        saved[mine] += (n[mine] - 1) * chars[mine]
        below = mine[depth[mine] > 0]
        up = trie.check[below]
        for into, what in ((leaves, leaves[below]), (saved, saved[below]), (kids, 1)):
            np.add.at(into, up, what)
    names: dict[int, bytes] = {}
    keys = keys.to_pylist()
    key_at = np.cumsum(lens) - lens
    for k in range(t.num_rows) if named else sorted({0, t.num_rows - 1}):
        names.update(zip(states[begin[k]:begin[k] + lens[k] + 1].tolist(), chained(keys[key_at[k]:key_at[k] + lens[k]]), strict=True))
    mine = every[done[every]]
    parent = np.where(depth[mine] > 0, trie.check[mine], -1)
    rows = [{"conv_id": c, "depth": d, "parent_conv_id": int(conv[p]) if p >= 0 and done[p] else None, "n_convs": m, "n_children": k, "n_leaves": v, "saved_tokens": w,
             "ends_sha256": ends.get(s, NO_ONE), "key": names[s] if named else None, "up": names[p] if p >= 0 and not done[p] else None}
            for s, p, c, d, m, k, v, w in zip(mine.tolist(), parent.tolist(), *(x[mine].tolist() for x in (conv, depth, n, kids, leaves, saved)), strict=True)]
    given: set[int] = set()
    for side, o in enumerate(outer if not last_round else ()):
        row = 0 if side == 0 else t.num_rows - 1
        here = o.tolist()
        new = np.array([s not in given for s in here])
        given.update(here)
        rows.append({"shard": shard, "side": side, "path": keys[key_at[row]:key_at[row] + lens[row]], "lens": chars[o[1:]].tolist(), "conv": np.where(new, conv[o], NEVER).tolist(),
                     "ends": [ends.get(s) if f else None for s, f in zip(here, new, strict=True)]}
                    | {c: np.where(new, x[o], 0).tolist() for c, x in (("n", n), ("leaves", leaves), ("saved", saved), ("kids", kids))})
    return pa.Table.from_pylist(rows, SCHEMA)


LONGS = pa.list_(pa.int64())
SCHEMA = pa.schema([("shard", pa.int32()), ("side", pa.int32()), ("path", pa.list_(pa.binary())), *[(c, LONGS) for c in ("lens", "n", "conv", "leaves", "saved", "kids")], ("ends", pa.list_(pa.string())),
                    *[(c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")],
                    ("ends_sha256", pa.string()), ("key", pa.binary()), ("up", pa.binary())])


def later_round(fan: int, last: bool):
    """A round over the outer paths of `fan` shards, which lie one after the other in the order of their shards."""
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("shard", "ascending"), ("side", "ascending")])
        return merged(t, t.column("shard")[0].as_py() // fan, last, True)
    return run


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, lens): the turns of each conversation as the contract rebuilds them, a turn as a 128-bit digest of its role and text, and its length.

    A conversation gets the first h turns of the one at the head of its hundred, then its own after its first h.
    """
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turn = F.substring(F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256)), 1, 16)
    rows = rows.select("conv_id", "turn", "role", "text", turn.alias("key"), F.char_length("text").cast("long").alias("len"))
    own = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    placed = rows.select("conv_id", F.row_number().over(own).alias("place"), "key", "len")
    c = cut_point(placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "key", "len"))).alias("own")), "conversations")
    heads = c.select(F.col("conv_id").alias("head_id"), F.slice("own", 1, 5).alias("head"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(6)).cast("int")
    both = c.withColumn("h", h).withColumn("head_id", F.col("conv_id") - F.col("conv_id") % 100).join(heads, "head_id", "left")
    left = F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0)))
    both = both.select("conv_id", F.concat(F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("own", 1, 0)), left).alias("turns"))
    return both.select("conv_id", F.col("turns.key").alias("path"), F.col("turns.len").alias("lens"))


def distinct_paths(paths: DataFrame) -> DataFrame:
    """One strand for each distinct path: how many conversations take it, the smallest of them, and a digest of all their ids.

    Ids come in sorted blocks that are hashed in order, so a path of very many conversations is never held as a whole.
    """
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    blocks = paths.groupBy("path", "lens", F.shiftright("conv_id", BLOCK_BITS).alias("block")).agg(
        ids.alias("ids"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"))

    def digests(batches) -> Iterator[pa.RecordBatch]:
        at = state = None

        def strand():
            path, lens, n, conv, sha = state
            d = len(path)
            return pa.RecordBatch.from_pylist([{"path": path, "lens": lens, "n": [n] * (d + 1), "conv": [conv] * (d + 1), "ends": [None] * d + [sha.hexdigest()]}
                                               | {c: [0] * (d + 1) for c in ("leaves", "saved", "kids")}], pa.schema([SCHEMA.field(f.split()[0]) for f in STRAND.split(", ")]))
        for b in batches:
            for r in b.to_pylist():
                if at is None or r["path"] != at:
                    if at is not None:
                        yield strand()
                    at, state = r["path"], [r["path"], r["lens"], 0, r["conv_id"], hashlib.sha256()]
                else:
                    state[4].update(b",")
                state[2] += r["n"]
                state[4].update(r["ids"].encode())
        if at is not None:
            yield strand()
    return blocks.repartition("path").sortWithinPartitions("path", "block").mapInArrow(digests, STRAND)


def trie_nodes(paths: DataFrame, shard_turns: int = SHARD_TURNS, fan: int = FAN) -> DataFrame:
    """conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every distinct prefix of `paths`
    (conv_id, path, lens), each conv_id once. No conversations give no nodes."""
    strands = cut_point(distinct_paths(paths), "paths")
    turns = strands.agg(F.coalesce(F.sum(F.size("path") + 1), F.lit(0))).first()[0]
    shards = max(1, -(-turns // shard_turns))
    if not turns:
        return strands.sparkSession.createDataFrame([], NODE).drop("key", "up")

    def first_round(batches):
        rows = [b for b in batches if b.num_rows]
        if rows:
            yield from merged(pa.Table.from_batches(rows), TaskContext.get().partitionId(), False, False).to_batches()
    step = cut_point(strands.repartitionByRange(shards, "path").sortWithinPartitions("path").mapInArrow(first_round, BOTH), "trie")
    found, uppers = step.filter("depth is not null"), []
    while True:
        up = step.filter("side is not null")
        most = up.agg(F.max("shard")).first()[0]
        last = most < fan

        step = cut_point(up.groupBy(F.floor(F.col("shard") / fan).alias("_group")).applyInArrow(later_round(fan, last), BOTH), "trie")
        uppers.append(step.filter("depth is not null"))
        if last:
            break
    named = uppers[0]
    for u in uppers[1:]:
        named = named.unionByName(u)
    parents = named.select(F.col("key").alias("up"), F.col("conv_id").alias("_parent"))
    nodes = found.unionByName(named).join(parents, "up", "left")
    return nodes.select("conv_id", "depth", F.coalesce("parent_conv_id", "_parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


# The remainders of a reflected CRC-32, made by its rule.
def _remainder(i: int) -> int:
    for _ in range(8):
        i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
    return i


CHECK_SQL = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place FROM conversations WHERE conv_id IS NOT NULL),
z AS (SELECT {[_remainder(i) for i in range(256)]} AS z),
c AS (SELECT conv_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda a, b: xor(a >> 8, z[(xor(a, b) & 255) + 1])), 4294967295) % 6 AS h FROM (SELECT DISTINCT conv_id FROM t), z),
r AS (SELECT c.conv_id, place, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND place <= h
  UNION ALL SELECT c.conv_id, place + 10, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND place > h),
s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS depth, length(text) AS len, sha256(length(role) || ':' || role || text) AS k FROM r),
p AS (SELECT conv_id, depth, len, sha256(string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS path FROM s UNION ALL SELECT conv_id, 0, 0, '' FROM c),
n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n, min(len) AS len FROM p GROUP BY path, depth),
u AS (SELECT n.*, q.conv_id AS parent, q.path AS above FROM n LEFT JOIN p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1 LEFT JOIN n q ON q.path = p.path AND q.depth = p.depth),
k AS (SELECT above AS path, count(*) AS kids FROM u WHERE depth > 0 GROUP BY above),
v AS (SELECT u.*, coalesce(kids, 0) AS kids FROM u LEFT JOIN k USING (path)),
b AS (SELECT a.path, sum((v.n - 1) * v.len) AS saved, count(*) FILTER (WHERE v.kids = 0) AS leaves FROM v JOIN p a ON a.conv_id = v.conv_id AND a.depth <= v.depth GROUP BY a.path),
e AS (SELECT path, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends FROM (SELECT conv_id, max_by(path, depth) AS path FROM p GROUP BY conv_id) GROUP BY path)
SELECT conv_id, depth, parent AS parent_conv_id, n AS n_convs, kids AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM v JOIN b USING (path) LEFT JOIN e USING (path)
"""

"""Near duplicates by HyperMinHash: compressed registers, banded, estimated, then confirmed on whole shingle sets.

A document's set holds its distinct shingles of five words. Its sketch has 128 registers: the shingle hash names a
register, and the smallest rest of the hash is kept as a count of leading zeros and ten mantissa bits. Empty
registers borrow from a full one in an order fixed per register, so short texts band like long ones. Four
registers make a band key; two sets with a similarity of 0.75 share one of 32 bands but for about 5 in a million.

Equal sets are one class. Classes that share a band key are compared with the key's hub, the member that shares most
keys with others, so a group of copies costs its size and not its square. Keys that then still hold several
components are compared block against block, members of the hub's component only with the others.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsgauge.llm.common import connected, hash_words, mix, numbered_words, over_texts, packed, raw_texts, unpacked, window_hashes
from newsgauge.session import cut_point

BUCKET_BITS, MANTISSA, BAND_ROWS = 7, 10, 4
BUCKETS = 1 << BUCKET_BITS
BANDS = BUCKETS // BAND_ROWS
BLOCK_SHINGLES, COLUMNS = 50_000, 4096
SKETCH = "doc_id long, text_id long, n_shingles long, digest binary, registers binary, filled binary"


def borrow_order() -> np.ndarray:
    """For each register the order in which it looks for a full one, itself first."""
    b = np.arange(BUCKETS, dtype=np.uint64)
    order = np.argsort(mix(b[:, None] * np.uint64(BUCKETS) + b[None, :] + np.uint64(1)), axis=1, kind="stable")
    for i in range(BUCKETS):
        order[i] = np.concatenate(([i], order[i][order[i] != i]))
    return order


def shingle_sets(texts: list[bytes], n: int = 5) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text; with fewer than n words the whole sequence is one shingle."""
    codes, lens, distinct = numbered_words([t.lower() for t in texts])
    words = hash_words(distinct)[codes]
    hashes = window_hashes(words, n)
    ends = np.cumsum(lens)
    out = []
    for end, size in zip(ends, lens, strict=True):
        if size >= n:
            out.append(np.unique(hashes[end - size:end - n + 1]))
        else:
            out.append(window_hashes(words[end - size:end], int(size)) if size else np.empty(0, np.uint64))
    return out


def registers_of(sets: list[np.ndarray], order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(registers with borrowed ones, which registers are their own)."""
    raw = np.zeros((len(sets), BUCKETS), np.uint16)
    flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    spread = mix(flat + np.uint64(0x9E3779B97F4A7C15))
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    bucket = (spread >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    rest = (spread << np.uint64(BUCKET_BITS)) >> np.uint64(12)                        # 52 bits: exact as a double
    smallest = np.full(len(sets) * BUCKETS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(smallest, owner * BUCKETS + bucket, rest)
    full = np.flatnonzero(smallest != np.iinfo(np.uint64).max)
    value = smallest[full]
    zeros = 52 - np.frexp(value.astype(np.float64))[1]
    tail = (value << (zeros + 1).astype(np.uint64)) & np.uint64((1 << 52) - 1)
    raw.reshape(-1)[full] = ((zeros + 1).astype(np.uint16) << MANTISSA) | (tail >> np.uint64(52 - MANTISSA)).astype(np.uint16)
    own = raw != 0
    dense, rows = raw.copy(), np.flatnonzero(own.any(axis=1) & ~own.all(axis=1))
    for b in range(BUCKETS):
        donor = order[b][own[rows][:, order[b]].argmax(axis=1)]
        dense[rows, b] = raw[rows, donor]
    return dense, own


def sketches(docs: DataFrame) -> DataFrame:
    """One row per document: size of the set, a digest of the whole set, and its registers."""
    order = borrow_order()

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(raw_texts(batch))
        dense, own = registers_of(sets, order)
        bits = np.packbits(own, axis=1)
        return pa.RecordBatch.from_arrays([
            batch.column("doc_id").cast(pa.int64()), batch.column("text_id"), pa.array([len(s) for s in sets], pa.int64()),
            pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
            pa.array([r.astype("<u2").tobytes() for r in dense], pa.binary()), pa.array([r.tobytes() for r in bits], pa.binary()),
        ], names=["doc_id", "text_id", "n_shingles", "digest", "registers", "filled"])
    return over_texts(docs.select("doc_id", "text", F.xxhash64("text").alias("text_id")), ["doc_id", "text_id", "text"], make, SKETCH)


def estimate(a: np.ndarray, b: np.ndarray, own_a: np.ndarray, own_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(similarity, registers used). Chance matches of compressed registers are taken off, as the sketch's authors do."""
    either, both = own_a | own_b, own_a & own_b
    used = np.maximum(either.sum(axis=1), 1)
    equal = ((a == b) & both).sum(axis=1)
    ratio = np.maximum(n_a, n_b) / np.maximum(np.minimum(n_a, n_b), 1)
    chance = 0.169919487159739 * 2.0 ** (BUCKET_BITS - MANTISSA) * 4 * ratio / (1 + ratio) ** 2
    return np.maximum(equal - chance, 0) / used, used


def likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes allow a link and whose estimate is within five deviations of it."""
    side = lambda s: nodes.select(F.col("node").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("n_shingles", "registers", "filled")])
    wide = pairs.join(side("b"), "b").join(side("a"), "a").filter(
        (100 * F.least("n_shingles_a", "n_shingles_b") >= percent * F.greatest("n_shingles_a", "n_shingles_b")))
    t = percent / 100

    def keep(batches):
        for x in batches:
            if not x.num_rows:
                continue
            grid = lambda c, kind, n: np.frombuffer(b"".join(x.column(c).to_pylist()), kind).reshape(-1, n)
            bits = lambda c: np.unpackbits(grid(c, np.uint8, BUCKETS // 8), axis=1).astype(bool)
            sim, used = estimate(grid("registers_a", "<u2", BUCKETS), grid("registers_b", "<u2", BUCKETS), bits("filled_a"), bits("filled_b"),
                                 x.column("n_shingles_a").to_numpy(), x.column("n_shingles_b").to_numpy())
            yield x.select(["a", "b"]).filter(pa.array(sim >= t - 5 * np.sqrt(t * (1 - t) / used)))
    return wide.mapInArrow(keep, "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union of their whole sets. A leader's many partners come to it in skew-split pieces."""
    side = lambda s: sets.select(F.col("node").alias(s), F.col("shingles").alias(f"shingles_{s}"))

    def keep(batches):
        for x in batches:
            good = []
            for a, b in zip(x.column("shingles_a"), x.column("shingles_b"), strict=True):
                u, v = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                same = len(np.intersect1d(u, v, assume_unique=True))
                good.append(100 * same >= percent * (len(u) + len(v) - same))
            yield x.select(["a", "b"]).filter(pa.array(good, pa.bool_()))
    return pairs.join(side("b"), "b").join(side("a"), "a").mapInArrow(keep, "a long, b long")


def set_table(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles) of the classes in `wanted` (node, doc_id, digest), made from the text of the class's first document."""
    def make(batches):
        for part, texts in unpacked(batches):
            sets = shingle_sets(texts)
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            right = [i for i, (d, w) in enumerate(zip(digest, part.column("digest").to_pylist(), strict=True)) if d == w]
            yield pa.RecordBatch.from_arrays([part.column("node").take(pa.array(right, pa.int64())), pa.array([sets[i].tobytes() for i in right], pa.binary())],
                                             names=["node", "shingles"])
    return packed(docs).join(wanted.hint("merge"), "doc_id").select("node", "digest", "packed").mapInArrow(make, "node long, shingles binary")


def cross_links(a: dict, b: dict, percent: int) -> list[tuple[int, int]]:
    """One link for each two components of which a block of `a` and a block of `b` hold linked sets."""
    own = lambda x: [np.frombuffer(s, np.uint64) for s in x["sets"]]
    sa, sb = own(a), own(b)
    na, nb = np.array([len(s) for s in sa]), np.array([len(s) for s in sb])
    fa, fb = np.concatenate(sa), np.concatenate(sb)
    both = np.intersect1d(fa, fb)
    cells = []
    for flat, n in ((fa, na), (fb, nb)):
        at = np.minimum(np.searchsorted(both, flat), max(len(both) - 1, 0))
        hit = both[at] == flat if len(both) else np.zeros(len(flat), bool)
        row, col = np.repeat(np.arange(len(n)), n)[hit], at[hit]
        order = np.argsort(col, kind="stable")
        cells.append((row[order], col[order], len(n)))
    same = np.zeros((len(sa), len(sb)), np.float32)
    for start in range(0, len(both), COLUMNS):                       # counts stay far below 2^24, so floats are exact
        grids = []
        for row, col, n in cells:
            lo, hi = np.searchsorted(col, (start, start + COLUMNS))
            grid = np.zeros((n, COLUMNS), np.float32)
            grid[row[lo:hi], col[lo:hi] - start] = 1
            grids.append(grid)
        same += grids[0] @ grids[1].T
    same = same.astype(np.int64)
    ca, cb = np.array(a["comps"]), np.array(b["comps"])
    i, j = np.nonzero((100 * same >= percent * (na[:, None] + nb[None, :] - same)) & (ca[:, None] != cb[None, :]))
    _, first = np.unique(np.column_stack([ca[i], cb[j]]), axis=0, return_index=True) if len(i) else (None, np.empty(0, np.int64))
    return [(a["nodes"][i[k]], b["nodes"][j[k]]) for k in first]


def block_links(mixed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components inside band keys that still hold several, block against block.

    A block holds about BLOCK_SHINGLES shingles of one key. Members of the leader's component meet only the others.
    No pair of documents is a row; a row is two blocks, and what comes out is a link for each two components.
    """
    rows = mixed.join(sets, "node").withColumn("inside", F.col("component") == F.col("component_a"))
    size = rows.groupBy("bucket").agg(F.ceil(F.sum(F.length("shingles")) / F.lit(8 * BLOCK_SHINGLES)).alias("n_blocks"))
    blocks = rows.join(size, "bucket").groupBy("bucket", "inside", F.pmod(F.xxhash64("node"), "n_blocks").alias("block")).agg(
        F.collect_list(F.struct("node", "component", "shingles")).alias("x"))
    blocks = cut_point(blocks.select("bucket", F.struct("inside", "block").alias("block"), F.struct(
        F.col("x.node").alias("nodes"), F.col("x.component").alias("comps"), F.col("x.shingles").alias("sets")).alias("x")), "blocks")
    pairs = blocks.select("bucket", F.col("block").alias("block_a"), F.col("x").alias("xa")).join(
        blocks.select("bucket", F.col("block").alias("block_b"), F.col("x").alias("xb")), "bucket").filter(
        (F.col("block_a") <= F.col("block_b")) & ~(F.col("block_a.inside") & F.col("block_b.inside")))

    def run(batches):
        for x in batches:
            found = [p for k in range(x.num_rows) for p in cross_links(x.column("xa")[k].as_py(), x.column("xb")[k].as_py(), percent)]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], names=["a", "b"])
    return pairs.select("xa", "xb").mapInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept, text_id (a hash of the text, as an id may repeat), for every row of docs (doc_id, text).

    Documents without a word are linked with nothing. Rows that repeat an id and a text are one document; a row
    without an id is linked with nothing and is kept. Other columns are ignored. An empty table gives an empty one.
    """
    sketch = cut_point(sketches(docs), "sketches")
    some = sketch.filter("n_shingles > 0 and doc_id is not null")
    sketched = F.struct("n_shingles", "registers", "filled")
    classes = some.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.min_by(sketched, "doc_id").alias("s"))
    nodes = cut_point(classes.select("digest", "doc_id", "s.*").withColumn("node", F.monotonically_increasing_id()), "classes")
    part = lambda b: F.substring("registers", F.lit(1) + b * 2 * BAND_ROWS, F.lit(2 * BAND_ROWS))
    bands = nodes.select("node", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"), "registers").select("node", "band", part(F.col("band")).alias("key"))
    shared = bands.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = cut_point(bands.join(shared, ["band", "key"]).select("node", F.xxhash64("band", "key").alias("bucket"), "n"), "members")
    wanted = cut_point(nodes.select("node", "doc_id", "digest").join(members.select("node").distinct(), "node", "left_semi"), "wanted")
    sets = cut_point(set_table(docs, wanted), "sets")
    weight = members.groupBy("node").agg(F.sum("n").alias("weight"))
    hub = F.max(F.struct("weight", "node")).alias("hub")
    weighted = members.join(weight, "node")
    led = cut_point(weighted.join(weighted.groupBy("bucket").agg(hub), "bucket").select("bucket", "node", F.col("hub.node").alias("a")), "led")
    pairs = led.filter("a <> node").select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
    links = cut_point(confirmed(likely(pairs, nodes, percent), sets, percent), "links")
    comps = connected(links)
    component = lambda of, name: comps.select(F.col("node").alias(of), F.col("component").alias(name))
    named = led.join(component("node", "component"), "node", "left").join(component("a", "component_a"), "a", "left").select(
        "bucket", "node", F.coalesce("component", "node").alias("component"), F.coalesce("component_a", "a").alias("component_a"))
    named = cut_point(named.filter("node <> a"), "named")                     # every pair with a hub has been compared
    several = named.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high")
    mixed = named.join(several.select("bucket"), "bucket", "left_semi")
    more = cut_point(block_links(mixed, sets, percent), "links")
    comps = connected(links.union(more)) if not more.isEmpty() else comps
    named = comps.join(nodes.select("node", "doc_id"), "node").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_class = nodes.join(comps.join(named, "component").select("node", "component_id"), "node", "left").select(
        "digest", F.coalesce("component_id", "doc_id").alias("class_component"))
    has = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    of_class = cut_point(of_class, "groups")
    out = sketch.select("doc_id", "text_id", "n_shingles", F.when(has, F.col("digest")).alias("digest")).join(of_class, "digest", "left")
    component = F.coalesce("class_component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "text_id")

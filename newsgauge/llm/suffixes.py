"""Suffix-array dedup: every byte of a text that lies in a stretch which also stands in a document of a smaller id is removed.

Sorting the suffix of every byte would move each text fifty times. A suffix is kept where its leading token has the smallest hash
of some stretch of `least` bytes (ten bytes a token), which depends on nothing but the stretch, so equal stretches keep equal suffixes, about one
byte in twenty. Neighbouring stretches with the same suffix travel once, as one run of bytes around it.

Runs are ranged over buckets by (leading token, document); a sample of them, ranked by Spark, gives the splitters, so a token that is
in a third of all documents is cut into several buckets. A bucket is sorted by itself with a multikey quicksort, eight bytes at a time,
in which only what is equal so far goes on to the next eight. Whatever shares its leading token with a splitter is compared once more
across the buckets' boundaries. Equal means equal bytes throughout: hashes only tell what cannot be equal.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsgauge.llm.common import mix, raw_texts, slices, trim
from newsgauge.operators.scaling import rank_in_blocks
from newsgauge.session import cut_point

LEAST = 50
TOKEN = 10                 # bytes of a leading token
PIECE = 1 << 20            # bytes of text that are hashed at a time
LONGEST_RUN = 1024         # stretches of a run
FLUSH = 16 << 20           # bytes of text whose runs a task holds before it sends them
BUCKET = 12 << 20          # stretches of a bucket, about
SAMPLES = 400              # sampled runs for each splitter
ROUND = 1 << 20            # stretches that are sorted at a time, if one leading token has no more
FOUND = "doc_id long, ident long, start long, stop long, stretch binary"
U = np.uint64


def tokens(a: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one big-endian number."""
    return np.ndarray(len(a) - 7, ">u8", a, strides=(1,)).astype(U)


def token_hash(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """58 bits of the hash of a leading token, given by its first and its last eight bytes."""
    return mix(mix(first) + last) >> U(6)


def runs(buf: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(start, stretches, place of the suffix after the start, leading token's hash) of each run in texts that lie one after the other in `buf`."""
    none = np.empty(0, np.int64)
    if len(buf) < least:
        return none, none, none, none.astype(U)
    t = tokens(buf)
    h = token_hash(t[:len(t) - TOKEN + 8], t[TOKEN - 8:])
    low = (h << U(6)) | (np.arange(len(h)).astype(U) & U(63))               # the place modulo 64 rides along; a stretch spans fewer
    wide, span = least - TOKEN + 1, 1
    while 2 * span <= wide:
        low, span = np.minimum(low[:len(low) - span], low[span:]), 2 * span
    if wide > span:
        low = np.minimum(low[:len(low) - (wide - span)], low[wide - span:])
    low = low[:len(buf) - least + 1]
    at = np.arange(len(low))
    text = np.searchsorted(ends, at, side="right")
    inside = at + least <= ends[text]
    key = low >> U(6)
    fresh = np.ones(len(low), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(fresh)
    fresh |= (at - first[np.cumsum(fresh) - 1]) % LONGEST_RUN == 0
    stops = np.flatnonzero(np.append(fresh | ~inside, True))
    start = np.flatnonzero(fresh & inside)
    return start, stops[np.searchsorted(stops, start, side="right")] - start, ((low[start] & U(63)).astype(np.int64) - start) & 63, key[start]


def gather(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of all parts, one part after the other."""
    ends = np.cumsum(size)
    return buf[np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]


def pieces(batches: Iterable[pa.RecordBatch], least: int) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
    """(texts, doc_id, ident, place in the whole text); long texts come in pieces that overlap by one byte less than a stretch."""
    for b in slices(batches, limit=PIECE):
        texts, ids, idents = raw_texts(b), b.column("doc_id").to_numpy(zero_copy_only=False), b.column("ident").to_numpy(zero_copy_only=False)
        if len(texts) == 1 and len(texts[0]) > PIECE + least:
            for a in range(0, len(texts[0]) - least + 1, PIECE):
                yield [texts[0][a:a + PIECE + least - 1]], ids, idents, np.array([a])
        else:
            yield texts, ids, idents, np.zeros(len(texts), np.int64)


def found_runs(batches: Iterable[pa.RecordBatch], least: int) -> Iterator[dict[str, np.ndarray]]:
    """The runs of bounded pieces of text, as arrays: doc_id, ident, pos, n (stretches), off (of the suffix), key, bytes."""
    for texts, ids, idents, base in pieces(batches, least):
        buf, lens = np.frombuffer(b"".join(texts), np.uint8), np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lens)
        start, n, off, key = runs(buf, ends, least)
        if len(start):
            text = np.searchsorted(ends, start, side="right")
            yield {"doc_id": ids[text], "ident": idents[text], "pos": start - (ends - lens)[text] + base[text], "n": n, "off": off, "key": key, "bytes": gather(buf, start, n + least - 1)}


def bucket_of(key: np.ndarray, doc: np.ndarray, split_key: np.ndarray, split_doc: np.ndarray) -> np.ndarray:
    """How many splitters (token, document) are not above each run."""
    low, high = np.searchsorted(split_key, key, side="left"), np.searchsorted(split_key, key, side="right")
    out = high.copy()
    for at in np.unique(low[low < high]):
        mine = np.flatnonzero((low == at) & (low < high))
        out[mine] = at + np.searchsorted(split_doc[at:high[mine[0]]], doc[mine], side="right")
    return out


# A packed blob: numbers of runs and documents, then the columns, then the bytes of the runs; each column with the smallest type that holds it.
COLUMNS = (("pos", np.uint32), ("n", np.uint16), ("off", np.uint8), ("doc", np.uint32))


def pack(x: dict[str, np.ndarray], rows: np.ndarray, starts: np.ndarray, least: int, press) -> bytes:
    docs = np.stack((x["doc_id"][rows], x["ident"][rows]))
    fresh = np.flatnonzero(np.append(True, (docs[:, 1:] != docs[:, :-1]).any(axis=0)))
    x = {c: x[c][rows] for c in ("pos", "n", "off")} | {"doc": np.diff(np.append(fresh, len(rows))), "bytes": gather(x["bytes"], starts[rows], x["n"][rows] + least - 1)}
    head = np.array([len(rows), len(fresh)], np.int64).tobytes() + docs[:, fresh].tobytes()
    return press(head + b"".join(x[c].astype(kind).tobytes() for c, kind in COLUMNS) + x["bytes"].tobytes())


def unpack(blobs: Iterable[bytes]) -> dict[str, np.ndarray]:
    unpress, parts = zstandard.ZstdDecompressor().decompress, []
    for blob in blobs:
        raw = unpress(blob)
        (rows, n_docs), at = np.frombuffer(raw, np.int64, 2), 16
        docs, at = np.frombuffer(raw, np.int64, 2 * n_docs, at).reshape(2, n_docs), at + 16 * n_docs
        x = {}
        for c, kind in COLUMNS:
            size = n_docs if c == "doc" else rows
            x[c], at = np.frombuffer(raw, kind, size, at).astype(np.int64), at + size * np.dtype(kind).itemsize
        times = x.pop("doc")
        parts.append(x | {"doc_id": np.repeat(docs[0], times), "ident": np.repeat(docs[1], times), "bytes": np.frombuffer(raw, np.uint8, -1, at)})
    return {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}


def load(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each of these places on."""
    return np.ndarray(len(buf) - 7, ">u8", buf, strides=(1,))[at].astype(U)


def multikey(buf: np.ndarray, at: np.ndarray, group: np.ndarray, doc: np.ndarray, least: int, all_needed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(stretches, their class) sorted by their bytes: equal stretches share a class. Classes that lie in one document only are left out as soon
    as that is seen, unless `all_needed`."""
    rows = np.arange(len(at))
    for depth in [*range(0, least - 8, 8), least - 8]:                       # the last eight bytes may overlap the ones before
        if not len(rows):
            break
        token = load(buf, at[rows] + depth)
        order = np.lexsort((token, group[rows]))
        rows, token = rows[order], token[order]
        fresh = np.ones(len(rows), bool)
        fresh[1:] = (token[1:] != token[:-1]) | (group[rows[1:]] != group[rows[:-1]])
        first = np.flatnonzero(fresh)
        several = np.minimum.reduceat(doc[rows], first) != np.maximum.reduceat(doc[rows], first)
        number = np.cumsum(fresh) - 1
        keep = several[number] | all_needed[rows]
        rows = rows[keep]
        group[rows] = number[keep]
    return rows, group[rows]


def sieve(x: np.ndarray) -> np.ndarray:
    """Which numbers occur more than once."""
    order = np.argsort(x)
    same = np.flatnonzero(x[order[1:]] == x[order[:-1]])
    out = np.zeros(len(x), bool)
    out[order[same]] = out[order[same + 1]] = True
    return out


def judged_round(x: dict[str, np.ndarray], at: np.ndarray, rows: np.ndarray, split: np.ndarray, least: int) -> Iterator[tuple]:
    """(doc_id, ident, start, stop, stretch) of what is repeated in runs of whole leading tokens. Where a token is split between buckets, the
    stretches of its first document here come too, with their bytes: an earlier bucket may hold them."""
    buf, doc = x["bytes"], x["doc_id"]
    size = x["n"][rows] + least - 1
    raw, ends = gather(buf, at[rows], size).tobytes(), np.cumsum(size)
    first: dict[bytes, int] = {}
    alike = np.empty(len(rows), np.int64)                                    # runs of equal bytes are judged once, by the smallest document
    for i, (a, z) in enumerate(zip((ends - size).tolist(), ends.tolist(), strict=True)):
        alike[i] = first.setdefault(raw[a:z], i)
    least_doc = np.full(len(rows), np.iinfo(np.int64).max)
    np.minimum.at(least_doc, alike, doc[rows])
    own = np.flatnonzero(alike == np.arange(len(rows)))                      # one run for each kind
    n = x["n"][rows[own]]
    ends = np.cumsum(n)
    run = np.repeat(np.arange(len(own)), n)
    place = np.arange(len(run)) - (ends - n)[run]                            # the stretch's number in its run
    where, key, need, docs = at[rows[own]][run] + place, x["key"][rows[own]][run], split[own][run], least_doc[own][run]
    some = sieve(mix(key + load(buf, where))) | need
    run, place, where, need, docs = run[some], place[some], where[some], need[some], docs[some]
    _, group = np.unique(key[some], return_inverse=True)
    met, cls = multikey(buf, where, group, docs, least, need)
    smallest = np.full(int(cls.max()) + 1 if len(cls) else 0, np.iinfo(np.int64).max)
    np.minimum.at(smallest, cls, docs[met])
    later = docs[met] > smallest[cls]
    begin, bad = ends - n, np.zeros(int(ends[-1]), bool)
    bad[begin[run[met[later]]] + place[met[later]]] = True                   # stretches of the kinds' smallest documents
    edge = np.flatnonzero(np.diff(np.concatenate(([0], bad.view(np.int8), [0]))))
    of_run = np.repeat(np.arange(len(own)), n)
    cuts = np.union1d(edge[0::2], begin[bad[begin]])
    stops = np.union1d(edge[1::2], np.append(begin[1:], len(bad)))
    kind = np.full(len(rows), -1)
    kind[own] = np.arange(len(own))
    kind = kind[alike]                                                       # the kind of each run
    if len(cuts):
        kinds, lo = of_run[cuts], cuts - begin[of_run[cuts]]
        hi = stops[np.searchsorted(stops, cuts, side="right")] - begin[kinds]
        a, z = np.searchsorted(kinds, kind, side="left"), np.searchsorted(kinds, kind, side="right")
        mine = np.flatnonzero((z > a) & (doc[rows] == least_doc[alike]))
        times = (z - a)[mine]
        cut = np.repeat(a[mine] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        r = rows[np.repeat(mine, times)]
        yield doc[r], x["ident"][r], x["pos"][r] + lo[cut], x["pos"][r] + hi[cut] + least - 1, None
    copies = rows[doc[rows] > least_doc[alike]]                              # whole runs that stand in a smaller document
    if len(copies):
        yield doc[copies], x["ident"][copies], x["pos"][copies], x["pos"][copies] + x["n"][copies] + least - 1, None
    ask = met[need[met] & ~later]
    if len(ask):                                                             # of the first document here, whichever runs of it are of this kind
        by_kind = np.argsort(kind, kind="stable")
        by_kind = by_kind[doc[rows[by_kind]] == least_doc[alike[by_kind]]]
        a, z = np.searchsorted(kind[by_kind], run[ask], side="left"), np.searchsorted(kind[by_kind], run[ask], side="right")
        times = z - a
        r = rows[by_kind[np.repeat(a - (np.cumsum(times) - times), times) + np.arange(times.sum())]]
        p, w = np.repeat(place[ask], times), np.repeat(where[ask], times)
        yield doc[r], x["ident"][r], x["pos"][r] + p, x["pos"][r] + p + least, [buf[k:k + least].tobytes() for k in w.tolist()]


def judged_bucket(x: dict[str, np.ndarray], split_keys: np.ndarray, least: int) -> Iterator[tuple]:
    """What judged_round finds, for all runs of a bucket, in rounds of bounded size."""
    size = x["n"] + least - 1
    at = np.cumsum(size) - size
    x["bytes"] = np.append(x["bytes"], np.zeros(8, np.uint8))
    x["key"] = token_hash(load(x["bytes"], at + x["off"]), load(x["bytes"], at + x["off"] + TOKEN - 8))
    order = np.argsort(x["key"], kind="stable")
    key = x["key"][order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    doc = x["doc_id"][order]
    split = np.isin(key[first], split_keys)
    shared = (np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)) | split
    token = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    keep = shared[token]
    order, token = order[keep], token[keep]
    if not len(order):
        return
    done = np.cumsum(x["n"][order])
    last = np.append(token[1:] != token[:-1], True)
    part = np.zeros(len(order), np.int64)
    part[1:] = np.cumsum(last)[:-1]                                          # tokens, then tokens pooled into rounds
    total = done[np.flatnonzero(last)]
    part = (total // ROUND)[part]
    edges = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    for a, z in zip(edges, [*edges[1:], len(order)], strict=True):
        yield from judged_round(x, at, order[a:z], split[token[a:z]], least)


def spans(docs: DataFrame, least: int = LEAST, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, ident, spans): the stretches of each document that a document of a smaller id holds too, as places of bytes that may overlap.

    `ident` is the hash of the text, as an id may repeat. Documents without an id have none that is smaller and are smaller than none.
    """
    if not 32 <= least <= 58 + TOKEN:
        raise ValueError("a stretch takes 32 bytes or more, and no more than the places that a suffix is found by")
    texts = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("ident"), F.col("text").cast("string").alias("text"))
    texts = texts.filter(F.octet_length("text") >= least)
    total, n_texts = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    n_buckets = -(-total // bucket)
    split: list = []
    if n_buckets > 1:
        def sampled(batches):
            for x in found_runs(batches, least):
                yield pa.RecordBatch.from_arrays([pa.array(x["key"].astype(np.int64)), pa.array(x["doc_id"])], names=["key", "doc_id"])
        share = min(1.0, max(SAMPLES * 20 / bucket, 200 / n_texts))          # about one run in twenty bytes, and some 200 documents
        sample = cut_point(texts.sample(share, seed=7).mapInArrow(sampled, "key long, doc_id long"), "sample")
        every = max(1, round(sample.count() / n_buckets))
        placed = rank_in_blocks(sample, [], F.shiftright("key", 46), [F.col("key"), F.col("doc_id")], "place")
        split = sorted(tuple(r) for r in placed.filter(F.col("place") % every == 0).select("key", "doc_id").collect())   # one row for each bucket
    split_key, split_doc = np.array([r[0] for r in split], np.int64).astype(U), np.array([r[1] for r in split], np.int64)

    def sent(batches):
        press = zstandard.ZstdCompressor(level=3).compress

        def flush(parts):
            x = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
            size = x["n"] + least - 1
            starts, to = np.cumsum(size) - size, bucket_of(x["key"], x["doc_id"], split_key, split_doc)
            order = np.argsort(to, kind="stable")
            edges = np.flatnonzero(np.append(True, np.diff(to[order]) != 0))
            parts.clear()
            for a, z in zip(edges, [*edges[1:], len(order)], strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([to[order[a]]], pa.int32()), pa.array([pack(x, order[a:z], starts, least, press)], pa.binary())], names=["bucket", "packed"])
            trim()
        parts, held = [], 0
        for x in found_runs(batches, least):
            parts.append(x)
            held += int(x["n"].sum())
            if held >= FLUSH:
                yield from flush(parts)
                held = 0
        if parts:
            yield from flush(parts)

    def judge(group: pa.Table) -> pa.Table:
        x, out = unpack(group.column("packed").to_pylist()), []
        for doc, ident, start, stop, stretch in judged_bucket(x, split_key, least):
            out.append(pa.Table.from_arrays([pa.array(doc), pa.array(ident), pa.array(start), pa.array(stop), pa.array(stretch, pa.binary()) if stretch else pa.nulls(len(doc), pa.binary())],
                                            names=["doc_id", "ident", "start", "stop", "stretch"]))
        trim()
        empty = pa.schema([(c, pa.binary() if c == "stretch" else pa.int64()) for c in ("doc_id", "ident", "start", "stop", "stretch")]).empty_table()
        return pa.concat_tables([empty, *out])

    found = cut_point(texts.mapInArrow(sent, "bucket int, packed binary").groupBy("bucket").applyInArrow(judge, FOUND), "repeats")
    asked = found.filter("stretch is not null")
    first = asked.groupBy("stretch").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("stretch", "first")
    across = asked.join(first, "stretch").filter(F.col("doc_id") > F.col("first"))                    # a stretch is asked for once by each bucket
    both = found.filter("stretch is null").select("doc_id", "ident", "start", "stop").unionByName(across.select("doc_id", "ident", "start", "stop"))
    return both.groupBy("doc_id", "ident").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def merged(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal stretches out of overlapping ones; those that touch are one."""
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    fresh = np.append(True, start[1:] > stop[:-1])
    return start[fresh], stop[np.append(np.flatnonzero(fresh)[1:] - 1, len(stop) - 1)]


def without_repeats(docs: DataFrame, least: int = LEAST, bucket: int = BUCKET) -> DataFrame:
    """doc_id, n_bytes, spans (start and stop of each maximal removed stretch, in bytes), kept (the bytes left, not always whole characters).

    One row for each row of docs. A null text counts as empty; a text shorter than `least` bytes loses nothing; rows without an id lose
    nothing; rows with the same id do not count against each other, whatever their texts. Other columns are ignored.
    """
    repeats = cut_point(spans(docs, least, bucket), "spans").select(F.col("doc_id").alias("_doc"), F.col("ident").alias("_ident"), "spans")

    def packed(batches):
        press = zstandard.ZstdCompressor(level=3).compress
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("ident"), pa.array([press(t) for t in raw_texts(b)], pa.binary())], names=["doc_id", "ident", "packed"])

    def cut(batches):
        unpress = zstandard.ZstdDecompressor().decompress
        for b in batches:
            rows, held = [], 0
            lists, ids = b.column("spans"), b.column("doc_id").to_pylist()
            for i, blob in enumerate(b.column("packed").to_pylist()):
                text, mine, lost = unpress(blob), lists[i], []
                size = len(text)
                if mine.is_valid and len(mine):
                    flat = mine.values
                    a, z = merged(flat.field("start").to_numpy(), flat.field("stop").to_numpy())
                    lost = [{"start": s, "stop": e} for s, e in zip(a.tolist(), z.tolist(), strict=True)]
                    text = b"".join(text[s:e] for s, e in zip([0, *z.tolist()], [*a.tolist(), size], strict=True))
                rows.append((ids[i], size, lost, text))
                held += len(text)
                if held > PIECE:
                    yield batch(rows)
                    rows, held = [], 0
            yield batch(rows)

    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), span, pa.binary()))], names=["doc_id", "n_bytes", "spans", "kept"])
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("ident"), F.col("text").cast("string").alias("text")).mapInArrow(packed, "doc_id long, ident long, packed binary")
    d = d.join(repeats.hint("merge"), (d["doc_id"] == repeats["_doc"]) & (d["ident"] == repeats["_ident"]), "left").select("doc_id", "packed", "spans")
    return d.mapInArrow(cut, "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary")


# The rows of the query op11: every stretch of 50 bytes as hex digits, looked up as it is. Texts are cut into pieces first, as long strings are slow to step through.
CHECK_SQL = """
WITH n AS (SELECT r, doc_id, x, len(x) // 2 AS n FROM (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents)),
p AS (SELECT r, doc_id, n, p, substr(x, 4000 * p + 1, 4098) AS y FROM (SELECT *, unnest(range(0, greatest(n - 49, 0) // 2000 + 1)) AS p FROM n)),
w AS (SELECT r, doc_id, 2000 * p + k AS i, substr(y, CAST(2 * k + 1 AS BIGINT), 100) AS s FROM (SELECT *, unnest(range(0, greatest(least(2000, n - 49 - 2000 * p), 0))) AS k FROM p) WHERE doc_id IS NOT NULL),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
g AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM w JOIN f USING (s) WHERE doc_id > first),
h AS (SELECT r, i, sum(CASE WHEN i - before <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS span FROM g),
e AS (SELECT r, min(i) AS a, max(i) + 50 AS z FROM h GROUP BY r, span),
k AS (SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS s FROM e),
t AS (SELECT r, count(*) AS n_spans, sum(z - a) AS n_removed, max(z) AS last, string_agg(substr(x, CAST(2 * s + 1 AS BIGINT), CAST(2 * (a - s) AS BIGINT)), '' ORDER BY a) AS head FROM k JOIN n USING (r) GROUP BY r)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(x, CAST(2 * coalesce(last, 0) + 1 AS BIGINT)))) AS kept_sha256 FROM n LEFT JOIN t USING (r)
"""

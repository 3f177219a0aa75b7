"""Helpers of the text operators: bounded slices of Arrow batches, words as numbers, 64-bit hashes, links to components."""
from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsgauge.session import cut_point

SLICE_BYTES = 4 << 20
# The multipliers of a common 64-bit finaliser.
MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def trim() -> None:
    """Give freed memory back to the system: Python workers outlive their tasks, and what they keep counts against the executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):                       # a C library without it keeps its memory
        ctypes.CDLL(None).malloc_trim(0)


_KEPT: dict[tuple, object] = {}


def let_go(but: tuple = ()) -> None:
    """Free what other operators' tasks left in this worker."""
    if any(k != but for k in _KEPT):
        for k in [k for k in _KEPT if k != but]:
            del _KEPT[k]
        trim()


def kept(key: tuple, make: Callable[[], object]) -> object:
    """What the tasks of one operator keep in a Python worker, such as chunks encoded before; a worker keeps it until it comes to another operator."""
    let_go(key)
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES, keeps: tuple = ()) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each slice holds about `limit` bytes of text; a longer single text is a slice of its own. Only what was kept as `keeps` stays."""
    let_go(keeps)
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size) // limit
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            yield batch.slice(a, b - a)
        trim()


def raw_texts(batch: pa.RecordBatch, text: str = "text") -> list[bytes]:
    """The texts as UTF-8; null is the empty text."""
    return [t or b"" for t in batch.column(text).cast(pa.binary()).to_pylist()]


def numbered_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number of each word, number of words of each text, the distinct words).

    bytes.split cuts at the ASCII white space 0x20 and 0x09 to 0x0D, which is what [^\\x20\\x09-\\x0D]+ leaves.
    """
    split = [t.split() for t in texts]
    lens = np.fromiter(map(len, split), np.int64, len(split))
    flat = np.empty(int(lens.sum()), dtype=object)
    at = 0
    for words, n in zip(split, lens, strict=True):
        flat[at:at + n] = words
        at += n
    codes, distinct = pd.factorize(flat)
    return codes.astype(np.int64), lens, distinct


def hash_words(distinct: np.ndarray) -> np.ndarray:
    return pd.util.hash_array(distinct, categorize=False) if len(distinct) else np.empty(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit number over all of it."""
    x = x ^ (x >> np.uint64(33))
    x = x * MIX[0]
    x = x ^ (x >> np.uint64(33))
    x = x * MIX[1]
    return x ^ (x >> np.uint64(33))


def window_hashes(word_hash: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of n neighbours; run i starts at word i. Runs across texts are for the caller to leave out."""
    m = len(word_hash) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    total = np.full(m, np.uint64(n), np.uint64)
    for k in range(n):
        total = mix(total ^ word_hash[k:k + m]) + np.uint64(k + 1)
    return total


def inner_starts(lens: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(places where a run of n words lies inside one text, number of that text)."""
    ends = np.cumsum(lens)
    text_of = np.repeat(np.arange(len(lens)), lens)
    at = np.arange(len(text_of))
    ok = at + n <= ends[text_of] if len(at) else np.empty(0, bool)
    return at[ok], text_of[ok]


def over_texts(docs: DataFrame, columns: list[str], make: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, limit: int = SLICE_BYTES) -> DataFrame:
    """Run `make` over bounded slices of the chosen columns, where the rows lie; nothing is shuffled."""
    def run(batches):
        for part in slices(batches, limit=limit):
            yield make(part)
    return docs.select(*columns).mapInArrow(run, schema)


def packed(docs: DataFrame) -> DataFrame:
    """(doc_id, packed): texts compressed before they travel to meet a table of ids."""
    def run(batches):
        press = zstandard.ZstdCompressor(level=1).compress
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array([press(t) for t in raw_texts(b)], pa.binary())], names=["doc_id", "packed"])
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, packed binary")


def unpacked(batches: Iterable[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """(a part of a batch with `packed`, its texts), cut so that the texts of a part hold about `limit` bytes."""
    unpress = zstandard.ZstdDecompressor().decompress
    for b in batches:
        texts, size, start = [], 0, 0
        for i, t in enumerate(b.column("packed").to_pylist()):
            texts.append(unpress(t))
            size += len(texts[-1])
            if size >= limit or i == b.num_rows - 1:
                yield b.slice(start, i + 1 - start), texts
                texts, size, start = [], 0, i + 1


def connected(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of every node in `links` (a, b); a component is called by its smallest node.

    Each round gives a node the smallest label around it, then the label of its label, so that chains
    halve. A hub's labels are combined before the shuffle. Rounds are cut on shared storage.
    """
    both = cut_point(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), name)
    labels = cut_point(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("component")), name)
    while True:
        seen = labels.select(F.col("node").alias("b"), F.col("component").alias("near"))
        least = both.join(seen, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        nearer = labels.join(least, "node").select("node", F.col("component").alias("before"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
        step = cut_point(nearer.join(jump, "component").select("node", "before", F.least("component", "next").alias("component")), name)
        labels = step.select("node", "component")
        if step.filter("before <> component").isEmpty():
            return labels


class Pool:
    """Sequences of numbers by key, in one growing array, so that many keys unfold without a loop."""

    def __init__(self):
        self.known: dict = {}
        self.starts, self.lens, self.flat, self.filled = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32), 0

    def add(self, keys: list, lens: np.ndarray, flat: np.ndarray) -> None:
        n = len(self.known)
        while n + len(keys) > len(self.starts):
            self.starts, self.lens = (np.concatenate((x, np.zeros_like(x))) for x in (self.starts, self.lens))
        while self.filled + len(flat) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.flat[self.filled:self.filled + len(flat)] = flat
        self.lens[n:n + len(keys)] = lens
        self.starts[n:n + len(keys)] = self.filled + np.cumsum(lens) - lens
        self.filled += len(flat)
        self.known.update(zip(keys, range(n, n + len(keys)), strict=True))

    def unfold(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the sequences at these places one after the other, their ends)."""
        size = self.lens[place]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.starts[place] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)], ends

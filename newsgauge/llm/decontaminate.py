"""Benchmark decontamination: rare pairs of neighbouring words bring passages to test items, Smith-Waterman scores what they meet.

Test items are taken in blocks of bounded size, one after the other, so what the driver or a task holds of them is bounded however many there are.
A passage that reaches the least score leaves at least p of an item's pairs of neighbouring words whole, within a bounded stretch of text: an insertion
costs a point and parts one pair, a changed word costs three and parts two. So the item's rarest pairs, all but p - 1 of them, are its seeds: one of them is
always whole. How rare a pair is, is counted over all documents, and only compared with the item's other pairs, so the seeds are as many at every size.
Texts that a seed brings to an item are looked at again with all its pairs; only stretches with too few pairs or words go without an alignment, so none is lost.
Items too short for such a promise are matched as whole word sequences.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsgauge.llm.common import hash_words, inner_starts, numbered_words, raw_texts, slices, window_hashes
from newsgauge.session import cut_point

SEED = 2
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_CHARS = 16 << 20
LEAST_WORDS = 6            # items of fewer words are matched whole
LEAKS = "doc_id long, text_id long, item_id long, score double, first_word long, last_word long"


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(best local score, place after its last word in the text), linear gaps. A row's gaps come from a running maximum."""
    step = -GAP * np.arange(len(text) + 1)
    row, best, end = np.zeros(len(text) + 1, np.int64), 0, 0
    for w in item:
        up = np.maximum(row + GAP, 0)
        up[1:] = np.maximum(up[1:], row[:-1] + np.where(text == w, MATCH, MISMATCH))
        row = np.maximum.accumulate(up + step) - step
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


class Block:
    """A block of test items as arrays that a task can search."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids = [r[0] for r in rows]
        codes, self.lens, distinct = numbered_words([(r[1] or "").encode().lower() for r in rows])
        self.words = hash_words(distinct)[codes]
        self.ends = np.cumsum(self.lens)
        places, owner = inner_starts(self.lens, SEED)
        hashes = window_hashes(self.words, SEED)[places] if len(places) else np.empty(0, np.uint64)
        use = self.lens[owner] >= LEAST_WORDS if len(places) else np.empty(0, bool)
        self.pair_hash, self.pair_owner = self.ordered(hashes[use], owner[use])
        self.kinds = np.unique(self.pair_hash)
        self.seed_hash, self.seed_owner = self.pair_hash, self.pair_owner
        self.short = {}                                                      # number of words -> (hash of the whole item, item), by hash
        for n in range(1, LEAST_WORDS):
            mine = np.flatnonzero(self.lens == n)
            if len(mine):
                self.short[n] = self.ordered(window_hashes(self.words, n)[(self.ends - n)[mine]], mine)

    @staticmethod
    def ordered(hashes: np.ndarray, *others: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.argsort(hashes, kind="stable")
        return hashes[order], *(x[order] for x in others)

    def choose(self, counts: np.ndarray, least: float) -> None:
        """Keep as seeds the rarest pairs of each item, as many as make sure that one of them is whole; `counts` go with `kinds`."""
        rare = counts[np.searchsorted(self.kinds, self.pair_hash)]
        order = np.lexsort((self.pair_hash, rare, self.pair_owner))
        owner = self.pair_owner[order]
        place = np.arange(len(order)) - np.searchsorted(owner, owner)
        size = self.lens[owner]
        keep = np.sort(order[place <= size - 1 - least_pairs(size, least)])
        self.seed_hash, self.seed_owner = self.pair_hash[keep], self.pair_owner[keep]

    def item(self, k: int) -> np.ndarray:
        return self.words[self.ends[k] - self.lens[k]:self.ends[k]]


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, words of each text, places where an n-gram starts, hash of it)."""
    codes, lens, distinct = numbered_words([t.lower() for t in texts])
    words = hash_words(distinct)[codes]
    places, _ = inner_starts(lens, SEED)
    return words, lens, places, window_hashes(words, SEED)[places] if len(places) else np.empty(0, np.uint64)


def spot(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, x), max(len(table) - 1, 0))
    return at, table[at] == x if len(table) else np.zeros(len(x), bool)


def spot_all(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of x that are in the sorted table, where)."""
    at, ok = spot(table, x)
    return np.flatnonzero(ok), at[ok]


def least_pairs(size: np.ndarray, least: float) -> np.ndarray:
    """How many pairs at least an alignment of `least` leaves whole: each point of the score that is missing parts one at most."""
    return np.maximum(1, size - 1 - np.floor(2 * size * (1 - least) + 1e-9)).astype(np.int64)


def crowded(order_key: np.ndarray, where: np.ndarray, need: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Which hits belong to a group of `need` hits of one key within `width` words. Hits are ordered by key, then by place."""
    last = np.arange(len(where)) + need - 1
    inside = last < len(where)
    end = np.minimum(last, len(where) - 1)
    ok = inside & (order_key[end] == order_key) & (where[end] - where < width)
    change = np.zeros(len(where) + 1, np.int64)
    np.add.at(change, np.flatnonzero(ok), 1)
    np.add.at(change, end[ok] + 1, -1)
    return np.cumsum(change[:-1]) > 0


def hits(table: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the gram, row of the table) of each meeting; a table may hold a hash several times."""
    at, hit = spot(table, grams)
    lo = at[hit]
    n = np.searchsorted(table, grams[hit], side="right") - lo
    return np.repeat(np.flatnonzero(hit), n), np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())


def whole(block: Block, words: np.ndarray, ends: np.ndarray, lens: np.ndarray) -> list[tuple[int, int, float, int, int]]:
    """(text, item, score, first word, word after the last) of the first copy of each short item in each text."""
    out = []
    for n, (table, owner) in block.short.items():
        places, text = inner_starts(lens, n)
        if not len(places):
            continue
        i, row = hits(table, window_hashes(words, n)[places])
        _, first = np.unique(text[i] * len(block.ids) + owner[row], return_index=True)
        for j in first:
            t = int(text[i[j]])
            start = int(places[i[j]] - (ends[t] - lens[t]))
            out.append((t, int(owner[row[j]]), 1.0, start, start + n))
    return out


def meet(block: Block, words: np.ndarray, ends: np.ndarray, lens: np.ndarray, places: np.ndarray, grams: np.ndarray, least: float) -> list[tuple[int, int, float, int, int]]:
    """(text, item, score, first word, word after the last) of the best passage of each text for each item that reaches `least`."""
    if not len(grams) or not len(block.seed_hash):
        return []
    i, row = hits(block.seed_hash, grams)
    if not len(i):
        return []
    brought = np.unique(np.searchsorted(ends, places[i], side="right") * len(block.ids) + block.seed_owner[row])
    text = np.searchsorted(ends, places, side="right")
    here = np.zeros(len(ends), bool)
    here[brought // len(block.ids)] = True
    near = np.flatnonzero(here[text])
    i, row = hits(block.pair_hash, grams[near])
    key = text[near[i]] * len(block.ids) + block.pair_owner[row]
    known, _ = spot_all(brought, key)
    key = np.unique(np.stack((key[known], places[near[i[known]]])), axis=1)                            # a place counts once for an item
    key, where = key[0], key[1]
    reach = np.floor(block.lens * (1 + 2 * (1 - least)) + 1e-9).astype(np.int64)                         # words of text that an alignment spans at most
    k = key % len(block.ids)
    keep = crowded(key, where, least_pairs(block.lens[k], least), reach[k])
    key, where, k = key[keep], where[keep], k[keep]
    if not len(key):                                                         # seeds, but nowhere enough of them together
        return []
    fresh = np.flatnonzero((np.diff(key, prepend=-1) != 0) | (np.diff(where, prepend=0) > reach[k]))
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    sorted_items: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for a, z in zip(fresh, [*fresh[1:], len(key)], strict=True):
        n, t = int(k[a]), int(key[a]) // len(block.ids)
        size, far, begin = int(block.lens[n]), int(reach[n]), int(ends[t] - lens[t])
        low, high = max(begin, int(where[a]) - far), min(int(ends[t]), int(where[z - 1]) + far + SEED)
        span = words[low:high]
        if n not in sorted_items:
            sorted_items[n] = np.unique(block.item(n), return_counts=True)
        kinds, times = sorted_items[n]
        at, ok = spot(kinds, span)
        if np.minimum(np.bincount(at[ok], minlength=len(kinds)), times).sum() < least * size:
            continue
        total = np.concatenate(([0], np.cumsum(ok)))
        if (total[np.minimum(np.arange(len(span)) + far, len(span))] - total[:-1]).max() < least * size:  # no stretch with enough of the item's words
            continue
        score, end = align(block.item(n), span)
        if score >= least * MATCH * size and score > best.get((t, n), (0,))[0]:
            back, length = align(block.item(n)[::-1], span[:end][::-1])
            best[t, n] = (score, low - begin + end - length, low - begin + end)
    return [(t, n, score / (MATCH * int(block.lens[n])), first, last) for (t, n), (score, first, last) in sorted(best.items())]


def pair_counts(docs: DataFrame, block: Block) -> np.ndarray:
    """How often each pair of the block's items stands in the documents. A task adds up its own; a row for each kind of pair comes back."""
    kinds = block.kinds

    def run(batches):
        total = np.zeros(len(kinds), np.int64)
        for b in slices(batches):
            _, _, _, grams = hashed(raw_texts(b))
            _, at = spot_all(kinds, grams)
            total += np.bincount(at, minlength=len(kinds))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["pair", "n"])
    rows = docs.select("text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(len(kinds), np.int64)
    counts[rows["pair"].to_numpy(np.int64)] = rows["n"]
    return counts


def found_in(docs: DataFrame, block: Block, least: float) -> DataFrame:
    """The leaks of the items of one block."""
    def run(batches):
        for b in slices(batches):
            words, lens, places, grams = hashed(raw_texts(b))
            ends, docs_of, text_of = np.cumsum(lens), b.column("doc_id").to_pylist(), b.column("text_id").to_pylist()
            rows = [(docs_of[t], text_of[t], block.ids[n], *r) for t, n, *r in sorted(meet(block, words, ends, lens, places, grams, least) + whole(block, words, ends, lens))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64() if k == 3 else pa.int64()) for k, x in enumerate(zip(*rows, strict=True))],
                                                 names=[c.split()[0] for c in LEAKS.split(", ")])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_id"), "text").mapInArrow(run, LEAKS)


def leaks(docs: DataFrame, tests: DataFrame, least: float = 0.6, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document and test item whose best local alignment reaches `least` of the item's own score: doc_id, text_id (a hash of
    the text, as an id may repeat), item_id, score, first_word, last_word.

    Words are lower-cased and cut at white space. Items of fewer than six words have to stand in the text as they are. Null
    texts match nothing; repeated documents and items are judged each by itself; empty tables give an empty result.
    """
    spark = docs.sparkSession
    tests = tests.filter("text is not null").select("item_id", "text")
    blocks = max(1, -(-(tests.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))
    found = spark.createDataFrame([], LEAKS)
    for k in range(blocks):                                                  # one block after the other: about block_chars, by the count above
        block = Block([tuple(r) for r in tests.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()])
        if len(block.words):
            if len(block.kinds):
                block.choose(pair_counts(docs, block), least)
            found = found.unionByName(cut_point(found_in(docs, block, least), "leaks"))
    return found

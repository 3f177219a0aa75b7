"""SentencePiece encoding and decoding by suffix-array matching.

New segments of a batch of texts are put one after the other and indexed by a suffix array as deep as the longest piece. Every
piece is searched in it by bisection; its range gives all its occurrences, the edges. Edges are sorted by position
and relaxed: for a merge model, an edge over exactly two symbols of its segment joins them, the best score first and then the
leftmost, until no edge is left; for a unigram model the best sum of scores is carried from left to right. Characters without a
piece become byte pieces. A segment runs from blanks to before the next blank: no piece reaches across that, which is
checked when the model is read.
"""
from __future__ import annotations

import heapq
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from newsgauge.llm.common import Pool, kept, slices, trim

BLANK = "▁"
CACHE, SHORT, SLICE, INDEXED = 500_000, 48, 1 << 19, 20_000
ENCODED = "doc_id long, ids array<int>, n_pieces long, ids_crc32 long, round_trip boolean"


class Pieces:
    """The vocabulary of a model file as arrays."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as model
        proto = model.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec, kinds = proto.normalizer_spec, sentencepiece_type(model)
        self.merges = proto.trainer_spec.model_type == 2
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces:
            self.normal = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            self.normal = None
        self.prefix = spec.add_dummy_prefix
        text = [p.piece for p in proto.pieces]
        self.ids = np.array([i for i, p in enumerate(proto.pieces) if p.type == kinds["NORMAL"]], np.int64)
        words = [text[i] for i in self.ids]
        self.scores = np.array([proto.pieces[i].score for i in self.ids], np.float64)
        self.size = np.array([len(w) for w in words], np.int64)
        self.depth = int(self.size.max())
        most = (1 << 21) - 1                                                 # above any character
        spelled = np.full((len(words), -(-self.depth // 3) * 3), -1, np.int64)
        for i, w in enumerate(words):
            spelled[i, :len(w)] = [ord(c) for c in w]
        three = lambda x: x[:, ::3] << 42 | x[:, 1::3] << 21 | x[:, 2::3]
        self.least, self.most = three(spelled + 1), three(np.where(spelled < 0, most, spelled + 1))      # what a text that starts with the piece lies between
        self.single = {w: int(i) for w, i in zip(words, self.ids, strict=True) if len(w) == 1}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds["BYTE"]}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == kinds["UNKNOWN"])
        held = any(BLANK in w.lstrip(BLANK) for w in words)
        self.segment = re.compile(r"(?s).+" if held else rf"{BLANK}*[^{BLANK}]+|{BLANK}+" if any("\n" in w for w in words) else rf"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n")
        self.out = Pool()
        raw = [bytes([int(p.piece[3:5], 16)]) if p.type == kinds["BYTE"] else p.piece.replace(BLANK, " ").encode() if p.type == kinds["NORMAL"]
               else " ⁇ ".encode() if p.type == kinds["UNKNOWN"] else b"" for p in proto.pieces]
        self.out.add(list(range(len(raw))), np.array([len(r) for r in raw]), np.frombuffer(b"".join(raw), np.uint8))

    def prepare(self, text: str) -> str:
        if self.normal is not None:
            return self.normal.normalize(text)
        return ((BLANK if self.prefix else "") + text.replace(" ", BLANK)) if text else ""

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts of id sequences that end at `ends`."""
        flat, byte_ends = self.out.unfold(ids.astype(np.int64))
        flat, cut = flat.astype(np.uint8), np.concatenate(([0], byte_ends))
        out, a = [], 0
        for z in ends:
            text = flat[cut[a]:cut[z]].tobytes().decode("utf-8", "replace")
            out.append(text[1:] if self.prefix and text.startswith(" ") else text)
            a = z
        return out


def sentencepiece_type(model) -> dict[str, int]:
    return dict(model.ModelProto.SentencePiece.Type.items())


def packed(codes: np.ndarray) -> np.ndarray:
    """The three characters from each place on as one number that sorts as they do; -1 stands for no character."""
    x = np.concatenate((codes + 1, np.zeros(2, np.int64)))
    return x[:-2] << 42 | x[1:-1] << 21 | x[2:]


def ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, dense rank) of numbers; equal numbers come in any order."""
    order = np.argsort(key)
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(np.diff(key[order], prepend=key[order[:1]]) != 0)
    return order, rank


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Places sorted by the `depth` characters from them, by doubling from three (`words`) on."""
    (order, rank), width = ranked(words), 3
    while width < depth:
        later = np.zeros(len(rank), np.int64)
        later[:-width or None] = rank[width:] + 1 if width < len(rank) else 0
        (order, rank), width = ranked(rank * (len(rank) + 2) + later), width * 2
    return order


def occurrences(codes: np.ndarray, p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(place, piece number) of every occurrence of every piece, by bisection of the suffix array, sorted by place.

    Three characters are compared at a time; the first three are looked up for all pieces at once, longer pieces are bisected inside that range.
    """
    words = packed(codes)
    order = suffix_array(words, p.depth)
    first = words[order]
    low, high = np.searchsorted(first, p.least[:, 0], side="left"), np.searchsorted(first, p.most[:, 0], side="right")
    wide = np.concatenate((words, np.zeros(3 * p.least.shape[1], np.int64)))

    def bound(edge: np.ndarray, right: bool, low=low, high=high) -> np.ndarray:
        """Where the suffixes end that lie before `edge`, those equal to it included if `right`."""
        out, a, z = (low if not right else high).copy(), low.copy(), high.copy()
        now = np.flatnonzero((p.size > 3) & (low < high))
        while len(now):
            middle = (a[now] + z[now]) // 2
            at = order[middle]
            go, open_ = np.full(len(now), right), np.ones(len(now), bool)
            for k in range(1, edge.shape[1]):
                x, y = wide[at + 3 * k], edge[now, k]
                differs = open_ & (x != y)
                go[differs] = x[differs] < y[differs]
                open_ &= x == y
                if not open_.any():
                    break
            a[now], z[now] = np.where(go, middle + 1, a[now]), np.where(go, z[now], middle)
            done = a[now] >= z[now]
            out[now[done]] = a[now[done]]
            now = now[~done]
        return out
    low, high = bound(p.least, False), bound(p.most, True)
    n = high - low
    piece = np.repeat(np.arange(len(n)), n)
    place = order[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    by = np.argsort(place)
    return place[by], piece[by]


def merge_rounds(place: np.ndarray, end: np.ndarray, piece: np.ndarray, rank: np.ndarray, segment: np.ndarray, after: np.ndarray, name: np.ndarray) -> None:
    """Relax the edges of many short segments at once: each round joins the best two neighbours of every segment. `after` (the end of the
    symbol that starts at a place, -1 inside one) and `name` (its piece) are changed. Edges come by place, and so by segment."""
    while len(place):
        middle = after[place]
        alive = (middle >= 0) & (middle < end)
        alive[alive] &= after[middle[alive]] >= 0
        place, end, piece, rank, segment, middle = (x[alive] for x in (place, end, piece, rank, segment, middle))
        two = np.flatnonzero(after[middle] == end)
        if not len(two):
            return
        firsts = np.flatnonzero(np.diff(segment[two], prepend=-1))
        best = two[np.minimum.reduceat(rank[two] * len(two) + np.arange(len(two)), firsts) % len(two)]
        after[place[best]], name[place[best]], after[middle[best]] = end[best], piece[best], -1
        more = np.zeros(int(segment.max()) + 1, bool)
        more[segment[best]] = True
        go = more[segment]
        place, end, piece, rank, segment = (x[go] for x in (place, end, piece, rank, segment))


def merge_heap(start: int, stop: int, edges: dict[tuple[int, int], tuple[int, int]], after: np.ndarray, name: np.ndarray) -> None:
    """The same for one long segment, with a heap of the joins that are possible."""
    before = {i: i - 1 for i in range(start, stop)}
    heap = [(*edges[i, i + 2], i, i + 1, i + 2) for i in range(start, stop - 1) if (i, i + 2) in edges]
    heapq.heapify(heap)
    while heap:
        _, piece, a, m, z = heapq.heappop(heap)
        if after[a] != m or m >= stop or after[m] != z:
            continue
        after[a], name[a], after[m] = z, piece, -1
        if z < stop:
            before[z] = a
            if (a, int(after[z])) in edges:
                heapq.heappush(heap, (*edges[a, int(after[z])], a, z, int(after[z])))
        left = before[a]
        if left >= start and (left, z) in edges:
            heapq.heappush(heap, (*edges[left, z], left, a, z))


def best_path(start: int, stop: int, into: dict[int, list[tuple[int, int, float]]], floor: float) -> list[tuple[int, int]]:
    """Unigram relaxation: (place, piece or -1) of the best sum of scores from start to stop."""
    best, back = {start: 0.0}, {}
    for at in range(start + 1, stop + 1):
        best[at], back[at] = best[at - 1] + floor, (at - 1, -1)
        for a, piece, score in into.get(at, []):
            if best[a] + score > best[at]:
                best[at], back[at] = best[a] + score, (a, piece)
    out, at = [], stop
    while at > start:
        out.append(back[at])
        at = back[at][0]
    return out[::-1]


def encode_segments(segments: list[str], p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, ids one after the other) of distinct segments."""
    text = "\0".join(segments) + "\0"
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
    size = np.array([len(s) for s in segments], np.int64)
    starts = np.cumsum(size + 1) - (size + 1)
    owner = np.repeat(np.arange(len(segments)), size + 1)
    place, piece = occurrences(codes, p)
    end = place + p.size[piece]
    ok = end <= (starts + size)[owner[place]]
    place, piece, end = place[ok], piece[ok], end[ok]
    after, name = np.arange(1, len(codes) + 1), np.full(len(codes), -1, np.int64)
    after[starts + size] = -1                                                # separators are no symbols
    one = end == place + 1
    name[place[one]] = piece[one]
    if p.merges:
        rank = np.argsort(np.argsort(-p.scores, kind="stable"), kind="stable")[piece]
        long = size[owner[place]] > SHORT
        some = ~one & ~long
        merge_rounds(*(x[some] for x in (place, end, piece, rank)), owner[place[some]], after, name)
        for k in np.unique(owner[place[~one & long]]):
            mine = np.flatnonzero(~one & (owner[place] == k))
            edges = {(int(place[i]), int(end[i])): (int(rank[i]), int(piece[i])) for i in mine}
            merge_heap(int(starts[k]), int(starts[k] + size[k]), edges, after, name)
    else:
        floor = float(p.scores.min()) - 10.0
        by = np.argsort(end, kind="stable")
        into: dict[int, list[tuple[int, int, float]]] = {}
        for i in by:
            into.setdefault(int(end[i]), []).append((int(place[i]), int(piece[i]), float(p.scores[piece[i]])))
        after[:] = -1
        for s, n in zip(starts, size, strict=True):
            path = best_path(int(s), int(s + n), into, floor)
            for (a, q), z in zip(path, [*[x[0] for x in path[1:]], int(s + n)], strict=True):
                after[a], name[a] = z, q
    at = np.flatnonzero(after >= 0)
    ids = np.where(name[at] >= 0, p.ids[np.maximum(name[at], 0)], -1)
    times = np.ones(len(at), np.int64)
    odd = np.flatnonzero(ids < 0)
    spelled = [[p.bytes.get(b, p.unknown) for b in chr(codes[at[i]]).encode()] if p.bytes else [p.unknown] for i in odd]
    times[odd] = [len(s) for s in spelled]
    flat = np.repeat(ids, times)
    flat[np.flatnonzero(flat < 0)] = [i for s in spelled for i in s]
    return np.bincount(owner[at], times, len(segments)).astype(np.int64), flat.astype(np.uint32)


class Coder:
    """Encodes batches of texts; segments met before are looked up.

    They lie in two pools of half of CACHE each. When the younger one is full the older one goes; what is met again moves to the
    younger one, so frequent segments stay while those met once go.
    """

    def __init__(self, path: str):
        self.pieces, self.pool, self.older = Pieces(path), Pool(), Pool()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, ends of the texts)."""
        split = [self.pieces.segment.findall(self.pieces.prepare(t)) for t in texts]
        lens = np.fromiter(map(len, split), np.int64, len(split))
        flat = np.empty(int(lens.sum()), dtype=object)
        at = 0
        for parts, n in zip(split, lens, strict=True):
            flat[at:at + n] = parts
            at += n
        codes, distinct = pd.factorize(flat)
        if len(self.pool.known) + len(distinct) > CACHE // 2:
            self.pool, self.older = Pool(), self.pool
        new = [s for s in distinct if s not in self.pool.known]
        again = [s for s in new if s in self.older.known]
        if again:
            ids, ends = self.older.unfold(np.array([self.older.known[s] for s in again]))
            self.pool.add(again, np.diff(ends, prepend=0), ids)
            new = [s for s in new if s not in self.older.known]
        for k in range(0, len(new), INDEXED):                               # one suffix array holds so many segments
            self.pool.add(new[k:k + INDEXED], *encode_segments(new[k:k + INDEXED], self.pieces))
        place = np.fromiter((self.pool.known[s] for s in distinct), np.int64, len(distinct))
        ids, ends = self.pool.unfold(place[codes] if len(codes) else np.empty(0, np.int64))
        return ids, np.concatenate(([0], ends))[np.cumsum(lens)]


def coder_of(path: str) -> Coder:
    """One coder for each Python worker, so that what it has met serves later tasks too; CACHE bounds it."""
    return kept(("pieces", path), lambda: Coder(path))


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, n_pieces, ids_crc32 (of little-endian 32-bit ids), round_trip (decoding gives the text) of every row of docs (doc_id, text).

    Null and empty texts have no ids. Texts are taken whole, and rows stay as many as they were; other columns are ignored.
    Where the model's own rules change a text before encoding, round_trip compares with the changed text.
    """
    def run(batches):
        trim()                                                               # what earlier tasks of this worker left
        coder = coder_of(path)
        for b in slices(batches, limit=SLICE, keeps=("pieces", path)):
            texts = [t or "" for t in b.column("text").to_pylist()]
            ids, ends = coder.encode(texts)
            back = coder.pieces.decode(ids, ends)
            plain = lambda t: t if coder.pieces.normal is None else coder.pieces.prepare(t).replace(BLANK, " ").removeprefix(" ")
            starts = np.concatenate(([0], ends[:-1]))
            raw = ids.astype("<u4")
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id").cast(pa.int64()), pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids.astype(np.int32))),
                pa.array(ends - starts), pa.array([zlib.crc32(raw[a:z].tobytes()) for a, z in zip(starts, ends, strict=True)], pa.int64()),
                pa.array([a == plain(t) for a, t in zip(back, texts, strict=True)])], names=["doc_id", "ids", "n_pieces", "ids_crc32", "round_trip"])
            b = texts = ids = ends = back = starts = raw = None
        trim()                                                               # the worker may wait long for its next task
    return docs.select("doc_id", "text").mapInArrow(run, ENCODED)

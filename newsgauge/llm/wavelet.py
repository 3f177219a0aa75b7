"""Token ids in wavelet-matrix files: one compressed file per shard, with access, counting and occurrence lookup.

Documents are put in ascending doc_id order, encoded where they land, and cut into shards of about `shard_tokens`
ids. A shard file holds one bit-plane per bit of an id, each with a rank directory, and its documents' ids and ends.
Files are named per attempt and found only through the manifest, which Spark commits, so a task that runs again does no harm.
"""
from __future__ import annotations

import json
import os
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsgauge.llm.common import Pool, kept, slices
from newsgauge.session import cut_point, run_dir

MAGIC, BLOCK = b"WMX1", 512
SHARD_TOKENS, CACHE, SLICE = 2_000_000, 1_200_000, 16 << 20
STRIP = 1 << 16            # bits of a plane that are parted at once: by their places, which takes a fraction of the time of masks, and inside the processor's cache
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long, shard string"


class Wavelet:
    """A sequence of small numbers as bit-planes. Plane k is ordered by the planes above it: zeros first, then ones, each in the old order."""

    def __init__(self, n: int, planes: list[np.ndarray], ranks: list[np.ndarray]):
        self.n, self.planes, self.ranks = n, planes, ranks
        self.ones = [int(r[-1]) for r in ranks]

    @classmethod
    def build(cls, ids: np.ndarray, levels: int) -> Wavelet:
        planes, ranks, now = [], [], ids
        for k in range(levels - 1, -1, -1):
            bit = (now & now.dtype.type(1 << k)) != 0
            packed = np.packbits(bit)
            planes.append(packed)
            per = np.add.reduceat(np.bitwise_count(packed), np.arange(0, len(packed), BLOCK // 8), dtype=np.int64) if len(packed) else np.empty(0, np.int64)
            ranks.append(np.concatenate(([0], np.cumsum(per))).astype(np.uint32))
            down, zero, one = np.empty_like(now), 0, len(now) - int(ranks[-1][-1])
            for a in range(0, len(now), STRIP):
                part, at = now[a:a + STRIP], bit[a:a + STRIP]
                zeros, ones = np.flatnonzero(~at), np.flatnonzero(at)
                part.take(zeros, out=down[zero:zero + len(zeros)], mode="clip")         # clip: straight into `out`; no place lies outside
                part.take(ones, out=down[one:one + len(ones)], mode="clip")
                zero, one = zero + len(zeros), one + len(ones)
            now = down
        return cls(len(ids), planes, ranks)

    def bits(self, k: int) -> np.ndarray:
        return np.unpackbits(self.planes[k], count=self.n).view(bool)

    def rank1(self, k: int, at: np.ndarray) -> np.ndarray:
        """How many ones plane k holds before each place."""
        at = np.asarray(at, np.int64)
        padded = np.concatenate((self.planes[k], np.zeros(BLOCK // 8 + 1, np.uint8)))
        start = at // BLOCK * (BLOCK // 8)
        got = self.ranks[k][at // BLOCK].astype(np.int64)
        whole = at // 8 - start
        for j in range(BLOCK // 8):
            use = j < whole
            if not use.any():
                break
            got += np.where(use, np.bitwise_count(padded[start + j]), 0)
        last = padded[at // 8] >> (8 - at % 8).astype(np.uint8)
        return got + np.where(at % 8 > 0, np.bitwise_count(last), 0)

    def access(self, at: np.ndarray) -> np.ndarray:
        at = np.asarray(at, np.int64)
        value = np.zeros(len(at), np.int64)
        for k, plane in enumerate(self.planes):
            bit = (plane[at // 8] >> (7 - at % 8).astype(np.uint8)) & 1
            ones = self.rank1(k, at)
            at = np.where(bit == 1, self.n - self.ones[k] + ones, at - ones)
            value = value * 2 + bit
        return value

    def span(self, symbol: int, low: int, high: int) -> tuple[int, int]:
        """The places of a symbol's copies among [low, high), below the last plane."""
        for k in range(len(self.planes)):
            a, b = (int(x) for x in self.rank1(k, np.array([low, high])))
            one = (symbol >> (len(self.planes) - 1 - k)) & 1
            low, high = (self.n - self.ones[k] + a, self.n - self.ones[k] + b) if one else (low - a, high - b)
        return low, high

    def count(self, symbol: int, low: int = 0, high: int | None = None) -> int:
        a, b = self.span(symbol, low, self.n if high is None else high)
        return b - a

    def occurrences(self, symbol: int) -> np.ndarray:
        """Every place of a symbol, by selecting upwards through the planes."""
        at = np.arange(*self.span(symbol, 0, self.n))
        for k in range(len(self.planes) - 1, -1, -1):
            bit = self.bits(k)
            one = (symbol >> (len(self.planes) - 1 - k)) & 1
            at = np.flatnonzero(bit)[at - (self.n - self.ones[k])] if one else np.flatnonzero(~bit)[at]
        return np.sort(at)

    def decode(self) -> np.ndarray:
        """The whole sequence, from the last plane up, without a random access."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for k in range(len(self.planes) - 1, -1, -1):
            bit, up = self.bits(k), np.empty(self.n, kind)
            zero, one = 0, self.n - self.ones[k]
            now[one:] |= kind(1 << (len(self.planes) - 1 - k))
            for a in range(0, self.n, STRIP):
                part, at = up[a:a + STRIP], bit[a:a + STRIP]
                zeros, ones = np.flatnonzero(~at), np.flatnonzero(at)
                part[zeros], part[ones] = now[zero:zero + len(zeros)], now[one:one + len(ones)]
                zero, one = zero + len(zeros), one + len(ones)
            now = up
        return now

    def to_bytes(self, doc_ids: list[int | None], ends: np.ndarray) -> bytes:
        press = zstandard.ZstdCompressor(level=1).compress
        known = np.array([i is not None for i in doc_ids], np.uint8)
        blobs = [press(x.tobytes()) for x in (known, np.array([i or 0 for i in doc_ids], "<i8"), ends.astype("<i8"), *self.planes, *(r.astype("<u4") for r in self.ranks))]
        head = json.dumps({"n": self.n, "levels": len(self.planes), "docs": len(doc_ids), "sizes": [len(b) for b in blobs]}).encode()
        return MAGIC + struct.pack("<I", len(head)) + head + b"".join(blobs)

    @classmethod
    def from_bytes(cls, data: bytes) -> tuple[Wavelet, list[int | None], np.ndarray]:
        if data[:4] != MAGIC:
            raise ValueError("not a shard of token ids")
        size = struct.unpack("<I", data[4:8])[0]
        head, at, parts = json.loads(data[8:8 + size]), 8 + size, []
        unpress = zstandard.ZstdDecompressor().decompress
        for n in head["sizes"]:
            parts.append(unpress(data[at:at + n]))
            at += n
        levels = head["levels"]
        known, ids = np.frombuffer(parts[0], np.uint8), np.frombuffer(parts[1], "<i8")
        doc_ids = [int(i) if k else None for i, k in zip(ids, known, strict=True)]
        planes = [np.frombuffer(p, np.uint8) for p in parts[3:3 + levels]]
        return cls(head["n"], planes, [np.frombuffer(p, "<u4") for p in parts[3 + levels:]]), doc_ids, np.frombuffer(parts[2], "<i8")


class Encoder:
    """Whole texts to ids. A blank before a word or a line break before one always ends the piece before, so such chunks are
    encoded once and looked up; texts in which white space meets white space there, or that hold a token added to the vocabulary,
    are encoded whole. New chunks are encoded as
    one text: only a chunk's first piece begins with a blank or a line break, which tells them apart again."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.added = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.spaced = any(c.isspace() for a in self.added for c in a)                      # such a token would not lie in one chunk
        words = self.tokenizer.get_vocab(with_added_tokens=True)
        self.first = np.zeros(max(words.values()) + 1, bool)
        self.first[[i for w, i in words.items() if w[0] in "\u0120\u010a"]] = True          # how the vocabulary spells blank and line break
        self.clear()

    def clear(self) -> None:
        self.pool, self.odd = Pool(), np.zeros(1024, bool)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def learn(self, new: pa.Array, chunks: list[str]) -> None:
        """Encode chunks that were not met before, given as an Arrow array and as a list."""
        first, second = pc.utf8_slice_codeunits(new, 0, 1), pc.utf8_slice_codeunits(new, 1, 2)
        broken = pc.equal(first, "\n")
        blank = lambda x: pc.or_(pc.equal(x, ""), pc.utf8_is_space(x))
        odd = pc.if_else(broken, blank(second), blank(first))
        for a in self.added:
            odd = pc.or_(odd, pc.match_substring(new, a))
        plain = pc.if_else(broken, new, pc.binary_join_element_wise(pa.scalar(" ", new.type), new, pa.scalar("", new.type))).filter(pc.invert(odd))
        odd = odd.to_numpy(zero_copy_only=False)
        parts = pa.LargeListArray.from_arrays(pa.array(np.append(np.arange(0, len(plain), 1000), len(plain)), pa.int64()), plain)
        joined = pc.binary_join(parts, pa.scalar("", new.type)).to_pylist()
        got = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)]
        ids = np.concatenate([*got, np.empty(0, np.uint32)])
        lens = np.zeros(len(chunks), np.int64)
        lens[~odd] = np.diff(np.flatnonzero(self.first[ids]), append=len(ids))
        n = len(self.pool.known)
        self.pool.add(chunks, lens, ids)
        if len(self.odd) < len(self.pool.starts):
            self.odd = np.concatenate((self.odd, np.zeros(len(self.pool.starts) - len(self.odd), bool)))
        self.odd[n:n + len(chunks)] = odd

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        large = lambda x: pa.scalar(x, pa.large_string())
        split = pc.split_pattern(pc.binary_join_element_wise(large("\n"), pc.replace_substring(texts, "\n", " \n"), large("")), " ")
        lens = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        coded = split.flatten().dictionary_encode()
        codes, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
        if len(self.pool.known) + len(distinct) > CACHE:
            self.clear()
        known = self.pool.known.get
        place = np.array([known(c, -1) for c in distinct], np.int64)
        new = np.flatnonzero(place < 0)
        if len(new):
            place[new] = len(self.pool.known) + np.arange(len(new))
            self.learn(coded.dictionary.take(pa.array(new)), [distinct[i] for i in new])
        place = place[codes]
        ids, total = self.pool.unfold(place)
        ends = np.cumsum(lens)
        bad = np.add.reduceat(self.odd[place].astype(np.int64), ends - lens) > 0 if len(texts) else []
        for a in self.added:
            bad = bad | pc.match_substring(texts, a).to_numpy(zero_copy_only=False) if len(texts) else bad
        bad = [True] * len(texts) if self.spaced else bad
        cut = np.concatenate(([0], total))
        return [self.whole(texts[i].as_py()) if b else ids[cut[e - n] + 1:cut[e]] for i, (b, e, n) in enumerate(zip(bad, ends, lens, strict=True))]   # the first id is the added line break


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker, so that what it has learned serves later tasks too."""
    return kept(("wavelet", path), lambda: Encoder(path))


def write_shards(docs: DataFrame, path: str, tokenizer: str, vocabulary: int = 50_257, end_id: int = 0, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write docs (doc_id, text) as shard files under `path`; returns the manifest (part, seq, file, n_docs, n_tokens, before).

    `before` is the number of ids in all shards before. Order: doc_id, nulls first, then a hash of the text. Null texts are
    empty and hold the end id only. Other columns are ignored; an empty table gives no file.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    levels = max(1, (max(vocabulary, end_id + 1) - 1).bit_length())
    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h")

    def run(batches):
        encode, seq, ids, names = encoder(tokenizer), 0, [], []
        store, base = fs.FileSystem.from_uri(path)
        end = np.array([end_id], np.uint32)

        def flush() -> pa.RecordBatch:
            nonlocal seq, ids, names
            flat = np.concatenate(ids).astype(np.uint16 if levels <= 16 else np.uint32)
            data = Wavelet.build(flat, levels).to_bytes(names, np.cumsum([len(x) for x in ids]))
            part, file = TaskContext.get().partitionId(), f"{uuid.uuid4().hex}.wmx"
            store.create_dir(base, recursive=True)
            with store.open_output_stream(f"{base}/{file}") as out:
                out.write(data)
            row = pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "file": file, "n_docs": len(ids), "n_tokens": len(flat)}], schema=pa.schema(
                [("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))
            seq, ids, names = seq + 1, [], []
            return row
        held = 0
        for batch in slices(batches, limit=SLICE, keeps=("wavelet", tokenizer)):      # a chunk is looked up once for each slice
            for doc, got in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text")), strict=True):
                ids.append(np.concatenate((got, end)))
                names.append(doc)
                held += len(got) + 1
                if held >= shard_tokens:
                    held = 0
                    yield flush()
        if ids:
            yield flush()
    manifest = cut_point(ordered.select("doc_id", "text").mapInArrow(run, "part int, seq int, file string, n_docs long, n_tokens long"), "manifest")
    # One row per task goes through the unsplit window; inside a task the shards are few.
    parts_before = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_before"))
    inside = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return manifest.withColumn("inside", inside).join(parts_before, "part").select(
        "part", "seq", "file", "n_docs", "n_tokens", (F.col("part_before") + F.col("inside")).alias("before"))


def read_documents(manifest: DataFrame, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens with the end id, ids_crc32, shard; from the files alone."""
    def run(batches):
        store, base = fs.FileSystem.from_uri(path)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_stream(f"{base}/{row['file']}") as f:
                    wavelet, doc_ids, ends = Wavelet.from_bytes(f.read())
                ids = wavelet.decode().astype("<u4")
                starts = np.concatenate(([0], ends[:-1]))
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts + row["before"], pa.int64()), pa.array(ends - starts, pa.int64()),
                                                  pa.array(crc, pa.int64()), pa.array([row["file"]] * len(crc))], names=["doc_id", "start", "n_tokens", "ids_crc32", "shard"])
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(parts, "file").mapInArrow(run, DOCUMENTS)


def token_table(docs: DataFrame, tokenizer: str) -> DataFrame:
    path = run_dir(docs.sparkSession, "tokens")
    return read_documents(write_shards(docs, path, tokenizer), path)

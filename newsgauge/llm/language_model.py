"""Quality by an interpolated modified Kneser-Ney model of words, trained on trusted text.

The model's grams are runs of up to three words, known by 64-bit keys made of the words' hashes. Counts are taken over every
trusted document, combined per task, and summed; lower orders count distinct left neighbours, and what starts a text counts as
often as it occurs. A text's log probability is a plain sum over its places of one weight per gram: what the gram adds over its
back-off, and the back-off mass it has as a context. So grams can be looked up apart. Those with at least 1/HEAVY of all places
are at most HEAVY per order and are shared with every task; all others go through joins on the key, one row for each gram and
slice of text. Words are what white space leaves; those the model has not seen share one place of the uniform base.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsgauge.llm.common import hash_words, numbered_words, packed, raw_texts, slices, unpacked
from newsgauge.session import cut_point

ORDER, HEAVY, SLICE, HELD = 3, 500_000, 2 << 20, 1_500_000
BEGIN, END = 0x1D8E4E27C47D124F, 0x6A09E667F3BCC908        # fixed values that stand for the start and the end of a text
TURN = 21                                                  # bits by which a word's hash is turned for each word after it
HOLD_OUT = 5               # every fifth trusted document is kept out of training and sets the thresholds
WORDS = [f"w{i}" for i in range(ORDER)]                    # a longest gram's words, the first one first
LOOKED = "rid long, doc_id long, lang string, places long, score double, key long, docs binary"


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes with marks before each text and one after it, the places that are scored, text of each place)."""
    codes, lens, distinct = numbered_words(texts)
    text = np.repeat(np.arange(len(texts)), lens + 1)
    places = np.arange(len(text)) + (text + 1) * (ORDER - 1)
    word = np.ones(len(text), bool)
    word[np.cumsum(lens + 1) - 1] = False
    buf = np.full(len(text) + len(texts) * (ORDER - 1), BEGIN, np.uint64)
    buf[places[word]] = hash_words(distinct)[codes]
    buf[places[~word]] = END
    return buf, places, text


def turned(x: np.ndarray, bits: int) -> np.ndarray:
    return x << np.uint64(bits) | x >> np.uint64(64 - bits)


def keys_at(buf: np.ndarray, places: np.ndarray, order: int) -> np.ndarray:
    """The key of the gram of `order` words that ends at each place."""
    key = buf[places]
    for back in range(1, order):
        key = key ^ turned(buf[places - back], TURN * back)
    return key.view(np.int64)


def key_of(words: list[str]) -> Column:
    """The same key from columns of word hashes; 0 is the empty gram."""
    if not words:
        return F.lit(0).cast("long")
    key = F.col(words[-1])
    for back, w in enumerate(reversed(words[:-1]), 1):
        key = key.bitwiseXOR(F.shiftleft(w, TURN * back).bitwiseOR(F.shiftrightunsigned(w, 64 - TURN * back)))
    return key


def summed(grams: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(distinct grams as rows of words, how often)."""
    flat = np.concatenate(grams)
    codes, distinct = pd.factorize(keys_at(flat.reshape(-1), np.arange(len(flat)) * ORDER + ORDER - 1, ORDER))
    first = np.flatnonzero(np.diff(np.maximum.accumulate(codes), prepend=-1))
    return flat[first], np.bincount(codes, np.concatenate(counts), len(distinct)).astype(np.int64)


def gram_counts(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(w0, w1 ..., n) of the longest grams of the trusted documents. Texts travel compressed to meet their labels."""
    def batch(grams, counts):
        return pa.RecordBatch.from_arrays([*(pa.array(grams[:, i].copy().view(np.int64)) for i in range(ORDER)), pa.array(counts)], names=[*WORDS, "n"])

    def count(batches):
        grams, counts, held = [], [], 0
        for _, texts in unpacked(batches, SLICE):
            buf, places, _ = padded(texts)
            g, c = summed([buf[places[:, None] + np.arange(1 - ORDER, 1)]], [np.ones(len(places))])
            grams, counts, held = [*grams, g], [*counts, c], held + len(g)
            if held > HELD:
                g, c = summed(grams, counts)
                grams, counts, held = [g], [c], len(g)
            if held > HELD:
                yield batch(g, c)
                grams, counts, held = [], [], 0
        if grams:
            yield batch(*summed(grams, counts))
    mine = packed(docs).join(trusted.select("doc_id").hint("merge"), "doc_id")           # ids have no bound, so they are not sent to every task
    return mine.select("packed").mapInArrow(count, ", ".join(f"{w} long" for w in [*WORDS, "n"])).groupBy(*WORDS).agg(F.sum("n").alias("n"))


def train(longest: DataFrame) -> tuple[DataFrame, int, int]:
    """((key, weight, seen): log weights of every gram of every order, and how often it ended a place; all places; distinct words).

    Order by order: discounts from counts of counts (one row), totals and kinds per context, the interpolated
    probability, and the log of what it adds. All are joins and sums on keys.
    """
    full = cut_point(longest, "grams")
    tables = {ORDER: full.withColumnRenamed("n", "seen").withColumn("c", F.col("seen"))}
    for m in range(ORDER - 1, 0, -1):
        first, *rest = WORDS[ORDER - m - 1:]
        c = F.coalesce(F.sum(F.when(F.col(first) == BEGIN, F.col("seen")).otherwise(1)), F.lit(0))       # only a mark stands before what starts a text
        tables[m] = cut_point(tables[m + 1].groupBy(*rest).agg(c.alias("c"), F.sum("seen").alias("seen")), "grams")
    counts = tables[1].agg(F.sum("seen").alias("places"), F.count(F.lit(1)).alias("kinds")).first()
    below, weights = None, []
    for m in range(1, ORDER + 1):
        mine = WORDS[ORDER - m:]
        t = tables[m].select(key_of(mine).alias("key"), key_of(mine[:-1]).alias("context"), key_of(mine[1:]).alias("key_below"), "c", "seen")
        kinds = t.agg(*[F.count(F.when(F.col("c") == i, 1)).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)])
        some = lambda i: F.nullif(F.col(f"n{i}"), F.lit(0.0))  # noqa: E731         a count that never occurs estimates nothing
        y = some(1) / (some(1) + 2 * some(2))
        guess = lambda i: i - (i + 1) * y * some(i + 1) / some(i)
        cut = lambda i: F.when(guess(i).isNull(), 0.5).otherwise(F.greatest(F.least(guess(i), F.lit(i - 0.05)), F.lit(0.05)))  # noqa: E731      least and greatest pass over nulls
        cuts = cut_point(kinds.select(cut(1).alias("d1"), cut(2).alias("d2"), cut(3).alias("d3")), "discounts").first()
        d = F.when(F.col("c") == 1, cuts.d1).when(F.col("c") == 2, cuts.d2).otherwise(cuts.d3)
        contexts = t.groupBy("context").agg(F.sum("c").alias("total"), F.sum(d).alias("left")).withColumn("back", F.col("left") / F.col("total"))
        about = contexts.select("context", "total", "back")
        if below is None:                                                    # one context, the empty one: a single row
            t = t.drop("context").crossJoin(F.broadcast(about)).withColumn("p_below", F.lit(1.0 / (counts.kinds + 1)))
        else:
            t = t.join(about.hint("merge"), "context").join(below.hint("merge"), "key_below")
        p = (F.col("c") - d) / F.col("total") + F.col("back") * F.col("p_below")
        t = cut_point(t.withColumn("p", p).select("key", "seen", "p", F.log(F.col("p") / (F.col("back") * F.col("p_below"))).alias("weight")), "order")
        weights.append(t.select("key", "weight", "seen"))
        weights.append(contexts.select(F.col("context").alias("key"), F.log("back").alias("weight"), F.lit(0).cast("long").alias("seen")))
        below = t.select(F.col("key").alias("key_below"), F.col("p").alias("p_below"))
    union = weights[0]
    for w in weights[1:]:
        union = union.union(w)
    return cut_point(union.groupBy("key").agg(F.sum("weight").alias("weight"), F.sum("seen").alias("seen")), "weights"), counts.places or 0, counts.kinds


def lookups(docs: DataFrame, heavy_keys: np.ndarray, heavy_weights: np.ndarray, start: float, once: float) -> DataFrame:
    """Rows of two kinds. One per document: its places and the sum of its heavy weights, of `start` for each place and of `once`. One per
    slice and other gram: the documents that hold it, as pairs of 64-bit numbers (row id, count)."""
    def run(batches):
        task = TaskContext.get().partitionId() << 36
        at = 0
        for b in slices(batches, limit=SLICE):
            texts = raw_texts(b)
            buf, places, text = padded(texts)
            n = np.bincount(text, minlength=len(texts))
            score, keys, sizes, held = n * start + once, [], [], []
            for m in range(1, ORDER + 1):
                codes, distinct = pd.factorize(keys_at(buf, places, m))
                spot = np.minimum(np.searchsorted(heavy_keys, distinct), max(len(heavy_keys) - 1, 0))
                known = heavy_keys[spot] == distinct if len(heavy_keys) else np.zeros(len(distinct), bool)
                weight = np.where(known, heavy_weights[spot], 0.0) if len(heavy_keys) else np.zeros(len(distinct))
                score = score + np.bincount(text, weight[codes], len(texts))
                rare = ~known[codes]
                pair, times = np.unique(codes[rare] * len(texts) + text[rare], return_counts=True)
                which, doc = pair // len(texts), pair % len(texts)
                cuts = np.flatnonzero(np.diff(which, prepend=-1))
                keys.append(distinct[which[cuts]])
                sizes.append(np.diff(cuts, append=len(which)))
                held.append(np.column_stack([doc + task + at, times]).astype("<i8"))
            key, ends = np.concatenate(keys), np.concatenate(([0], np.cumsum(np.concatenate(sizes) * 16))).astype("<i8")
            pairs = pa.Array.from_buffers(pa.large_binary(), len(key), [None, pa.py_buffer(ends), pa.py_buffer(np.concatenate(held))])
            none = lambda k, kind: pa.nulls(k, kind)
            rows, k = len(texts), len(key)
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([pa.array(np.arange(rows) + task + at), none(k, pa.int64())]), pa.concat_arrays([b.column("doc_id").cast(pa.int64()), none(k, pa.int64())]),
                pa.concat_arrays([b.column("lang").cast(pa.string()), none(k, pa.string())]), pa.concat_arrays([pa.array(n), none(k, pa.int64())]),
                pa.concat_arrays([pa.array(score), none(k, pa.float64())]), pa.concat_arrays([none(rows, pa.int64()), pa.array(key, pa.int64())]),
                pa.concat_arrays([none(rows, pa.binary()), pairs.cast(pa.binary())])], names=["rid", "doc_id", "lang", "places", "score", "key", "docs"])
            at += rows
    return docs.select("doc_id", "text", "lang").mapInArrow(run, LOOKED)


def spread_weights(joined: DataFrame) -> DataFrame:
    """(rid, more): the weight of other grams, summed for each document and batch before the shuffle."""
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            pairs = [np.frombuffer(x, "<i8").reshape(-1, 2) for x in b.column("docs").to_pylist()]
            weight = np.repeat(b.column("weight").to_numpy(), [len(p) for p in pairs])
            flat = np.concatenate(pairs)
            codes, rid = pd.factorize(flat[:, 0])
            yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(np.bincount(codes, flat[:, 1] * weight))], names=["rid", "more"])
    return joined.mapInArrow(run, "rid long, more double").groupBy("rid").agg(F.sum("more").alias("more"))


def perplexities(docs: DataFrame, trusted: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """rid, doc_id, lang, places, perplexity (per word, the end of the text included) of every row."""
    weights, places, kinds = train(gram_counts(docs, trusted))
    often = weights.filter(F.col("seen") >= F.lit(max(places / heavy, 1.0)))
    top = often.toPandas().sort_values("key")                                # at most `heavy` for each order
    marks = [keys_at(np.full(ORDER, BEGIN, np.uint64), np.array([ORDER - 1]), m)[0] for m in range(1, ORDER)]
    fixed = {r.key: r.weight for r in weights.filter(F.col("key").isin([0, *map(int, marks)])).select("key", "weight").collect()}   # ORDER rows at most
    start = fixed.pop(0, 0.0) - float(np.log(kinds + 1))                     # the empty context stands before every place, marks only before the first
    looked = cut_point(lookups(docs, top["key"].to_numpy(np.int64), top["weight"].to_numpy(np.float64), start, sum(fixed.values())), "looked")
    rest = weights.filter(F.col("seen") < F.lit(max(places / heavy, 1.0))).select("key", "weight")
    more = spread_weights(looked.filter("key is not null").select("key", "docs").join(rest, "key").select("docs", "weight"))
    done = looked.filter("rid is not null").join(more, "rid", "left")
    return done.select("rid", "doc_id", "lang", "places", F.exp(-(F.col("score") + F.coalesce("more", F.lit(0.0))) / F.col("places")).alias("perplexity"))


def judged(docs: DataFrame, labels: DataFrame, quantile: float = 0.99, heavy: int = HEAVY) -> DataFrame:
    """doc_id, lang, places, perplexity, threshold, kept for every row of docs (doc_id, text, lang).

    Trusted: labelled good and not toxic. A fifth of them, by a hash of the id, is kept out of training; the `quantile` of its
    perplexities is the threshold of a language (of all languages where a language has none). A row is kept unless it lies above.
    Null and empty texts are one place, the end. Without trusted text everything is kept. Null languages are one language.
    """
    good = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")).filter("q = 1 and t = 0")
    good = cut_point(good.select("doc_id", (F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(HOLD_OUT)) == 0).alias("held")), "trusted")
    scored = cut_point(perplexities(docs, good.filter(~F.col("held")), heavy).withColumn("tongue", F.coalesce("lang", F.lit(""))), "scored")
    held = scored.join(good.filter("held"), "doc_id", "left_semi").filter("places > 1")
    cut = F.percentile_approx("perplexity", quantile, 10_000)
    per = held.groupBy("tongue").agg(cut.alias("own"))
    overall = held.agg(cut.alias("overall"))
    out = scored.join(per, "tongue", "left").crossJoin(F.broadcast(overall)).withColumn("threshold", F.coalesce("own", "overall"))
    return out.select("doc_id", "lang", "places", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)).alias("kept"))

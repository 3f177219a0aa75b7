"""Quality rules: gradient-boosted trees over document statistics, with monotone features.

The statistics are counted once, from whole texts, where the documents lie. Trees are fitted to a bounded sample of
labelled rows (`fit_rows`), by histograms, and a split is only taken if it keeps the promised direction of a
monotone feature. All trees are complete, so the forest is three arrays that score a batch without branching.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsgauge.llm.common import inner_starts, numbered_words, over_texts, raw_texts
from newsgauge.session import cut_point

FIT_ROWS = 20_000
WINDOW = 8
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_upper", "n_digits", "n_ends"]
STATS = "doc_id long, text_id long, " + ", ".join(f"{c} long" for c in COUNTS)
# Each feature and the direction in which it may move the score: -1 only down, 1 only up, 0 either.
FEATURES = {"words": 0, "word_length": 0, "symbols": -1, "dup_lines": -1, "repeats": -1, "distinct": 0, "upper": -1, "digits": 0, "ends": 0, "line_words": 0}

SPACE, SYMBOL, UPPER, DIGIT, TAIL, END = 1, 2, 4, 8, 16, 32
KIND = np.zeros(256, np.uint8)
KIND[[0x20, *range(0x09, 0x0E)]] |= SPACE
KIND[[*b"#*$%&|<>"]] |= SYMBOL
KIND[ord("A"):ord("Z") + 1] |= UPPER
KIND[ord("0"):ord("9") + 1] |= DIGIT
KIND[0x80:0xC0] |= TAIL                   # a later byte of a code point
KIND[[*b".!?"]] |= END


def repeated_words(codes: np.ndarray, lens: np.ndarray, n: int = WINDOW) -> np.ndarray:
    """For each text, how many words lie in a window of n words that it holds twice or more. Windows are numbered by doubling, so no hash is involved."""
    starts, text = inner_starts(lens, n)
    covered = np.zeros(len(codes) + 1, np.int64)
    if len(starts):
        grams, width = codes, 1
        while width < n:                                        # numbers of runs of 2, 4, 8 words
            grams = pd.factorize(grams[:-width] * (grams.max() + 1) + grams[width:])[0].astype(np.int64)
            width *= 2
        window = pd.factorize(grams[starts] * len(lens) + text)[0]
        again = starts[np.bincount(window)[window] > 1]
        covered[again] += 1
        covered[again + n] -= 1
    inside = np.concatenate(([0], np.cumsum(np.cumsum(covered[:-1]) > 0)))
    ends = np.cumsum(lens)
    return inside[ends] - inside[ends - lens]


def statistics(texts: list[bytes]) -> dict[str, np.ndarray]:
    codes, lens, distinct = numbered_words(texts)
    buf = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    starts = np.concatenate(([0], ends[:-1])) if len(texts) else ends
    kind = KIND[buf]

    def count(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags)))
        return total[ends] - total[starts]
    owner = np.repeat(np.arange(len(texts)), lens)
    n_distinct = np.bincount(pd.unique(owner * (len(distinct) + 1) + codes) // (len(distinct) + 1), minlength=len(texts))
    dup, lines = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        rows = [x for x in t.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
        lines[i], dup[i] = len(rows), len(rows) - len(set(rows))
    return {"n_words": lens, "word_chars": count((kind & (SPACE | TAIL)) == 0), "n_symbols": count((kind & SYMBOL) > 0), "n_dup_lines": dup,
            "n_repeat_words": repeated_words(codes, lens), "n_lines": lines, "n_distinct_words": n_distinct, "n_upper": count((kind & UPPER) > 0),
            "n_digits": count((kind & DIGIT) > 0), "n_ends": count((kind & END) > 0)}


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, text_id (a hash of the text) and the counts of each row. A null text has none of anything."""
    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = statistics(raw_texts(batch))
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("text_id"), *[pa.array(got[c].astype(np.int64)) for c in COUNTS]],
                                          names=["doc_id", "text_id", *COUNTS])
    return over_texts(docs.select("doc_id", "text", F.xxhash64("text").alias("text_id")), ["doc_id", "text", "text_id"], make, STATS)


def features(c) -> np.ndarray:
    """The features of FEATURES from counts, as shares, so that long and short texts compare."""
    f = lambda name: np.asarray(c[name], dtype=np.float64)
    words, chars = np.maximum(f("n_words"), 1), np.maximum(f("word_chars"), 1)
    lines = np.maximum(f("n_lines"), 1)
    return np.column_stack([np.log1p(f("n_words")), chars / words, f("n_symbols") / words, f("n_dup_lines") / lines, f("n_repeat_words") / words,
                            f("n_distinct_words") / words, f("n_upper") / chars, f("n_digits") / chars, f("n_ends") / words, words / lines])


@dataclass(frozen=True)
class Forest:
    """Complete trees as arrays: node k of a tree has the children 2k+1 and 2k+2; `split` says which feature, `at` from where to the right."""
    split: np.ndarray
    at: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows, inner = np.arange(len(x)), self.split.shape[1]
        for split, at, leaf in zip(self.split, self.at, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(x) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, split[node]] > at[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def fit_forest(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, least: float = 5.0) -> Forest:
    """Second-order boosting of the log loss on binned features. A node's value is held between the middles of the splits above it that were monotone."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
    prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(prior / (1 - prior)))
    margin, inner = np.full(len(y), base), 2 ** depth - 1
    all_split, all_at, all_leaf = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), np.int64)
        split, at = np.zeros(inner, np.int64), np.full(inner, np.inf)
        low, high = np.full(2 * inner + 1, -np.inf), np.full(2 * inner + 1, np.inf)
        for k in range(inner):
            mine, best = node == k, 1e-9
            low[2 * k + 1:2 * k + 3], high[2 * k + 1:2 * k + 3] = low[k], high[k]
            g, h = grad[mine], hess[mine]
            for j, e in enumerate(edges):
                if len(g) < 2 or not len(e):
                    continue
                sums = [np.cumsum(np.bincount(binned[mine, j], w, len(e) + 1))[:-1] for w in (g, h)]
                gl, hl = sums
                gr, hr = g.sum() - gl, h.sum() - hl
                left, right = np.clip(gl / (hl + 1), low[k], high[k]), np.clip(gr / (hr + 1), low[k], high[k])
                gain = gl * left - (hl + 1) * left ** 2 / 2 + gr * right - (hr + 1) * right ** 2 / 2
                own = np.clip(g.sum() / (h.sum() + 1), low[k], high[k])
                gain = gain - (g.sum() * own - (h.sum() + 1) * own ** 2 / 2)
                gain[(hl < least * 0.1) | (hr < least * 0.1) | (monotone[j] * (right - left) < 0)] = -np.inf
                if gain.max() > best:
                    c = int(gain.argmax())
                    best, split[k], at[k] = gain[c], j, e[c]
                    middle, m = (left[c] + right[c]) / 2, monotone[j]
                    low[2 * k + 1:2 * k + 3], high[2 * k + 1:2 * k + 3] = low[k], high[k]
                    if m:
                        (high if m > 0 else low)[2 * k + 1] = (low if m > 0 else high)[2 * k + 2] = middle
            node[mine] = 2 * k + 1 + (x[mine, split[k]] > at[k])
        leaf = np.zeros(inner + 1)
        for k in range(inner + 1):
            mine = node == inner + k
            leaf[k] = rate * np.clip(grad[mine].sum() / (hess[mine].sum() + 1), low[inner + k], high[inner + k])
        margin += leaf[node - inner]
        all_split.append(split)
        all_at.append(at)
        all_leaf.append(leaf)
    return Forest(np.array(all_split), np.array(all_at), np.array(all_leaf), base)


def sample_of_labels(stats: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> pd.DataFrame:
    """About `fit_rows` labelled documents, chosen by a hash of the id; all of them where there are fewer."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    have = known.count()
    share = min(1.0, fit_rows / max(have, 1))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < int(share * 1_000_000))
    return stats.join(chosen, "doc_id").select("doc_id", "text_id", *COUNTS, "quality").toPandas().sort_values(["doc_id", "text_id"], ignore_index=True)


def train(stats: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Forest | None:
    """None where the labels do not hold both kinds."""
    rows = sample_of_labels(stats, labels, fit_rows)
    y = (rows["quality"].to_numpy() > 0).astype(np.float64)
    return fit_forest(features(rows), y, list(FEATURES.values())) if 0 < y.sum() < len(y) else None


def judged(docs: DataFrame, labels: DataFrame, least: float = 0.5, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Every row of docs (doc_id, text) by its counts, with base_failed, score (chance of good quality) and kept.

    base_failed: under 20 words, or over 30 % of the words in repeated windows of eight. The rest is kept if its score
    reaches `least`; without labels of both kinds everything that passes the base is kept. Null and empty texts fail
    the base. Rows stay as many as they were, repeated ids included.
    """
    stats = cut_point(document_statistics(docs), "statistics")
    forest = train(stats, labels, fit_rows)

    @F.pandas_udf("double")
    def score(c: pd.DataFrame) -> pd.Series:
        return pd.Series(forest.score(features(c))) if forest is not None else pd.Series(np.ones(len(c)))

    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    scored = stats.withColumn("base_failed", failed).withColumn("score", score(F.struct(*COUNTS)))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= least))


def kept_documents(docs: DataFrame, labels: DataFrame, least: float = 0.5, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of docs that are kept, with the columns of docs. Row and verdict meet by id and a hash of the text."""
    good = judged(docs, labels, least, fit_rows).filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_id").alias("_text")).distinct()
    return docs.join(good, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_text")), "left_semi")

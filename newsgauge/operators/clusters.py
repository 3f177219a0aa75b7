"""Clusters of vectors: choosing k by silhouette, medoids, exemplars and when to fall back to k-means."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsgauge.operators.texts import top_words
from newsgauge.session import cut_point


def kmeans_runs(vectors: DataFrame, ident: str, vector: str, lo: int = 3, hi: int = 14, seed: int = 0) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """(vectors with the label of every k as a column k<k>, the centres of every k). Vectors must be unit length."""
    data = cut_point(vectors.select(ident, F.col(vector).alias("vector"), array_to_vector(F.col(vector)).alias("features")), "features")
    labelled, centres = data, {}
    for k in range(lo, hi + 1):
        model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol=f"k{k}", distanceMeasure="cosine").fit(data)
        labelled, centres[k] = model.transform(labelled), np.stack(model.clusterCenters())
    return cut_point(labelled, "labelled"), centres


def silhouettes(labelled: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """(k, n, silhouette, nearest) for every k in one pass: the mean cosine silhouette, and how many vectors have their own centre nearest.

    A vector's mean distance to a cluster is one minus its product with the cluster's sum over the cluster's size, so no pair is formed. The sums, at most
    hi * hi of them, are added up map-side and go to every task.
    """
    ks = sorted(centres)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("cluster")) for k in ks])).alias("x")
    sums = labelled.select(each, "features").groupBy("x.k", "x.cluster").agg(Summarizer.sum(F.col("features")).alias("total"), F.count(F.lit(1)).alias("size")).collect()
    total = {k: np.zeros_like(c) for k, c in centres.items()}
    size = {k: np.zeros(len(c)) for k, c in centres.items()}
    for r in sums:
        total[r.k][r.cluster], size[r.k][r.cluster] = r.total.toArray(), r["size"]
    unit = {k: c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12) for k, c in centres.items()}

    def score(batches):
        out = {k: [0, 0.0, 0] for k in ks}
        for b in batches:
            if not len(b):
                continue
            x = np.stack(b["vector"].to_numpy())
            for k in ks:
                own, at = b[f"k{k}"].to_numpy(), np.arange(len(b))
                near = x @ total[k].T
                away = np.where(size[k] > 0, 1 - near / np.maximum(size[k], 1), np.inf)
                mine = (size[k][own] - near[at, own]) / np.maximum(size[k][own] - 1, 1)
                away[at, own] = np.inf
                other = away.min(axis=1)
                s = np.where(size[k][own] > 1, (other - mine) / np.maximum(np.maximum(other, mine), 1e-300), 0.0)
                best = x @ unit[k].T
                out[k][0] += len(b)
                out[k][1] += float(s.sum())
                out[k][2] += int((best[at, own] >= best.max(axis=1) - 1e-9).sum())
        yield pd.DataFrame([(k, *v) for k, v in out.items()], columns=["k", "n", "s", "nearest"])
    parts = labelled.drop("features").mapInPandas(score, "k int, n long, s double, nearest long")
    return parts.groupBy("k").agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("silhouette"), F.sum("nearest").alias("nearest"))


def best_labels(labelled: DataFrame, scores: DataFrame) -> DataFrame:
    """Labels of the k with the highest silhouette (the smaller k on a tie), with k and the silhouette on every row."""
    best = max(scores.collect(), key=lambda r: (round(r.silhouette, 12), -r.k))                            # a row for each k
    return labelled.select(labelled.columns[0], F.col(f"k{best.k}").alias("cluster"),
                           F.lit(best.k).alias("k"), F.lit(best.silhouette).alias("silhouette"))


def kmeans_by_silhouette(vectors: DataFrame, ident: str, vector: str, lo: int = 3, hi: int = 14, seed: int = 0) -> DataFrame:
    """K-means labels of the k with the highest cosine silhouette."""
    labelled, centres = kmeans_runs(vectors, ident, vector, lo, hi, seed)
    return best_labels(labelled, silhouettes(labelled, centres))


def centroids(labelled: DataFrame, cluster: str, vector: str) -> DataFrame:
    """Mean vector per cluster, averaged element by element (the array holds one number per dimension)."""
    parts = labelled.select(cluster, F.posexplode(vector).alias("i", "x")).groupBy(cluster, "i").agg(F.avg("x").alias("x"))
    return parts.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centre"))


def nearest(labelled: DataFrame, cluster: str, ident: str, vector: str, k: int) -> DataFrame:
    """The k members nearest to their cluster's centre, noise (-1) left out; ties by id."""
    members = labelled.filter(F.col(cluster) != -1)
    sizes = members.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"))
    dot = F.aggregate(F.zip_with(vector, "centre", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    scored = members.join(centroids(members, cluster, vector), cluster).select(cluster, ident, F.round(dot, 9).alias("similarity"))
    place = F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc("similarity"), ident))
    return scored.withColumn("place", place.cast("long")).filter(F.col("place") <= k).join(sizes, cluster)


def cluster_summary(labelled: DataFrame, cluster: str, ident: str, vector: str, texts: DataFrame, text: str, group: str, stop: DataFrame, k: int = 6) -> DataFrame:
    """Clusters by size (the largest first, ties by label): the member nearest to the centre with its text, the k most used words outside the stop list,
    and how the members split over groups. `texts` has id, text and group of members; noise (-1) is left out."""
    medoids = nearest(labelled, cluster, ident, vector, 1).select(cluster, F.col(ident).alias("medoid"), "size")
    members = labelled.filter(F.col(cluster) != -1).select(cluster, ident).join(texts.select(ident, text, group), ident)
    words = top_words(members, [cluster], text, stop, k)
    listed = lambda rows, order, shown, name: rows.groupBy(cluster).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, shown.alias("_s")))), lambda x: x["_s"]), ", ").alias(name))
    terms = listed(words, ["place"], F.col("word"), "terms")
    split = members.groupBy(cluster, group).agg(F.count(F.lit(1)).alias("n"))
    groups = listed(split, [(-F.col("n")).alias("o"), F.col(group).alias("g")], F.concat(group, F.lit(" "), "n"), "groups")
    place = F.row_number().over(Window.orderBy(F.desc("size"), cluster)).cast("long")                    # one row for each cluster
    return (medoids.join(texts.select(F.col(ident).alias("medoid"), F.col(text).alias("medoid_text")), "medoid", "left").join(terms, cluster, "left").join(groups, cluster, "left")
            .withColumn("place", place))


def seed_rule(labelled: DataFrame, cluster: str, max_narratives: int = 8) -> DataFrame:
    """Whether a clustering is too coarse to start from, and how many k-means groups to use instead."""
    sizes = labelled.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))
    real = F.col(cluster) != -1
    total = sizes.agg(F.count_if(real).alias("clusters"), F.max(F.when(real, F.col("n"))).alias("_big"), F.sum(F.when(real, F.col("n"))).alias("_in"), F.sum("n").alias("n"))
    dominant = F.coalesce(F.col("_big").cast("double") / F.col("_in"), F.lit(1.0))
    noise = (F.col("n") - F.coalesce("_in", F.lit(0))).cast("double") / F.greatest("n", F.lit(1))
    k = F.least(F.lit(max_narratives), F.greatest(F.lit(3), F.floor(F.col("n") / 40))).cast("int")
    return total.select("clusters", dominant.alias("dominant"), noise.alias("noise_share"),
                        ((F.col("clusters") < 3) | (dominant > 0.6) | (noise > 0.5)).alias("use_kmeans"), k.alias("k"))

"""Hard, mini-batch and soft clustering of vectors, and the figures on clusters."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..plans.session import stored


#: Times that the few vectors drawn for a start are clustered; the best counts.
TRIALS = 5


class ClusterError(ValueError):
    """Clustering of no vectors, or into fewer than one or more clusters than vectors."""


def centroid_frame(spark, centroids) -> DataFrame:
    return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centroids)], "cluster_id int, c array<double>")


def assign(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """vec_id, cluster_id, distance of the nearest centroid, the first on a tie. Centroids are k rows, so they are broadcast."""
    near = vectors.join(F.broadcast(centroids), F.lit(True)).withColumn("d", F.round(V.euclidean(F.col("v"), F.col("c")), 9))
    return near.groupBy("vec_id").agg(F.min(F.struct("d", "cluster_id")).alias("m")).select("vec_id", F.col("m.cluster_id").alias("cluster_id"), F.round("m.d", 6).alias("distance"))


def means(vectors: DataFrame, assignment: DataFrame) -> DataFrame:
    """cluster_id, dim, mean: the mean of each dimension; sums combine before the shuffle."""
    j = vectors.join(assignment.select("vec_id", "cluster_id"), "vec_id").select("cluster_id", F.posexplode("v").alias("dim", "x"))
    return j.groupBy("cluster_id", "dim").agg(F.avg("x").alias("mean"))


def mean_vectors(vectors: DataFrame, assignment: DataFrame) -> DataFrame:
    m = means(vectors, assignment)
    return m.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "mean"))), lambda s: s["mean"]).alias("c"))


def sizes(assignment: DataFrame, centroids: DataFrame) -> DataFrame:
    n = assignment.groupBy("cluster_id").agg(F.count("*").alias("n"))
    return centroids.select("cluster_id").join(n, "cluster_id", "left").select("cluster_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def residual(vectors: DataFrame, centroids: DataFrame, assignment: DataFrame) -> DataFrame:
    j = vectors.join(assignment.select("vec_id", "cluster_id"), "vec_id").join(F.broadcast(centroids), "cluster_id")
    return j.agg(F.count("*").alias("n"), F.sum(V.squared_distance(F.col("v"), F.col("c"))).alias("rss"))


def bic(n, rss, k: int, dims: int):
    """n ln((rss + 1e-10) / n) + (k d + k - 1) ln n"""
    return n * F.log((rss + 1e-10) / n) + (k * dims + k - 1) * F.log(n)


def memberships(vectors: DataFrame, centroids: DataFrame, temperature: float = 0.5, least: float = 0.01) -> DataFrame:
    """vec_id, cluster_id, probability: softmax of negative distances, of at least ``least``."""
    near = vectors.join(F.broadcast(centroids), F.lit(True)).withColumn("d", V.euclidean(F.col("v"), F.col("c")))
    w = W.partitionBy("vec_id")
    p = near.withColumn("e", V.softmax_weight(F.col("d"), F.min("d").over(w), temperature)).withColumn("probability", F.round(F.col("e") / F.sum("e").over(w), 6))
    return p.where(F.col("probability") >= least).select("vec_id", "cluster_id", "probability")


def _check(n: int, k: int) -> None:
    if n == 0:
        raise ClusterError("no vectors to cluster")
    if k <= 0:
        raise ClusterError(f"k must be positive, not {k}")
    if k > n:
        raise ClusterError(f"{k} clusters asked of {n} vectors")


def _rows(col) -> np.ndarray:
    """Lists of one size as a matrix."""
    col = col.combine_chunks() if hasattr(col, "combine_chunks") else col
    return np.asarray(col.flatten(), float).reshape(len(col), -1)


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distance of each row to each centroid, a block of centroids at a time: no array of rows x centroids x dimensions."""
    return np.stack([((x - y) ** 2).sum(1) for y in c], axis=1)


def _drawn(vectors: DataFrame, seed: int, *salt: int):
    """A number from 0 to 1 for each vector, by hash: the same whenever and wherever a task runs."""
    return (F.xxhash64("vec_id", F.lit(seed), *map(F.lit, salt)).cast("double") / F.lit(2.0**64)) + 0.5


def initial(vectors: DataFrame, k: int, seed: int = 0, rounds: int = 5, factor: int = 2) -> list[list[float]]:
    """Starting centroids by k-means||: a round draws about ``factor * k`` vectors, each with a chance by its squared distance to those
    drawn so far, inside the tasks; k-means++ and some rounds of k-means then make k of the drawn ones, weighted by how many vectors are nearest to each.

    Some ``rounds * factor * k`` vectors come to the driver, whatever the table holds. Distances to few candidates are a pass over
    the vectors each for their sum and for the draw; nothing is sorted."""
    first = vectors.agg(F.min(F.struct(F.xxhash64("vec_id", F.lit(seed)), "vec_id", "v")).alias("m")).first().m
    c = np.array([first.v], float)
    rng = np.random.default_rng(seed)
    for i in range(rounds):
        total = _totals(vectors, {0: c})[0][2]
        if total <= 0:
            break
        share, here = factor * k / total, c

        def draw(batches, here=here, share=share):
            for batch in batches:
                x = _rows(batch.column(0))
                if len(x):
                    yield batch.filter(pa.array(np.asarray(batch.column(1)) < share * _squared(x, here).min(1)))

        more = vectors.select("v", _drawn(vectors, seed, i).alias("u")).mapInArrow(draw, "v array<double>, u double").collect()
        if more:
            c = np.vstack([c, np.array([r.v for r in sorted(more, key=lambda r: (r.u, r.v))], float)])
    weight = _totals(vectors, {0: c})[0][0]
    best = min((_reduced(c, weight, k, rng) for _ in range(TRIALS)), key=lambda t: t[0])[1]
    return [x.tolist() for x in best]


def _reduced(x: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator) -> tuple[float, np.ndarray]:
    """k-means++ and some of Lloyd's rounds on a few weighted vectors: the residual and k means of them."""
    picks = [rng.choice(len(x), p=weight / weight.sum())]
    d = ((x - x[picks[0]]) ** 2).sum(1)
    for _ in range(k - 1):
        p = weight * d
        picks.append(rng.choice(len(x), p=p / p.sum()) if p.sum() > 0 else rng.integers(len(x)))
        d = np.minimum(d, ((x - x[picks[-1]]) ** 2).sum(1))
    c = x[picks]
    for _ in range(10):
        near = _squared(x, c).argmin(1)
        n = np.bincount(near, weight, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x * weight[:, None])
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1e-300)[:, None], c)
    return float((weight * _squared(x, c).min(1)).sum()), c


def _totals(vectors: DataFrame, sets: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """For each set of centroids: how many vectors are nearest to each (the first on a tie), their sums, and the sum of squared
    distances. One pass for all sets; a task gives a row for each centroid and dimension, which combine before the driver gets them."""

    def add_up(batches):
        held = {s: (np.zeros(len(c)), np.zeros_like(c), np.zeros(len(c))) for s, c in sets.items()}
        for batch in batches:
            x = _rows(batch.column(0))
            for s, c in sets.items() if len(x) else ():
                d = _squared(x, c)
                near = d.argmin(1)
                n, sums, rss = held[s]
                n += np.bincount(near, minlength=len(c))
                rss += np.bincount(near, d[np.arange(len(x)), near], minlength=len(c))
                np.add.at(sums, near, x)
        for s, (n, sums, rss) in held.items():
            at = np.flatnonzero(n)
            flat = np.column_stack([n, rss, sums])[at]
            m = flat.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at) * m, s)), pa.array(np.repeat(at, m)), pa.array(np.tile(np.arange(m), len(at))), pa.array(flat.ravel())], ["s", "c", "d", "x"])

    got = vectors.select("v").mapInArrow(add_up, "s long, c long, d long, x double").groupBy("s", "c", "d").agg(F.sum("x").alias("x")).collect()
    out = {s: np.zeros((len(c), c.shape[1] + 2)) for s, c in sets.items()}
    for r in got:
        out[r.s][r.c, r.d] = r.x
    return {s: (t[:, 0], t[:, 2:], float(t[:, 1].sum())) for s, t in out.items()}


def _settled(vectors: DataFrame, sets: dict[int, np.ndarray], iterations: int) -> tuple[dict[int, np.ndarray], dict[int, float]]:
    """Lloyd's rounds of several sets of centroids at once, each until none of its centroids moves; the sets and their residuals."""
    moving, rss = dict(sets), dict.fromkeys(sets, 0.0)
    sets = dict(sets)
    for _ in range(iterations):
        for s, (n, sums, r) in _totals(vectors, moving).items():
            old, rss[s] = sets[s], r
            sets[s] = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], old)
            if np.abs(sets[s] - old).max() < 1e-12:
                del moving[s]
            else:
                moving[s] = sets[s]
        if not moving:
            return sets, rss
    return sets, rss | {s: t[2] for s, t in _totals(vectors, moving).items()}


def k_means(vectors: DataFrame, k: int, iterations: int = 100, seed: int = 0, centroids=None) -> tuple[list[list[float]], DataFrame]:
    """Centroids (k rows on the driver) and the assignment. An empty cluster keeps its centroid. Stops when no centroid moves."""
    _check(vectors.count(), k)
    start = np.array([list(map(float, x)) for x in (centroids or initial(vectors, k, seed))])
    c = _settled(vectors, {k: start}, iterations)[0][k].tolist()
    return c, assign(vectors, centroid_frame(vectors.sparkSession, c))


def mini_batch_k_means(vectors: DataFrame, k: int, batch: int = 100, iterations: int = 100, seed: int = 0, tolerance: float = 1e-4) -> tuple[list[list[float]], DataFrame]:
    """Centroids move towards each vector of a random batch by one over how many they have had; checked every 10 rounds.

    Vectors are laid out once in the order of a hash; a batch of about ``batch`` is a range of it, a filter that reaches the scan. Where
    the ranges have gone through the table, they start again from its beginning."""
    n = vectors.count()
    _check(n, k)
    laid = stored(vectors.select("v", _drawn(vectors, seed).alias("u")).repartitionByRange("u").sortWithinPartitions("u"), "batches")
    c = np.array(initial(vectors, k, seed))
    had, before, width = np.zeros(k), c.copy(), min(1.0, batch / n)
    for i in range(iterations):
        low = i * width % 1.0
        rows = laid.where((F.col("u") >= low) & (F.col("u") < low + width)).select("v", "u").collect()
        for r in sorted(rows, key=lambda r: (r.u, r.v)):
            v = np.array(r.v, float)
            m = int(((c - v) ** 2).sum(1).argmin())
            had[m] += 1
            c[m] += (v - c[m]) / had[m]
        if i % 10 == 9:
            if np.linalg.norm(c - before) < tolerance:
                break
            before = c.copy()
    out = c.tolist()
    return out, assign(vectors, centroid_frame(vectors.sparkSession, out))


def soft(vectors: DataFrame, most: int = 10, least: float = 0.01, use_bic: bool = True, seed: int = 0) -> tuple[int, DataFrame]:
    """The number of clusters (the one with the least BIC) and the memberships. All numbers are tried in the same passes."""
    spark = vectors.sparkSession
    n = vectors.count()
    empty = spark.createDataFrame([], "vec_id long, cluster_id int, probability double")
    if n == 0:
        return 0, empty
    if n == 1:
        return 1, vectors.select("vec_id", F.lit(0).alias("cluster_id"), F.lit(1.0).alias("probability"))
    low, high = vectors.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if low != high:
        raise ClusterError("vectors of different dimensions")
    ks = range(1, min(most, n) + 1) if use_bic else [min(most, n)]
    sets, rss = _settled(vectors, {k: np.array(initial(vectors, k, seed)) for k in ks}, 100)
    value = lambda k: n * math.log((rss[k] + 1e-10) / n) + (k * low + k - 1) * math.log(n)
    best = min(ks, key=lambda k: (value(k), k))
    return best, memberships(vectors, centroid_frame(spark, sets[best].tolist()), least=least)


def concept_match(clusters: DataFrame, concepts: DataFrame, threshold: float) -> DataFrame:
    """cluster_id, concept_id, confidence: the concept nearest by cosine that reaches the threshold, else a label from the summary.

    Of equal concepts the first (by ``ordinal``) wins; vectors of other sizes count 0; a zero vector never matches.
    Concepts are a bounded vocabulary, held against a few clusters; both sides are small.
    """
    pair = clusters.join(F.broadcast(concepts), F.lit(True)).withColumn("confidence", F.round(V.cosine(F.col("centroid"), F.col("v")), 6)).where(F.col("confidence") >= threshold)
    best = pair.groupBy("cluster_id").agg(F.min(F.struct((-F.col("confidence")).alias("n"), "ordinal", "concept_id")).alias("m"))
    label = F.substring(F.trim(F.split(F.col("summary"), "[.!?]")[0]), 1, 50)
    return clusters.join(best, "cluster_id", "left").select("cluster_id", F.col("m.concept_id").alias("concept_id"), (-F.col("m.n")).alias("confidence"), F.when(F.col("m").isNull(), label).alias("suggested_label"))

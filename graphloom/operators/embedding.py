"""Embeddings of nodes: seeded vectors, smoothing, translation models and link prediction."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.vectors import norm, normalized
from graphloom.storage import materialize


def seeded_vectors(nodes: DataFrame, dim: int, id_col: str = "id") -> DataFrame:
    """Unit vectors from a stable hash of the id: the same in every process and engine."""
    raw = F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: F.conv(F.substring(F.md5(F.concat_ws("|", F.col(id_col).cast("string"), i.cast("string"))), 1, 6), 16, 10).cast("bigint") / float(1 << 23) - 1.0)
    return nodes.select(F.col(id_col).alias("id"), normalized(raw).alias("v"))


def smooth(vectors: DataFrame, edges: DataFrame, self_weight: float = 0.5, neighbor_weight: float = 0.5, layers: int = 1) -> DataFrame:
    """Mean-of-neighbours smoothing, normalised, layer by layer.  Means are taken per dimension with
    partial sums, so a hub's neighbours are never gathered."""
    for _ in range(layers):
        parts = edges.select("src", "dst").join(vectors.select(F.col("id").alias("dst"), F.posexplode("v").alias("pos", "x")), "dst")
        means = parts.groupBy("src", "pos").agg(F.avg("x").alias("x")).groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s.x).alias("m"))
        joined = vectors.join(means, F.col("id") == F.col("src"), "left")
        mixed = F.when(F.col("m").isNull(), F.col("v")).otherwise(normalized(F.zip_with("v", "m", lambda a, b: self_weight * a + neighbor_weight * b)))
        vectors = joined.select("id", mixed.alias("v"))
    return vectors


def translation_distance(h, r, t):
    """Norm of head plus relation minus tail."""
    return norm(F.zip_with(F.zip_with(h, r, lambda a, b: a + b), t, lambda a, b: a - b))


def rotation_distance(h, phase, t):
    """Distance of the rotated head from the tail; vectors hold real parts, then imaginary ones."""
    half = (F.size(h) / 2).cast("int")
    re, im = F.slice(h, F.lit(1), half), F.slice(h, half + 1, half)
    out_re = F.zip_with(F.zip_with(re, phase, lambda a, p: a * F.cos(p)), F.zip_with(im, phase, lambda b, p: b * F.sin(p)), lambda x, y: x - y)
    out_im = F.zip_with(F.zip_with(re, phase, lambda a, p: a * F.sin(p)), F.zip_with(im, phase, lambda b, p: b * F.cos(p)), lambda x, y: x + y)
    return norm(F.zip_with(F.concat(out_re, out_im), t, lambda x, y: x - y))


def predict_links(queries: DataFrame, relations: DataFrame, entities: DataFrame, top_k: int) -> DataFrame:
    """Nearest tails of each (head, relation) by translation distance, over all entities."""
    q = queries.join(relations, "rel").select("head", "rel", F.zip_with("hv", "rv", lambda a, b: a + b).alias("aim"))
    scored = entities.join(q, F.col("id") != F.col("head")).select("head", "rel", "id", norm(F.zip_with("aim", "v", lambda a, b: a - b)).alias("distance"))
    order = Window.partitionBy("head", "rel").orderBy("distance", "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def numbered(nodes: DataFrame, per_bucket: int = 10_000) -> DataFrame:
    """Numbers 0 to n - 1 for distinct ids: id, no.  Ids are numbered within hash buckets, so no sort is global."""
    buckets = nodes.count() // per_bucket + 1
    ids = nodes.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(buckets)))
    sizes = ids.groupBy("b").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("b")) - F.col("n")).select("b", "before")  # a row per bucket
    within = F.row_number().over(Window.partitionBy("b").orderBy("id")) - 1
    return ids.withColumn("k", within).join(before, "b").select("id", (F.col("before") + F.col("k")).alias("no"))


def _normal(no: str, dim: int, seed: int):
    """``dim`` draws of a normal distribution with deviation 0.1, by hashes of the number."""
    even = lambda i, part: (F.pmod(F.xxhash64(F.lit(seed), F.col(no), F.lit(i), F.lit(part)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    return F.array(*[0.1 * F.sqrt(-2.0 * F.log(even(i, 0))) * F.cos(2.0 * math.pi * even(i, 1)) for i in range(dim)])


def fit_translation(edges: DataFrame, dim: int = 16, epochs: int = 30, rate: float = 0.05, margin: float = 1.0, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """TransE by margin ranking on all distinct edges: (id, v) of entities and (rel, v) of relations.

    An epoch joins the edges with the vectors of head, tail, relation and a drawn wrong tail, and takes
    the mean step of each vector with partial sums, so a hub's edges are never gathered."""
    rows = materialize(edges.select("src", "rel", "dst").distinct(), "edges")
    ids = materialize(numbered(rows.select(F.col("src").alias("id")).union(rows.select("dst")).distinct()), "ids")
    # entities have numbers from 0 on, relations -1, -2, ...: one table holds the vectors of both
    rels = materialize(numbered(rows.select(F.col("rel").alias("id")).distinct()).select("id", (-1 - F.col("no")).alias("no")), "rels")
    names = ids.count()
    if not names:
        empty = [s.select("id").withColumn("v", F.array().cast("array<double>")) for s in (ids, rels)]
        return empty[0], empty[1].withColumnRenamed("id", "rel")
    links = rows.join(ids.toDF("src", "h"), "src").join(ids.toDF("dst", "t"), "dst").join(rels.toDF("rel", "r"), "rel")
    links = materialize(links.select("h", "r", "t"), "links")
    state = materialize(ids.select("no").union(rels.select("no")).select("no", _normal("no", dim, seed).alias("v")), "vectors")
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    minus = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)
    square = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)
    for k in range(epochs):
        batch = links.withColumn("x", F.pmod(F.xxhash64("h", "r", "t", F.lit(seed), F.lit(k)), F.lit(names)))
        for c in ("h", "r", "t", "x"):
            batch = batch.join(state.select(F.col("no").alias(c), F.col("v").alias(f"v{c}")), c)
        aim = plus(F.col("vh"), F.col("vr"))
        batch = batch.select("h", "r", "t", "x", minus(aim, F.col("vt")).alias("good"), minus(aim, F.col("vx")).alias("bad"))
        lose = batch.where(margin + square(F.col("good")) - square(F.col("bad")) > 0).withColumn("gap", minus(F.col("good"), F.col("bad")))
        parts = [("h", "gap", 1.0), ("t", "good", -1.0), ("x", "bad", 1.0), ("r", "gap", 1.0)]
        steps = F.explode(F.array(*[F.struct(F.col(c).alias("no"), F.lit(c).alias("as"), F.transform(g, lambda y, f=f: f * y).alias("g")) for c, g, f in parts]))
        steps = lose.select(steps.alias("s")).select("s.*")
        # the mean over each part an entity plays, added up
        means = steps.groupBy("no").agg(*[sum(F.coalesce(F.avg(F.when(F.col("as") == c, F.col("g")[i])), F.lit(0.0)) for c, _, _ in parts).alias(f"g{i}") for i in range(dim)])
        moved = state.join(means.select("no", F.array(*[f"g{i}" for i in range(dim)]).alias("g")), "no", "left")
        moved = moved.select("no", F.when(F.col("g").isNull(), F.col("v")).otherwise(F.zip_with("v", "g", lambda v, g: v - 2 * rate * g)).alias("v"))
        size = F.when(F.col("no") < 0, F.lit(1.0)).otherwise(F.greatest(norm(F.col("v")), F.lit(1.0)))
        state = materialize(moved.withColumn("size", size).select("no", F.transform("v", lambda y: y / F.col("size")).alias("v")), "vectors")
    return ids.join(state, "no").select("id", "v"), rels.join(state, "no").select(F.col("id").alias("rel"), "v")


def procrustes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rotation that best maps rows of ``a`` onto rows of ``b``."""
    u, _, vt = np.linalg.svd(a.T @ b)
    return u @ vt


def align(vectors: DataFrame, anchors: DataFrame, dim: int) -> DataFrame:
    """Rotate vectors onto another space, given pairs of anchors (a, b).

    The cross-covariance is summed in Spark (dim x dim numbers reach the driver, however many
    anchors there are)."""
    cells = anchors.select(F.posexplode("a").alias("i", "x"), "b").select("i", "x", F.posexplode("b").alias("j", "y"))
    sums = cells.groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("s")).collect()
    m = np.zeros((dim, dim))
    for row in sums:
        m[row.i, row.j] = row.s
    u, _, vt = np.linalg.svd(m)
    rotation = u @ vt
    columns = [F.array(*[F.lit(float(x)) for x in rotation[:, j]]) for j in range(dim)]
    turned = F.array(*[F.aggregate(F.zip_with(F.col("v").cast("array<double>"), c, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) for c in columns])
    return vectors.withColumn("v", turned)


def signal_statistics(signal):
    """Mean, deviation, bounds, range, zero crossings, energy and peaks of an array of doubles."""
    n = F.size(signal)
    mean = F.aggregate(signal, F.lit(0.0), lambda s, x: s + x) / n
    energy = F.aggregate(signal, F.lit(0.0), lambda s, x: s + x * x)
    pairs = F.zip_with(F.slice(signal, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(signal, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.when(F.signum(a) * F.signum(b) < 0, 1).otherwise(0))
    crossings = F.aggregate(pairs, F.lit(0), lambda s, x: s + x)
    inner = F.sequence(F.lit(2), F.greatest(n - 1, F.lit(2)))
    peak = lambda i: F.when((i < n) & (F.try_element_at(signal, i) > F.try_element_at(signal, i - 1)) & (F.try_element_at(signal, i) > F.try_element_at(signal, i + 1)), 1).otherwise(0)
    return F.struct(
        mean.alias("mean"),
        F.sqrt(F.greatest(energy / n - mean * mean, F.lit(0.0))).alias("std"),
        F.array_min(signal).alias("low"),
        F.array_max(signal).alias("high"),
        (F.array_max(signal) - F.array_min(signal)).alias("range"),
        crossings.alias("crossings"),
        energy.alias("energy"),
        F.aggregate(F.transform(inner, peak), F.lit(0), lambda s, x: s + x).alias("peaks"),
    )


def spectral_features(bins: int = 8):
    """Pandas UDF: log energy of the spectrum in ``bins`` bands."""

    @F.pandas_udf("array<double>")
    def features(signals: pd.Series) -> pd.Series:
        def one(x):
            power = np.abs(np.fft.rfft(np.asarray(x, float))) ** 2
            return [float(np.log1p(part.sum())) for part in np.array_split(power, bins)]

        return signals.map(one)

    return features

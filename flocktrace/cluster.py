"""K-Means partitions of feature tables, their validity, stability and profiles."""

from __future__ import annotations

import json
from itertools import accumulate, combinations
from pathlib import Path

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import metrics
from .scaling import require_finite, scale, varying


def prepared(df: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str]]:
    """df with standardised columns that vary (name_z), and a vector of them; ValueError for values that are not finite."""
    require_finite(df, columns)
    kept = varying(df, columns)
    scaled, _ = scale(df, kept, "standard", "_z")
    names = [f"{c}_z" for c in kept]
    return VectorAssembler(inputCols=names, outputCol="vector").transform(scaled), names


def kmeans(vectors: DataFrame, k: int, seed: int = 42, n_init: int = 20) -> tuple[DataFrame, float]:
    """vectors with cluster_id by the best of n_init starts, and its inertia.  ValueError if k is not below the rows or one cluster comes out."""
    if k >= vectors.count():
        raise ValueError("k must be smaller than the number of rows")
    best = None
    cached = vectors.select("vector").persist()
    try:
        for start in range(n_init):
            model = KMeans(k=k, seed=seed + start, featuresCol="vector", predictionCol="cluster_id").fit(cached)
            if best is None or model.summary.trainingCost < best[1]:
                best = (model, model.summary.trainingCost)
    finally:
        cached.unpersist()
    out = best[0].transform(vectors)
    if out.select("cluster_id").distinct().count() < 2:
        raise ValueError("K-Means gave one cluster only")
    return out, best[1]


def sizes(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("cluster_id").agg(F.count("*").alias("n_rows"))


def profiles(labelled: DataFrame, columns: list[str]) -> DataFrame:
    """Size, share and medians of each cluster."""
    total = labelled.agg(F.count("*").alias("_n"))  # one row
    grouped = labelled.groupBy("cluster_id").agg(F.count("*").alias("n_rows"), *(F.expr(f"percentile({c}, 0.5)").alias(f"median_{c}") for c in columns))
    return grouped.join(F.broadcast(total)).withColumn("share", F.col("n_rows") / F.col("_n")).drop("_n")


def pca(vectors: DataFrame, k: int = 2) -> tuple[DataFrame, list[float]]:
    """vectors with pc1 to pck, and the share of variance of each; the sign of a component is arbitrary."""
    model = PCA(k=k, inputCol="vector", outputCol="pcs").fit(vectors)
    out = model.transform(vectors).withColumn("pcs", vector_to_array("pcs"))
    return out.withColumns({f"pc{i + 1}": F.col("pcs")[i] for i in range(k)}).drop("pcs"), [float(x) for x in model.explainedVariance]


def validity(labelled: DataFrame, names: list[str], key: str, most: int = 3000, seed: int = 42) -> DataFrame:
    """Silhouette over a sample and Davies-Bouldin of a partition, one row."""
    return metrics.silhouette(labelled, names, "cluster_id", key, most, seed).join(F.broadcast(metrics.davies_bouldin(labelled, names, "cluster_id")))


def sweep(df: DataFrame, key: str, representations: dict[str, list[str]], ks: list[int], seed: int = 42, n_init: int = 20, most: int = 3000) -> DataFrame:
    """Validity of each representation and k."""
    out: DataFrame | None = None
    for name, columns in representations.items():
        vectors, names = prepared(df, columns)
        for k in ks:
            labelled, inertia = kmeans(vectors, k, seed, n_init)
            row = validity(labelled, names, key, most, seed).select(F.lit(name).alias("representation"), F.lit(k).cast("long").alias("k"), "silhouette", "davies_bouldin", F.lit(inertia).alias("inertia"))
            out = row if out is None else out.unionByName(row)
    return out


def stability(df: DataFrame, key: str, columns: list[str], k: int, seeds: list[int], n_init: int = 20) -> DataFrame:
    """Adjusted Rand index of the partitions of each two seeds."""
    vectors, _ = prepared(df, columns)
    parts = {s: kmeans(vectors, k, s, n_init)[0].select(key, F.col("cluster_id")) for s in seeds}
    out: DataFrame | None = None
    for a, b in combinations(seeds, 2):
        row = metrics.adjusted_rand(parts[a], parts[b], key, "cluster_id", "cluster_id").select(F.lit(a).alias("seed_a"), F.lit(b).alias("seed_b"), "ari")
        out = row if out is None else out.unionByName(row)
    return out


def sensitivity(df: DataFrame, key: str, reference: list[str], variants: dict[str, list[str]], k: int, seed: int = 42, n_init: int = 20) -> DataFrame:
    """Adjusted Rand index of each variant's partition with that of the reference features."""
    base = kmeans(prepared(df, reference)[0], k, seed, n_init)[0].select(key, "cluster_id")
    out: DataFrame | None = None
    for name, columns in variants.items():
        part = kmeans(prepared(df, columns)[0], k, seed, n_init)[0].select(key, "cluster_id")
        row = metrics.adjusted_rand(base, part, key, "cluster_id", "cluster_id").select(F.lit(name).alias("variant"), "ari")
        out = row if out is None else out.unionByName(row)
    return out


def assignments(features: DataFrame, labelled: DataFrame, key: str = "episode_id") -> DataFrame:
    """Every row with its cluster; null, and a status that says so, where its history is incomplete."""
    joined = features.join(labelled.select(key, F.col("cluster_id").cast("int").alias("cluster_id")), key, "left")
    return joined.withColumn("status", F.when(F.col("cluster_id").isNull(), "incomplete_history").otherwise("assigned"))


def fit_bundle(df: DataFrame, columns: list[str], k: int, seed: int = 42, n_init: int = 20) -> dict:
    """What is needed to label new rows: columns with centre and spread, the best centres, and the settings."""
    kept = varying(require_finite(df, columns), columns)
    scaled, scaler = scale(df, kept, "standard", "_z")
    names = [f"{c}_z" for c in kept]
    vectors = VectorAssembler(inputCols=names, outputCol="vector").transform(scaled)
    best = None
    for start in range(n_init):
        model = KMeans(k=k, seed=seed + start, featuresCol="vector", predictionCol="cluster_id").fit(vectors)
        if best is None or model.summary.trainingCost < best[0]:
            best = (model.summary.trainingCost, model.clusterCenters())
    return {"columns": kept, "scaler": {c: list(scaler[c]) for c in kept}, "centres": [[float(x) for x in c] for c in best[1]], "inertia": best[0], "k": k, "seed": seed, "n_init": n_init}


def predict(df: DataFrame, bundle: dict) -> DataFrame:
    """df with cluster_id, the nearest centre of a bundle."""
    z = [(F.col(c) - F.lit(bundle["scaler"][c][0])) / F.lit(bundle["scaler"][c][1]) for c in bundle["columns"]]
    squares = []
    for i, centre in enumerate(bundle["centres"]):
        total = F.lit(0.0)
        for x, y in zip(z, centre, strict=True):
            total = total + (x - y) * (x - y)
        squares.append(F.struct(total.alias("d"), F.lit(i).alias("i")))
    return df.withColumn("cluster_id", F.array_min(F.array(*squares))["i"])


def save_bundle(bundle: dict, path: str | Path) -> None:
    Path(path).write_text(json.dumps(bundle, indent=2))


def load_bundle(path: str | Path) -> dict:
    return json.loads(Path(path).read_text())


def stability_summary(pairs: DataFrame, *keys: str) -> DataFrame:
    """Mean, sample deviation, least and greatest agreement of the pairs of seeds, by keys if there are any."""
    return pairs.groupBy(*keys).agg(F.avg("ari").alias("mean_ari"), F.stddev_samp("ari").alias("std_ari"), F.min("ari").alias("min_ari"), F.max("ari").alias("max_ari"))


def explained(spark: SparkSession, shares: list[float]) -> DataFrame:
    """component, its share of the variance, and the share of all components up to it."""
    return spark.createDataFrame(list(zip(range(1, len(shares) + 1), shares, accumulate(shares), strict=True)), "component long, explained_variance_ratio double, cumulative_variance double")

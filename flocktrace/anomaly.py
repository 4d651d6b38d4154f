"""Anomaly scores: statistical, nearest neighbours, density, isolation, one class, and forecast error.

Every detector returns its input with anomaly_score (higher is worse), is_anomaly and rank, from 1 by falling score; ties
keep the order of the key column.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import sample
from .scaling import scale
from .schemas import require_filled
from .storage import running_totals, staged


def ranked(df: DataFrame, key: str) -> DataFrame:
    """df with rank by falling anomaly_score; numbers come from totals over ranges, not from one task."""
    order = [F.col("anomaly_score").desc(), F.col(key)]
    return running_totals(df, order, {"rank": F.lit(1).cast("long")}, "ranked").drop("_range")


def top_fraction(df: DataFrame, contamination: float, score: str = "anomaly_score") -> DataFrame:
    """df with is_anomaly: scores above the quantile 1 - contamination."""
    if not 0 < contamination < 0.5:
        raise ValueError("contamination must be between 0 and 0.5")
    cut = df.agg(F.expr(f"percentile({score}, {1 - contamination})").alias("_cut"))  # one row
    return df.join(F.broadcast(cut)).withColumn("is_anomaly", F.col(score) > F.col("_cut")).drop("_cut")


def zscore(df: DataFrame, key: str, value: str, threshold: float = 3.0, robust: bool = False) -> DataFrame:
    """z_score by mean and sample deviation, or by median and 1.4826 times the median deviation; 0 where there is no spread."""
    require_filled(df, [key, value])
    v = F.col(value).cast("double")
    if robust:
        centre = df.agg(F.expr(f"percentile({value}, 0.5)").alias("c"))
        moved = df.join(F.broadcast(centre))
        spread = moved.agg((1.4826 * F.expr(f"percentile(abs({value} - c), 0.5)")).alias("s"))
        placed = moved.join(F.broadcast(spread))
    else:
        placed = df.join(F.broadcast(df.agg(F.avg(v).alias("c"), F.stddev_samp(v).alias("s"))))
    z = F.when(F.col("s").isNull() | (F.col("s") == 0) | F.isnan("s"), F.lit(0.0)).otherwise((v - F.col("c")) / F.col("s"))
    scored = placed.withColumn("z_score", z).drop("c", "s").withColumn("anomaly_score", F.abs("z_score"))
    return ranked(scored.withColumn("is_anomaly", F.col("anomaly_score") > threshold), key)


def neighbours(df: DataFrame, key: str, features: list[str], k: int, block: int = 4096) -> DataFrame:
    """key, other, distance and place of the k nearest other rows of every row, exact, on standardised features.

    The table is cut into blocks of about `block` rows; every block is compared with every other, as matrices, and keeps
    the k nearest of each row, of which the k nearest of all remain.  The work is that of all pairs, the memory of a task
    that of two blocks, and no row meets more than k rows of a block in a shuffle.
    """
    scaled, _ = scale(df.select(key, *(F.col(f).cast("double").alias(f) for f in features)), features, "standard", "_z")
    rows = scaled.select(F.col(key).alias("key"), F.array(*(f"{f}_z" for f in features)).alias("x"))
    n = rows.count()
    if k >= n:
        raise ValueError("k must be smaller than the number of rows")
    blocks = max(1, math.ceil(n / block))
    placed = staged(rows.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks))), "placed")
    # a copy of each block for each other: a blocked comparison of all rows with all rows
    spread = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    left = spread.select(F.col("block").alias("a"), F.col("with").alias("b"), F.lit(0).alias("side"), "key", "x")
    right = spread.select(F.col("with").alias("a"), F.col("block").alias("b"), F.lit(1).alias("side"), "key", "x")
    kind = df.schema[key].dataType.simpleString()

    def near(rows: pa.Table) -> pa.Table:
        side = np.array(rows["side"].to_pylist())
        x = np.array(rows["x"].to_pylist(), dtype=float).reshape(len(side), -1)
        keys = rows["key"].to_pylist()
        ai, bi = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        out: tuple[list, list, list] = ([], [], [])
        b = x[bi]
        for i in ai.tolist():
            d = np.sqrt(((b - x[i]) ** 2).sum(axis=1))
            order = np.lexsort((bi, d))[: k + 1]
            best = [(float(d[j]), keys[bi[j]]) for j in order if keys[bi[j]] != keys[i]][:k]
            out[0].extend([keys[i]] * len(best))
            out[1].extend(o for _, o in best)
            out[2].extend(v for v, _ in best)
        return pa.table({"key": pa.array(out[0], rows["key"].type), "other": pa.array(out[1], rows["key"].type), "distance": pa.array(out[2], pa.float64())})

    found = left.unionByName(right).groupBy("a", "b").applyInArrow(near, f"key {kind}, other {kind}, distance double")
    place = F.row_number().over(Window.partitionBy("key").orderBy("distance", "other"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def knn_distance(df: DataFrame, key: str, features: list[str], k: int = 5, contamination: float = 0.05) -> DataFrame:
    """Score: mean distance to the k nearest others."""
    require_filled(df, [key, *features])
    found = neighbours(df, key, features, k).groupBy(F.col("key").alias(key)).agg(F.avg("distance").alias("anomaly_score"))
    return ranked(top_fraction(df.join(found, key), contamination), key)


def lof(df: DataFrame, key: str, features: list[str], n_neighbors: int = 20, contamination: float = 0.05) -> DataFrame:
    """Local outlier factor: the density of a row's neighbours over its own."""
    require_filled(df, [key, *features])
    k = min(n_neighbors, df.count() - 1)
    near = staged(neighbours(df, key, features, k), "near")
    reach = near.groupBy("key").agg(F.max("distance").alias("k_distance"))
    each = near.join(reach.select(F.col("key").alias("other"), "k_distance"), "other")
    density = staged(each.groupBy("key").agg((1 / (F.avg(F.greatest("distance", "k_distance")) + 1e-10)).alias("lrd")), "density")
    others = near.join(density.select(F.col("key").alias("other"), F.col("lrd").alias("theirs")), "other").groupBy("key").agg(F.avg("theirs").alias("theirs"))
    scored = others.join(density, "key").select(F.col("key").alias(key), (F.col("theirs") / F.col("lrd")).alias("anomaly_score"))
    return ranked(top_fraction(df.join(scored, key), contamination), key)


def _path(n: float) -> float:
    """The mean depth of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def _grow(x: np.ndarray, rng: np.random.Generator, depth: int, limit: int) -> tuple:
    if depth >= limit or len(x) <= 1:
        return (depth + _path(len(x)),)
    spread = np.flatnonzero(x.max(axis=0) > x.min(axis=0))
    if not len(spread):
        return (depth + _path(len(x)),)
    f = int(rng.choice(spread))
    at = float(rng.uniform(x[:, f].min(), x[:, f].max()))
    low = x[:, f] < at
    return f, at, _grow(x[low], rng, depth + 1, limit), _grow(x[~low], rng, depth + 1, limit)


def _depths(tree: tuple, x: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
    if len(tree) == 1:
        out[rows] += tree[0]
        return
    f, at, low, high = tree
    below = x[rows, f] < at
    _depths(low, x, rows[below], out)
    _depths(high, x, rows[~below], out)


def isolation_forest(df: DataFrame, key: str, features: list[str], n_estimators: int = 200, contamination: float = 0.05, seed: int = 42, rows_per_tree: int = 256) -> DataFrame:
    """Isolation forest: trees grow on samples of at most rows_per_tree rows, and all rows are scored by all trees.

    The trees come from one sample of at most 64 times rows_per_tree rows on the driver; their size does not depend on
    the table's.
    """
    require_filled(df, [key, *features])
    pool = sample(df.select(key, *(F.col(f).cast("double").alias(f) for f in features)), key, 64 * rows_per_tree, seed).toPandas()
    x = pool.sort_values(key)[features].to_numpy()
    rng = np.random.default_rng(seed)
    size = min(rows_per_tree, len(x))
    trees = [_grow(x[rng.choice(len(x), size, replace=False)], rng, 0, math.ceil(math.log2(max(size, 2)))) for _ in range(n_estimators)]
    shared = df.sparkSession.sparkContext.broadcast(trees)  # at most n_estimators * rows_per_tree nodes
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = np.stack([batch.column(i + 1).to_numpy() for i in range(len(features))], 1)
            depth = np.zeros(len(m))
            for tree in shared.value:
                _depths(tree, m, np.arange(len(m)), depth)
            score = 2.0 ** -(depth / len(shared.value) / max(_path(size), 1e-9))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=[key, "anomaly_score"])

    scored = df.select(key, *(F.col(f).cast("double").alias(f) for f in features)).mapInArrow(run, f"{key} {kind}, anomaly_score double")
    return ranked(top_fraction(df.join(staged(scored, "scored"), key), contamination), key)


def _svm(x: np.ndarray, nu: float, gamma: float, steps: int = 20_000, tolerance: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and offset of a one-class machine: minimises a'Ka / 2 over sum a = 1, 0 <= a <= 1 / (nu n), two weights at a time."""
    n = len(x)
    k = np.exp(-gamma * ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    most = 1 / (nu * n)
    a = np.zeros(n)
    full = int(nu * n)
    a[:full] = most
    if full < n:
        a[full] = 1 - full * most
    g = k @ a
    for _ in range(steps):
        up, down = a < most - 1e-12, a > 1e-12
        i, j = int(np.argmin(np.where(up, g, np.inf))), int(np.argmax(np.where(down, g, -np.inf)))
        if g[j] - g[i] < tolerance:
            break
        move = min((g[j] - g[i]) / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12), most - a[i], a[j])
        a[i], a[j] = a[i] + move, a[j] - move
        g += move * (k[:, i] - k[:, j])
    edge = (a > 1e-10) & (a < most - 1e-10)
    return a, float(g[edge].mean() if edge.any() else (g[a > 1e-10].max() if (a > 1e-10).any() else 0.0))


def one_class_svm(df: DataFrame, key: str, features: list[str], nu: float = 0.1, gamma: float | None = None, seed: int = 42, most_rows: int = 1500) -> DataFrame:
    """One-class machine with a Gaussian kernel on standardised features; rows outside its border are anomalies.

    It is fitted on at most most_rows sampled rows, which bounds the kernel matrix, and scores all rows.
    """
    require_filled(df, [key, *features])
    scaled, _ = scale(df.select(key, *(F.col(f).cast("double").alias(f) for f in features)), features, "standard", "_z")
    names = [f"{f}_z" for f in features]
    x = sample(scaled.select(key, *names), key, most_rows, seed).toPandas().sort_values(key)[names].to_numpy()
    var = float(x.var())
    g = gamma if gamma is not None else 1 / (len(features) * var) if var else 1.0
    weights, rho = _svm(x, nu, g)
    keep = weights > 1e-10
    shared = df.sparkSession.sparkContext.broadcast((x[keep], weights[keep]))  # at most most_rows rows
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        support, w = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                m = np.stack([batch.column(i + 1).to_numpy() for i in range(len(names))], 1)
                value = np.exp(-g * ((m[:, None, :] - support[None, :, :]) ** 2).sum(-1)) @ w - rho
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(-value), pa.array(value < 0)], names=[key, "anomaly_score", "is_anomaly"])

    scored = scaled.select(key, *names).mapInArrow(run, f"{key} {kind}, anomaly_score double, is_anomaly boolean")
    return ranked(df.join(staged(scored, "scored"), key), key)


def prediction_error(df: DataFrame, time: str, value: str, method: str = "rolling", window: int = 12, threshold: float = 3.0) -> DataFrame:
    """Score: distance from the median of the values before, or from a straight line, in median deviations of all residuals.

    A series is one sequence, so its window has no key.
    """
    require_filled(df, [time, value])
    v = F.col(value).cast("double")
    if method == "rolling":
        order = Window.orderBy(time)
        past = F.expr(f"percentile({value}, 0.5)").over(order.rowsBetween(-window, -1))
        first = F.first(v).over(order.rowsBetween(Window.unboundedPreceding, 0))
        told = df.withColumn("predicted_value", F.coalesce(past, first))
    elif method == "linear":
        t = F.col(time).cast("double")
        line = df.agg(F.regr_slope(v, t).alias("a"), F.regr_intercept(v, t).alias("b"))
        told = df.join(F.broadcast(line)).withColumn("predicted_value", F.col("a") * t + F.col("b")).drop("a", "b")
    else:
        raise ValueError("method must be 'rolling' or 'linear'")
    told = told.withColumn("residual", v - F.col("predicted_value"))
    centred = told.join(F.broadcast(told.agg(F.expr("percentile(residual, 0.5)").alias("c"))))
    spread = centred.agg((1.4826 * F.expr("percentile(abs(residual - c), 0.5)")).alias("s"))
    score: Column = F.when(F.col("s") > 0, F.abs("residual") / F.col("s")).otherwise(F.abs("residual"))
    scored = told.join(F.broadcast(spread)).withColumn("anomaly_score", score).drop("s")
    return ranked(scored.withColumn("is_anomaly", F.col("anomaly_score") > threshold), time)


def compare_methods(df: DataFrame, key: str, features: list[str], contamination: float = 0.05, seed: int = 42) -> DataFrame:
    """Rows that each of four detectors flags."""
    found = {
        "knn_distance": knn_distance(df, key, features, contamination=contamination),
        "lof": lof(df, key, features, contamination=contamination),
        "isolation_forest": isolation_forest(df, key, features, contamination=contamination, seed=seed),
        "one_class_svm": one_class_svm(df, key, features, nu=contamination, seed=seed),
    }
    out: DataFrame | None = None
    for name, scored in found.items():
        row = scored.agg(F.lit(name).alias("method"), F.count("*").alias("n_rows"), F.count_if("is_anomaly").alias("n_flagged"))
        out = row if out is None else out.unionByName(row)
    return out


def flag_summary(scored: DataFrame, columns: list[str]) -> DataFrame:
    """Rows and medians of flagged and other rows."""
    return scored.groupBy("is_anomaly").agg(F.count("*").alias("n_rows"), *(F.expr(f"percentile({c}, 0.5)").alias(f"median_{c}") for c in columns))


def rank_cut(scored: DataFrame, share: float) -> DataFrame:
    """The int(rows * share) rows with the highest scores."""
    total = scored.agg(F.floor(F.count("*") * F.lit(share)).alias("_n"))  # one row
    return scored.join(F.broadcast(total)).where(F.col("rank") <= F.col("_n")).drop("_n")




#: The features of episodes that the run looks at.
EPISODE_FEATURES = ["n_slots", "median_size", "median_rssi", "n_gap_slots", "night_share"]


def run(episodes: DataFrame, folder: str, contamination: float = 0.05, seed: int = 42) -> dict[str, DataFrame]:
    """Scores episodes by an isolation forest, compares four detectors and writes all; the tables as they were written.

    all, normal and anomalous are parquet tables, comparison a CSV file.
    """
    from .sources import write_csv, write_split

    spark = episodes.sparkSession
    scored = staged(isolation_forest(episodes, "episode_id", EPISODE_FEATURES, contamination=contamination, seed=seed), "scored")
    compared = compare_methods(episodes, "episode_id", EPISODE_FEATURES, contamination, seed)
    out = {name: spark.read.parquet(path) for name, path in write_split(scored, folder).items()}
    path = write_csv(compared, f"{folder.rstrip('/')}/comparison")
    return out | {"comparison": spark.read.csv(path, header=True, schema=compared.schema)}

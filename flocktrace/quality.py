"""Data-quality reports and the decisions that follow from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _pct(part, whole):
    return F.when(whole > 0, F.round(100.0 * part / whole, 4)).otherwise(F.lit(0.0))


def duplicate_report(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Rows, repeated rows (nulls are equal) and their percentage."""
    counted = df.groupBy(*(subset or df.columns)).agg(F.count("*").alias("_c"))
    n, d = F.coalesce(F.sum("_c"), F.lit(0)), F.coalesce(F.sum(F.col("_c") - 1), F.lit(0))
    return counted.agg(n.alias("n_rows"), d.alias("n_duplicate_rows"), _pct(d, n).alias("pct_duplicate_rows"))


def drop_duplicates(df: DataFrame, position: str, subset: list[str] | None = None) -> DataFrame:
    """The first row, by position, of those that are equal in the subset."""
    keys = subset or [c for c in df.columns if c != position]
    w = Window.partitionBy(*keys).orderBy(position)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def symmetric_report(df: DataFrame, a: str, b: str) -> DataFrame:
    """Edges, self-loops, and edges that repeat another whatever way round."""
    counted = df.groupBy(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).agg(F.count("*").alias("c"))
    return counted.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n_edges"), F.coalesce(F.sum(F.when(F.col("lo") == F.col("hi"), F.col("c"))), F.lit(0)).alias("n_self_loops"), F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("n_duplicate_edges"))


def drop_symmetric(df: DataFrame, a: str, b: str, position: str, drop_self_loops: bool = True) -> DataFrame:
    """The first row, by position, of each undirected edge."""
    kept = df.where(F.col(a) != F.col(b)) if drop_self_loops else df
    w = Window.partitionBy(F.least(a, b), F.greatest(a, b)).orderBy(position)
    return kept.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def _absent(df: DataFrame, c: str):
    return F.col(c).isNull() | (F.isnan(c) if dict(df.dtypes)[c] in ("double", "float") else F.lit(False))


def missingness_report(df: DataFrame) -> DataFrame:
    """column, n_missing and pct_missing; NaN counts as missing.  One pass for all columns."""
    row = df.agg(F.count("*").alias("_n"), *(F.count_if(_absent(df, c)).alias(c) for c in df.columns))
    return row.select("_n", F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("n_missing")) for c in df.columns))).alias("r")).select("r.column", "r.n_missing", _pct(F.col("r.n_missing"), F.col("_n")).alias("pct_missing"))


def apply_missing(df: DataFrame, column: str, strategy: str) -> DataFrame:
    """drop_column, impute_median, impute_mode (lowest on a tie) or flag_missing."""
    if strategy == "drop_column":
        return df.drop(column)
    if strategy == "flag_missing":
        return df.withColumn(f"{column}_missing", _absent(df, column))
    if strategy == "impute_median":
        fill = df.agg(F.expr(f"percentile({column}, 0.5)").alias("_fill"))
    elif strategy == "impute_mode":
        counted = df.where(F.col(column).isNotNull()).groupBy(column).count()
        fill = counted.agg(F.min_by(column, F.struct(-F.col("count"), F.col(column))).alias("_fill"))
    else:
        raise ValueError(f"unknown strategy: {strategy}")
    return df.join(F.broadcast(fill)).withColumn(column, F.coalesce(F.col(column), F.col("_fill"))).drop("_fill")  # one row


def _bounds(df: DataFrame, column: str, k: float) -> DataFrame:
    q = df.agg(F.expr(f"percentile({column}, 0.25)").alias("q1"), F.expr(f"percentile({column}, 0.75)").alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    return q.select("q1", "q3", iqr.alias("iqr"), (F.col("q1") - k * iqr).alias("lower_bound"), (F.col("q3") + k * iqr).alias("upper_bound"))


def outlier_report(df: DataFrame, column: str, k: float = 1.5) -> DataFrame:
    """Quartiles, bounds, and rows strictly outside them."""
    out = F.count_if((F.col(column) < F.col("lower_bound")) | (F.col(column) > F.col("upper_bound")))
    names = ["q1", "q3", "iqr", "lower_bound", "upper_bound"]
    told = df.select(column).join(F.broadcast(_bounds(df, column, k))).groupBy(*names).agg(out.alias("n_outliers"), F.count("*").alias("n"))
    return told.select(F.lit(column).alias("column"), *names, "n_outliers", _pct(F.col("n_outliers"), F.col("n")).alias("pct_outliers"))


def flag_outliers(df: DataFrame, column: str, k: float = 1.5) -> DataFrame:
    """df with {column}_outlier; nulls are none."""
    flag = F.coalesce((F.col(column) < F.col("lower_bound")) | (F.col(column) > F.col("upper_bound")), F.lit(False))
    return df.join(F.broadcast(_bounds(df, column, k))).withColumn(f"{column}_outlier", flag).drop("q1", "q3", "iqr", "lower_bound", "upper_bound")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """label, its rows and n / (classes * rows)."""
    counted = df.groupBy(label).agg(F.count("*").alias("n_rows"))
    total = counted.agg(F.sum("n_rows").alias("_n"), F.count("*").alias("_k"))  # one row
    return counted.join(F.broadcast(total)).select(label, "n_rows", (F.col("_n") / (F.col("_k") * F.col("n_rows"))).alias("weight"))


def degrees(edges: DataFrame, a: str = "user_a", b: str = "user_b") -> DataFrame:
    """Edges at each node."""
    return edges.select(F.explode(F.array(a, b)).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def id_gap(reference: DataFrame, others: list[DataFrame], column: str) -> DataFrame:
    """Ids of the other tables that the reference table lacks; every table has the column."""
    every = others[0].select(column)
    for df in others[1:]:
        every = every.unionByName(df.select(column))
    return every.distinct().join(reference.select(column), column, "left_anti")


def with_group_total(df: DataFrame, key: str, out: str) -> DataFrame:
    """df with the rows of its key; counts are combined before the shuffle and joined back."""
    return df.join(df.groupBy(key).agg(F.count("*").alias(out)), key)


def with_endpoints(edges: DataFrame, dimension: DataFrame, key: str, columns: list[str], a: str = "user_a", b: str = "user_b") -> DataFrame:
    """edges with columns of a dimension for each end, as a_ and b_; null where it has no row."""
    out = edges
    for end, prefix in ((a, "a_"), (b, "b_")):
        out = out.join(dimension.select(F.col(key).alias(end), *(F.col(c).alias(prefix + c) for c in columns)), end, "left")
    return out


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """Values with rows and share."""
    counted = df.groupBy(column).agg(F.count("*").alias("n_rows"))
    total = counted.agg(F.sum("n_rows").alias("_n"))  # one row
    return counted.join(F.broadcast(total)).select(column, "n_rows", (F.col("n_rows") / F.col("_n")).alias("share"))


def describe(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles."""
    q = lambda p: F.expr(f"percentile({column}, {p})")
    return df.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).cast("double").alias("min"), q(0.25).alias("q25"), q(0.5).alias("q50"), q(0.75).alias("q75"), F.max(column).cast("double").alias("max"))


def prepare_scans(classified: DataFrame, k: float = 1.5) -> DataFrame:
    """Scans with rssi_outlier and rssi_scaled (robust) for contacts, null for all others."""
    contact = F.col("is_valid_contact") & (F.col("rssi") < 0)
    q = classified.where(contact).agg(*(F.expr(f"percentile(rssi, {p})").alias(n) for n, p in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))))
    iqr = F.col("q3") - F.col("q1")
    outlier = (F.col("rssi") < F.col("q1") - k * iqr) | (F.col("rssi") > F.col("q3") + k * iqr)
    return classified.join(F.broadcast(q)).withColumns({"rssi_outlier": F.when(contact, outlier), "rssi_scaled": F.when(contact, (F.col("rssi") - F.col("q2")) / F.when(iqr == 0, F.lit(1.0)).otherwise(iqr))}).drop("q1", "q2", "q3")


def _judged(df: DataFrame, column: str, k: float) -> DataFrame:
    """df with {column}_outlier and {column}_scaled (robust), both by the quartiles of df itself."""
    q = df.agg(*(F.expr(f"percentile({column}, {p})").alias(n) for n, p in (("_q1", 0.25), ("_q2", 0.5), ("_q3", 0.75))))  # one row
    iqr = F.col("_q3") - F.col("_q1")
    outlier = (F.col(column) < F.col("_q1") - k * iqr) | (F.col(column) > F.col("_q3") + k * iqr)
    scaled = (F.col(column) - F.col("_q2")) / F.when(iqr == 0, F.lit(1.0)).otherwise(iqr)
    return df.join(F.broadcast(q)).withColumns({f"{column}_outlier": F.coalesce(outlier, F.lit(False)), f"{column}_scaled": scaled}).drop("_q1", "_q2", "_q3")


def prepare_calls(calls: DataFrame, k: float = 1.5) -> DataFrame:
    """Distinct calls with is_missed_call, duration_outlier and duration_scaled; missed calls are no outliers and have no scale."""
    kept = calls.dropDuplicates().withColumn("is_missed_call", F.col("duration") == -1)
    missed = kept.where("is_missed_call").withColumns({"duration_outlier": F.lit(False), "duration_scaled": F.lit(None).cast("double")})
    return _judged(kept.where("not is_missed_call"), "duration", k).unionByName(missed)


def prepare_sms(sms: DataFrame, k: float = 1.5) -> DataFrame:
    """Distinct messages with how many their sender sent, whether that is an outlier among senders, and its robust scale."""
    kept = sms.dropDuplicates(["timestamp", "sender", "recipient"])
    senders = _judged(kept.groupBy("sender").agg(F.count("*").alias("sender_n_sent")), "sender_n_sent", k)
    return kept.join(senders, "sender")


def prepare_friends(friends: DataFrame, position: str, k: float = 1.5) -> DataFrame:
    """Undirected edges with the number of friends at each end, whether it is an outlier among users, and its robust scale."""
    kept = drop_symmetric(friends, "user_a", "user_b", position)
    users = _judged(degrees(kept).withColumnRenamed("degree", "n_friends"), "n_friends", k)
    return with_endpoints(kept, users, "node", ["n_friends", "n_friends_outlier", "n_friends_scaled"])


def ordinal(df: DataFrame, column: str, order: list[str], out: str | None = None) -> DataFrame:
    """df with the place, from 0, of a category in the given order; null for any other value."""
    place = F.array_position(F.array(*(F.lit(v) for v in order)), F.col(column)) - 1
    return df.withColumn(out or f"{column}_ordinal", F.when(place >= 0, place))

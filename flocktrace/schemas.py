"""Table schemas, and checks on columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _longs(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.LongType()) for n in names])


SCANS = _longs("timestamp", "user_a", "user_b", "rssi")
FLAGS = ["is_empty_scan", "is_external_device", "is_valid_contact"]
PREPARED = T.StructType([*SCANS.fields, *(T.StructField(n, T.BooleanType()) for n in FLAGS)])
FRIENDS = _longs("user_a", "user_b")
GENDERS = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("is_female", T.IntegerType())])
CALLS = _longs("timestamp", "caller", "callee", "duration")
SMS = _longs("timestamp", "sender", "recipient")


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """df, or a ValueError that names the columns it lacks."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    """df, or a ValueError if a key comes twice."""
    if not df.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"{', '.join(keys)} is not unique")
    return df


def require_filled(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """df; ValueError if it is empty or has a missing value in the columns, KeyError if one is absent."""
    names = list(names)
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise KeyError(f"columns not found: {absent}")
    kinds = dict(df.dtypes)
    nothing = [F.col(n).isNull() | (F.isnan(n) if kinds[n] in ("double", "float") else F.lit(False)) for n in names]
    row = df.agg(F.count("*").alias("n"), *(F.count_if(c).alias(f"m{i}") for i, c in enumerate(nothing))).first()
    if row["n"] == 0:
        raise ValueError("the input is empty")
    if any(row[f"m{i}"] for i in range(len(names))):
        raise ValueError(f"columns {names} contain missing values")
    return df

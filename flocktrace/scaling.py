"""Scaling of numeric columns with statistics over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scale(df: DataFrame, columns: list[str], method: str = "standard", suffix: str = "_scaled") -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """df with scaled columns, and centre and spread of each.

    standard: mean and population deviation; minmax: least and range; robust: median and quartile range, exact.  A spread
    of 0 counts as 1.
    """
    of = {
        "standard": lambda c: (F.avg(c), F.stddev_pop(c)),
        "minmax": lambda c: (F.min(c).cast("double"), (F.max(c) - F.min(c)).cast("double")),
        "robust": lambda c: (F.expr(f"percentile(`{c}`, 0.5)"), F.expr(f"percentile(`{c}`, 0.75) - percentile(`{c}`, 0.25)")),
    }
    if method not in of:
        raise ValueError(f"unknown method: {method}")
    row = df.agg(*(x.alias(f"{k}{i}") for i, c in enumerate(columns) for k, x in zip("cs", of[method](c), strict=True))).first()
    scaler = {c: (row[f"c{i}"], row[f"s{i}"] or 1.0) for i, c in enumerate(columns)}
    return df.withColumns({f"{c}{suffix}": (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in scaler.items()}), scaler


def varying(df: DataFrame, columns: list[str]) -> list[str]:
    """The columns with more than one value."""
    row = df.agg(*((F.min(c) < F.max(c)).alias(c) for c in columns)).first()
    return [c for c in columns if row[c]]


def require_finite(df: DataFrame, columns: list[str]) -> DataFrame:
    bad = [F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))) for c in columns]
    if any(df.agg(*(b.alias(str(i)) for i, b in enumerate(bad))).first()):
        raise ValueError("feature values must all be finite")
    return df

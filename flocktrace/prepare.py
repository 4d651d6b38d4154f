"""Classification and filtering of scans, time slots, and preparation of the other logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def classify(scans: DataFrame) -> DataFrame:
    """scans with flags for empty scans, outside devices and valid contacts."""
    return scans.withColumns({
        "is_empty_scan": (F.col("user_b") == -1) & (F.col("rssi") == 0),
        "is_external_device": F.col("user_b") == -2,
        "is_valid_contact": (F.col("user_a") >= 0) & (F.col("user_b") >= 0),
    })


def slot_of(timestamp: Column, slot: int) -> Column:
    """The number of the time slot; floors, also below zero."""
    return F.floor(timestamp / F.lit(slot)).cast("long")


def contacts(classified: DataFrame, rssi_threshold: int = -90, slot: int = 300) -> DataFrame:
    """Valid contacts at or above the threshold and below 0, with their slot."""
    kept = classified.where(F.col("is_valid_contact") & (F.col("rssi") < 0) & (F.col("rssi") >= rssi_threshold))
    return kept.drop("is_empty_scan", "is_external_device", "is_valid_contact").withColumn("slot_id", slot_of(F.col("timestamp"), slot))


def coverage(classified: DataFrame) -> DataFrame:
    """Scans that saw nobody or an outside device."""
    return classified.where(F.col("is_empty_scan") | F.col("is_external_device")).drop("is_empty_scan", "is_external_device", "is_valid_contact")


def sentinel_summary(classified: DataFrame) -> DataFrame:
    """Rows and percentage of each kind of scan."""
    empty, outside, valid = (F.col(c) for c in ("is_empty_scan", "is_external_device", "is_valid_contact"))
    kind = F.when(empty, "empty").when(outside, "external").when(valid & (F.col("rssi") < 0), "contact").otherwise("unexpected")
    counted = classified.groupBy(kind.alias("kind")).agg(F.count("*").alias("n_rows"))
    # one row for each kind
    total = classified.agg(F.count("*").alias("all_rows"))
    return counted.join(F.broadcast(total)).select("kind", "n_rows", F.round(100.0 * F.col("n_rows") / F.col("all_rows"), 4).alias("pct"))


def split_calls(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Completed (duration 0 or more) and missed (-1) calls; other durations are neither."""
    return calls.where("duration >= 0"), calls.where("duration = -1")


def day_parts(df: DataFrame, time_col: str = "start_time") -> DataFrame:
    """df with day, week, weekday (0 for the first day of all) and hour, from seconds."""
    day = F.floor(F.col(time_col) / 86400)
    return df.withColumns({"day": day, "week": F.floor(day / 7), "weekday": F.pmod(day, F.lit(7)), "hour": F.floor(F.pmod(F.col(time_col), F.lit(86400)) / 3600)})


def coercion_failures(df: DataFrame, columns: list[str]) -> DataFrame:
    """For each column the values that are there but are no whole numbers."""
    counted = df.agg(*(F.count_if(F.col(c).isNotNull() & F.expr(f"try_cast({c} as bigint) is null")).alias(c) for c in columns))
    return counted.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("n_failed")) for c in columns))).alias("r")).select("r.*")

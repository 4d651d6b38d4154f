"""Aggregate reports over contacts, gatherings and episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Left-closed bands of signal strength.
BANDS = [-100, -90, -85, -80, -75, -70, -65, -60, 0]


def rssi_bands(contacts: DataFrame) -> DataFrame:
    """Contacts in each band, 0 for empty ones; values outside all bands are not counted."""
    spark = contacts.sparkSession
    pairs = list(zip(BANDS[:-1], BANDS[1:], strict=True))
    label = lambda a, b: f"[{a}, {b})"
    band = F.lit(None).cast("string")
    for a, b in pairs:
        band = F.when((F.col("rssi") >= a) & (F.col("rssi") < b), label(a, b)).otherwise(band)
    bands = spark.createDataFrame([(i, label(a, b)) for i, (a, b) in enumerate(pairs)], "position long, band string")
    counted = contacts.groupBy(band.alias("band")).agg(F.count("*").alias("n"))
    return bands.join(F.broadcast(counted), "band", "left").select("position", "band", F.coalesce("n", F.lit(0)).alias("contact_records"))


def per_slot(contacts: DataFrame) -> DataFrame:
    return contacts.groupBy("slot_id").agg(F.count("*").alias("contact_records"), F.countDistinct("user_a").alias("scanners"))


def per_day(contacts: DataFrame, slot: int) -> DataFrame:
    return contacts.groupBy(F.floor(F.col("slot_id") * slot / 86400).alias("relative_day")).agg(F.count("*").alias("contact_records"))


def participants(contacts: DataFrame) -> DataFrame:
    """Records, people at either end, people who scanned, and the median strength."""
    people = contacts.select(F.explode(F.array("user_a", "user_b")).alias("u")).agg(F.countDistinct("u").alias("participants"))
    main = contacts.agg(F.count("*").alias("contact_records"), F.countDistinct("user_a").alias("scanners"), F.expr("percentile(rssi, 0.5)").alias("median_rssi_dbm"))
    return main.join(F.broadcast(people))  # one row each


def gathering_metrics(gatherings: DataFrame) -> DataFrame:
    return gatherings.agg(F.count("*").alias("gatherings"), F.avg(F.size("participant_set")).alias("mean_size"), F.expr("percentile(median_rssi, 0.5)").alias("median_rssi_dbm"))


def episode_spans(episodes: DataFrame) -> DataFrame:
    return episodes.groupBy(F.col("n_slots").alias("covered_slots")).agg(F.count("*").alias("episodes"))


def episode_metrics(episodes: DataFrame) -> DataFrame:
    return episodes.agg(F.count("*").alias("episodes"), F.expr("percentile(n_slots, 0.5)").alias("median_slots"), F.count_if(F.col("n_gap_slots") > 0).alias("episodes_with_gaps"), F.expr("percentile(size(participant_set), 0.5)").alias("median_union_size"))


def communication_by_day(features: DataFrame) -> DataFrame:
    return features.groupBy(F.floor(F.col("start_time") / 86400).alias("relative_day")).agg(F.sum("calls_events_pre").alias("calls_events_pre"), F.sum("sms_events_pre").alias("sms_events_pre"))


def search(df: DataFrame, text: str) -> DataFrame:
    """Rows whose JSON has the text, whatever the case."""
    return df.where(F.contains(F.lower(F.to_json(F.struct("*"))), F.lit(text.lower())))


def compare_partitions(a: DataFrame, b: DataFrame, key: str = "episode_id") -> DataFrame:
    """Shared keys, those of one side only, and the adjusted Rand index."""
    from .metrics import adjusted_rand

    return adjusted_rand(a, b, key, "cluster_id", "cluster_id")


def rssi_histogram(contacts: DataFrame) -> DataFrame:
    """Contacts by whole dBm."""
    return contacts.groupBy(F.round("rssi").cast("long").alias("rssi")).agg(F.count("*").alias("contact_records"))


def size_between(gatherings: DataFrame, least: int, most: int) -> DataFrame:
    """Gatherings of least to most members, both included."""
    return gatherings.where(F.size("participant_set").between(least, most))


def quantile_vector(df: DataFrame, column: str) -> DataFrame:
    """Exact least, quartiles and greatest of a column, one row."""
    return df.agg(*(F.expr(f"percentile({column}, {p})").alias(n) for n, p in (("q0", 0.0), ("q25", 0.25), ("q50", 0.5), ("q75", 0.75), ("q100", 1.0))))


def id_universe(frames: list[tuple[DataFrame, str]]) -> DataFrame:
    """Distinct ids of a column of each table."""
    out = None
    for df, column in frames:
        ids = df.select(F.col(column).alias("id"))
        out = ids if out is None else out.unionByName(ids)
    return out.distinct()

"""Contacts as a stream: the same filters and slots on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import prepare


def contacts_per_window(scans: DataFrame, rssi_threshold: int = -90, slot: int = 300, late: str = "10 minutes") -> DataFrame:
    """Contacts and scanners in each slot of a stream of scans; rows later than `late` are dropped once a slot is out.

    Scanners are counted approximately, as exact distinct counts are not kept on streams.
    """
    kept = prepare.contacts(prepare.classify(scans), rssi_threshold, slot).withColumn("at", F.timestamp_seconds("timestamp"))
    counted = kept.withWatermark("at", late).groupBy(F.window("at", f"{slot} seconds"))
    return counted.agg(F.count("*").alias("contact_records"), F.approx_count_distinct("user_a").alias("scanners")).select(F.floor(F.unix_seconds("window.start") / slot).alias("slot_id"), "contact_records", "scanners")

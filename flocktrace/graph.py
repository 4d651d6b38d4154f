"""Gatherings: connected groups of participants within a time slot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .storage import running_totals, shuffled, staged


def slot_components(contacts: DataFrame) -> DataFrame:
    """slot_id, member and component (its least member) for every participant of a contact between two people.

    All slots are one graph whose nodes are (slot, participant), so one run finds the components of all.
    """
    node = lambda c: F.struct(F.col("slot_id").alias("slot"), F.col(c).alias("member"))
    pairs = contacts.select("slot_id", F.least("user_a", "user_b").alias("a"), F.greatest("user_a", "user_b").alias("b")).distinct()
    found = connected_components(pairs.select(node("a").alias("u"), node("b").alias("v")))
    loops = pairs.where("a = b").select(node("a").alias("node")).distinct().join(shuffled(found), "node", "left_anti").select("node", F.col("node").alias("component"))
    return found.unionByName(loops).select(F.col("node.slot").alias("slot_id"), F.col("node.member").alias("member"), F.col("component.member").alias("component"))


def gatherings(contacts: DataFrame, min_size: int = 3, position: str | None = None) -> DataFrame:
    """One row for each component of at least min_size members.

    slot_id, gathering_id, participant_set, start_time, end_time, median_rssi; times and the median are over all contact
    rows of the component, repeated ones included.  Ids run over slots, and within a slot over the first contact row of
    each component: by the column `position`, or else by (timestamp, user_a, user_b, rssi).
    """
    first = F.struct(F.col(position)) if position else F.struct("timestamp", "user_a", "user_b", "rssi")
    members = staged(slot_components(contacts), "members")
    sets = members.groupBy("slot_id", "component").agg(F.array_sort(F.collect_list("member")).alias("participant_set")).where(F.size("participant_set") >= min_size)
    placed = contacts.withColumn("first_row", first).join(shuffled(members.withColumnRenamed("member", "user_a")), ["slot_id", "user_a"])
    spans = placed.groupBy("slot_id", "component").agg(F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"), F.expr("percentile(rssi, 0.5)").alias("median_rssi"), F.min("first_row").alias("first_row"))
    rows = sets.join(shuffled(spans), ["slot_id", "component"]).drop("component")
    numbered = running_totals(rows, [F.col("slot_id"), F.col("first_row")], {"number": F.lit(1).cast("long")}, "gatherings")
    return numbered.select("slot_id", (F.col("number") - 1).alias("gathering_id"), "participant_set", "start_time", "end_time", "median_rssi")


def gathering_sizes(found: DataFrame) -> DataFrame:
    """How many gatherings have each size."""
    return found.groupBy(F.size("participant_set").cast("long").alias("participants")).agg(F.count("*").alias("gathering_slots"))

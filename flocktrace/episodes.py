"""Episodes: gatherings linked over time by the similarity of their members."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import dropped, running_totals, shuffled, staged

MOST_ROUNDS = 200


def positioned(gatherings: DataFrame) -> DataFrame:
    """gatherings with pos, their number in the order of (slot_id, gathering_id), from 0."""
    numbered = running_totals(gatherings, [F.col("slot_id"), F.col("gathering_id")], {"pos": F.lit(1).cast("long")}, "positioned")
    return numbered.withColumn("pos", F.col("pos") - 1).drop("_range")


def candidate_links(rows: DataFrame, theta: float, max_gap: int) -> DataFrame:
    """i, j, jac and gap of rows j that come 1 to max_gap + 1 slots after i, share a member, and have similarity theta or more.

    An inverted index over members finds the pairs that share one; their counts are the intersections.
    """
    each = rows.select("pos", "slot_id", F.size("participant_set").alias("n"), F.explode("participant_set").alias("member"))
    left = each.select(F.col("pos").alias("i"), F.col("n").alias("n_i"), "member", F.explode(F.sequence(F.lit(0), F.lit(max_gap))).alias("gap"), "slot_id").withColumn("slot_id", F.col("slot_id") + 1 + F.col("gap"))
    right = each.select(F.col("pos").alias("j"), F.col("n").alias("n_j"), "member", "slot_id")
    shared = left.join(shuffled(right), ["slot_id", "member"]).groupBy("i", "j", "gap", "n_i", "n_j").agg(F.count("*").alias("shared"))
    jac = F.col("shared") / (F.col("n_i") + F.col("n_j") - F.col("shared"))
    return shared.select("i", "j", jac.alias("jac"), F.col("gap").cast("long").alias("gap")).where(F.col("jac") >= theta)


def accept_links(links: DataFrame, theta: float, max_gap: int) -> DataFrame:
    """The links (i, j) that a scan in the order gap, falling jac, i, j accepts when each row takes one link either way.

    A link that is first of those left at both of its ends is accepted by the scan whatever else is left, so rounds of
    such links give the same result; links at taken ends go.
    """
    left = staged(links.where((F.col("jac") >= theta) & (F.col("gap") <= max_gap)), "links")
    taken: DataFrame | None = None
    order = [F.col("gap"), F.col("jac").desc(), F.col("i"), F.col("j")]
    for _ in range(MOST_ROUNDS):
        ranked = left.withColumns({"ri": F.row_number().over(Window.partitionBy("i").orderBy(*order)), "rj": F.row_number().over(Window.partitionBy("j").orderBy(*order))})
        new = staged(ranked.where("ri = 1 and rj = 1").select("i", "j"), "accepted")
        taken = new if taken is None else taken.unionByName(new)
        rest = staged(left.join(shuffled(new.select("i")), "i", "left_anti").join(shuffled(new.select("j")), "j", "left_anti"), "links")
        dropped(left)
        left = rest
        if left.isEmpty():
            return taken
    raise RuntimeError(f"links have not settled after {MOST_ROUNDS} rounds")


def chains(rows: DataFrame, accepted: DataFrame) -> DataFrame:
    """pos, root and step of every row: the first row of its chain, and how many links after it.  Pointers are doubled."""
    start = rows.select("pos").join(shuffled(accepted.select(F.col("j").alias("pos"), F.col("i").alias("before"))), "pos", "left")
    now = staged(start.select("pos", F.coalesce("before", "pos").alias("root"), F.when(F.col("before").isNotNull(), 1).otherwise(0).cast("long").alias("step")), "pointers")
    moving = now.where("root <> pos").count()
    while moving:
        ahead = now.select(F.col("pos").alias("root"), F.col("root").alias("next"), F.col("step").alias("more"))
        further = staged(now.join(shuffled(ahead), "root").select("pos", F.col("next").alias("root"), (F.col("step") + F.col("more")).alias("step")), "pointers")
        moving = further.join(shuffled(now.select("pos", F.col("root").alias("old"))), "pos").where("root <> old").count()
        dropped(now)
        now = further
    return now


def assemble(rows: DataFrame, chained: DataFrame, slot: int = 300) -> DataFrame:
    """One row for each chain, numbered in the order of first rows, with its span, members, medians and hours."""
    joined = rows.join(shuffled(chained), "pos")
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("step", F.col(c).alias("v")))), lambda x: x["v"])
    grouped = joined.groupBy("root").agg(
        F.min("slot_id").alias("first_slot"),
        F.max("slot_id").alias("last_slot"),
        F.min_by("start_time", "step").alias("start_time"),
        F.max_by("end_time", "step").alias("end_time"),
        F.count("*").alias("n_rows"),
        ordered("gathering_id").alias("gathering_ids"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("participant_set")))).alias("participant_set"),
        F.expr("percentile(size(participant_set), 0.5)").alias("median_size"),
        F.expr("percentile(median_rssi, 0.5)").alias("median_rssi"),
    )
    hour = lambda s: F.pmod(F.floor(s * slot / F.lit(3600)), F.lit(24))
    n_slots = F.col("last_slot") - F.col("first_slot") + 1
    night = F.size(F.filter(F.sequence("first_slot", "last_slot"), lambda s: hour(s) < 7)) / n_slots
    numbered = running_totals(grouped, [F.col("root")], {"number": F.lit(1).cast("long")}, "episodes")
    return numbered.select((F.col("number") - 1).alias("episode_id"), "first_slot", "last_slot", "start_time", "end_time", n_slots.alias("n_slots"), (n_slots - F.col("n_rows")).alias("n_gap_slots"), "gathering_ids", "participant_set", "median_size", "median_rssi", hour(F.col("first_slot")).cast("int").alias("start_hour"), night.alias("night_share"))


def build_episodes(gatherings: DataFrame, theta: float = 0.7, max_gap: int = 1, slot: int = 300) -> DataFrame:
    """Links gatherings into episodes."""
    rows = staged(positioned(gatherings), "rows")
    links = candidate_links(rows, theta, max_gap)
    return assemble(rows, chains(rows, accept_links(links, theta, max_gap)), slot)


def end_to_end(rows: DataFrame, chained: DataFrame) -> DataFrame:
    """root, n_slots, n_rows and jac_ends, the similarity of the first and the last row of each chain."""
    joined = rows.join(chained, "pos")
    ends = joined.groupBy("root").agg((F.max("slot_id") - F.min("slot_id") + 1).alias("n_slots"), F.count("*").alias("n_rows"), F.min_by("participant_set", "step").alias("a"), F.max_by("participant_set", "step").alias("b"))
    shared = F.size(F.array_intersect("a", "b"))
    return ends.select("root", "n_slots", "n_rows", (shared / (F.size("a") + F.size("b") - shared)).alias("jac_ends"))


def _summary(ends: DataFrame, long_slots: int = 5, drift: float = 0.5) -> DataFrame:
    long = F.col("n_slots") >= long_slots
    return ends.agg(
        F.count("*").alias("n_episodes"),
        F.round(100.0 * F.avg((F.col("n_slots") == 1).cast("int")), 2).alias("one_slot_pct"),
        F.expr("percentile(n_slots, 0.5)").alias("median_slots"),
        F.expr("percentile(n_slots, 0.95)").alias("p95_slots"),
        F.max("n_slots").alias("max_slots"),
        F.sum(F.col("n_slots") - F.col("n_rows")).alias("gap_slots"),
        F.count_if(long).alias("n_long"),
        F.round(100.0 * F.count_if(long & (F.col("jac_ends") < drift)) / F.nullif(F.count_if(long), F.lit(0)), 2).alias("drift_pct"),
    )


def theta_gap_grid(gatherings: DataFrame, thetas: list[float], gaps: list[int]) -> DataFrame:
    """One row for each pair of settings; links are found once, at the loosest, and filtered."""
    rows = staged(positioned(gatherings), "rows")
    links = staged(candidate_links(rows, min(thetas), max(gaps)), "candidates")
    out: DataFrame | None = None
    for theta in thetas:
        for gap in gaps:
            row = _summary(end_to_end(rows, chains(rows, accept_links(links, theta, gap)))).select(F.lit(float(theta)).alias("theta"), F.lit(gap).cast("long").alias("max_gap"), "*")
            out = row if out is None else out.unionByName(row)
    return out


def rssi_sensitivity(classified: DataFrame, thresholds: list[int], min_size: int = 3, theta: float = 0.7, max_gap: int = 1, slot: int = 300, position: str | None = None) -> DataFrame:
    """The whole chain from scans to episodes for each threshold, one row each."""
    from . import graph, prepare

    out: DataFrame | None = None
    for threshold in thresholds:
        kept = prepare.contacts(classified, threshold, slot)
        found = staged(graph.gatherings(kept, min_size, position), "gatherings")
        rows = staged(positioned(found), "rows")
        ends = end_to_end(rows, chains(rows, accept_links(candidate_links(rows, theta, max_gap), theta, max_gap)))
        sizes = found.agg(F.count("*").alias("gatherings"), F.expr("percentile(size(participant_set), 0.5)").alias("median_size"))
        # one row on every side
        row = kept.agg(F.count("*").alias("contacts")).join(F.broadcast(sizes)).join(F.broadcast(_summary(ends).select("n_episodes", "one_slot_pct", "n_long", "drift_pct"))).select(F.lit(threshold).cast("long").alias("rssi_threshold"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def presence(contacts: DataFrame) -> DataFrame:
    """user and slot_id of everyone who was in a contact."""
    return contacts.select("slot_id", F.explode(F.array("user_a", "user_b")).alias("user")).distinct()


def sandwich_rate(seen: DataFrame) -> DataFrame:
    """Of users seen in a slot and in the next but one, how many are silent in between."""
    later = seen.select("user", (F.col("slot_id") - 2).alias("slot_id"))
    pairs = seen.join(later, ["user", "slot_id"]).select("user", (F.col("slot_id") + 1).alias("slot_id"))
    marked = pairs.join(seen.withColumn("there", F.lit(1)), ["user", "slot_id"], "left")
    return marked.agg(F.count("*").alias("n_pairs"), F.count_if(F.col("there").isNull()).alias("n_silent"))


def gap_silence(rows: DataFrame, accepted: DataFrame, seen: DataFrame) -> DataFrame:
    """Member-slots in bridged gaps, and how many of them are silent: shared members of linked rows in the slots between."""
    a = rows.select(F.col("pos").alias("i"), F.col("slot_id").alias("from_slot"), F.col("participant_set").alias("pa"))
    b = rows.select(F.col("pos").alias("j"), F.col("slot_id").alias("to_slot"), F.col("participant_set").alias("pb"))
    gaps = accepted.join(a, "i").join(b, "j").where("to_slot - from_slot > 1")
    each = gaps.select(F.explode(F.array_intersect("pa", "pb")).alias("user"), "from_slot", "to_slot").select("user", F.explode(F.sequence(F.col("from_slot") + 1, F.col("to_slot") - 1)).alias("slot_id"))
    marked = each.join(seen.withColumn("there", F.lit(1)), ["user", "slot_id"], "left")
    return marked.agg(F.count("*").alias("n_member_slots"), F.count_if(F.col("there").isNull()).alias("n_silent"))


def long_episode_hours(found: DataFrame, least_slots: int, slot: int = 300) -> DataFrame:
    """How long episodes of at least least_slots slots spread over the hours of the day: covered slots by hour, and the episodes in each."""
    covered = found.where(F.col("n_slots") >= least_slots).select("episode_id", F.explode(F.sequence("first_slot", "last_slot")).alias("s"))
    hour = F.pmod(F.floor(F.col("s") * slot / F.lit(3600)), F.lit(24))
    return covered.groupBy(hour.alias("hour")).agg(F.count("*").alias("n_slots"), F.countDistinct("episode_id").alias("n_episodes"))


def one_slot_profile(found: DataFrame) -> DataFrame:
    """Episodes and medians of size and strength of one-slot and longer episodes."""
    return found.groupBy((F.col("n_slots") == 1).alias("one_slot")).agg(F.count("*").alias("n_episodes"), F.expr("percentile(median_size, 0.5)").alias("median_size"), F.expr("percentile(median_rssi, 0.5)").alias("median_rssi"))

"""Features of episodes: structure, friendship among members, and what they said to each other before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .schemas import require_columns, require_unique
from .storage import shuffled, staged


def structural(episodes: DataFrame, slot: int = 300) -> DataFrame:
    """episodes with sizes, spans, shares and logarithms."""
    unique = F.size(F.array_distinct("participant_set")).cast("long")
    observed = F.col("n_slots") - F.col("n_gap_slots")
    span = F.col("n_slots") * slot / 60
    return episodes.withColumns({
        "n_unique_participants": unique,
        "n_observed_slots": observed,
        "span_minutes": span,
        "observed_minutes": observed * slot / 60,
        "gap_fraction": F.col("n_gap_slots") / F.col("n_slots"),
        "membership_expansion_ratio": unique / F.col("median_size"),
        "relative_day_index": F.floor(F.col("start_time") / 86400),
        "log_median_size": F.log1p("median_size"),
        "log_span_minutes": F.log1p(span),
        "input_version": F.lit("episodes_v1"),
        "feature_version": F.lit("social_communication_v1"),
    })


def canonical_pairs(edges: DataFrame, a: str = "user_a", b: str = "user_b") -> DataFrame:
    """Distinct pairs u < v of non-negative ids."""
    return edges.where(f"{a} >= 0 and {b} >= 0 and {a} <> {b}").select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()


def internal_edges(episodes: DataFrame, friends: DataFrame, id_col: str = "episode_id", set_col: str = "participant_set") -> DataFrame:
    """id, internal_fb_edges and internal_fb_density of every episode.

    Edges meet members at one end by a join, and the other end is looked up by a second one, so no pair of members is made
    and no row holds a set of members.
    """
    members = episodes.select(id_col, F.array_distinct(set_col).alias("members"))
    each = staged(members.select(id_col, F.explode("members").alias("u")), "members")
    met = each.join(shuffled(canonical_pairs(friends)), "u").select(id_col, "v")
    found = met.join(shuffled(each.select(id_col, F.col("u").alias("v"))), [id_col, "v"], "left_semi").groupBy(id_col).agg(F.count("*").alias("n_edges"))
    sizes = members.select(id_col, F.size("members").cast("long").alias("n_members"))
    n = F.col("n_members")
    possible = n * (n - 1) / 2
    edges = F.coalesce("n_edges", F.lit(0))
    return sizes.join(shuffled(found), id_col, "left").select(id_col, edges.alias("internal_fb_edges"), F.when(possible > 0, edges / possible).otherwise(F.lit(0.0)).alias("internal_fb_density"))


def prepare_events(events: DataFrame, left: str, right: str) -> DataFrame:
    """Events between two different non-negative ids.  A null or negative timestamp anywhere raises ValueError."""
    require_columns(events, ["timestamp", left, right])
    if not events.where("timestamp is null or timestamp < 0").isEmpty():
        raise ValueError("timestamps are missing or negative")
    return events.where(f"{left} >= 0 and {right} >= 0 and {left} <> {right}").select("timestamp", F.least(left, right).alias("u"), F.greatest(left, right).alias("v"))


def communication_before(episodes: DataFrame, events: DataFrame, prefix: str, lookback: int) -> DataFrame:
    """episode_id, {prefix}_events_pre and {prefix}_active_pairs_pre: events between members in [start - lookback, start), not before 0.

    A range join by buckets as long as the look-back: a window touches two of them, so members are joined with events by
    (bucket, one end) and the rest of the condition is checked on what meets.  The other end is looked up by a second join
    with members; no row holds a set of members.
    """
    if lookback <= 0:
        raise ValueError("the look-back must be positive")
    bucket = lambda c: F.floor(c / lookback)
    start = F.col("start_time")
    each = staged(episodes.select("episode_id", "start_time", F.greatest(start - lookback, F.lit(0)).alias("since"), F.explode(F.array_distinct("participant_set")).alias("u")), "members")
    placed = each.withColumn("bucket", F.explode(F.array_distinct(F.array(bucket(F.col("since")), bucket(start)))))
    met = placed.join(shuffled(events.withColumn("bucket", bucket(F.col("timestamp")))), ["bucket", "u"]).where("timestamp >= since and timestamp < start_time")
    # events of a pair are summed first, so that distinct pairs are rows
    pairs = met.groupBy("episode_id", "u", "v").agg(F.count("*").alias("n"))
    within = pairs.join(shuffled(each.select("episode_id", F.col("u").alias("v"))), ["episode_id", "v"], "left_semi")
    summed = within.groupBy("episode_id").agg(F.sum("n").alias("n"), F.count("*").alias("p"))
    return episodes.select("episode_id").join(shuffled(summed), "episode_id", "left").select("episode_id", F.coalesce("n", F.lit(0)).alias(f"{prefix}_events_pre"), F.coalesce("p", F.lit(0)).alias(f"{prefix}_active_pairs_pre"))


def pair_normalized(features: DataFrame) -> DataFrame:
    """features with calls and SMS by possible pair of members; ValueError if an episode has fewer than two."""
    require_columns(features, ["n_unique_participants", "calls_events_pre", "sms_events_pre"])
    n = F.col("n_unique_participants")
    pairs = n * (n - 1) / 2
    if not features.where(pairs <= 0).isEmpty():
        raise ValueError("an episode has fewer than two distinct participants; at least two are needed")
    out = features.withColumn("n_possible_member_pairs", pairs.cast("long"))
    for p in ("calls", "sms"):
        rate = F.col(f"{p}_events_pre") / pairs
        out = out.withColumns({f"{p}_events_per_pair_pre": rate, f"log_{p}_events_per_pair_pre": F.log1p(rate)})
    return out


def assemble(episodes: DataFrame, friends: DataFrame, calls: DataFrame, sms: DataFrame, params: dict, slot: int = 300) -> DataFrame:
    """All features of episodes, with the parameters that they come from."""
    from .prepare import split_calls

    lookback = int(params["communication_lookback_hours"] * 3600)
    out = require_unique(structural(episodes, slot), "episode_id").join(shuffled(internal_edges(episodes, friends)), "episode_id", "left")
    completed, missed = split_calls(calls)
    for events, a, b, prefix in ((completed, "caller", "callee", "calls"), (missed, "caller", "callee", "missed_calls"), (sms, "sender", "recipient", "sms")):
        out = out.join(shuffled(communication_before(episodes, prepare_events(events, a, b), prefix, lookback)), "episode_id", "left")
        out = out.withColumn(f"log_{prefix}_events_pre", F.log1p(f"{prefix}_events_pre"))
    out = out.withColumns({
        "prehistory_available_hours": F.least(F.greatest("start_time", F.lit(0)), F.lit(lookback)) / 3600,
        "has_full_communication_window": F.col("start_time") >= lookback,
    })
    names = {"rssi_threshold": "rssi_threshold", "min_gathering_size": "min_gathering_size", "episode_jaccard_threshold": "jaccard_threshold", "episode_max_gap_slots": "max_gap_slots", "communication_lookback_hours": "communication_lookback_hours"}
    return pair_normalized(out).withColumns({k: F.lit(params[v]) for k, v in names.items()})


def check_episodes(episodes: DataFrame, gatherings: DataFrame) -> dict[str, int]:
    """How many rows break each rule that episodes and gatherings must keep; all 0 for sound tables."""
    each = episodes.select("episode_id", F.explode("gathering_ids").alias("gathering_id"))
    row = episodes.agg(F.count_if(F.col("n_slots") != F.col("last_slot") - F.col("first_slot") + 1).alias("span"), F.count_if(F.col("n_gap_slots") != F.col("n_slots") - F.size("gathering_ids")).alias("gaps"), F.count_if(F.col("end_time") < F.col("start_time")).alias("times"), F.count_if(~F.col("night_share").between(0, 1)).alias("night")).first().asDict()
    row["repeated"] = each.groupBy("gathering_id").count().where("count > 1").count()
    row["unplaced"] = gatherings.join(each, "gathering_id", "left_anti").count()
    return row

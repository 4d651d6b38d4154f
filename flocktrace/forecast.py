"""When cohorts come back: recurrence, stability over halves, and the next encounter."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .mining import containing, transactions
from .storage import staged

DAY = 86400.0


def meetings(episodes: DataFrame, cohorts: DataFrame) -> DataFrame:
    """cohort_id and start_time of every episode that contains a cohort (cohort_id, members)."""
    starts = episodes.select(F.col("episode_id").alias("txn_id"), "start_time")
    return containing(transactions(episodes), cohorts).join(starts, "txn_id").select("cohort_id", "start_time")


def _gaps(met: DataFrame) -> DataFrame:
    w = Window.partitionBy("cohort_id").orderBy("start_time")
    return met.withColumn("gap", (F.col("start_time") - F.lag("start_time").over(w)) / DAY)


def recurrence(met: DataFrame) -> DataFrame:
    """Occurrences, span, rate and gaps in days; gaps are null for single occurrences, and the span is at least a day."""
    span = F.greatest((F.max("start_time") - F.min("start_time")) / DAY, F.lit(1.0))
    return _gaps(met).groupBy("cohort_id").agg(
        F.count("*").alias("total_occurrences"),
        F.min("start_time").alias("first_seen"),
        F.max("start_time").alias("last_seen"),
        span.alias("time_span_days"),
        (F.count("*") / span).alias("recurrence_rate_per_day"),
        F.avg("gap").alias("mean_gap_days"),
        F.expr("percentile(gap, 0.5)").alias("median_gap_days"),
        F.min("gap").alias("min_gap_days"),
        F.max("gap").alias("max_gap_days"),
        F.stddev_pop("gap").alias("std_gap_days"),
    )


def stability(met: DataFrame) -> DataFrame:
    """Occurrences before and from the middle of each cohort's span, and the chi-square of their difference; for two or more."""
    span = met.groupBy("cohort_id").agg(F.count("*").alias("n"), ((F.min("start_time") + F.max("start_time")) / 2).alias("middle")).where("n > 1")
    halves = met.join(span, "cohort_id").groupBy("cohort_id").agg(F.count_if(F.col("start_time") < F.col("middle")).alias("first_half_count"), F.count_if(F.col("start_time") >= F.col("middle")).alias("second_half_count"))
    a, b = F.col("first_half_count"), F.col("second_half_count")
    expected = (a + b) / 2
    return halves.select("cohort_id", a, b, (a / b).alias("ratio_first_to_second"), (((a - expected) * (a - expected) + (b - expected) * (b - expected)) / expected).alias("chi_square"))


def next_encounter(met: DataFrame, as_of: int) -> DataFrame:
    """Last occurrence plus the median gap, days until then from as_of (epoch seconds), and a confidence that falls with the gaps' deviation."""
    told = _gaps(met).groupBy("cohort_id").agg(F.count("*").alias("n"), F.max("start_time").alias("last_occurrence"), F.expr("percentile(gap, 0.5)").alias("median_gap_days"), F.stddev_pop("gap").alias("s")).where("n > 1")
    due = F.col("last_occurrence") + F.col("median_gap_days") * DAY
    return told.select("cohort_id", "last_occurrence", "median_gap_days", due.alias("predicted_next"), ((due - as_of) / DAY).alias("days_until_next"), (1 / (1 + F.col("s"))).alias("confidence"))


def run(episodes: DataFrame, cohorts: DataFrame, as_of: int) -> dict[str, DataFrame]:
    """All three tables from one table of meetings; empty tables, with their columns, where nothing meets."""
    met = staged(meetings(episodes, cohorts), "meetings")
    return {"recurrence": recurrence(met), "stability": stability(met), "next_encounter": next_encounter(met, as_of)}


def most_regular(told: DataFrame, n: int = 10) -> DataFrame:
    return told.orderBy(F.col("recurrence_rate_per_day").desc(), "cohort_id").limit(n)


def summary(tables: dict[str, DataFrame], steady: float = 1.0, drifting: float = 5.0, sure: float = 0.5) -> DataFrame:
    """One row over the tables of run: rates, gaps, how many cohorts keep or change their frequency, and confidence."""
    rate = F.col("recurrence_rate_per_day")
    a = tables["recurrence"].agg(F.count("*").alias("n_cohorts"), F.avg(rate).alias("mean_rate"), F.median(rate).alias("median_rate"), F.stddev_samp(rate).alias("std_rate"), F.avg("mean_gap_days").alias("mean_gap"), F.median("median_gap_days").alias("median_gap"), F.min("min_gap_days").alias("min_gap"), F.max("max_gap_days").alias("max_gap"))
    b = tables["stability"].agg(F.avg("chi_square").alias("mean_chi_square"), F.count_if(F.col("chi_square") < steady).alias("n_stable"), F.count_if(F.col("chi_square") > drifting).alias("n_drifting"))
    c = tables["next_encounter"].agg(F.avg("confidence").alias("mean_confidence"), F.count_if(F.col("confidence") > sure).alias("n_confident"))
    return a.join(F.broadcast(b)).join(F.broadcast(c))  # one row each


def least_stable(told: DataFrame, n: int = 20) -> DataFrame:
    return told.orderBy(F.col("chi_square").desc_nulls_last(), "cohort_id").limit(n)


def most_confident(told: DataFrame, n: int = 20) -> DataFrame:
    return told.orderBy(F.col("confidence").desc_nulls_last(), "cohort_id").limit(n)

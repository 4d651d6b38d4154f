"""Readers and writers, and adapters that give the engine's tables from a star schema with an event log."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import schemas


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV file whose first line is skipped and whose columns get the schema's names, whatever the header says."""
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=True)


def read_scans(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.SCANS)


def read_friends(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.FRIENDS)


def read_genders(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.GENDERS)


def read_telecom(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Calls, with is_missed_call, or SMS."""
    if kind == "sms":
        return read_csv(spark, path, schemas.SMS)
    if kind == "calls":
        return with_missed_flag(read_csv(spark, path, schemas.CALLS))
    raise ValueError(f"unknown kind of log: {kind}")


def with_missed_flag(calls: DataFrame) -> DataFrame:
    return calls.withColumn("is_missed_call", F.col("duration") == -1)


def read_prepared(spark: SparkSession, path: str) -> DataFrame:
    """Prepared scans with the columns of the contract; FileNotFoundError and ValueError name what is not there."""
    if not there(spark, path):
        raise FileNotFoundError(f"no prepared scans at {path}")
    names = schemas.PREPARED.fieldNames()
    return schemas.require_columns(spark.read.parquet(path), names).select(*names)


def read_cohorts(spark: SparkSession, path: str) -> DataFrame:
    """Cohorts with members as a sorted array next to the text column."""
    df = spark.read.csv(path, header=True)
    return df.withColumn("member_set", members_of("members"))


def members_of(column: str):
    """Space-separated ids as a sorted array."""
    return F.array_sort(F.transform(F.split(F.col(column), " "), lambda x: x.cast("long")))


def members_text(column: str):
    """An array of ids as space-separated text."""
    return F.array_join(F.col(column).cast("array<string>"), " ")


def write_parquet(df: DataFrame, folder: str, name: str) -> str:
    """Writes a table and returns its path."""
    path = f"{folder.rstrip('/')}/{name}"
    df.write.mode("overwrite").parquet(path)
    return path


def write_csv(df: DataFrame, path: str) -> str:
    """Writes a result table as one CSV file with a header; for small tables."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)
    return path


def write_split(df: DataFrame, folder: str, flag: str = "is_anomaly") -> dict[str, str]:
    """All rows, those without and those with the flag, as three tables."""
    parts = {"all": df, "normal": df.where(~F.col(flag)), "anomalous": df.where(F.col(flag))}
    return {name: write_parquet(part, folder, name) for name, part in parts.items()}


def export_secondary(spark: SparkSession, raw: str, folder: str) -> dict[str, str]:
    """The four secondary tables as parquet; name to path."""
    tables = {"fb_friends": read_friends(spark, f"{raw}/fb_friends.csv"), "genders": read_genders(spark, f"{raw}/genders.csv"), "calls": read_telecom(spark, f"{raw}/calls.csv", "calls"), "sms": read_telecom(spark, f"{raw}/sms.csv", "sms")}
    return {name: write_parquet(df, folder, name) for name, df in tables.items()}


def validate_inputs(raw: str | Path, prepared: str | Path, skip_secondary: bool = False) -> None:
    """FileNotFoundError that lists every local input that is missing."""
    wanted = [Path(prepared), *([] if skip_secondary else [Path(raw) / f"{n}.csv" for n in ("fb_friends", "genders", "calls", "sms")])]
    missing = [str(p) for p in wanted if not p.exists()]
    if missing:
        raise FileNotFoundError("missing inputs: " + ", ".join(missing))


def summary_json(metrics: dict[str, Any], tables: dict[str, DataFrame], path: str | Path, most: int = 500) -> None:
    """Metrics and the first rows of each table as JSON."""
    out = {"metrics": metrics, "tables": {n: [r.asDict(recursive=True) for r in t.limit(most).collect()] for n, t in tables.items()}}
    Path(path).write_text(json.dumps(out, indent=2, default=str))


#: The files of saved results, by what they hold.
BASELINE = {"validity": "cluster_validity_normalized_without_gap.csv", "stability": "cluster_seed_stability_summary.csv", "cohorts": "recurring_cohorts.csv"}
COORDINATES = "cluster_visualization_coordinates.csv"
MODEL = "gathering_clustering_v1_metadata.json"


def there(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists, on whatever file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_baseline(spark: SparkSession, tables: str, models: str, most: int = 3000, seed: int = 42) -> dict[str, Any]:
    """Saved results to show beside new ones, of those files that are there.

    Tables give their first `most` records as text, cohorts without their members; coordinates give `most` points drawn
    by hash, and coordinates_sampled tells whether there were more.  model_metadata is the model's JSON or None.
    """
    out: dict[str, Any] = {}
    for name, file in BASELINE.items():
        if there(spark, f"{tables}/{file}"):
            out[name] = spark.read.csv(f"{tables}/{file}", header=True).drop(*(["members"] if name == "cohorts" else [])).limit(most)
    model = f"{models}/{MODEL}"
    # one small file
    out["model_metadata"] = json.loads(spark.read.text(model, wholetext=True).first()[0]) if there(spark, model) else None
    if there(spark, f"{tables}/{COORDINATES}"):
        points = spark.read.csv(f"{tables}/{COORDINATES}", schema=_header_schema(spark, f"{tables}/{COORDINATES}"), header=True).select("PC1", "PC2", "cluster_id")
        out["coordinates"] = points.orderBy(F.xxhash64("PC1", "PC2", "cluster_id", F.lit(seed)), "PC1", "PC2", "cluster_id").limit(most)
        out["coordinates_sampled"] = points.count() > most
    return out


def _header_schema(spark: SparkSession, path: str) -> T.StructType:
    """The columns of a CSV file of coordinates: components are numbers, clusters whole ones, all others text."""
    kinds = {"PC1": T.DoubleType(), "PC2": T.DoubleType(), "cluster_id": T.IntegerType()}
    return T.StructType([T.StructField(c, kinds.get(c, T.StringType())) for c in spark.read.csv(path, header=True).columns])


def kept_table(spark: SparkSession, name: str, path: str, reload: bool = False) -> DataFrame:
    """A parquet table kept in executors' memory under a name; reload drops what is kept and reads the files again."""
    known = spark.catalog.tableExists(name)
    if known and reload:
        spark.catalog.uncacheTable(name)
        spark.catalog.refreshByPath(path)
    if not known or reload:
        spark.read.parquet(path).createOrReplaceTempView(name)
        spark.catalog.cacheTable(name)
    return spark.table(name)


# adapters -----------------------------------------------------------------------------------------------------------

#: Seconds at 2024-01-01, where the event log starts.
ORIGIN = 1704067200


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log with t, seconds since its start, and k, a number out of its JSON."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    return df.select("event_id", "user_id", "event_type", "value", (F.unix_seconds(F.col("ts").cast("timestamp")) - ORIGIN).alias("t"), F.get_json_object("props", "$.k").cast("long").alias("k"))


def scans(spark: SparkSession, sf_dir: str, slot: int = 3600) -> DataFrame:
    """Events as proximity scans: the user before, in the same slot and of the same type, is the one that was seen."""
    w = Window.partitionBy(F.floor(F.col("t") / slot), "event_type").orderBy("t", "event_id")
    prev = F.lag("user_id").over(w)
    seen = events(spark, sf_dir).withColumn("prev", prev)
    return seen.select(
        F.col("event_id").alias("row_pos"),
        F.col("t").alias("timestamp"),
        F.col("user_id").alias("user_a"),
        F.when(F.col("prev").isNull(), F.lit(-1)).when(F.col("event_id") % 11 == 0, F.lit(-2)).otherwise(F.col("prev")).cast("long").alias("user_b"),
        F.when(F.col("prev").isNull(), F.lit(0)).otherwise(-50 - F.floor("value") % 50).cast("long").alias("rssi"),
    )


def _next_user(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    # one kind of event is one sequence over all users, so the window has no key; the adapter is for test data
    return events(spark, sf_dir).where(F.col("event_type") == kind).withColumn("next", F.lead("user_id").over(Window.orderBy("t", "event_id"))).where("next is not null")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _next_user(spark, sf_dir, "purchase").select(F.col("t").alias("timestamp"), F.col("user_id").alias("caller"), F.col("next").alias("callee"), F.when(F.col("k") < 10, F.lit(-1)).otherwise(F.floor("value")).cast("long").alias("duration"))


def sms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _next_user(spark, sf_dir, "view").select(F.col("t").alias("timestamp"), F.col("user_id").alias("sender"), F.col("next").alias("recipient"))


def friends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _next_user(spark, sf_dir, "signup").select(F.col("event_id").alias("row_pos"), F.col("user_id").alias("user_a"), F.col("next").alias("user_b"))


def genders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("user_id").distinct().select("user_id", (F.col("user_id") % 5 == 0).cast("int").alias("is_female"))


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as transactions: txn_id and items, the sorted distinct numbers of the brands in them."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.regexp_extract("p_brand", r"(\d+)", 1).cast("long").alias("item"))
    joined = lines.join(parts, lines.l_partkey == parts.p_partkey)
    return joined.groupBy(F.col("l_orderkey").alias("txn_id")).agg(F.array_sort(F.collect_set("item")).alias("items"))


def basket_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as episodes that start and end when they were placed."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    start = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    placed = orders.select(F.col("o_orderkey").alias("txn_id"), start.alias("start_time"))
    hour = F.pmod(F.col("txn_id"), F.lit(24)).cast("int")
    return baskets(spark, sf_dir).join(placed, "txn_id").select(F.col("txn_id").alias("episode_id"), "start_time", F.col("start_time").alias("end_time"), F.col("items").alias("participant_set"), hour.alias("start_hour"), (F.pmod(F.col("txn_id"), F.lit(4)) / 3).alias("night_share"))


def vectors(spark: SparkSession, sf_dir: str, size: int = 4) -> DataFrame:
    """Embeddings with their first components as columns x0, x1, ..."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return df.select("vec_id", "label", *(F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(size)))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and their value by day."""
    return events(spark, sf_dir).groupBy(F.floor(F.col("t") / 86400).alias("day")).agg(F.count("*").alias("n_events"), F.round(F.sum("value"), 2).alias("total"))

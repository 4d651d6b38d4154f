"""Runs registered analyses: parameters are validated, tables up to them are built once and kept, results are tables."""

from __future__ import annotations

import json
import shutil
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import wait as wait_for
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cluster, config, episodes, features, graph, mining, prepare, reports, sources
from .storage import staged


@dataclass
class Result:
    """Tables of an analysis, the parameters it ran with, and whether kept tables were used."""

    analysis: str
    parameters: dict[str, Any]
    tables: dict[str, DataFrame]
    lineage_hit: bool


class Engine:
    """Analyses over one set of inputs: classified scans, friends, calls and SMS.

    position: a column of scans that numbers their rows; see graph.gatherings.
    store: a folder where tables are kept by a key of their parameters and of `inputs`, which tells the inputs apart; a
    later engine over the same inputs reads them.  Without it tables last as long as the engine.
    """

    def __init__(self, scans: DataFrame, friends: DataFrame, calls: DataFrame, sms: DataFrame, settings: dict[str, Any] | None = None, least_support: int = 200, position: str | None = None, store: str | None = None, inputs: Any = None):
        self.store, self.inputs = store and store.rstrip("/"), inputs
        self.scans, self.friends, self.calls, self.sms = scans, friends, calls, sms
        self.settings = settings or dict(config.DEFAULTS)
        self.least_support, self.position = least_support, position
        self._kept: dict[str, DataFrame] = {}

    def lineage(self, params: dict[str, Any]) -> tuple[dict[str, DataFrame], bool]:
        """Contacts, gatherings, episodes and features under the parameters, each built and kept by what it depends on."""
        p = {k: self.settings[k] for k in ("rssi_threshold", "min_gathering_size", "jaccard_threshold", "max_gap_slots", "communication_lookback_hours")} | params
        slot = self.settings["slot_duration_sec"]
        steps = [("contacts", ["rssi_threshold"]), ("gatherings", ["rssi_threshold", "min_gathering_size"]), ("episodes", ["rssi_threshold", "min_gathering_size", "jaccard_threshold", "max_gap_slots"]), ("features", list(p)[:5])]
        make = {
            "contacts": lambda t: prepare.contacts(self.scans, p["rssi_threshold"], slot),
            "gatherings": lambda t: graph.gatherings(t["contacts"], p["min_gathering_size"], self.position),
            "episodes": lambda t: episodes.build_episodes(t["gatherings"], p["jaccard_threshold"], p["max_gap_slots"], slot),
            "features": lambda t: features.assemble(t["episodes"], self.friends, self.calls, self.sms, p, slot),
        }
        out: dict[str, DataFrame] = {}
        hit = True
        for name, fields in steps:
            key = config.cache_key(name, slot, {f: p[f] for f in fields}, self.inputs)
            if key not in self._kept:
                self._kept[key], known = self._table(f"{name}-{key}", lambda n=name: make[n](out))
                hit = hit and known
            out[name] = self._kept[key]
        return out, hit

    def _table(self, name: str, make: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
        """A table and whether the store had it whole; one that a lost run left unfinished is written again."""
        if not self.store:
            return staged(make(), name.split("-")[0]), False
        spark, path = self.scans.sparkSession, f"{self.store}/{name}"
        known = sources.there(spark, f"{path}/_SUCCESS")
        if not known:
            make().write.mode("overwrite").parquet(path)
        return spark.read.parquet(path), known

    def run(self, analysis: str, params: dict[str, Any] | None = None) -> Result:
        values = config.validate(analysis, params or {}, self.settings, self.least_support)
        tables, hit = self.lineage({k: v for k, v in values.items() if k in self.settings})
        return Result(analysis, values, getattr(self, f"_{analysis}")(tables, values), hit)

    def _bluetooth(self, t: dict[str, DataFrame], p: dict[str, Any]) -> dict[str, DataFrame]:
        slot = self.settings["slot_duration_sec"]
        return {"metrics": reports.participants(t["contacts"]), "rssi_bands": reports.rssi_bands(t["contacts"]), "contacts_by_relative_day": reports.per_day(t["contacts"], slot), "communication_by_episode_day": reports.communication_by_day(t["features"])}

    def _gatherings(self, t: dict[str, DataFrame], p: dict[str, Any]) -> dict[str, DataFrame]:
        return {"metrics": reports.gathering_metrics(t["gatherings"]), "gathering_size_distribution": graph.gathering_sizes(t["gatherings"])}

    def _episodes(self, t: dict[str, DataFrame], p: dict[str, Any]) -> dict[str, DataFrame]:
        return {"metrics": reports.episode_metrics(t["episodes"]), "episode_span_distribution": reports.episode_spans(t["episodes"])}

    def _clustering(self, t: dict[str, DataFrame], p: dict[str, Any]) -> dict[str, DataFrame]:
        eligible = t["features"].where("has_full_communication_window")
        vectors, names = cluster.prepared(eligible, config.REPRESENTATIONS[p["representation"]])
        labelled, inertia = cluster.kmeans(vectors, p["k"], p["seed"], p["n_init"])
        labelled = staged(labelled, "labelled")
        placed, _ = cluster.pca(labelled, min(2, len(names)))
        shown = ["median_size", "span_minutes", "gap_fraction", "membership_expansion_ratio", "median_rssi", "internal_fb_density", "calls_events_pre", "sms_events_pre", "calls_events_per_pair_pre", "sms_events_per_pair_pre"]
        metrics = cluster.validity(labelled, names, "episode_id", p["silhouette_sample_size"], p["seed"]).withColumn("inertia", F.lit(inertia))
        return {"metrics": metrics, "sizes": cluster.sizes(labelled), "profiles": cluster.profiles(labelled, shown), "assignments": cluster.assignments(t["features"].select("episode_id"), labelled), "coordinates": placed.select("episode_id", *(c for c in ("pc1", "pc2") if c in placed.columns), "cluster_id")}

    def _mined(self, t: dict[str, DataFrame], p: dict[str, Any]) -> mining.Mined:
        return mining.apriori(mining.transactions(t["episodes"]), p["min_support"])

    def _associations(self, t: dict[str, DataFrame], p: dict[str, Any]) -> dict[str, DataFrame]:
        found = self._mined(t, p)
        return {"itemsets": found.itemsets, "rules": mining.ordered_rules(found.itemsets, found.n_transactions)}

    def _cohorts(self, t: dict[str, DataFrame], p: dict[str, Any]) -> dict[str, DataFrame]:
        found = self._mined(t, p)
        told = mining.cohort_report(t["episodes"], found, p["min_support"], self.settings["slot_duration_sec"], max_gap=self.settings["session_gap_sec"], large=self.settings["large_quantile"])
        return {"itemsets": found.itemsets, "cohorts": mining.ordered_cohorts(told, by_size=True).drop("members")}


class Jobs:
    """Runs analyses into folders of their own, with a record of each; a run with the same content is taken from an earlier one.

    Runs that are not waited for are queued and run one after another in a thread.
    """

    def __init__(self, engine: Engine, root: str | Path, version: str = "1", inputs: Any = None, most_active: int = 8):
        self.engine, self.root, self.version, self.inputs, self.most_active = engine, Path(root), version, inputs, most_active
        self._pool, self._queued = ThreadPoolExecutor(max_workers=1), {}

    def submit(self, analysis: str, params: dict[str, Any] | None = None, wait: bool = True) -> str:
        """The id of a new run; ValueError for wrong parameters, RuntimeError if too many runs are active."""
        values = config.validate(analysis, params or {}, self.engine.settings, self.engine.least_support)
        if sum(r["state"] in ("queued", "running") for r in self.list()) >= self.most_active:
            raise RuntimeError("too many active runs")
        key = config.cache_key(analysis, values, self.version, self.inputs)
        run = uuid.uuid4().hex
        folder = self.root / run
        folder.mkdir(parents=True)
        record = {"id": run, "analysis": analysis, "parameters": values, "key": key, "state": "queued", "created": time.time()}
        self._save(record)
        if wait:
            self._perform(record)
        else:
            self._queued[run] = self._pool.submit(self._perform, record)
        return run

    def _perform(self, record: dict[str, Any]) -> None:
        run, analysis, values, key = (record[f] for f in ("id", "analysis", "parameters", "key"))
        folder = self.root / run
        record["state"] = "running"
        self._save(record)
        try:
            earlier = next((r for r in self.list() if r["key"] == key and r["state"] == "done"), None)
            if earlier:
                for name in earlier["artifacts"]:
                    shutil.copytree(self.root / earlier["id"] / name, folder / name, dirs_exist_ok=True) if (self.root / earlier["id"] / name).is_dir() else shutil.copy(self.root / earlier["id"] / name, folder / name)
                record |= {"state": "done", "cached": True, "artifacts": earlier["artifacts"]}
            else:
                result = self.engine.run(analysis, values)
                for name, table in result.tables.items():
                    sources.write_csv(table.select(*(F.col(c).cast("string") if t.startswith("array") else F.col(c) for c, t in table.dtypes)), f"file://{folder}/{name}.csv")
                sources.summary_json({}, result.tables, folder / "summary.json")
                record |= {"state": "done", "cached": False, "artifacts": ["summary.json", *(f"{n}.csv" for n in result.tables)]}
        except Exception as error:
            record |= {"state": "failed", "error": str(error)[:500]}
            raise
        finally:
            self._save(record)

    def finished(self, run: str, timeout: float | None = None) -> dict[str, Any]:
        """Waits for a queued run, whatever comes of it, and gives its record."""
        if run in self._queued:
            wait_for([self._queued[run]], timeout)
        return self.get(run)

    def cancel(self, run: str) -> dict[str, Any]:
        """Takes a run out of the queue; ValueError if it runs or ran already."""
        record, queued = self.get(run), self._queued.get(run)
        if record["state"] != "queued" or queued is None or not queued.cancel():
            raise ValueError("only queued runs can be cancelled")
        record["state"] = "cancelled"
        self._save(record)
        return record

    def _save(self, record: dict[str, Any]) -> None:
        # renamed into place, so that nobody reads half a record
        path = self.root / record["id"] / "metadata.json"
        path.with_suffix(".new").write_text(json.dumps(record, default=str))
        path.with_suffix(".new").replace(path)

    def get(self, run: str) -> dict[str, Any]:
        return json.loads((self.root / run / "metadata.json").read_text())

    def list(self, most: int = 100) -> list[dict[str, Any]]:
        """Newest first."""
        found = [json.loads(p.read_text()) for p in self.root.glob("*/metadata.json")] if self.root.exists() else []
        return sorted(found, key=lambda r: r["created"], reverse=True)[:most]

    def artifact(self, run: str, name: str) -> Path:
        """The path of an artifact that the run declares; KeyError for any other name."""
        if name not in self.get(run).get("artifacts", []):
            raise KeyError(name)
        return self.root / run / name


def main(args: list[str] | None = None) -> dict[str, int]:
    """python -m flocktrace.engine --raw-dir DIR --out DIR [--config FILE] [--skip-secondary]: scans to episodes, written as parquet."""
    import argparse

    parser = argparse.ArgumentParser(description=main.__doc__)
    parser.add_argument("--config")
    parser.add_argument("--raw-dir", required=True)
    parser.add_argument("--out", required=True)
    parser.add_argument("--skip-secondary", action="store_true")
    given = parser.parse_args(args)
    settings = config.load(given.config) if given.config else dict(config.DEFAULTS)
    spark = SparkSession.builder.getOrCreate()
    sources.validate_inputs(given.raw_dir, f"{given.raw_dir}/bt_symmetric.csv", given.skip_secondary)
    classified = prepare.classify(sources.read_scans(spark, f"{given.raw_dir}/bt_symmetric.csv"))
    out = {"contacts": prepare.contacts(classified, settings["rssi_threshold"], settings["slot_duration_sec"]), "coverage": prepare.coverage(classified)}
    counts = {}
    for name, df in out.items():
        counts[name] = spark.read.parquet(sources.write_parquet(df, given.out, name)).count()
    found = graph.gatherings(spark.read.parquet(f"{given.out}/contacts"), settings["min_gathering_size"])
    counts["gatherings"] = spark.read.parquet(sources.write_parquet(found, given.out, "gatherings")).count()
    linked = episodes.build_episodes(spark.read.parquet(f"{given.out}/gatherings"), settings["jaccard_threshold"], settings["max_gap_slots"], settings["slot_duration_sec"])
    counts["episodes"] = spark.read.parquet(sources.write_parquet(linked, given.out, "episodes")).count()
    if not given.skip_secondary:
        sources.export_secondary(spark, given.raw_dir, given.out)
    return counts


if __name__ == "__main__":
    print(main())

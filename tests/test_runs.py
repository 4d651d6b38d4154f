"""Runs that write their results, summaries over many fits, and what the engine keeps."""

import statistics
from itertools import combinations, permutations

import pytest

from flocktrace import anomaly, cluster, engine, features, forecast, mining, nullmodel, prepare, reports
from flocktrace.config import DEFAULTS

#: Three clouds far from each other, 30 points each.
CLOUDS = [(100 * c + i, 10.0 * c + (i % 5) * 0.1, -7.0 * c + (i // 5) * 0.1) for c in range(3) for i in range(30)]


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame(CLOUDS, "episode_id long, x double, y double").cache()


@pytest.fixture(scope="module")
def meetings(spark):
    rows = [(i, 86400 * i, [1, 2, 3] if i % 2 else [1, 2]) for i in range(8)] + [(i, 86400 * i, [4, 5]) for i in (8, 9, 30)]
    return spark.createDataFrame(rows, "episode_id long, start_time long, participant_set array<long>")


def test_anomaly_run_writes_what_it_found(spark, tmp_path):
    rows = [(i, 2 + i % 3, 3.0 + i % 2, -70.0 - i % 5, i % 2, 0.0) for i in range(60)] + [(99, 80, 40.0, -20.0, 30, 1.0)]
    made = spark.createDataFrame(rows, "episode_id long, n_slots long, median_size double, median_rssi double, n_gap_slots long, night_share double")
    out = anomaly.run(made, str(tmp_path))
    ids = lambda name: {r.episode_id for r in out[name].collect()}
    assert ids("all") == {r[0] for r in rows} and 99 in ids("anomalous")
    assert ids("normal") == ids("all") - ids("anomalous") and not ids("normal") & ids("anomalous")
    told = {r.method: (r.n_rows, r.n_flagged) for r in out["comparison"].collect()}
    assert set(told) == {"knn_distance", "lof", "isolation_forest", "one_class_svm"}
    assert told["isolation_forest"] == (61, len(ids("anomalous"))) and all(n == 61 and 0 < f < 31 for n, f in told.values())
    by = {r.is_anomaly: r for r in anomaly.flag_summary(out["all"], ["n_slots"]).collect()}
    assert by[False].n_rows == len(ids("normal")) and by[True].n_rows == len(ids("anomalous"))
    assert by[False].median_n_slots == statistics.median(r[1] for r in rows if r[0] in ids("normal"))


def test_null_model_run(spark, meetings, tmp_path):
    cohorts = spark.createDataFrame([(1, [1, 2]), (2, [4, 5]), (3, [2, 5])], "cohort_id int, members array<bigint>")
    out = nullmodel.run(meetings, cohorts, str(tmp_path), n_permutations=6)
    told = {r.cohort_id: r for r in out["significance"].collect()}
    assert {c: r.observed_support for c, r in told.items()} == {1: 8, 2: 3, 3: 0} and told[3].members == "2 5"
    row = out["summary"].first()
    assert row.n_cohorts == 3 and row.mean_observed == pytest.approx(11 / 3)
    assert row.n_significant == sum(r.p_value < 0.05 for r in told.values()) and row.n_highly_significant == sum(r.p_value < 0.01 for r in told.values())
    assert row.mean_z == pytest.approx(sum(r.z_score for r in told.values()) / 3)
    assert spark.read.csv(f"{tmp_path}/cohort_significance", header=True).count() == 3


def test_forecast_summary(spark, meetings):
    cohorts = spark.createDataFrame([(1, [1, 2]), (2, [4, 5])], "cohort_id int, members array<bigint>")
    out = forecast.run(meetings, cohorts, 86400 * 40)
    row = forecast.summary(out).first()
    # gaps of a day each, and of 1 and 21 days
    assert (row.n_cohorts, row.min_gap, row.max_gap, row.mean_gap, row.median_gap) == (2, 1, 21, (1 + 11) / 2, (1 + 11) / 2)
    assert row.mean_rate == pytest.approx((8 / 7 + 3 / 22) / 2) and (row.n_stable, row.n_drifting) == (2, 0)
    assert row.n_confident == 1 and [r.cohort_id for r in forecast.most_confident(out["next_encounter"], 1).collect()] == [1]
    assert [r.cohort_id for r in forecast.least_stable(out["stability"], 1).collect()] == [2]
    empty = forecast.summary(forecast.run(meetings.where("false"), cohorts, 0)).first()
    assert empty.n_cohorts == 0 and empty.mean_rate is None


def test_many_fits(spark, points):
    swept = {(r.representation, r.k): r for r in cluster.sweep(points, "episode_id", {"both": ["x", "y"], "one": ["x"]}, [2, 3], n_init=2).collect()}
    assert set(swept) == {("both", 2), ("both", 3), ("one", 2), ("one", 3)}
    assert swept["both", 3].silhouette > swept["both", 2].silhouette and swept["both", 3].inertia < swept["both", 2].inertia
    pairs = cluster.stability(points, "episode_id", ["x", "y"], 3, [1, 2, 3], n_init=3)
    assert {(r.seed_a, r.seed_b) for r in pairs.collect()} == set(combinations([1, 2, 3], 2))
    assert cluster.stability_summary(pairs).first().asDict() == pytest.approx({"mean_ari": 1, "std_ari": 0, "min_ari": 1, "max_ari": 1})
    made = spark.createDataFrame([("a", 0.5), ("a", 1.0), ("b", 0.2)], "k string, ari double")
    assert {r.k: (r.mean_ari, r.min_ari, r.max_ari) for r in cluster.stability_summary(made, "k").collect()} == {"a": (0.75, 0.5, 1.0), "b": (0.2, 0.2, 0.2)}
    assert {r.variant: r.ari for r in cluster.sensitivity(points, "episode_id", ["x", "y"], {"one": ["x"]}, 3, n_init=3).collect()} == pytest.approx({"one": 1.0})


def test_variance_of_components(spark, points):
    import numpy as np

    vectors, names = cluster.prepared(points, ["x", "y"])
    _, shares = cluster.pca(vectors, 2)
    z = np.array([r[1:] for r in CLOUDS])
    z = (z - z.mean(0)) / z.std(0)
    wanted = np.sort(np.linalg.eigvalsh(np.cov(z.T)))[::-1]
    told = cluster.explained(spark, shares).orderBy("component").collect()
    assert [r.explained_variance_ratio for r in told] == pytest.approx(list(wanted / wanted.sum()))
    assert [r.cumulative_variance for r in told] == pytest.approx([wanted[0] / wanted.sum(), 1.0])


def test_bundle_labels_new_rows_as_the_old(spark, points, tmp_path):
    bundle = cluster.fit_bundle(points, ["x", "y"], 3, n_init=3)
    cluster.save_bundle(bundle, tmp_path / "b.json")
    assert cluster.load_bundle(tmp_path / "b.json") == bundle
    labels = {r.episode_id: r.cluster_id for r in cluster.predict(points, cluster.load_bundle(tmp_path / "b.json")).collect()}
    assert len({labels[c * 100] for c in range(3)}) == 3 and all(labels[i] == labels[i // 100 * 100] for i in labels)
    a = cluster.predict(points, bundle).select("episode_id", "cluster_id")
    row = reports.compare_partitions(a, a.where("episode_id >= 20"), "episode_id").first()
    assert (row.n_shared, row.only_left, row.only_right, row.ari) == (70, 20, 0, 1.0)


def test_orders_of_rules_and_cohorts(spark):
    baskets = [{1, 2, 3}, {1, 2}, {1, 2, 3}, {2, 3}, {4, 1}, {4, 1}, {3}]
    found = mining.apriori(spark.createDataFrame([(i, sorted(b)) for i, b in enumerate(baskets)], "txn_id long, items array<long>"), 2)
    held = lambda s: sum(set(s) <= b for b in baskets)
    sets = {s for k in range(1, 4) for s in combinations(range(1, 5), k) if held(s) >= 2}
    assert mining.supports_of(found.itemsets) == {s: held(s) for s in sets}
    where = {(tuple(r.itemset), r.txn_id) for r in found.lists.collect()}
    assert where == {(s, i) for s in sets for i, b in enumerate(baskets) if set(s) <= b}
    sides = {(tuple(sorted(p[:n])), tuple(sorted(p[n:]))) for s in sets for p in permutations(s) for n in range(1, len(s))}
    told = mining.rules_by_sides(mining.rules(found.itemsets, found.n_transactions))
    assert set(told) == sides
    for (a, c), (confidence, lift) in told.items():
        assert confidence == pytest.approx(held(a + c) / held(a)) and lift == pytest.approx(7 * held(a + c) / held(a) / held(c))
    ordered = mining.ordered_rules(found.itemsets, found.n_transactions).collect()
    assert [r.rule_number for r in ordered] == list(range(1, len(sides) + 1))
    assert [(-r.lift, -r.support) for r in ordered] == sorted((-r.lift, -r.support) for r in ordered)
    shares = spark.createDataFrame([([2, 1], 3 / 7), ([3], 4 / 7)], "itemset array<long>, support double")
    assert mining.supports_of(mining.counted_supports(shares, 7)) == {(1, 2): 3, (3,): 4}
    report = spark.createDataFrame([("9 10", 5, 2), ("10 9 1", 5, 3), ("1 2", 5, 2), ("7 8", 9, 2)], "members string, support long, size long")
    assert [r.members for r in mining.ordered_cohorts(report).collect()] == ["7 8", "1 2", "10 9 1", "9 10"]
    assert [r.members for r in mining.ordered_cohorts(report, by_size=True).collect()] == ["7 8", "1 2", "9 10", "10 9 1"]


def test_broken_episodes_are_told(spark):
    shape = "episode_id long, first_slot long, last_slot long, n_slots long, n_gap_slots long, gathering_ids array<long>, start_time long, end_time long, night_share double"
    gatherings = spark.createDataFrame([(0,), (1,), (2,)], "gathering_id long")
    sound = spark.createDataFrame([(0, 0, 2, 3, 1, [0, 1], 0, 700, 0.0), (1, 5, 5, 1, 0, [2], 1500, 1500, 1.0)], shape)
    assert set(features.check_episodes(sound, gatherings).values()) == {0}
    broken = spark.createDataFrame([(0, 0, 2, 4, 1, [0, 1], 9, 7, 0.0), (1, 5, 5, 1, 0, [1], 1500, 1500, 1.5)], shape)
    assert features.check_episodes(broken, gatherings) == {"span": 1, "gaps": 1, "times": 1, "night": 1, "repeated": 1, "unplaced": 1}


def _engine(spark, **more):
    scans = [(t, a, b, -70) for t in (0, 300, 90000) for a, b in ((1, 2), (2, 3))]
    df = prepare.classify(spark.createDataFrame(scans, "timestamp long, user_a long, user_b long, rssi long"))
    empty = lambda shape: spark.createDataFrame([], shape)
    return engine.Engine(df, spark.createDataFrame([(1, 2)], "user_a long, user_b long"), empty("timestamp long, caller long, callee long, duration long"), empty("timestamp long, sender long, recipient long"), dict(DEFAULTS), least_support=1, **more)


def test_tables_outlast_the_engine(spark, tmp_path):
    run = lambda inputs: _engine(spark, store=str(tmp_path), inputs=inputs).run("episodes")
    first, again, other = run("a"), run("a"), run("b")
    assert (first.lineage_hit, again.lineage_hit, other.lineage_hit) == (False, True, False)
    assert first.tables["metrics"].first() == again.tables["metrics"].first()
    for marker in tmp_path.glob("episodes-*/_SUCCESS"):
        marker.unlink()
    assert not run("a").lineage_hit and run("a").lineage_hit


def test_queued_runs(spark, tmp_path):
    jobs = engine.Jobs(_engine(spark), tmp_path)
    first, second, third = (jobs.submit(a, wait=False) for a in ("episodes", "gatherings", "associations"))
    assert jobs.cancel(third)["state"] == "cancelled" == jobs.get(third)["state"]
    assert [jobs.finished(r)["state"] for r in (first, second, third)] == ["done", "done", "cancelled"]
    with pytest.raises(ValueError):
        jobs.cancel(first)
    assert {r["id"] for r in jobs.list()} == {first, second, third}
    assert jobs.artifact(second, "metrics.csv").exists()
    few = engine.Jobs(jobs.engine, tmp_path / "few", most_active=0)
    with pytest.raises(RuntimeError):
        few.submit("episodes")

"""Scores, partitions and reports on hand-made tables; the registry and the engine."""

import inspect
import math
import random
from pathlib import Path

import numpy as np
import pytest

from flocktrace import anomaly, cluster, config, engine, metrics, nullmodel, prepare, quality, registry, scaling

SF = "/root/testdata/sf0.001"

GRID = [(i * 5 + j, float(i), float(j)) for i in range(5) for j in range(5)] + [(99, 30.0, 30.0)]


def test_zscores(spark):
    flat = spark.createDataFrame([(i, 2.0) for i in range(4)], "k long, v double")
    assert {r.z_score for r in anomaly.zscore(flat, "k", "v").collect()} == {0.0}
    odd = spark.createDataFrame(list(enumerate([1.0, 2.0, 3.0, 4.0, 100.0])), "k long, v double")
    assert [r.v for r in anomaly.zscore(odd, "k", "v", robust=True).where("is_anomaly").collect()] == [100.0]


@pytest.mark.parametrize("method", [anomaly.knn_distance, anomaly.lof, anomaly.isolation_forest, anomaly.one_class_svm])
def test_far_point_ranks_first(spark, method):
    df = spark.createDataFrame(GRID, "k long, x double, y double")
    assert method(df, "k", ["x", "y"]).where("rank = 1").first().k == 99


def test_spike_and_not_what_follows(spark):
    df = spark.createDataFrame([(i, 50.0 if i == 6 else 1.0) for i in range(12)], "t long, v double")
    assert anomaly.prediction_error(df, "t", "v", window=3).where("rank = 1").first().t == 6


def test_detection_with_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1)], "y int, s double")
    r = metrics.detection(df, "y", "s").first()
    assert (r.auc_roc, r.auc_pr) == pytest.approx((0.625, 0.5833333))
    assert metrics.detection(df.where("y = 1"), "y", "s").first().auc_roc is None


def _silhouette(points):
    """Of {(cluster, *features): rows}, by definition."""
    sizes = {c: sum(n for p, n in points.items() if p[0] == c) for c in {p[0] for p in points}}
    scores = 0.0
    for p, n in points.items():
        means = {c: sum(m * math.dist(p[1:], q[1:]) for q, m in points.items() if q[0] == c) / max(1, sizes[c] - (c == p[0])) for c in sizes}
        x, y = means.pop(p[0]), min(means.values())
        scores += n * (y - x) / max(x, y) if sizes[p[0]] > 1 else 0
    return scores / sum(points.values())


def test_registered_silhouette_takes_every_row(spark, monkeypatch):
    from flocktrace import queries

    points = {(0, 0.0, 0.0, 1.0, 2.0): 10_000, (0, 3.0, 0.5, 1.0, 2.0): 40, (1, 9.0, 1.0, 4.0, 2.0): 30, (1, 0.5, 0.0, 1.0, 2.0): 29, (2, 1.0, 1.0, 1.0, 1.0): 1}
    rows = [p for p, n in points.items() for _ in range(n)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "vec_id long, label int, x0 double, x1 double, x2 double, x3 double")
    monkeypatch.setattr(queries, "_features4", lambda *_: df)
    assert queries.QUERIES["silhouette"](spark, "").first()[0] == pytest.approx(_silhouette(points), abs=6e-7)


def test_distance_sums_by_chunks(spark):
    draw = random.Random(5)
    rows = [(i + 1, draw.choice([None, "a", "b"]), draw.randrange(1, 4), draw.random(), draw.random()) for i in range(50)]
    points = spark.createDataFrame(rows, "pos long, l string, w long, x0 double, x1 double")
    got = {(r.pos, r.other): r.total for r in metrics._distance_sums(points, ["x0", "x1"], chunk=7).collect()}
    wanted = {(p[0], c): sum(q[2] * math.dist(p[3:], q[3:]) for q in rows if q[1] == c) for p in rows for c in (None, "a", "b")}
    assert got == {k: pytest.approx(v) for k, v in wanted.items()}


def test_rand_index_and_repeated_ids(spark):
    a = spark.createDataFrame([(10, 0), (11, 0), (12, 1)], "episode_id long, cluster_id int")
    b = spark.createDataFrame([(12, 7), (11, 7), (99, 8)], "episode_id long, cluster_id int")
    r = metrics.adjusted_rand(a, b, "episode_id", "cluster_id", "cluster_id").first()
    assert (r.n_shared, r.only_left, r.only_right) == (2, 1, 1)
    with pytest.raises(ValueError):
        metrics.adjusted_rand(a.union(a), b, "episode_id", "cluster_id", "cluster_id")


def test_scaling(spark):
    df = spark.createDataFrame([(0.0,), (10.0,), (20.0,)], "v double")
    out, scaler = scaling.scale(df, ["v"])
    assert scaler["v"] == pytest.approx((10.0, 8.16496580927726)) and out.agg({"v_scaled": "avg"}).first()[0] == pytest.approx(0)
    robust, _ = scaling.scale(spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 100)], "v double"), ["v"], "robust")
    assert robust.where("v = 3").first().v_scaled == 0


def test_quality_reports(spark):
    rep = quality.duplicate_report(spark.createDataFrame([(1, 1), (1, 1), (2, 2)], "a long, b long")).first()
    assert rep.n_duplicate_rows == 1
    edges = spark.createDataFrame([(1, 0, 512), (2, 512, 0), (3, 3, 3)], "p long, a long, b long")
    s = quality.symmetric_report(edges, "a", "b").first()
    assert (s.n_self_loops, s.n_duplicate_edges) == (1, 1)
    assert [(r.a, r.b) for r in quality.drop_symmetric(edges, "a", "b", "p").collect()] == [(0, 512)]
    holes = spark.createDataFrame([(1.0,), (None,), (3.0,)], "a double")
    assert quality.missingness_report(holes).first().n_missing == 1
    assert sorted(r.a for r in quality.apply_missing(holes, "a", "impute_median").collect()) == [1, 2, 3]
    with pytest.raises(ValueError):
        quality.apply_missing(holes, "a", "guess")
    tail = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 100)], "v double")
    assert [r.v for r in quality.flag_outliers(tail, "v").where("v_outlier").collect()] == [100.0]


def test_registry():
    d = config.registry()["clustering"]["defaults"]
    assert (d["k"], d["seed"], d["n_init"]) == (5, 42, 20)
    for bad in ({"k": 99}, {"other": 1}, {"n_init": True}):
        with pytest.raises(ValueError):
            config.validate("clustering", bad)
    with pytest.raises(ValueError):
        config.validate("cohorts", {"min_support": 199})
    with pytest.raises(ValueError):
        config.validate("anomalies", {})
    assert config.cache_key("a", {"x": 1}) != config.cache_key("a", {"x": 2})


@pytest.fixture(scope="module")
def runner(spark):
    scans = [(t, 1, 2, -70) for t in (0, 90000)] + [(t, 2, 3, -85) for t in (0, 90000)] + [(t, 3, 4, -70) for t in (90000,)]
    df = prepare.classify(spark.createDataFrame(scans, "timestamp long, user_a long, user_b long, rssi long"))
    friends = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (5, 6)], "user_a long, user_b long")
    calls = spark.createDataFrame([(2000, 1, 2, 30)], "timestamp long, caller long, callee long, duration long")
    sms = spark.createDataFrame([], "timestamp long, sender long, recipient long")
    return engine.Engine(df, friends, calls, sms, least_support=1)


def test_parameters_move_results(runner):
    count = lambda **p: runner.run("gatherings", p).tables["metrics"].first().gatherings
    assert count() == 2 and count(rssi_threshold=-80) == 0 and count(min_gathering_size=4) == 1
    assert runner.run("gatherings").lineage_hit


def test_calls_enter_the_window(runner):
    t, _ = runner.lineage({"communication_lookback_hours": 24})
    got = {r.start_time: (r.calls_events_pre, r.internal_fb_edges, r.has_full_communication_window) for r in t["features"].collect()}
    assert got == {0: (0, 2, False), 90000: (0, 3, True)}
    t, _ = runner.lineage({"communication_lookback_hours": 25})
    assert {r.calls_events_pre for r in t["features"].collect()} == {0, 1}


def test_jobs_keep_a_record(runner, tmp_path):
    jobs = engine.Jobs(runner, tmp_path)
    first, second = jobs.submit("episodes"), jobs.submit("episodes")
    assert not jobs.get(first)["cached"] and jobs.get(second)["cached"]
    assert jobs.artifact(second, "summary.json").is_file()
    with pytest.raises(KeyError):
        jobs.artifact(first, "../metadata.json")


def test_entry_imports_without_the_training_data_part():
    """The rest stands alone: nothing in it imports the subpackage."""
    import ast
    from pathlib import Path

    import flocktrace

    for path in Path(flocktrace.__file__).parent.glob("*.py"):
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] + [getattr(node, "module", "") or ""] if isinstance(node, (ast.Import, ast.ImportFrom)) else []
            assert not any("llm" in n.split(".") or n == "corpus_pipeline" for n in names)


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize(
    ("name", "module", "function", "wanted"),
    [("null_support", nullmodel, "evaluate", {"n_permutations": 100, "mode": "exhaust"}), ("null_support_shuffled", nullmodel, "evaluate", {"n_permutations": 100, "mode": "shuffle"}), ("isolation_forest", anomaly, "isolation_forest", {"n_estimators": 200}), ("kmeans_profiles", cluster, "kmeans", {"n_init": 20}), ("cluster_bundle", cluster, "fit_bundle", {"n_init": 20})],
)
def test_registered_with_production_settings(spark, monkeypatch, name, module, function, wanted):
    class Seen(Exception):
        pass

    known = inspect.signature(getattr(module, function))

    def spy(*a, **b):
        got = known.bind(*a, **b)
        got.apply_defaults()
        assert {k: got.arguments[k] for k in wanted} == wanted
        raise Seen

    monkeypatch.setattr(module, function, spy)
    with pytest.raises(Seen):
        registry.QUERIES[name](spark, SF)


def test_shuffles_are_those_made_one_by_one(spark):
    eps = spark.createDataFrame([(0, [1, 2, 3]), (1, [2, 3, 4]), (2, [1, 3, 4]), (3, [5, 6])], "episode_id long, participant_set array<long>")
    sets = lambda n, seed: {(r.perm_id, r.txn_id, tuple(r["items"])) for r in nullmodel.shuffled_sets(eps, n, seed).collect()}
    assert sets(3, 42) == {(p, t, i) for p in range(3) for _, t, i in sets(1, 42 + p)}


def test_shuffled_support_is_that_of_the_sets(spark, monkeypatch):
    draw = random.Random(8)
    eps = [(i, draw.choices([*range(90), None], k=draw.randrange(0, 30))) for i in range(300)]
    made = spark.createDataFrame(eps, "episode_id long, participant_set array<long>")
    cohorts = spark.createDataFrame([(f"c{i}", draw.sample(range(90), 1 + i % 3)) for i in range(60)] + [("none", []), ("far", [1, 1000]), ("null", [1, None])], "cohort_id string, members array<long>")
    told = lambda df: {(r.cohort_id, r.perm_id): r.support for r in df.collect()}
    by_hand = told(nullmodel.contained_support(nullmodel.shuffled_sets(made, 4, 9), cohorts))
    # supports are counted without a set being written or joined
    monkeypatch.setattr(nullmodel, "contained_support", None)
    assert told(nullmodel.shuffled_support(made, cohorts, 4, 9)) == by_hand and len(by_hand) > 100


def test_shuffled_sets_keep_sizes_and_participants(spark, monkeypatch):
    eps = spark.createDataFrame([(i, [i % 7, 10 + i % 5, 20]) for i in range(70)], "episode_id long, participant_set array<long>")
    for most in (nullmodel.MOST_MEMBERS, 3):
        monkeypatch.setattr(nullmodel, "MOST_MEMBERS", most)
        sets = nullmodel.shuffled_sets(eps, 20, 1).collect()
        assert len({(r.perm_id, r.txn_id) for r in sets}) == len(sets) == 1400
        assert all(list(r["items"]) == sorted(set(r["items"])) and 1 <= len(r["items"]) <= 3 for r in sets)
        # a third of all places is held by 20: an episode lacks it with a chance near 8 in 27
        assert 0.25 < sum(20 not in r["items"] for r in sets) / 1400 < 0.34


@pytest.mark.parametrize("n", [1, 7, 65_536, 65_537, 70_001])
def test_permuted_is_a_permutation_in_parts(n):
    whole = nullmodel.permuted(np.arange(n), n, 3, 1)
    assert (np.sort(whole) == np.arange(n)).all()
    assert (nullmodel.permuted(np.arange(n // 2, n), n, 3, 1) == whole[n // 2 :]).all()
    if n > 100:
        assert abs(np.corrcoef(np.arange(n), whole)[0, 1]) < 0.02
        assert abs(np.corrcoef(whole[:-1], whole[1:])[0, 1]) < 0.02
        assert (nullmodel.permuted(np.arange(n), n, 3, 2) == whole).mean() < 0.001

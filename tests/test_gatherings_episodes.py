"""Filters, components, links and chains on hand-made tables, and against brute force on random ones."""

import random
import re
from pathlib import Path

import pytest

from flocktrace import components, episodes, graph, prepare, registry, sources

SCANS = "timestamp long, user_a long, user_b long, rssi long"


def test_contacts_and_coverage(spark):
    rows = [(0, 1, 2, -80), (300, 2, -1, 0), (600, 3, -2, -70), (900, 4, 5, 0), (1200, 6, 7, -95)]
    df = prepare.classify(spark.createDataFrame(rows, SCANS))
    assert [tuple(r) for r in prepare.contacts(df, -85).select("user_a", "user_b", "slot_id").collect()] == [(1, 2, 0)]
    assert sorted(r.user_b for r in prepare.coverage(df).collect()) == [-2, -1]


def test_missing_columns_and_files(spark, tmp_path):
    spark.createDataFrame([(1, 2, 3, 4)], SCANS).write.parquet(str(tmp_path / "p"))
    with pytest.raises(ValueError, match="is_empty_scan"):
        sources.read_prepared(spark, str(tmp_path / "p"))
    with pytest.raises(FileNotFoundError):
        sources.read_prepared(spark, str(tmp_path / "nothing"))


def test_one_component_of_three(spark):
    rows = [(0, 1, 2, -80, 0), (10, 2, 3, -70, 0), (300, 4, 5, -80, 1)]
    found = graph.gatherings(spark.createDataFrame(rows, SCANS + ", slot_id long")).collect()
    assert [(r.slot_id, r.gathering_id, r.participant_set, r.start_time, r.end_time, r.median_rssi) for r in found] == [(0, 0, [1, 2, 3], 0, 10, -75.0)]


def test_components_equal_union_find(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3)]
    parent: dict = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        if a is not None and a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    found = {x.node: x.component for x in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {a: find(a) for a in parent}


def test_no_edges(spark):
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def _gatherings(spark, sets):
    rows = [(s, i, sorted(m), s * 300, s * 300 + 299, -80.0) for i, (s, m) in enumerate(sets)]
    return spark.createDataFrame(rows, "slot_id long, gathering_id long, participant_set array<long>, start_time long, end_time long, median_rssi double")


def _brute(sets, theta, gap):
    links = []
    for i, (s, a) in enumerate(sets):
        for j, (t, b) in enumerate(sets):
            g = t - s - 1
            if 0 <= g <= gap and a & b and len(a & b) / len(a | b) >= theta:
                links.append((g, -len(a & b) / len(a | b), i, j))
    after, before = {}, set()
    for _, _, i, j in sorted(links):
        if i not in after and j not in before:
            after[i] = j
            before.add(j)
    out = []
    for i in range(len(sets)):
        if i not in before:
            chain = [i]
            while chain[-1] in after:
                chain.append(after[chain[-1]])
            out.append(chain)
    return out


@pytest.mark.parametrize("theta,gap", [(0.5, 0), (0.3, 1), (0.0, 2)])
def test_episodes_equal_a_scan_of_links(spark, theta, gap):
    r = random.Random(9)
    sets = sorted(((r.randrange(12), frozenset(r.sample(range(14), r.randint(3, 6)))) for _ in range(60)), key=lambda x: x[0])
    found = episodes.build_episodes(_gatherings(spark, sets), theta, gap).orderBy("episode_id").collect()
    assert [e.gathering_ids for e in found] == _brute(sets, theta, gap)
    for e in found:
        members = set().union(*(sets[g][1] for g in e.gathering_ids))
        assert e.participant_set == sorted(members) and e.n_slots == e.last_slot - e.first_slot + 1 and e.n_gap_slots == e.n_slots - len(e.gathering_ids)


def test_long_chain(spark):
    sets = [(s, frozenset({1, 2, 3})) for s in range(40)]
    (e,) = episodes.build_episodes(_gatherings(spark, sets)).collect()
    assert e.gathering_ids == list(range(40)) and e.n_slots == 40


@pytest.fixture
def sized_by_files(spark):
    """Broadcasts only by what Spark takes a table's size to be before it runs, up to Spark's own bound."""
    kept = {"spark.sql.autoBroadcastJoinThreshold": "10m", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in kept}
    for k, v in kept.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test tables")
def test_episode_features_sends_no_table_by_the_size_of_its_files(spark, sized_by_files, monkeypatch):
    monkeypatch.setattr(components, "MOST_SENT", 0, raising=False)  # the smallest tables have fewer edges
    ran = spark._jsparkSession.sharedState().statusStore().executionsList
    seen = {ran().apply(i).executionId() for i in range(ran().size())}
    registry.QUERIES["episode_features"](spark, "/root/testdata/sf0.001").collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    found = ran()
    plans = [e.physicalPlanDescription() for e in (found.apply(i) for i in range(found.size())) if e.executionId() not in seen]
    sent = [keys for p in plans for keys in re.findall(r"\(\d+\) Broadcast(?:HashJoin|NestedLoopJoin)[^\n]*\n(?:Left keys \[\d+\]: ([^\n]*))?", p)]
    # running totals send one row for each range
    assert len(sent) > 2 and all("_range" in keys for keys in sent), sent

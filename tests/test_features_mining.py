"""Windows, itemsets, rules and cohorts on hand-made tables."""

import random
import statistics
from itertools import combinations

import pytest

from flocktrace import features, forecast, mining, nullmodel

#: Drawn once from a seed; what should be found in them is counted, not written down.
T6 = [{x for x in range(11, 18) if _draw.random() < 0.5} | {20 + i % 3} for _draw in [random.Random(6)] for i in range(14)]


def _counted(least):
    sets = {s: sum(set(s) <= t for t in T6) for k in range(1, 9) for s in combinations(sorted(set().union(*T6)), k)}
    return {s: n for s, n in sets.items() if n >= least}


@pytest.fixture
def txns(spark):
    return spark.createDataFrame([(i, sorted(t)) for i, t in enumerate(T6)], "txn_id long, items array<long>")


def test_window_edges_and_pairs(spark):
    calls = spark.createDataFrame([(0, 1, 2), (3600, 1, 2), (3601, 2, 1), (86400, 1, 2), (86401, 1, 2)], "timestamp long, caller long, callee long")
    eps = spark.createDataFrame([(0, 3600, [1, 2]), (1, 86400, [1, 2])], "episode_id long, start_time long, participant_set array<long>")
    out = features.communication_before(eps, features.prepare_events(calls, "caller", "callee"), "calls", 86400).orderBy("episode_id").collect()
    assert [(r.calls_events_pre, r.calls_active_pairs_pre) for r in out] == [(1, 1), (3, 1)]


def _joined_types(df):
    """Types of the columns that go into joins."""
    left, out = [df._jdf.queryExecution().optimizedPlan()], set()
    while left:
        plan = left.pop()
        kids = [plan.children().apply(i) for i in range(plan.children().size())]
        left += kids
        if plan.nodeName() == "Join":
            out |= {k.output().apply(i).dataType().simpleString() for k in kids for i in range(k.output().size())}
    return out


def test_communication_joins_no_sets(spark):
    draw = random.Random(3)
    calls = [(draw.randrange(400), *draw.sample(range(12), 2)) for _ in range(300)]
    eps = [(i, draw.randrange(400), draw.sample(range(12), draw.randrange(1, 9)) * 2) for i in range(40)]
    made = spark.createDataFrame(eps, "episode_id long, start_time long, participant_set array<long>")
    events = features.prepare_events(spark.createDataFrame(calls, "timestamp long, a long, b long"), "a", "b")
    out = features.communication_before(made, events, "x", 100)
    wanted = {}
    for i, start, members in eps:
        met = [frozenset(ab) for t, *ab in calls if max(start - 100, 0) <= t < start and set(ab) <= set(members)]
        wanted[i] = (len(met), len(set(met)))
    assert {r[0]: (r[1], r[2]) for r in out.collect()} == wanted and any(n > p for n, p in wanted.values())
    assert not any("array" in t for t in _joined_types(out))


def test_internal_edges_join_no_sets(spark):
    draw = random.Random(4)
    edges = [tuple(draw.choices(range(-1, 12), k=2)) for _ in range(60)]
    eps = [(i, draw.choices(range(12), k=draw.randrange(0, 9))) for i in range(40)]
    out = features.internal_edges(spark.createDataFrame(eps, "episode_id long, participant_set array<long>"), spark.createDataFrame(edges, "user_a long, user_b long"))
    pairs = {frozenset(e) for e in edges if min(e) >= 0 and e[0] != e[1]}
    wanted = {i: (n := sum(p <= set(m) for p in pairs), pytest.approx(n / max(1, len(set(m)) * (len(set(m)) - 1) / 2))) for i, m in eps}
    assert {r[0]: (r[1], r[2]) for r in out.collect()} == wanted and any(n > 1 for n, _ in wanted.values())
    assert not any("array" in t for t in _joined_types(out))


def test_bad_timestamps_raise(spark):
    with pytest.raises(ValueError):
        features.prepare_events(spark.createDataFrame([(-1, 1, 2)], "timestamp long, a long, b long"), "a", "b")


def test_pair_normalisation(spark):
    cols = "n_unique_participants long, calls_events_pre long, sms_events_pre long"
    out = features.pair_normalized(spark.createDataFrame([(2, 2, 1), (4, 6, 0)], cols)).orderBy("n_unique_participants").collect()
    assert [r.calls_events_per_pair_pre for r in out] == [2.0, 1.0]
    with pytest.raises(ValueError, match="at least two"):
        features.pair_normalized(spark.createDataFrame([(1, 0, 0)], cols))


def test_itemsets_condensed_and_rules(spark, txns):
    found, wanted = mining.apriori(txns, 3), _counted(3)
    sets = {tuple(r.itemset): r.support for r in found.itemsets.collect()}
    assert sets == wanted and max(map(len, wanted)) >= 3
    over = {s: [t for t in wanted if set(s) < set(t)] for s in wanted}
    assert {tuple(r.itemset) for r in mining.maximal(found.itemsets).collect()} == {s for s in wanted if not over[s]}
    assert {tuple(r.itemset) for r in mining.closed(found.itemsets).collect()} == {s for s in wanted if all(wanted[t] < wanted[s] for t in over[s])}
    rules = {(tuple(r.antecedent), tuple(r.consequent)): (r.confidence, r.lift) for r in mining.rules(found.itemsets, len(T6)).collect()}
    splits = [(a, tuple(sorted({*s} - {*a}))) for s in wanted for k in range(1, len(s)) for a in combinations(s, k)]
    assert set(rules) == set(splits)
    for a, c in splits:
        confidence = wanted[tuple(sorted(a + c))] / wanted[a]
        assert rules[a, c] == pytest.approx((confidence, confidence / (wanted[c] / len(T6))))
    assert {tuple(r.itemset): r.support for r in mining.fp_growth(txns, 3).collect()} == sets
    assert [(r["k"], r["frequent"]) for r in found.levels if r["frequent"]] == [(k, sum(len(s) == k for s in wanted)) for k in range(1, max(map(len, wanted)) + 1)]


def test_registered_mining_has_no_largest_size(spark, monkeypatch):
    from flocktrace import queries

    baskets = [[1, 2, 3, 4, 5]] * 3 + [[1, 2, 3, 4], [2, 3, 4, 6], [1, 6]]
    df = spark.createDataFrame(list(enumerate(baskets)), "txn_id long, items array<long>")
    monkeypatch.setattr(queries, "_baskets", lambda *_: df)
    monkeypatch.setattr(queries, "SUPPORT_SHARE", 0.5)
    counts = {s: sum(set(s) <= set(b) for b in baskets) for k in range(1, 7) for s in combinations(range(1, 7), k)}
    wanted = {" ".join(map(str, s)): n for s, n in counts.items() if n >= 3}
    assert max(len(x.split()) for x in wanted) == 5
    got = lambda name: {r.itemset: r.support for r in queries.QUERIES[name](spark, "").collect()}
    assert got("frequent_itemsets") == got("fp_growth") == wanted
    above = lambda s: [t for t in wanted if set(s.split()) < set(t.split())]
    assert got("maximal_itemsets") == {s: n for s, n in wanted.items() if not above(s)}
    assert got("closed_itemsets") == {s: n for s, n in wanted.items() if all(wanted[t] < n for t in above(s))}


def test_transaction_numbers(txns):
    r = mining.transaction_stats(txns).first()
    items = sorted(set().union(*T6))
    assert (r.n_transactions, r.n_items, r.max_length, r.median_length) == (len(T6), len(items), max(map(len, T6)), statistics.median(map(len, T6)))
    assert mining.one_hot(txns).columns == ["txn_id", *map(str, items)]


def test_sessions_take_the_longest_end(spark):
    rows = spark.createDataFrame([(1, 0, 0), (1, 300, 9000), (1, 10000, 10000)], "c long, start_time long, end_time long")
    assert mining.sessions(rows, ["c"]).first().sessions == 1


def test_recurrence_and_stability(spark):
    met = spark.createDataFrame([(1, d * 86400) for d in (0, 1, 3)], "cohort_id long, start_time long")
    r = forecast.recurrence(met).first()
    assert (r.mean_gap_days, r.std_gap_days) == (1.5, 0.5)
    s = forecast.stability(met).first()
    assert (s.first_half_count, s.second_half_count) == (2, 1) and s.chi_square == pytest.approx(1 / 3)


def test_permutation_runs_out(spark):
    eps = spark.createDataFrame([(0, [1, 2, 3]), (1, [2, 3, 4]), (2, [1, 3, 4])], "episode_id long, participant_set array<long>")
    sets = {r.txn_id: len(r["items"]) for r in nullmodel.exhausted_sets(eps, 1).collect()}
    assert sets == {0: 3, 1: 1}
    assert nullmodel.shuffled_sets(eps, 2).count() == 6

"""How often cohorts would meet by chance: permutations of participants over the same group sizes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .mining import containing, transactions
from .storage import running_totals, staged


def universe(episodes: DataFrame) -> DataFrame:
    return episodes.select(F.explode("participant_set").alias("member")).distinct()


def exhausted_sets(episodes: DataFrame, n_permutations: int, seed: int = 42) -> DataFrame:
    """perm_id, txn_id and items: a permutation of the distinct participants dealt out once, in order of episodes.

    Each permutation runs out after as many places as there are participants; later sets are empty and left out.  The
    permutations are numpy's for seed + perm_id; only episodes that get a place are dealt to, so what comes to the driver
    is bounded by the number of participants.
    """
    spark = episodes.sparkSession
    members = sorted(r[0] for r in universe(episodes).collect())  # the participants of the study
    sized = running_totals(episodes.select("episode_id", F.size("participant_set").cast("long").alias("n")), [F.col("episode_id")], {"upto": F.col("n")}, "sized").drop("_range")
    places = sized.where(F.col("upto") - F.col("n") < len(members)).select("episode_id", (F.col("upto") - F.col("n")).alias("at"), "n")
    rows = [(p, pos, int(m)) for p in range(n_permutations) for pos, m in enumerate(np.random.RandomState(seed + p).permutation(members).tolist())]
    dealt = spark.createDataFrame(rows, "perm_id int, pos long, item long")
    met = dealt.join(F.broadcast(places), (F.col("pos") >= F.col("at")) & (F.col("pos") < F.col("at") + F.col("n")))  # at most one place for each participant
    return met.groupBy("perm_id", F.col("episode_id").alias("txn_id")).agg(F.array_sort(F.collect_list("item")).alias("items"))


#: Distinct participants, and cohorts, up to which they go to every task; beyond, places and participants are joined.
MOST_MEMBERS, MOST_COHORTS = 1 << 20, 10_000
#: Places up to which a permutation is drawn as a table.
SMALL = 1 << 16


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    """A hash of each number, from 0 to 2**32 - 1."""
    h = x + np.uint64(key)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h >>= np.uint64(32)
    return h


def permuted(at: np.ndarray, n: int, seed: int, perm: int, rounds: int = 5) -> np.ndarray:
    """Where a random permutation of the numbers below n, known by seed and perm, takes those in `at`.

    Any part of it can be told without the rest: the numbers are pairs (l, r), each half is turned by a hash of the
    other in rounds, and what ends outside goes round again.  Small ones are drawn as a whole.
    """
    rng = np.random.default_rng([seed & 0xFFFFFFFFFFFFFFFF, perm])
    if n <= SMALL:
        return rng.permutation(n)[at]
    keys = rng.integers(1 << 64, size=(rounds, 2), dtype=np.uint64).tolist()
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)
    wide, high = np.uint64(a), np.uint64(b)
    out = at.astype(np.uint64)
    left = slice(None)
    while True:
        l, r = np.divmod(out[left], high)  # noqa: E741
        for one, other in keys:
            l += _mixed(r, one) * wide >> np.uint64(32)
            np.subtract(l, wide, out=l, where=l >= wide)
            r += _mixed(l, other) * high >> np.uint64(32)
            np.subtract(r, high, out=r, where=r >= high)
        out[left] = l * high + r
        left = np.flatnonzero(out >= n)
        if not len(left):
            return out.astype(np.int64)


def _dealing(episodes: DataFrame) -> tuple[DataFrame, pa.Array, np.ndarray, int] | None:
    """Episodes (episode_id, at, n) with their first place, all participants in order, the places up to each, and all places; None if participants are too many."""
    counts = staged(episodes.select(F.explode("participant_set").alias("member")).groupBy("member").agg(F.count("*").alias("c")), "counts")
    if counts.count() > MOST_MEMBERS:
        return None
    known = counts.where("member is not null").orderBy("member").toArrow()
    ends = np.cumsum(known["c"].to_numpy())
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    sized = episodes.select("episode_id", F.size("participant_set").cast("long").alias("n")).where("n > 0")
    upto = running_totals(sized, [F.col("episode_id")], {"upto": F.col("n")}, "places")
    return upto.select("episode_id", (F.col("upto") - F.col("n")).alias("at"), "n"), pa.concat_arrays(known["member"].chunks or [pa.array([], known["member"].type)]), ends, total


def _places(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All places of a batch of episodes, and where each episode's begin."""
    at, n = batch.column(1).to_numpy(), batch.column(2).to_numpy()
    begins = np.cumsum(n) - n
    return np.repeat(at - begins, n) + np.arange(n.sum()), begins


def shuffled_sets(episodes: DataFrame, n_permutations: int, seed: int = 42) -> DataFrame:
    """perm_id, txn_id and items: all places of all episodes are dealt anew to the same multiset of participants.

    Sizes and, but for repeats within a set, how often each participant comes are kept.  Places are numbered by episode
    and participants in their own order; a permutation of the numbers tells who gets a place, so nothing is sorted for
    each permutation.
    """
    dealing = _dealing(episodes)
    if dealing is None:
        return _joined_sets(episodes, n_permutations, seed)
    places, members, ends, total = dealing
    sent = episodes.sparkSession.sparkContext.broadcast((members, ends))
    kinds = {f.name: f.dataType for f in episodes.schema}
    schema = T.StructType([T.StructField("perm_id", T.IntegerType()), T.StructField("txn_id", kinds["episode_id"]), T.StructField("items", T.ArrayType(kinds["participant_set"].elementType))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, ends = sent.value
        for batch in batches:
            at, begins = _places(batch)
            row = np.repeat(np.arange(batch.num_rows), batch.column(2).to_numpy())
            for perm in range(n_permutations):
                who = np.searchsorted(ends, permuted(at, total, seed, perm), "right")
                order = np.lexsort((who, row))
                who, of = who[order], row[order]
                # places beyond all participants are those of nulls
                kept = np.concatenate([[True], (who[1:] != who[:-1]) | (of[1:] != of[:-1])]) & (who < len(members))
                offsets = np.concatenate([[0], np.cumsum(np.bincount(of[kept], minlength=batch.num_rows))])
                items = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), members.take(pa.array(who[kept])))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, perm, dtype=np.int32)), batch.column(0), items], names=schema.names)

    return places.mapInArrow(run, schema)


def shuffled_support(episodes: DataFrame, cohorts: DataFrame, n_permutations: int, seed: int = 42) -> DataFrame:
    """contained_support of shuffled_sets, counted where places are dealt: no set is made, written or joined."""
    told = cohorts.select("cohort_id", "members").limit(MOST_COHORTS + 1).toArrow()
    dealing = _dealing(episodes) if told.num_rows <= MOST_COHORTS else None
    if dealing is None:
        return contained_support(staged(shuffled_sets(episodes, n_permutations, seed), "null_sets"), cohorts)
    places, members, ends, total = dealing
    number = {m: i for i, m in enumerate(members.to_pylist())}
    # a cohort with a null or unknown member meets nowhere
    wanted = {i: {number[m] for m in set(c)} for i, c in enumerate(told["members"].to_pylist()) if c and all(m in number for m in c)}
    bit = {m: k for k, m in enumerate(sorted(set().union(*wanted.values())))}
    bits = np.zeros((-(-len(bit) // 64), len(members) + 1), dtype=np.uint64)
    for m, k in bit.items():
        bits[k // 64, m] = np.uint64(1 << k % 64)
    needs = {i: [(w, np.bitwise_or.reduce(bits[w, sorted(c)])) for w in sorted({bit[m] // 64 for m in c})] for i, c in wanted.items()}
    ids = pa.concat_arrays(told["cohort_id"].chunks or [pa.array([], told["cohort_id"].type)])
    sent = episodes.sparkSession.sparkContext.broadcast((ends, bits, needs, ids))
    schema = T.StructType([T.StructField("cohort_id", cohorts.schema["cohort_id"].dataType), T.StructField("perm_id", T.IntegerType()), T.StructField("support", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, bits, needs, ids = sent.value
        found = np.zeros((n_permutations, len(ids)), dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            at, begins = _places(batch)
            for perm in range(n_permutations):
                who = np.searchsorted(ends, permuted(at, total, seed, perm), "right")
                here = [np.bitwise_or.reduceat(word[who], begins) for word in bits]
                for i, need in needs.items():
                    met = True
                    for w, mask in need:
                        met = met & (here[w] & mask == mask)
                    found[perm, i] += np.count_nonzero(met)
        for perm in range(n_permutations):
            some = np.flatnonzero(found[perm])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(some)), pa.array(np.full(len(some), perm, dtype=np.int32)), pa.array(found[perm, some])], names=schema.names)

    return places.mapInArrow(run, schema).groupBy("cohort_id", "perm_id").agg(F.sum("support").alias("support"))


def _joined_sets(episodes: DataFrame, n_permutations: int, seed: int) -> DataFrame:
    """shuffled_sets of any number of participants: places and participants are numbered in two random orders, for all permutations at once, and joined by number."""
    each = episodes.select("episode_id", F.explode("participant_set").alias("member")).withColumn("perm_id", F.explode(F.sequence(F.lit(0), F.lit(n_permutations - 1))))
    salt = (F.col("perm_id") + seed) * 2
    one = {"k": F.lit(1).cast("long")}
    # every permutation has as many places as members, so numbers over all permutations stay within each
    a = running_totals(each, [F.col("perm_id"), F.xxhash64("episode_id", "member", salt), F.col("episode_id"), F.col("member")], one, "places").select("k", "perm_id", "episode_id")
    b = running_totals(each, [F.col("perm_id"), F.xxhash64("member", "episode_id", salt + 1), F.col("member"), F.col("episode_id")], one, "members").select("k", "member")
    return a.join(b, "k").groupBy("perm_id", F.col("episode_id").alias("txn_id")).agg(F.array_sort(F.collect_set("member")).alias("items"))


def equal_support(sets: DataFrame, cohorts: DataFrame) -> DataFrame:
    """Null supports by equality of whole sets."""
    return sets.join(cohorts.select("cohort_id", F.array_sort("members").alias("items")), "items").groupBy("cohort_id", "perm_id").agg(F.count("*").alias("support"))


def contained_support(sets: DataFrame, cohorts: DataFrame) -> DataFrame:
    """Null supports by containment, without those that are 0."""
    keyed = sets.select(F.struct("perm_id", "txn_id").alias("txn_id"), "items")
    return containing(keyed, cohorts).groupBy("cohort_id", F.col("txn_id.perm_id").alias("perm_id")).agg(F.count("*").alias("support"))


def evaluate(episodes: DataFrame, cohorts: DataFrame, n_permutations: int = 100, mode: str = "exhaust", match: str = "contain", seed: int = 42) -> DataFrame:
    """cohort_id, observed_support, null_mean, null_std, z_score and p_value of every cohort (cohort_id, members).

    mode: exhaust or shuffle; match: contain or equal.  p_value is the share of permutations with at least the observed
    support.  Without spread, z_score is infinite if more than the mean was observed, else 0.
    """
    modes = {"exhaust": exhausted_sets, "shuffle": shuffled_sets}
    if mode not in modes or match not in ("contain", "equal"):
        raise ValueError("mode is exhaust or shuffle, match is contain or equal")
    observed = containing(transactions(episodes), cohorts).groupBy("cohort_id").agg(F.count("*").alias("o"))
    base = cohorts.select("cohort_id").join(observed, "cohort_id", "left").select("cohort_id", F.coalesce("o", F.lit(0)).alias("observed_support"))
    if mode == "shuffle" and match == "contain":
        nulls = staged(shuffled_support(episodes, cohorts, n_permutations, seed), "null_supports")
    else:
        sets = staged(modes[mode](episodes, n_permutations, seed), "null_sets")
        nulls = (contained_support if match == "contain" else equal_support)(sets, cohorts)
    all_of = base.withColumn("perm_id", F.explode(F.sequence(F.lit(0), F.lit(n_permutations - 1)))).join(nulls, ["cohort_id", "perm_id"], "left").withColumn("support", F.coalesce("support", F.lit(0)))
    grouped = all_of.groupBy("cohort_id", "observed_support").agg(F.avg("support").alias("null_mean"), F.stddev_pop("support").alias("null_std"), F.avg((F.col("support") >= F.col("observed_support")).cast("int")).alias("p_value"))
    o, m, s = F.col("observed_support"), F.col("null_mean"), F.col("null_std")
    z = F.when(s > 0, (o - m) / s).when(o > m, F.lit(float("inf"))).otherwise(F.lit(0.0))
    return grouped.select("cohort_id", "observed_support", "null_mean", "null_std", z.alias("z_score"), "p_value")


def summary(results: DataFrame, alpha: float = 0.05, strict: float = 0.01) -> DataFrame:
    """Cohorts, those below each level, and means; the mean z-score is infinite if one is."""
    return results.agg(
        F.count("*").alias("n_cohorts"),
        F.count_if(F.col("p_value") < alpha).alias("n_significant"),
        F.count_if(F.col("p_value") < strict).alias("n_highly_significant"),
        F.avg("observed_support").alias("mean_observed"),
        F.avg("null_mean").alias("mean_null"),
        F.avg("z_score").alias("mean_z"),
    )


def strongest(results: DataFrame, n: int = 10) -> DataFrame:
    return results.orderBy(F.col("z_score").desc(), "cohort_id").limit(n)




def run(episodes: DataFrame, cohorts: DataFrame, folder: str, n_permutations: int = 50, mode: str = "exhaust", seed: int = 42) -> dict[str, DataFrame]:
    """Tests every cohort (cohort_id, members) and writes the results as CSV: significance, its summary, and the 20 strongest."""
    from .sources import members_text, write_csv

    results = evaluate(episodes, cohorts, n_permutations, mode, seed=seed).join(cohorts.select("cohort_id", members_text("members").alias("members")), "cohort_id")
    results = staged(results, "significance")
    write_csv(results, f"{folder.rstrip('/')}/cohort_significance")
    return {"significance": results, "summary": summary(results), "strongest": strongest(results, 20)}

"""Frequent itemsets level by level, their condensations, and association rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import running_totals, staged

ITEMSETS = "itemset array<bigint>, k int, support bigint"


def transactions(episodes: DataFrame) -> DataFrame:
    """One transaction for each episode: txn_id and items."""
    return episodes.select(F.col("episode_id").alias("txn_id"), F.array_sort(F.array_distinct("participant_set")).alias("items"))


def one_hot(txns: DataFrame, items: list[int] | None = None) -> DataFrame:
    """One boolean column for each item, in ascending order; an export for small sets of items."""
    each = txns.select("txn_id", F.explode_outer("items").alias("item"))
    wanted = sorted(items) if items is not None else [r[0] for r in each.where("item is not null").select("item").distinct().orderBy("item").collect()]
    made = each.groupBy("txn_id").pivot("item", wanted).agg(F.lit(True))
    return made.select("txn_id", *(F.coalesce(F.col(f"`{i}`"), F.lit(False)).alias(str(i)) for i in wanted))


def transaction_stats(txns: DataFrame) -> DataFrame:
    """Number of transactions and items, and the lengths of transactions."""
    n = F.size("items")
    lengths = txns.agg(F.count("*").alias("n_transactions"), F.expr("percentile(size(items), 0.5)").alias("median_length"), F.round(F.avg(n), 6).alias("mean_length"), F.expr("percentile(size(items), 0.95)").alias("p95_length"), F.max(n).cast("long").alias("max_length"))
    items = txns.select(F.explode("items").alias("item")).agg(F.countDistinct("item").alias("n_items"))
    return lengths.join(F.broadcast(items))  # one row on either side


def containing(txns: DataFrame, itemsets: DataFrame, id_col: str = "cohort_id", set_col: str = "members") -> DataFrame:
    """(id, txn_id) wherever a transaction contains the whole itemset.

    Members are exploded and joined by item, and pairs with a hit for every member are kept.
    """
    wanted = itemsets.select(id_col, F.size(F.array_distinct(set_col)).alias("need"), F.explode(F.array_distinct(set_col)).alias("item"))
    items = txns.select("txn_id", F.explode(F.array_distinct("items")).alias("item"))
    return wanted.join(items, "item").groupBy(id_col, "need", "txn_id").agg(F.count("*").alias("hits")).where("hits = need").select(id_col, "txn_id")


def support_of(txns: DataFrame, itemsets: DataFrame, id_col: str = "cohort_id", set_col: str = "members") -> DataFrame:
    """The support of each itemset by its definition, 0 for those that are nowhere."""
    found = containing(txns, itemsets, id_col, set_col).groupBy(id_col).agg(F.count("*").alias("n"))
    return itemsets.join(found, id_col, "left").select(id_col, set_col, F.coalesce("n", F.lit(0)).alias("support"))


def candidates(level: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(joined, kept) for the frequent sets of a level: unions of two with a common prefix, and those all of whose subsets are frequent."""
    k = F.size("itemset")
    a = level.select(F.slice("itemset", F.lit(1), k - 1).alias("head"), F.element_at("itemset", -1).alias("x"), F.col("itemset").alias("a"))
    b = a.select("head", F.col("x").alias("y"), F.col("a").alias("b"))
    joined = a.join(b, "head").where("x < y").select(F.concat("head", F.array("x", "y")).alias("itemset"), "a", "b")
    size = F.size("itemset")
    subsets = joined.select("itemset", F.explode(F.transform(F.sequence(F.lit(1), size), lambda i: F.concat(F.slice("itemset", F.lit(1), i - 1), F.slice("itemset", i + 1, size)))).alias("subset"))
    whole = subsets.join(level.select(F.col("itemset").alias("subset")), "subset", "left_semi").groupBy("itemset").agg(F.count("*").alias("c")).where(F.col("c") == F.size("itemset")).select("itemset")
    return joined, joined.join(whole, "itemset", "left_semi")


@dataclass
class Mined:
    """All frequent itemsets with their supports, one row for each level that was tried, and the itemsets' transactions."""

    itemsets: DataFrame
    levels: list[dict[str, int]]
    n_transactions: int
    lists: DataFrame


def apriori(txns: DataFrame, min_support: int, max_size: int | None = None) -> Mined:
    """Level-wise mining on lists of transactions.

    A level keeps (itemset, txn_id); a candidate's transactions are those of both sets that it is made of.  Only
    candidates whose subsets are all frequent are counted.
    """
    each = txns.select("txn_id", F.explode(F.array_distinct("items")).alias("item"))
    counted = staged(each.groupBy("item").agg(F.count("*").alias("support")), "items")
    n_items = counted.count()
    level = staged(counted.where(F.col("support") >= min_support).select(F.array("item").alias("itemset"), F.lit(1).alias("k"), "support"), "level")
    levels = [{"k": 1, "joined": n_items, "candidates": n_items, "frequent": level.count()}]
    lists = staged(each.select(F.array("item").alias("itemset"), "txn_id").join(level.select("itemset"), "itemset", "left_semi"), "lists")
    found, every, k = level, lists, 1
    while levels[-1]["frequent"] and (max_size is None or k < max_size):
        k += 1
        joined, kept = candidates(level.select("itemset"))
        kept = staged(kept, "candidates")
        left = lists.select(F.col("itemset").alias("a"), "txn_id")
        right = lists.select(F.col("itemset").alias("b"), "txn_id")
        covered = kept.join(left, "a").join(right, ["b", "txn_id"]).select("itemset", "txn_id")
        level = staged(covered.groupBy("itemset").agg(F.count("*").alias("support")).where(F.col("support") >= min_support).select("itemset", F.lit(k).alias("k"), "support"), "level")
        levels.append({"k": k, "joined": joined.count(), "candidates": kept.count(), "frequent": level.count()})
        if levels[-1]["frequent"]:
            found = found.unionByName(level)
            lists = staged(covered.join(level.select("itemset"), "itemset", "left_semi"), "lists")
            every = every.unionByName(lists)
        if not levels[-1]["joined"]:
            break
    return Mined(found, levels, txns.count(), every)


def fp_growth(txns: DataFrame, min_support: int) -> DataFrame:
    """The same itemsets by Spark's FP-growth, as a cross-check."""
    from pyspark.ml.fpm import FPGrowth

    n = txns.count()
    model = FPGrowth(itemsCol="items", minSupport=(min_support - 0.5) / max(n, 1)).fit(txns)
    return model.freqItemsets.select(F.array_sort("items").alias("itemset"), F.size("items").alias("k"), F.col("freq").alias("support"))


def _without_one(itemsets: DataFrame, *keep: str) -> DataFrame:
    """Every itemset with each of its items left out once."""
    size = F.size("itemset")
    return itemsets.where("k > 1").select(F.explode(F.transform(F.sequence(F.lit(1), size), lambda i: F.concat(F.slice("itemset", F.lit(1), i - 1), F.slice("itemset", i + 1, size)))).alias("itemset"), *keep)


def maximal(itemsets: DataFrame) -> DataFrame:
    """Itemsets that no larger frequent one contains."""
    return itemsets.join(_without_one(itemsets).distinct(), "itemset", "left_anti")


def closed(itemsets: DataFrame) -> DataFrame:
    """Itemsets that no larger one with the same support contains."""
    return itemsets.join(_without_one(itemsets, "support").distinct(), ["itemset", "support"], "left_anti")


def _splits(itemsets: DataFrame) -> DataFrame:
    """Every way to part an itemset in two: a bit for each item tells its side."""
    masks = F.expr("sequence(1, cast(pow(2, size(itemset)) as int) - 2)")
    each = itemsets.where("k > 1").select("itemset", "support", F.explode(masks).alias("mask"))
    side = lambda bit: F.filter("itemset", lambda x, i: F.call_function("getbit", F.col("mask"), i) == bit)
    return each.select("itemset", "support", side(1).alias("antecedent"), side(0).alias("consequent"))


def rules(itemsets: DataFrame, n_transactions: int | Column) -> DataFrame:
    """All rules antecedent -> consequent with support, confidence and lift."""
    n = F.lit(n_transactions) if isinstance(n_transactions, int) else n_transactions
    known = itemsets.select("itemset", "support")
    a = known.select(F.col("itemset").alias("antecedent"), F.col("support").alias("support_a"))
    b = known.select(F.col("itemset").alias("consequent"), F.col("support").alias("support_b"))
    joined = _splits(itemsets).join(a, "antecedent").join(b, "consequent")
    confidence = F.col("support") / F.col("support_a")
    return joined.select("itemset", "antecedent", "consequent", "support", confidence.alias("confidence"), (confidence / (F.col("support_b") / n)).alias("lift"))


def rule_report(itemsets: DataFrame, n_transactions: int) -> DataFrame:
    """Rules without their items: support, confidence, lift and sizes."""
    return rules(itemsets, n_transactions).select("support", "confidence", "lift", F.size("antecedent").cast("long").alias("antecedent_size"), F.size("consequent").cast("long").alias("consequent_size"))


def lift_range(itemsets: DataFrame, n_transactions: int) -> DataFrame:
    """Least and greatest lift over all splits of each itemset."""
    return rules(itemsets, n_transactions).groupBy("itemset").agg(F.min("lift").alias("min_lift"), F.max("lift").alias("max_lift"))


def count_curve(itemsets: DataFrame, supports: list[int]) -> DataFrame:
    """For each minimum support the numbers of single, larger, closed and maximal itemsets, and the longest; mined once at the lowest."""
    out: DataFrame | None = None
    for s in supports:
        kept = itemsets.where(F.col("support") >= s)
        sizes = kept.agg(F.count_if(F.col("k") == 1).alias("singles"), F.count_if(F.col("k") > 1).alias("larger"), F.coalesce(F.max("k"), F.lit(0)).cast("long").alias("longest"))
        row = sizes.join(F.broadcast(closed(kept).agg(F.count("*").alias("closed")))).join(F.broadcast(maximal(kept).agg(F.count("*").alias("maximal"))))
        row = row.select(F.lit(s).cast("long").alias("min_support"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def sessions(rows: DataFrame, keys: list[str], max_gap: int = 3600, slot: int = 300) -> DataFrame:
    """Number of sessions of each key: a row starts one if it begins more than max_gap after the end of all before it.

    An end is end_time plus a slot.
    """
    w = Window.partitionBy(*keys).orderBy("start_time", "end_time").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.max(F.col("end_time") + slot).over(w)
    marked = rows.withColumn("new", (ended.isNull() | (F.col("start_time") - ended > max_gap)).cast("long"))
    return marked.groupBy(*keys).agg(F.sum("new").alias("sessions"))


def cohort_report(episodes: DataFrame, mined: Mined, min_support: int, slot: int = 300, half_day: int = 14, max_gap: int = 3600, large: float = 0.95) -> DataFrame:
    """Closed itemsets of two or more with when, how often and in what company they meet.

    mined comes from these episodes' transactions: its lists tell where each itemset meets, so nothing is searched again.
    """
    from .prepare import day_parts

    cohorts = closed(mined.itemsets).where("k > 1").select(F.array_join(F.col("itemset").cast("array<string>"), " ").alias("members"), "itemset", "support", F.col("k").cast("long").alias("size"))
    cohorts = staged(cohorts, "cohorts")
    matched = mined.lists.join(cohorts.select("itemset", "members"), "itemset").select("members", "txn_id")
    cut = episodes.agg(F.expr(f"percentile(size(participant_set), {large})").alias("large_cut"))  # one row
    told = day_parts(episodes.withColumn("n", F.size("participant_set"))).join(F.broadcast(cut))
    each = staged(matched.join(told.withColumnRenamed("episode_id", "txn_id"), "txn_id"), "matched")
    is_large = F.col("n") >= F.col("large_cut")
    main = each.groupBy("members").agg(
        F.countDistinct("day").alias("days_seen"),
        F.countDistinct("week").alias("weeks_seen"),
        F.count_if(F.col("day") < half_day).alias("support_first_half"),
        F.count_if(F.col("day") >= half_day).alias("support_second_half"),
        F.avg((F.col("night_share") >= 0.5).cast("int")).alias("night_episode_share"),
        F.avg("night_share").alias("night_share_mean"),
        F.avg("n").alias("mean_episode_students"),
        F.avg(is_large.cast("int")).alias("large_episode_share"),
        F.count_if(~is_large).alias("support_without_large"),
    )
    top = lambda c, out: each.groupBy("members", c).count().groupBy("members").agg((F.max("count") / F.sum("count")).alias(out))
    out = cohorts.join(main, "members").join(top("weekday", "top_weekday_share"), "members").join(top("start_hour", "top_hour_share"), "members")
    out = out.join(sessions(each, ["members"], max_gap, slot).withColumnRenamed("sessions", "sessions_1h"), "members").join(lift_range(mined.itemsets, mined.n_transactions), "itemset")
    return out.withColumn("survives_without_large", F.col("support_without_large") >= min_support).drop("itemset")


def ordered_rules(itemsets: DataFrame, n_transactions: int) -> DataFrame:
    """The rule report with rule_number: highest lift first, then highest support; equal ones by their items."""
    told = rules(itemsets, n_transactions)
    order = [F.col("lift").desc(), F.col("support").desc(), F.col("antecedent"), F.col("consequent")]
    numbered = running_totals(told, order, {"rule_number": F.lit(1).cast("long")}, "rules")
    return numbered.select("rule_number", "support", "confidence", "lift", F.size("antecedent").cast("long").alias("antecedent_size"), F.size("consequent").cast("long").alias("consequent_size")).orderBy("rule_number")


def ordered_cohorts(report: DataFrame, by_size: bool = False) -> DataFrame:
    """A cohort report with cohort_number: highest support first, then by the members' text, or by size and then members."""
    order = [F.col("support").desc(), *([F.col("size")] if by_size else []), F.col("members")]
    return running_totals(report, order, {"cohort_number": F.lit(1).cast("long")}, "cohorts").drop("_range").orderBy("cohort_number")


def supports_of(itemsets: DataFrame) -> dict[tuple[int, ...], int]:
    """Itemsets as a dictionary on the driver, for results that are known to be small."""
    return {tuple(sorted(r["itemset"])): r["support"] for r in itemsets.select("itemset", "support").collect()}


def counted_supports(itemsets: DataFrame, n_transactions: int, fraction: str = "support") -> DataFrame:
    """Itemsets whose support is a share of transactions, with the number that it stands for and sorted items."""
    return itemsets.withColumns({"itemset": F.array_sort("itemset"), "support": F.bround(F.col(fraction) * n_transactions).cast("long")})


def rules_by_sides(told: DataFrame) -> dict[tuple[tuple[int, ...], tuple[int, ...]], tuple[float, float]]:
    """Confidence and lift of each rule on the driver, for results that are known to be small."""
    return {(tuple(r["antecedent"]), tuple(r["consequent"])): (r["confidence"], r["lift"]) for r in told.select("antecedent", "consequent", "confidence", "lift").collect()}

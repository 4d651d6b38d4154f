"""Mixing sources to target weights by weighted sampling without replacement (Efraimidis and Spirakis).

Each document draws u from a hash of its id and gets the exponential key -ln(u) / weight, with a weight for its quality;
the smaller the key, the earlier the document.  Within a source, documents in the order of their keys are prefix-summed,
and a source takes whole epochs of all its documents before the rest of its target goes to the first documents of that
order.  DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, checked, running_totals, staged

#: Fixed by the recipe: sources in order weigh so much, and again from the start.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2


def n_words(text: Column) -> Column:
    """Words of a text, 0 for null."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{BLANK}|{BLANK}$", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, BLANK))).cast("long")


def quality(text: Column) -> Column:
    """A weight from 0.1 to 1 that falls with the share of symbols in a text; 0.1 for null and empty texts."""
    symbols = F.size(F.split(text, r"[#*$%&|<>{}\[\]\\^~=]")) - 1
    return F.coalesce(F.greatest(F.lit(0.1), 1 - 8.0 * symbols / F.nullif(F.char_length(text), F.lit(0))), F.lit(0.1))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most_epochs: float = MOST_EPOCHS) -> DataFrame:
    """source, source_size and target of each source, from rows of source and size.

    share times all sizes goes to the sources by weight.  No target passes most_epochs times its source's size; what is
    over goes to the others by weight, until none is above.  That is min(limit, level * weight) for one level, and as
    limits are reached in the order of limit / weight, two running totals give it.  Sources come in code point order,
    null last; sizes of 0 give targets of 0.
    """
    totals = staged(sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("source_size")), "totals")
    ranked = running_totals(totals, [F.col("source").asc_nulls_last()], {"rank": F.lit(1)}, "ranked").drop("_range")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    weighed = ranked.select("source", "source_size", weight.alias("w"), (F.lit(float(most_epochs)) * F.col("source_size")).alias("cap")).withColumn("ratio", F.col("cap") / F.col("w"))
    upto = running_totals(weighed, [F.col("ratio"), F.col("source").asc_nulls_last()], {"caps": F.col("cap"), "ws": F.col("w")}, "filled").drop("_range")
    whole = weighed.agg(F.sum("w").alias("all_w"), (F.sum("source_size") * F.lit(float(share))).alias("budget"))  # one row
    full = F.col("ratio") * (F.col("all_w") - F.col("ws") + F.col("w")) + F.col("caps") - F.col("cap") <= F.col("budget")
    flagged = upto.join(F.broadcast(whole)).withColumn("full", full)
    level = flagged.agg(((F.max("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))), F.lit(0.0))) / F.nullif(F.max("all_w") - F.coalesce(F.sum(F.when(F.col("full"), F.col("w"))), F.lit(0.0)), F.lit(0.0))).alias("level"))
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("w")))
    return flagged.join(F.broadcast(level)).select("source", "source_size", F.coalesce(target, F.col("cap")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None, seed: int = 0, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most_epochs: float = MOST_EPOCHS, whole: bool = False, row_col: str | None = None) -> DataFrame:
    """What a mix takes of each document: doc_id, source, size, source_size, target, taken (and row_col).

    size counts words.  taken is size for each whole epoch of its source's target, plus what is left of the target for
    as long as the running total of sizes in key order stays under it: all of a document, part of the one that crosses
    the target, nothing of later ones.  whole=True takes the crossing document wholly if at least half of it fits, else
    not at all.  weight: a column over docs, quality(text) by default.  Reruns agree, as keys are hashes of ids and seed.

    A third of all rows may be of one source: rows are dealt into ranges of (source, key), whose edges Spark draws from the
    rows themselves, so a hot source has many ranges; one sum for each range makes the running totals whole.

    Null ids, texts (size 0) and sources (a source of its own) are kept; null ids draw by their texts.  Rows with the same
    id stay separate and draw alike; the order among them is that of a hash of their texts, and rows that are alike in all
    that is read may swap places.  An empty table gives no rows.  Other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    tie = F.xxhash64(text, F.lit(seed))
    drawn = F.when(F.col(id_col).isNull(), tie).otherwise(F.xxhash64(F.col(id_col), F.lit(seed)))
    u = (F.shiftrightunsigned(drawn, 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    extra = [F.col(row_col)] if row_col else []
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), F.greatest(F.lit(1e-6), weight if weight is not None else quality(F.col(text_col))).alias("weight"), u.alias("u"), tie.alias("tie"), *extra)
    sized = staged(read.withColumn("key", -F.log("u") / F.col("weight")).drop("u", "weight"), "sized")
    of = targets(sized.select("source", "size"), weights, share, most_epochs)
    order = [F.col(c).asc_nulls_last() for c in ("source", "key", "doc_id", "tie")]
    summed = running_totals(sized, order, {"upto": F.col("size")}, "keyed")
    # what all earlier sources have in the order of the ranges
    earlier = running_totals(of, [F.col("source").asc_nulls_last()], {"through": F.col("source_size")}, "earlier").withColumn("before_source", F.col("through") - F.col("source_size")).drop("through", "_range")
    joined = summed.alias("d").join(checked(staged(earlier, "sources")).alias("o"), F.col("d.source").eqNullSafe(F.col("o.source"))).select("d.*", "before_source", "source_size", "target")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.floor("target").cast("long") - epochs * F.col("source_size")
    fits = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - (F.col("upto") - F.col("before_source") - F.col("size"))))
    if whole:
        fits = F.when((2 * fits >= F.col("size")) & (fits > 0), F.col("size")).otherwise(F.lit(0))
    taken = (epochs * F.col("size") + fits).cast("long")
    return joined.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), *(F.col(c) for c in ([row_col] if row_col else [])))

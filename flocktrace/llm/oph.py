"""Document fingerprints by one-permutation MinHash, in DataFrame operations only.

Every shingle is hashed once; the hash names a bin and competes in it.  Empty bins are filled by optimal densification:
each tries the bins of its own fixed random order until one is filled, and copies that one's value.  A fingerprint packs
the low-order bits of the bins as hexadecimal digits, and the likeness of two is the share of equal bins, corrected for
bits that agree by chance.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, words

BINS = 256
BITS = 8
SHINGLE = 5
#: Tries that are written out for each empty bin; beyond them all filled bins are compared by the same kind of order.
TRIES = 8
_VALUE_BITS = 40


def _let(value: Column, body) -> Column:
    """body(value) with the value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _shingle_hashes(hashes: Column, size: int) -> Column:
    """One hash for each run of `size` items; all items as one run if there are fewer; none for no items."""
    n = F.size(hashes)
    runs = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(size))))
    return F.when(n == 0, F.array().cast("array<bigint>")).when(n < size, F.array(F.xxhash64(hashes))).otherwise(runs)


def _bins(shingles: Column, bins: int) -> Column:
    """The least value in each bin, null where a bin is empty; an empty array for no shingles."""
    packed = F.sort_array(F.transform(shingles, lambda h: F.shiftrightunsigned(h, 64 - _VALUE_BITS - bins.bit_length() + 1)))
    edge = F.array(F.lit(bins << _VALUE_BITS))

    def spread(kept: Column) -> Column:
        bin_of = lambda x: F.shiftright(x, _VALUE_BITS).cast("int")
        ahead = bin_of(F.get(kept, 0))
        runs = F.transform(kept, lambda x, i: F.concat(F.array(x.bitwiseAND(F.lit((1 << _VALUE_BITS) - 1))), F.array_repeat(F.lit(None).cast("bigint"), bin_of(F.coalesce(F.get(kept, i + 1), F.get(edge, F.lit(0)))) - bin_of(x) - 1)))
        return F.concat(F.array_repeat(F.lit(None).cast("bigint"), ahead), F.flatten(runs))

    def first_of_bins(ordered: Column) -> Column:
        return F.filter(ordered, lambda x, i: (i == 0) | (F.shiftright(x, _VALUE_BITS) != F.shiftright(F.get(ordered, i - 1), _VALUE_BITS)))

    return F.when(F.size(shingles) == 0, F.array().cast("array<bigint>")).otherwise(_let(_let(packed, first_of_bins), spread))


def _densified(values: Column, bins: int, seed: int) -> Column:
    """values with empty bins filled from others; an empty array as it is."""
    drawn = random.Random(seed)
    tries = [F.array(*(F.lit(drawn.randrange(bins)) for _ in range(bins))) for _ in range(TRIES)]

    def least(i: Column) -> Column:
        # the filled bin that comes first in the order that bin i's hashes give
        ranked = F.transform(values, lambda v, j: F.when(v.isNotNull(), F.struct(F.xxhash64(i, j, F.lit(seed)).alias("rank"), v.alias("value"))))
        return F.array_min(F.filter(ranked, lambda x: x.isNotNull()))["value"]

    return F.transform(values, lambda v, i: F.coalesce(v, *(F.get(values, F.get(t, i)) for t in tries), least(i)))


def _packed(values: Column, bits: int) -> Column:
    """Low-order bits of the values as hexadecimal digits; '' for no values."""
    digits = bits // 4
    table = F.array(*(F.lit(f"{i:0{digits}x}") for i in range(1 << bits)))
    return F.array_join(F.transform(values, lambda v: F.get(table, v.bitwiseAND(F.lit((1 << bits) - 1)).cast("int"))), "")


def with_fingerprint(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint", bins: int = BINS, bits: int = BITS, shingle: int = SHINGLE, seed: int = 7) -> DataFrame:
    """docs with out_col, the fingerprint of the whole text: bins * bits / 4 hexadecimal digits.

    Shingles are runs of words; a text with fewer words is one shingle.  Texts without words, and null, get ''.  Equal
    texts get equal fingerprints.  bins is a power of two, bits 4 or 8.  All columns of docs stay; one called out_col is
    replaced.
    """
    if bins & (bins - 1) or bits not in (4, 8):
        raise ValueError("bins is a power of two and bits 4 or 8")
    # steps of their own, so that each is worked out once for a row
    step = fresh("_step", docs)
    hashed = docs.withColumn(step, F.transform(words(F.col(text_col)), lambda w: F.xxhash64(w)))
    shingled = hashed.withColumn(step, _let(F.col(step), lambda w: _shingle_hashes(w, shingle)))
    binned = shingled.withColumn(step, _let(F.col(step), lambda s: _bins(s, bins)))
    filled = binned.withColumn(step, _let(F.col(step), lambda v: _densified(v, bins, seed)))
    return filled.withColumn(out_col, _packed(F.col(step), bits)).drop(step)


def likeness(a: Column, b: Column, bins: int = BINS, bits: int = BITS) -> Column:
    """The estimated Jaccard similarity of two fingerprints, 0 to 1.

    Of unlike bins one in 2**bits agrees by chance, which is taken off.  Two texts without words are alike (1), one of
    them and another text are not (0); null for null.
    """
    digits = bits // 4
    same = F.size(F.filter(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.substring(a, i * digits + 1, digits) == F.substring(b, i * digits + 1, digits)))
    chance = 1.0 / (1 << bits)
    corrected = F.greatest(F.lit(0.0), (same / F.lit(float(bins)) - chance) / (1 - chance))
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(corrected)


#: Ranges of ids for each shuffle partition, and bytes of a range, about.
RANGES = 16
RANGE_BYTES = 4 << 20


def with_next(docs: DataFrame, columns: dict[str, str], id_col: str = "doc_id", size: Column | None = None, tie: Column | None = None) -> DataFrame:
    """docs with, for each column: new name, that column of the row with the next lower id; the lowest id's next is the highest.

    Ids of any type that sorts.  They are dealt into ranges whose edges Spark draws from all rows, so many that each holds
    some RANGE_BYTES of size (a column of bytes).  The highest row of each range is also sent to the range above, so one
    shuffle brings all neighbours together.  Rows with a null id come after all others.  tie (a hash of contents) orders
    rows with equal ids, of which the highest counts as last; those with equal ties too may swap places, and are one
    range.  All columns of docs stay; those of the new names are replaced.  An empty table gives no rows.
    """
    spark, kept = docs.sparkSession, docs.drop(*columns.values()).columns
    names = {n: fresh(f"_{n}", docs) for n in ("range", "key", "top", "to", "at", "copied")}
    of_range, key, top, to, at, copied = (names[n] for n in ("range", "key", "top", "to", "at", "copied"))
    keyed = F.struct(F.col(id_col).alias("id"), (tie if tie is not None else F.lit(0).cast("long")).alias("tie"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_bytes = docs.agg(F.sum(size if size is not None else F.lit(256).cast("long"))).first()[0]
    ranges = max(RANGES * partitions, -(-(n_bytes or 0) // RANGE_BYTES))
    # one row for each range comes to the driver, here and below
    drawn = docs.select(keyed.alias("k")).repartitionByRange(ranges, "k").groupBy(F.spark_partition_id().alias("p")).agg(F.min("k").alias("k"))
    kind = docs.select(keyed.alias("k")).schema["k"].dataType
    edges = [r["k"] for r in drawn.orderBy("k").select(F.to_json("k", {"ignoreNullFields": "false"}).alias("k")).collect()][1:]
    edge_list = F.from_json(F.lit(f"[{','.join(edges)}]"), T.ArrayType(kind))
    # binary search: the number of edges at or below a row's
    steps, step = [], 1
    while step <= len(edges):
        steps, step = [step, *steps], step * 2
    search = F.aggregate(F.array(*(F.lit(s) for s in steps)), F.lit(0), lambda i, s: F.when((i + s <= len(edges)) & (F.get(edge_list, i + s - 1) <= F.col(key)), i + s).otherwise(i)) if edges else F.lit(0)
    placed = docs.select("*", keyed.alias(key)).withColumn(of_range, search)
    tops = sorted(placed.groupBy(of_range).agg(F.max(key).alias("top")).collect(), key=lambda r: r[0])
    if not tops:
        return docs.withColumns({new: F.col(c) for c, new in columns.items()})
    # the top row of a range follows the lowest row of the range above; the highest range's top follows the lowest range
    sent = [(r[0], tuple(r[1]), tops[(k + 1) % len(tops)][0]) for k, r in enumerate(tops)]
    schema = T.StructType([T.StructField(of_range, T.IntegerType()), T.StructField(top, kind), T.StructField(to, T.IntegerType())])
    joined = placed.join(F.broadcast(spark.createDataFrame(sent, schema)), of_range)
    mine = F.struct(F.col(of_range).alias("at"), F.lit(0).alias("copied"))
    copies = F.when(F.col(key).eqNullSafe(F.col(top)), F.array(mine, F.struct(F.col(to).alias("at"), F.lit(1).alias("copied")))).otherwise(F.array(mine))
    dealt = joined.select(*docs.columns, F.col(f"{key}.tie").alias(key), F.explode(copies).alias(at)).select(*docs.columns, key, F.col(f"{at}.copied").alias(copied), F.col(f"{at}.at").alias(at))
    window = Window.partitionBy(at).orderBy(F.col(copied), F.col(id_col).desc_nulls_last(), F.col(key).desc())
    led = dealt.select(*kept, copied, *(F.lead(c).over(window).alias(new) for c, new in columns.items()))
    return led.where(F.col(copied) == 0).drop(copied)


def edited(text: Column, following: Column) -> Column:
    """text with its last half (rounded down, in code points) replaced by as many code points of the following text, or all it has."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))

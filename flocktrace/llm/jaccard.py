"""Exact Jaccard join of documents on word shingles by a grouped prefix join.

Shingles are put in one global order, and a document's prefix is so many of its first ones that two documents that link
must have a shingle of both prefixes in common.  Documents with the same size and prefix form a group, and prefixes are
joined for groups.  Pairs of groups are filtered by their sizes and by the most shingles that two documents with these
prefixes can share; what is left is expanded to members, which are verified on their whole sets.

As only connected components are asked for, links inside a component need not be found.  A first round takes, for every
list of groups that share a shingle, the pairs of its first group with the others; a second round takes those pairs of a
list that the first left in different components.  Every link is in some list, so none between components is missed.

The global order is that of hashes, but shingles found often in a first pass come last, the most frequent at the very end,
and so seldom enter a prefix: a document with enough shingles of its own has no list in common with any other.  Lists that
are long all the same are not paired; their documents are joined on parts instead: hashing cuts the shingles
into more parts than two linked documents can differ in, so these agree in a whole part.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..components import connected_components
from .common import bounded, checked, dropped, lean, staged
from .shingles import mixed, shingle_sets

SHINGLE = 5
PERCENT = 80
#: Groups on a list up to which its pairs are taken; longer lists go by parts.
LIST = 48
#: Groups of a longer list that the first round pairs with all its others, besides its least.
CENTRES = 5
#: Shingles that may be put last, which chooses the way, never the result.
MOST_LAST = 200_000


def prefix_length(n: int, percent: int) -> int:
    """A document of n shingles shares at least percent of them with a partner; one more than may be missing is enough."""
    return n - (percent * n + 99) // 100 + 1


def _long(raw: bytes) -> int:
    return int.from_bytes(raw[:8], "little", signed=True)


def _key(packed: bytes) -> tuple[int, int]:
    """Two hashes of 64 bits; the first names a set or group, the second tells apart those that share a name."""
    made = hashlib.blake2b(packed, digest_size=16).digest()
    return _long(made), _long(made[8:])


def _name(packed: bytes, renamed: dict[tuple[int, int], int]) -> int:
    key = _key(packed)
    return renamed.get(key, key[0])


def _clashes(rows: DataFrame, named: DataFrame, name: str, check: str) -> dict[tuple[int, int], int]:
    """For names that stand for different things, by their checks, another name for all of these but one."""
    bad = named.where("lo <> hi").select(name, "lo")
    if bad.isEmpty():
        return {}
    # as many as hashes of 64 bits collide
    return {(r[0], r[1]): r[1] for r in rows.join(bad, name).where(F.col(check) != F.col("lo")).select(name, check).distinct().collect()}


def _renamed(rows: DataFrame, name: str, check: str, names: dict[tuple[int, int], int]) -> DataFrame:
    if not names:
        return rows
    other = rows.sparkSession.createDataFrame([(*k, v) for k, v in names.items()], f"{name} long, {check} long, _other long")
    return rows.join(F.broadcast(other), [name, check], "left").withColumn(name, F.coalesce("_other", name)).select(*rows.columns)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
    flat = np.concatenate(rows).view(np.int64) if rows else np.empty(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _ordered(hashes: np.ndarray, last: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The shingles as sorted numbers in the global order: hashes without their low bit, then those that come last by rank."""
    keys = hashes >> np.uint64(1)
    known, ranks = last
    if len(known):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        keys = np.sort(np.where(known[at] == hashes, ranks[at], keys))
    return keys


def _small(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _frequent(docs: DataFrame, size: int, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that come often, and their places at the end of the global order, the most frequent last.

    Counted are shingles that come twice or more among some thousand documents of one task, in sums over tasks; the
    MOST_LAST most frequent of these are taken.  Any order gives right results; this one keeps lists short.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0

        def flush() -> Iterator[pa.RecordBatch]:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts > 1
            yield pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(counts[often].astype(np.int64))], names=["h", "c"])

        for whole in batches:
            for batch in _small(whole):
                for hashes in shingle_sets(batch.column(0), size, fold):
                    held.append(hashes)
                    n += len(hashes)
                if n > 2_000_000:
                    yield from flush()
                    held, n = [], 0
        if held:
            yield from flush()

    counted = docs.select("text").mapInArrow(lean(run), "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") > LIST // 4)
    found = [r["h"] for r in counted.orderBy(F.col("c").desc(), "h").limit(MOST_LAST).collect()]  # at most MOST_LAST numbers
    hashes = np.array(found, dtype=np.int64).view(np.uint64)
    ranks = np.uint64(1 << 63) + np.arange(len(found), dtype=np.uint64)[::-1]
    order = np.argsort(hashes)
    return hashes[order], ranks[order]


def _can_link(percent: int, x: str, y: str) -> Column:
    """Whether sets of sizes n_x and n_y that share no more than most_x and most_y can link."""
    small, large, most = F.least(f"n_{x}", f"n_{y}"), F.greatest(f"n_{x}", f"n_{y}"), F.least(f"most_{x}", f"most_{y}")
    # what each has alone is in the union only
    alone = F.col(f"n_{x}") - F.col(f"most_{x}") + F.col(f"n_{y}") - F.col(f"most_{y}")
    return (100 * small >= percent * large) & ((100 + percent) * most >= percent * (small + large)) & (100 * most >= percent * (most + alone))


def _survivors(pairs: DataFrame, groups: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of groups whose members can link, by their sizes and prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            n_a, n_b, p_a, p_b = (batch.column(i) for i in range(2, 6))
            for i in range(batch.num_rows):
                x, y = (p[i].values.to_numpy().view(np.uint64) for p in (p_a, p_b))
                cut = min(x[-1], y[-1])
                in_x, in_y = (int(np.searchsorted(v, cut, side="right")) for v in (x, y))
                # all that they share up to the cut is in both prefixes
                shared = len(np.intersect1d(x[:in_x], y[:in_y], assume_unique=True))
                a, b = n_a[i].as_py(), n_b[i].as_py()
                keep.append((100 + percent) * (shared + min(a - in_x, b - in_y)) >= percent * (a + b))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    of = lambda side: groups.select(F.col("gid").alias(side), F.col("n").alias(f"n_{side}"), F.col("prefix").alias(f"p_{side}"))
    size = lambda side: sizes.select(F.col("gid").alias(side), F.col("n").alias(f"n_{side}"))
    sized = pairs.join(size("a"), "a").join(size("b"), "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    full = sized.select("a", "b").join(of("a"), "a").join(of("b"), "b").select("a", "b", "n_a", "n_b", "p_a", "p_b")
    return full.mapInArrow(lean(run), "a long, b long")


def _texts_of(docs: DataFrame, sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts, copies among them, of the wanted sets, found by the tag of a text that has the set."""
    tags = staged(sets.join(checked(wanted), "sid", "left_semi").select("tag").distinct(), "tags")
    return docs.join(checked(tags), "tag", "left_semi").select("text")


def _vectors(docs: DataFrame, sets: DataFrame, wanted: DataFrame, size: int, fold: bool, renamed: dict[tuple[int, int], int]) -> DataFrame:
    """sid and the packed sorted hashes of each wanted set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for batch in _small(whole):
                keys, packed = [], []
                for hashes in shingle_sets(batch.column(0), size, fold):
                    if len(hashes) and (key := _name(hashes.tobytes(), renamed)) not in seen:
                        seen.add(key)
                        keys.append(key)
                        packed.append(hashes.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(packed, pa.binary())], names=["sid", "packed"])

    return _texts_of(docs, sets, wanted).mapInArrow(lean(run), "sid long, packed binary").dropDuplicates(["sid"])


def _verified(pairs: DataFrame, vectors: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) of sets that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (a, b))
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                shared = int(np.count_nonzero(y[at] == x))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    of = lambda side: vectors.select(F.col("sid").alias(side), F.col("packed").alias(f"v_{side}"))
    return pairs.join(of("x"), "x").join(of("y"), "y").select("x", "y", "v_x", "v_y").mapInArrow(lean(run), "x long, y long")


def _classes(percent: int, n: int) -> tuple[list[int], int]:
    """Starts of size classes up to one beyond that of n, and the class of n; partners are in the same class or the next."""
    starts = [1]
    while starts[-1] <= n:
        starts.append(starts[-1] * 100 // percent + 1)
    own = len(starts) - 2
    return [*starts, starts[-1] * 100 // percent + 1], own


def part_keys(hashes: np.ndarray, percent: int) -> np.ndarray:
    """Keys of which two linking documents share at least one.

    Within a class of sizes, two documents differ in at most `most` shingles; of most + 1 + spare parts at least spare + 1
    are equal.  A document with at most `spare` empty parts thus has an equal part that is not empty; all others share a
    key of their class.  A document has keys for its own class and the one below.
    """
    n = len(hashes)
    starts, own = _classes(percent, n)
    out = []
    for k in {own, max(0, own - 1)}:
        most = (100 - percent) * (starts[k + 1] - 1 + (starts[k + 2] if k + 2 < len(starts) else starts[k + 1] * 100 // percent + 1) - 1) // (100 + percent)
        spare = 2 + 2 * math.ceil((most + 1) * math.exp(-starts[k] / (most + 1)))
        parts = most + 1 + spare
        part = (mixed(hashes + np.uint64(0x51ED270B)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        filled, first = np.unique(part[order], return_index=True)
        sums = np.add.reduceat(mixed(hashes[order]), first)
        salt = np.uint64((k * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        out.append(mixed(sums ^ mixed(filled.astype(np.uint64) + salt)))
        if parts - len(filled) > spare:
            out.append(mixed(np.array([salt + np.uint64(1)], dtype=np.uint64)))
    return np.concatenate(out)


def _by_parts(docs: DataFrame, sets: DataFrame, wanted: DataFrame, states: DataFrame, size: int, percent: int, fold: bool, renamed: dict[tuple[int, int], int]) -> DataFrame:
    """Pairs (x, y) of wanted sets in different components that agree in a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for batch in _small(whole):
                keys, rows, sets = [], [], []
                for hashes in shingle_sets(batch.column(0), size, fold):
                    if len(hashes) and (key := _name(hashes.tobytes(), renamed)) not in seen:
                        seen.add(key)
                        keys.append(key)
                        rows.append(part_keys(hashes, percent))
                        sets.append(hashes)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), _lists(rows), _lists(sets)], names=["sid", "parts", "shingles"])

    made = staged(_texts_of(docs, sets, wanted).mapInArrow(lean(run), "sid long, parts array<long>, shingles array<long>").dropDuplicates(["sid"]), "made")
    # shingles that no other of these sets has are shared with none of them, so a set shares `most` at most
    once = made.select("sid", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("c"), F.min("sid").alias("sid")).where("c = 1")
    alone = once.groupBy("sid").agg(F.count("*").alias("alone"))
    known = states.select("sid", "n", "comp").join(alone, "sid", "left").select("sid", "n", "comp", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("most"))
    parts = staged(made.select("sid", F.explode("parts").alias("part")).join(known, "sid"), "parts")
    split = parts.groupBy("part").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("part")
    open_parts = staged(parts.join(checked(staged(split, "split")), "part"), "open_parts")
    every = open_parts.groupBy("sid").agg(F.collect_list("part").alias("own"))  # as many as a set has parts
    rows = staged(open_parts.join(every, "sid"), "rows")
    x, y = (rows.select("part", *(F.col(c).alias(f"{c}_{s}") for c in ("sid", "n", "most", "comp", "own"))) for s in ("x", "y"))
    near = (F.col("sid_x") < F.col("sid_y")) & (F.col("comp_x") != F.col("comp_y")) & _can_link(percent, "x", "y")
    # of all parts that two sets share, the least alone makes the pair
    once = F.array_min(F.array_intersect("own_x", "own_y")) == F.col("part")
    return x.join(y, "part").where(near & once).select(F.col("sid_x").alias("x"), F.col("sid_y").alias("y"))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, fold: bool = True, classes: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles and component_id, and with classes also tag and class.

    Documents link when 100 * intersection >= percent * union of their sets of shingles (runs of `shingle` words; a text
    with fewer words has all of them as its one shingle).  component_id is the least id that links reach.  Texts without
    words, and nulls, have no shingles, link with nothing and are their own component.  Rows with the same id stay
    separate rows; null ids take part, and a component has a null id only if all its rows do.  Equal texts are one set
    from the start and never paired.  An empty table gives no rows.  Other columns are not read.  tag is xxhash64 of the
    text, class a number for each component, null for rows without shingles.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent is over 50 and at most 100")
    id_type = docs.schema[id_col].dataType.simpleString()
    docs = bounded(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("tag", F.xxhash64("text"))
    last = docs.sparkSession.sparkContext.broadcast(_frequent(docs, shingle, fold))  # at most MOST_LAST numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _small(whole):
                n, sids, gids, prefixes = [], [], [], []
                for hashes in shingle_sets(batch.column(1), shingle, fold):
                    n.append(len(hashes))
                    if len(hashes):
                        prefix = _ordered(hashes, last.value)[: prefix_length(len(hashes), percent)]
                        sids.append(_key(hashes.tobytes()))
                        gids.append(_key(prefix.tobytes() + len(hashes).to_bytes(8, "little")))
                        prefixes.append(prefix.copy())
                    else:
                        sids.append((None, None))
                        gids.append((None, None))
                        prefixes.append(np.empty(0, dtype=np.uint64))
                names = [pa.array([x[k] for x in keys], pa.int64()) for keys in (sids, gids) for k in range(2)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *names, _lists(prefixes), batch.column(2)], names=["doc_id", "n", "sid", "sid_check", "gid", "gid_check", "prefix", "tag"])

    rows = staged(docs.mapInArrow(lean(run), f"doc_id {id_type}, n long, sid long, sid_check long, gid long, gid_check long, prefix array<long>, tag long"), "rows")
    told = rows.where("n > 0")
    renamed = {}
    while True:
        sets = staged(told.groupBy("sid").agg(F.min("n").alias("n"), F.min("gid").alias("gid"), F.min("tag").alias("tag"), F.min("doc_id").alias("least"), F.min("sid_check").alias("lo"), F.max("sid_check").alias("hi")), "sets")
        groups = staged(told.groupBy("gid").agg(F.min("n").alias("n"), F.min("sid").alias("rep"), F.first("prefix").alias("prefix"), F.min("gid_check").alias("lo"), F.max("gid_check").alias("hi")), "groups")
        of_sets, of_groups = _clashes(told, sets, "sid", "sid_check"), _clashes(told, groups, "gid", "gid_check")
        if not of_sets and not of_groups:
            break
        renamed |= of_sets
        told = _renamed(_renamed(told, "sid", "sid_check", of_sets), "gid", "gid_check", of_groups)
    extra = ["tag"] if classes else []
    placed_rows = staged(told.select("doc_id", "n", "sid", *extra), "documents")
    without = staged(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), *extra), "without")
    sets, groups = sets.drop("lo", "hi"), groups.drop("lo", "hi")
    dropped(rows)

    tokens = groups.select("gid", F.explode("prefix").alias("token"))
    shared = staged(tokens.groupBy("token").agg(F.count("*").alias("c"), F.min("gid").alias("a"), F.max("gid").alias("b")).where("c > 1"), "shared")
    twos = shared.where("c = 2").select("a", "b")
    lists = staged(tokens.join(checked(shared.where("c > 2").select("token", "c", F.col("a").alias("first"))), "token"), "lists")

    # own: the share of shingles in a group's prefix that no other prefix has
    listed_twice = twos.select(F.explode(F.array("a", "b")).alias("gid")).unionByName(lists.select("gid")).groupBy("gid").agg(F.count("*").alias("k"))
    sizes = staged(groups.join(listed_twice, "gid").select("gid", "n", ((F.size("prefix") - F.col("k")) / F.col("n")).alias("own")), "sizes")

    # first round: some groups of a list with the others, the representative of a group with its other members
    stars = lists.where("gid <> first").select(F.col("first").alias("a"), F.col("gid").alias("b"))
    # in a long list the centres are those with the fewest shingles of their own: near copies are nearest to what they are copies of
    of_long = lists.where(F.col("c") > LIST)
    draw = F.pmod(F.xxhash64("gid"), F.lit(CENTRES))
    ranked = of_long.join(sizes, "gid").withColumn("rank", F.struct("own", F.xxhash64("gid", F.lit(1)).alias("h")))
    centres = ranked.groupBy("token").agg(F.array_compact(F.array(*(F.min_by("gid", F.when(draw == k, F.col("rank"))) for k in range(CENTRES)))).alias("a")).select("token", F.explode("a").alias("a"))
    more_stars = of_long.join(centres, "token").where("a <> gid").select(F.least("a", "gid").alias("a"), F.greatest("a", "gid").alias("b"))
    first = staged(_survivors(twos.unionByName(stars).unionByName(more_stars).distinct(), groups, sizes, percent), "first")
    rep = lambda side, to: groups.select(F.col("gid").alias(side), F.col("rep").alias(to))
    between = first.join(rep("a", "ra"), "a").join(rep("b", "rb"), "b").select(F.least("ra", "rb").alias("x"), F.greatest("ra", "rb").alias("y"))
    inside = sets.join(groups.select("gid", "rep"), "gid").where("sid <> rep").select(F.col("rep").alias("x"), F.col("sid").alias("y"))
    tried = staged(between.unionByName(inside).distinct(), "tried")
    vectors = staged(_vectors(docs, sets, staged(tried.select(F.explode(F.array("x", "y")).alias("sid")).distinct(), "wanted"), shingle, fold, renamed), "vectors")
    links = staged(_verified(tried, vectors, percent), "links")
    found = staged(connected_components(links, "x", "y"), "components")

    # second round: what a list or a group still has in different components
    states = staged(sets.join(found.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "gid", "n", F.coalesce("component", "sid").alias("comp")), "states")
    group = staged(states.groupBy("gid").agg(F.count("*").alias("k"), F.min("comp").alias("lo"), F.max("comp").alias("hi")), "group")
    of = lambda side: group.select(F.col("gid").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("k", "lo", "hi")))
    apart = "not (lo_a = hi_a and lo_b = hi_b and lo_a = lo_b)"
    again = twos.join(of("a"), "a").join(of("b"), "b").where(f"(k_a > 1 or k_b > 1) and {apart}").select("a", "b")
    listed = lists.join(group, "gid")
    split = staged(listed.groupBy("token").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("token"), "split")
    open_lists = staged(listed.select("token", "c", "gid").join(checked(split), "token"), "open")
    short = open_lists.where(F.col("c") <= LIST)
    paired = short.select("token", F.col("gid").alias("a")).join(short.select("token", F.col("gid").alias("b")), "token").where("a < b").select("a", "b").distinct()
    paired = paired.join(of("a"), "a").join(of("b"), "b").where(apart).select("a", "b")
    own = group.where("lo <> hi").select(F.col("gid").alias("a"), F.col("gid").alias("b"))
    pairs = staged(_survivors(again.unionByName(paired).distinct(), groups, sizes, percent).unionByName(own), "pairs")
    members = lambda side, to: states.select(F.col("gid").alias(side), F.col("sid").alias(to), F.col("comp").alias(f"c{to}"))
    expanded = pairs.join(members("a", "x"), "a").join(members("b", "y"), "b").where("cx <> cy").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    long_lists = open_lists.where(F.col("c") > LIST).select("gid").distinct()
    hot = staged(states.join(long_lists, "gid", "left_semi").select("sid"), "hot")
    if not hot.isEmpty():
        by_parts = _by_parts(docs, sets, hot, states, shingle, percent, fold, renamed)
        gid_of = lambda side, to: states.select(F.col("sid").alias(side), F.col("gid").alias(to))
        located = staged(by_parts.join(gid_of("x", "a"), "x").join(gid_of("y", "b"), "y"), "by_parts")
        kept = _survivors(located.where("a <> b").select("a", "b").distinct(), groups, sizes, percent)
        expanded = expanded.unionByName(located.join(kept, ["a", "b"], "left_semi").select("x", "y"))
    left = staged(expanded.distinct().join(tried, ["x", "y"], "left_anti"), "left")
    if not left.isEmpty():
        more = staged(left.select(F.explode(F.array("x", "y")).alias("sid")).distinct().join(vectors.select("sid"), "sid", "left_anti"), "more")
        everything = vectors.unionByName(_vectors(docs, sets, more, shingle, fold, renamed))
        links = links.unionByName(_verified(left, everything, percent))
        found = staged(connected_components(links, "x", "y"), "components")

    # every step has one row on one side, read from a table, so that Spark may split the other side's hot keys
    own_comp = staged(sets.select("sid", "least").join(found.withColumnRenamed("node", "sid"), "sid"), "own_comp")
    least = staged(own_comp.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    linked = own_comp.join(checked(least), "component").select("sid", "component_id", F.col("component").alias("class"))
    alone = sets.join(found.select(F.col("node").alias("sid")), "sid", "left_anti").select("sid", F.col("least").alias("component_id"), F.col("sid").alias("class"))
    dropped(groups, lists, shared, vectors)
    known = staged(linked.unionByName(alone), "known")
    extra += ["class"] if classes else []
    return placed_rows.join(checked(known), "sid").select("doc_id", F.col("n").alias("n_shingles"), "component_id", *extra).unionByName(without, allowMissingColumns=True)

"""Connected components of an undirected graph by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import dropped, shuffled, staged

MOST_ROUNDS = 60
#: Edges up to which a round's joins may broadcast; larger rounds shuffle.
MOST_SENT = 65_536


def _star(edges: DataFrame, large: bool, many: bool) -> DataFrame:
    """One operation on edges (u > v): every node links its neighbours to the least node it sees.

    Large stars move neighbours greater than the node, small stars those below it and the node itself.  The least node is
    found by an aggregate that is combined before the shuffle, and joined back, so that Spark may split a hub's rows.
    many: the edges are too many to be broadcast, whatever the size of their files.
    """
    whole = shuffled if many else lambda df: df
    if large:
        seen = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = seen.groupBy("u").agg(F.min("v").alias("m"))
        joined = seen.join(whole(least), "u").where(F.col("v") > F.col("u"))
        moved = joined.select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        joined = edges.join(whole(least), "u")
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
    return moved.where(F.col("u") != F.col("v")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())


def connected_components(edges: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """node and component, the least node reachable, for every node that has an edge to another.

    Edges may repeat, run either way, be loops or have null ends; loops and nulls are left out.  The number of rounds
    grows with the logarithm of the number of nodes.  Each round is written to the shared folder.
    """
    ends = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = staged(ends.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    state = _state(now)
    for _ in range(MOST_ROUNDS):
        # a large star makes no more edges than it is given
        many = state[0] > MOST_SENT
        big = staged(_star(now, True, many), "large")
        small = staged(_star(big, False, many), "small")
        dropped(now, big)
        now, before, state = small, state, _state(small)
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    raise RuntimeError(f"components have not settled after {MOST_ROUNDS} rounds")

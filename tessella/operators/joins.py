"""Joins on keys that may hold a large part of all rows, and connected components by them. Workers load this without pandas."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import cut, drop

#: Fewer than this many keys are broadcast: those with more than this part of all rows, and more than so many rows.
HOT_KEYS, HOT_ROWS = 1024, 32
#: Over so many tasks the edges of one node are dealt.
SALTS = 8


def hot_join(left: DataFrame, right: DataFrame, key: str, count: str, total: int | None = None) -> DataFrame:
    """Inner join where ``right`` has one row for a key, and in ``count`` how many rows ``left`` has for it.

    Keys with more than a 1024th of all rows, of which there are fewer than 1024, are broadcast, so their rows stay where
    they are; the others are shuffled. Both frames are read twice and should be tables. ``total`` is an upper bound of the
    counts' sum, where it is known.
    """
    if total is None:
        total = right.agg(F.sum(count)).first()[0] or 0
    bound = max(HOT_ROWS, total // HOT_KEYS)
    hot, cold = right.where(F.col(count) > bound), right.where(F.col(count) <= bound)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return left.join(F.broadcast(hot), key).unionByName(rest)


def components(edges: DataFrame) -> DataFrame:
    """(a, b) to (node, root), root the least node: alternating large and small stars, cut after every round.

    Nodes are of any type that can be ordered. Isolated nodes do not occur. No group is collected: minima are aggregated on
    the map side, and the edges of a hub, which every large component has in the end, meet its minimum in ``SALTS`` tasks;
    beyond that AQE splits the join.
    """
    now = cut(edges.where("a <> b").selectExpr("greatest(a, b) as a", "least(a, b) as b").distinct(), "edges")
    seen = None
    while True:
        sides = now.unionByName(now.selectExpr("b as a", "a as b")).withColumn("salt", F.expr(f"cast(pmod(xxhash64(b), {SALTS}) as int)"))
        top = sides.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a", "least(a, m) as m", f"explode(sequence(0, {SALTS - 1})) as salt")
        large = sides.join(top, ["a", "salt"]).where("b > a").selectExpr("b as a", "m as b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        step = cut(large.join(low, "a").where("b <> m").selectExpr("b as a", "m as b").unionByName(low.selectExpr("a", "m as b")).distinct(), "edges")
        mark = step.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        drop(now)
        now = step
        if mark == seen:
            return now.selectExpr("a as node", "b as root").unionByName(now.selectExpr("b as node", "b as root").distinct())
        seen = mark

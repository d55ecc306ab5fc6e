"""Connected components of a graph of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from khata.llm.common import Written


def components(links: DataFrame, place: Written, name: str = "links") -> DataFrame:
    """(node, component) of every node in the links (a, b); the component is its smallest node.

    In a large star every node hands its larger neighbours to its smallest one, in a small star its smaller ones and itself.
    Both keep components and only lower the neighbours, until every node hangs on the smallest one of its component.
    Each round is written to the shared folder, which cuts the lineage; nothing but a row count and a check sum comes to
    the driver.  Neighbours are reduced to their minimum before the shuffle, so a hub costs no more than its links.
    """
    pairs = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, before, turn = place.table(pairs, f"{name}-0"), None, 0
    while before != (before := _state(now)):
        turn += 1
        after = place.table(_small_star(_large_star(now)), f"{name}-{turn}")
        place.drop(f"{name}-{turn - 1}")
        now = after
    member = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return member.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _large_star(pairs: DataFrame) -> DataFrame:
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    moved = pairs.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()

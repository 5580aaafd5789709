"""Connected components by contraction along hashed minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of `links` (a, b: long, not null).

    In each round every node moves to the neighbour (or itself) with the smallest
    hash; links between the places moved to are the next round's links. A star
    collapses in two rounds, and in a chain a constant share of the nodes goes
    each round, so few rounds are needed and each is smaller than the one before.
    Only minima and joins are used: no node's neighbours are gathered in a row.
    """
    links = cut(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    place = cut(links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("at", F.col("node")))
    while not links.isEmpty():
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.lit(17), c).alias("h"), F.col(c).alias("n"))
        move = cut(both.groupBy("a").agg(F.min(F.least(rank("a"), rank("b")))["n"].alias("to")))
        first = links.join(move.withColumnRenamed("to", "x"), "a").select("b", "x")
        second = first.join(move.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
        place = cut(place.join(move.withColumnRenamed("a", "at"), "at", "left").select("node", F.coalesce("to", "at").alias("at")))
        links = cut(second.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    smallest = place.groupBy("at").agg(F.min("node").alias("component"))
    return place.join(smallest, "at").select("node", "component")

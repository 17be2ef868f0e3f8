"""Connected components of a graph of links, by alternating stars in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Tables


#: Rounds grow with the logarithm of the graph; so many are never needed.
MAX_ROUNDS = 200


def components(links: DataFrame, tables: Tables, name: str) -> DataFrame:
    """node, label: for every node of the links (a, b) the smallest node that it reaches.

    Large stars hang each node's larger neighbours on its smallest one, small stars do so with its
    smaller neighbours, until nothing changes; the rounds grow with the logarithm of the graph. Minima
    are combined before the shuffle and joins on a hot node may be split, so no node's neighbours
    meet in one task. A graph that is still changing after ``MAX_ROUNDS`` rounds raises an error.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    stars, seen = tables.keep(links, f"{name}-0"), None
    for turn in range(1, MAX_ROUNDS + 1):
        found = stars.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if found == seen or not found["n"]:
            break
        seen = found
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = tables.keep(small.unionByName(smallest.select("u", F.col("m").alias("v"))).distinct(), f"{name}-{turn}")
        tables.drop(f"{name}-{turn - 1}")
    else:
        raise RuntimeError(f"components still change after {MAX_ROUNDS} rounds")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())

"""Chains that a pass over an order grows: each item that none took begins one and takes the first that follows it and is left, and so on."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .lineage import stored


def greedy_chains(edges: DataFrame) -> DataFrame:
    """edges (u, v, pu, pv): v can follow u, and stands later in the order, which pu and pv give and no two items share. Returns
    (item, head) with the place of the head of its chain for every item of an edge, as the pass leaves it.

    Every item offers itself to the first item behind it that no chain with an earlier head holds, with its own head's
    place, and an item is held by the earliest head that offers. Nothing disturbs the chain of the first head, so it
    is settled in as many rounds as it is long, then those that depend on it; chains that don't touch settle together."""
    e = stored(edges.select("u", "v", "pu", "pv").distinct())
    items = stored(e.select(F.col("u").alias("item"), F.col("pu").alias("place")).unionByName(e.select(F.col("v").alias("item"), F.col("pv").alias("place"))).distinct())
    offers = e.select(F.col("u").alias("u"), F.col("v").alias("v"), F.col("pu").alias("head")).limit(0)
    while True:
        held = offers.groupBy("v").agg(F.min("head").alias("holder"))
        heads = items.join(held.withColumnRenamed("v", "item"), "item", "left").select("item", F.coalesce("holder", "place").alias("head"))
        open_ = e.join(heads.withColumnRenamed("item", "u"), "u").join(held, "v", "left").where("holder is null or head <= holder")
        new = stored(open_.groupBy("u").agg(F.min_by("v", "pv").alias("v"), F.first("head").alias("head")))
        if new.join(offers, ["u", "v", "head"], "left_anti").isEmpty() and offers.join(new, ["u", "v", "head"], "left_anti").isEmpty():
            return heads
        offers = new


def components(pairs: DataFrame, rounds: int = 64) -> DataFrame:
    """pairs (a, b) -> (item, part): the smallest item that can be reached, for every item of a pair. In each round an item takes the
    smallest label of its neighbours and itself, and then the label of that label, so long rows of items take few rounds."""
    e = stored(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(e.groupBy(F.col("a").alias("item")).agg(F.least(F.min("b"), F.first("a")).alias("part")))
    for _ in range(rounds):
        near = e.join(labels.withColumnRenamed("item", "b"), "b").groupBy(F.col("a").alias("item")).agg(F.min("part").alias("near"))
        low = labels.join(near, "item").select("item", F.least("part", "near").alias("part"), F.col("part").alias("was"))
        jump = labels.select(F.col("item").alias("part"), F.col("part").alias("then"))
        new = stored(low.join(jump, "part", "left").select("item", F.least("part", F.coalesce("then", "part")).alias("part"), "was"))
        labels = new.select("item", "part")
        if new.where("part <> was").isEmpty():
            return labels
    raise RuntimeError(f"components didn't settle in {rounds} rounds")


def turns(items: DataFrame, key: str, order: str, pairs: DataFrame) -> DataFrame:
    """items that stand in a pair, with part (what can have to do with each other, by pairs) and turn: 1 and so on within a part, in the order.
    A pass over the order gives the same if all items of one turn are worked on together, for they have nothing to do with each other."""
    from pyspark.sql.window import Window

    of = components(pairs).withColumnRenamed("item", key)
    return items.join(of, key).withColumn("turn", F.row_number().over(Window.partitionBy("part").orderBy(order)))

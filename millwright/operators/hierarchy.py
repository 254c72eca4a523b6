"""Trees given by parent keys: levels, paths, ancestors, explosion of quantities.

Levels are walked by joins of a frontier, one join for each level; every frontier is written before the next one, so no
join is done twice. A path keeps a cycle from going on. A tree of n levels has n - 1 joins, whatever its width.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .lineage import stored


def _walk(edges: DataFrame, first: Column, then: Column, most: int, spread: bool = False) -> list[DataFrame]:
    """edges: __k, __p and __q. Frontiers with __k, level, path and value: `first` at roots, `then` (of value and __q) below. `spread` frontiers
    are joined by sort and shuffle whatever their size."""
    level = stored(edges.where("__p is null").select("__k", F.lit(0).alias("level"), F.array("__k").alias("path"), first.alias("value")))
    out, below = [level], edges.where("__p is not null")
    for n in range(1, most):
        above = level.select(F.col("__k").alias("__p"), "path", "value")
        children = below.join(above.hint("merge") if spread else above, "__p").where(~F.array_contains("path", F.col("__k")))
        level = stored(children.select("__k", F.lit(n).alias("level"), F.concat("path", F.array("__k")).alias("path"), then.alias("value")))
        if level.isEmpty():
            return out
        out.append(level)
    raise ValueError(f"more than {most} levels")


def tree(df: DataFrame, key: str, parent: str, most: int = 64) -> DataFrame:
    """key, level (0 for roots) and path (keys from the root) of every node that a root reaches."""
    edges = df.select(F.col(key).alias("__k"), F.col(parent).alias("__p"))
    levels = _walk(edges, F.lit(0), F.lit(0), most)
    return reduce(DataFrame.unionByName, levels).select(F.col("__k").alias(key), "level", "path")


def level_columns(nodes: DataFrame, key: str, levels: int | None = None) -> DataFrame:
    """Of tree(): key and l1, l2, ... up to the deepest level, or to a given one, null below a node's own."""
    if levels is None:
        levels = nodes.agg(F.coalesce(F.max("level"), F.lit(0))).first()[0] + 1
    return nodes.select(key, *[F.get("path", F.lit(k)).alias(f"l{k + 1}") for k in range(levels)])


def explode_quantities(df: DataFrame, key: str, parent: str, qty: str, most: int = 64) -> DataFrame:
    """key and needed: the product of quantities (whole numbers) from the root to every node."""
    edges = df.select(F.col(key).alias("__k"), F.col(parent).alias("__p"), F.col(qty).cast("long").alias("__q"))
    levels = _walk(edges, F.col("__q"), F.col("value") * F.col("__q"), most)
    return reduce(DataFrame.unionByName, levels).select(F.col("__k").alias(key), F.col("value").alias("needed"))


#: Characters that a row of nested JSON may have before its node's children go to rows of their own.
MOST_TREE = 1 << 24


def nest(df: DataFrame, key: str, parent: str, name: str, most: int = 64) -> DataFrame:
    """key, part and tree: each root with all below it as nested JSON {key, name, children}, built from the deepest level up, in part 0.

    Where the children of a node have more than MOST_TREE characters, they are in rows of their own, of about so many each: parts 1 to n of that
    node, each nested JSON of the node with a run of its children by key; above it stands {key, name, parts: n}. So no row
    grows with the tree, and every node is in one row. Levels are joined by sort and shuffle, never sent to the driver for a broadcast."""
    edges = df.select(F.col(key).alias("__k"), F.col(parent).alias("__p"), F.lit(0).alias("__q"))
    names = df.select(F.col(key).alias("__k"), F.col(name).cast("string").alias("__name"))
    plain = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.char_length(F.to_json(F.array(c))) - 2)
    held, out = None, []
    for level in reversed(_walk(edges, F.lit(0), F.lit(0), most, spread=True)):
        rows = level.select("__k", F.get("path", F.size("path") - 2).alias("__p")).join(names.hint("merge"), "__k")
        start = F.concat(F.lit('{"key":'), plain("__k"), F.lit(',"name":'), plain("__name"))
        nested = lambda inner: F.concat(start, F.lit(',"children":['), inner, F.lit("]}"))  # noqa: B023, E731
        if held is not None:
            runs = rows.join(held.where("__n > 1").hint("merge"), "__k")
            out.append(stored(runs.select("__k", (F.col("__run") + 1).cast("int").alias("part"), nested(F.col("inner")).alias("tree"))))
            rows = rows.join(held.where("__run = 0").withColumn("inner", F.when(F.col("__n") == 1, F.col("inner"))).hint("merge"), "__k", "left")
        else:
            rows = rows.withColumns({"__n": F.lit(1).cast("long"), "inner": F.lit(None).cast("string")})
        own = F.when(F.col("__n") > 1, F.concat(start, F.lit(',"parts":'), F.col("__n").cast("string"), F.lit("}"))).otherwise(nested(F.coalesce("inner", F.lit(""))))
        rows = stored(rows.select("__k", "__p", own.alias("tree")))
        before = F.sum(F.char_length("tree")).over(Window.partitionBy("__p").orderBy("__k").rowsBetween(Window.unboundedPreceding, -1))
        runs = rows.where("__p is not null").withColumn("__run", F.floor(F.coalesce(before, F.lit(0)) / MOST_TREE))
        inner = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__k", "tree"))), lambda c: c["tree"]), ",").alias("inner")
        runs = runs.groupBy("__p", "__run").agg(inner)
        # runs may leave numbers out where one child is longer than a run
        runs = runs.withColumns({"__run": F.row_number().over(Window.partitionBy("__p").orderBy("__run")).cast("long") - 1, "__n": F.count("*").over(Window.partitionBy("__p"))})
        held = stored(runs.select(F.col("__p").alias("__k"), "__run", "__n", "inner"))
    out.append(rows.select("__k", F.lit(0).alias("part"), "tree"))
    return reduce(DataFrame.unionByName, out).select(F.col("__k").alias(key), "part", "tree")


def roll_up(df: DataFrame, key: str, parent: str, value: str) -> DataFrame:
    """key and total: the sum of the values of a node and all below it."""
    paths = tree(df, key, parent).join(df.select(key, value), key)
    return paths.select(F.explode("path").alias(key), value).groupBy(key).agg(F.sum(value).alias("total"))

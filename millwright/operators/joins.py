"""Joins: anti, marked, disjunctive, by radius, of two states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Bytes up to which a side is broadcast, by Spark's own estimate; Spark's setting holds where it is lower.


def anti(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    return df.join(other, on, "left_anti")


def marked(df: DataFrame, keys: DataFrame, on: str, mark: str) -> DataFrame:
    """Adds whether the key is among `keys`, for predicates that an anti-join can't say."""
    return df.join(keys.select(on).distinct().withColumn(mark, F.lit(True)), on, "left").withColumn(mark, F.coalesce(F.col(mark), F.lit(False)))


def per_value(df: DataFrame, col: str, **made: Column) -> DataFrame:
    """df with columns that are costly to make of one column: they are made once for each of its values."""
    values = df.select(col).distinct().select(F.col(col).alias("__v"), *(c.alias(n) for n, c in made.items()))
    return df.join(values, F.col(col).eqNullSafe(F.col("__v"))).drop("__v")


def or_join(left: DataFrame, right: DataFrame, conditions: list[tuple[str, str]], keep: list[str]) -> DataFrame:
    """Pairs for which any of the equalities (left column, right column) holds: a union of equi-joins, no nested loop."""
    out = None
    for a, b in conditions:
        some = left.join(right, F.col(a) == F.col(b)).select(*keep)
        out = some if out is None else out.unionByName(some)
    return out.dropDuplicates()


def radius_pairs(points: DataFrame, others: DataFrame, group: str, radius: float) -> DataFrame:
    """Pairs of (pid, px, py) and (oid, ox, oy) of one group within the radius: cells of that size, each point looks into those that its square meets.

    Cells are found by rounded sums and quotients, which never change the order of two numbers: so the cell of what is in reach lies between
    those of the ends, however numbers are rounded."""
    reach = F.lit(radius * (1 + 1e-12))  # a rounded difference can be the radius where the true one is more
    cell = lambda c: F.floor(c / radius)
    span = lambda c: F.explode(F.sequence(cell(F.col(c) - reach), cell(F.col(c) + reach)))
    near = points.withColumn("__cx", span("px")).withColumn("__cy", span("py"))
    cells = others.withColumns({"__cx": cell(F.col("ox")), "__cy": cell(F.col("oy"))})
    dx, dy = F.col("px") - F.col("ox"), F.col("py") - F.col("oy")
    # the distance as SQL has it; squares first drop what lies clearly outside
    pairs = near.join(cells, [group, "__cx", "__cy"]).where(dx * dx + dy * dy <= radius * radius * (1 + 1e-9))
    return pairs.withColumn("dist", F.sqrt(dx * dx + dy * dy)).where(F.col("dist") <= radius).drop("__cx", "__cy")


def compare(left: DataFrame, right: DataFrame, key: str, cols: list[str], changes_only: bool = False) -> DataFrame:
    """Added, Removed, Changed or Same for each key of two states, with old and new values."""
    a = left.select(F.col(key), *[F.col(c).alias(f"old_{c}") for c in cols], F.lit(True).alias("__a"))
    b = right.select(F.col(key), *[F.col(c).alias(f"new_{c}") for c in cols], F.lit(True).alias("__b"))
    same: Column = F.lit(True)
    for c in cols:
        same = same & F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    kind = F.when(F.col("__a").isNull(), "Added").when(F.col("__b").isNull(), "Removed").when(same, "Same").otherwise("Changed")
    out = a.join(b, key, "full").withColumn("change_type", kind).drop("__a", "__b")
    return out.where("change_type <> 'Same'") if changes_only else out


def dense(df: DataFrame, rows: str, cols: str, value: Column) -> DataFrame:
    """Every row key with every column key, 0 where there is nothing. The keys of a cross-tab are few by their nature."""
    counts = df.groupBy(rows, cols).agg(value.alias("value"))
    values = F.collect_set(cols).alias("__all")
    every = df.select(rows).distinct().join(F.broadcast(df.agg(values)), how="cross").select(rows, F.explode("__all").alias(cols))
    return every.join(counts, [rows, cols], "left").withColumn("value", F.coalesce("value", F.lit(0)))

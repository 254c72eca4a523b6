"""Aggregations and windows that reports share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .lineage import stored


def sum_or_zero(c: str | Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0))


def count_if(condition: Column) -> Column:
    return F.count_if(condition)


def safe_rate(num: Column, den: Column, digits: int = 4) -> Column:
    """0 where there is nothing to divide by."""
    return F.when(den > 0, F.round(num / den, digits)).otherwise(F.lit(0.0))


def pivot_sum(df: DataFrame, keys: list[str], col: str, value: str, values: list[str], total: str = "total") -> DataFrame:
    """A column for each of `values`, 0 where absent, and their sum over all rows."""
    sums = [F.sum(F.when(F.col(col) == v, F.col(value)).otherwise(0)).alias(v.lower().replace(" ", "_")) for v in values]
    return df.groupBy(*keys).agg(*sums, F.sum(value).alias(total))


def running_balance(df: DataFrame, keys: list[str], order: list, signed: str, out: str = "balance") -> DataFrame:
    """The sum of all rows of the key up to each one; `order` must be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumns({"row_no": F.row_number().over(w), out: F.sum(signed).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))})


def latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    from .filters import first_of_each

    return first_of_each(df, keys, order)


def allocate_milestones(df: DataFrame, keys: list[str], order: str, qty: str, pct: str, is_last: str) -> DataFrame:
    """Quantities by percentages, rounded to cents, never more than is left; a last milestone takes the rest.

    With r the rounded share (all of qty for a last one) and S its running sum, the allocation is
    least(qty, S) - least(qty, S before), so one window does.
    """
    share = F.when(F.col(is_last) == 1, F.col(qty)).otherwise(F.round(F.col(qty) * F.col(pct) / 100, 2)).cast("decimal(18,2)")
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = F.sum("__r").over(w)
    df = df.withColumn("__r", share).withColumn("__s", after)
    alloc = F.least(F.col(qty), F.col("__s")) - F.least(F.col(qty), F.col("__s") - F.col("__r"))
    return df.withColumn("allocated", alloc.cast("decimal(18,2)")).drop("__r", "__s")


def islands(df: DataFrame, keys: list[str], order: list, breaks: Column, out: str = "island") -> DataFrame:
    """Numbers runs of rows; `breaks` says where a row begins a new one (null: at the first)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__b", F.when(breaks, 1).otherwise(0)).withColumn(out, F.sum("__b").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__b")


def number_rows(df: DataFrame, leading: str, order: list[str]) -> DataFrame:
    """df with number: 1, 2, ... over all rows in `order`, which begins with `leading`. Ranges of the whole order are sorted by a task each and
    stored once with a row's place in its range, which the counts of the ranges before move; rows of one leading value may lie in several."""
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    rows = stored(placed.select(*[F.col(f"`{c}`") for c in df.columns], F.shiftright("__id", 33).cast("int").alias("__part"), F.col("__id").bitwiseAND((1 << 33) - 1).alias("__place")))
    counts = {r["__part"]: r["count"] for r in rows.groupBy("__part").count().collect()}  # as many as ranges
    before, total = [], 0
    for k in range(max(counts, default=0) + 1):
        before.append(total)
        total += counts.get(k, 0)
    return rows.withColumn("number", (F.get(F.lit(before), F.col("__part")) + F.col("__place") + 1).cast("long")).drop("__part", "__place")

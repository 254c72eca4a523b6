"""Row filters: null defaults, optional parameters, searches, date windows and buckets."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F


def active(df: DataFrame, col: str) -> DataFrame:
    """Rows whose flag is 1; a null flag means active."""
    return df.where(F.coalesce(F.col(col), F.lit(1)) == 1)


def optional(df: DataFrame, **equal) -> DataFrame:
    """A predicate for each argument that isn't None."""
    for col, value in equal.items():
        if value is not None:
            df = df.where(F.col(col) == value)
    return df


def zero_means_all(df: DataFrame, col: str, value: int) -> DataFrame:
    """0 keeps every row but those whose column is null; any other value is compared."""
    return df.where(F.col(col).isNotNull() if value == 0 else F.col(col) == value)


def all_sentinel(df: DataFrame, **equal: str) -> DataFrame:
    """'All' keeps every row."""
    return optional(df, **{c: None if v == "All" else v for c, v in equal.items()})


def matches(term: str, cols: list[str]) -> Column:
    """Any of the columns holds the term, whatever the case; null columns are empty."""
    return reduce(or_, [F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(term.lower())) for c in cols])


def search(df: DataFrame, term: str, cols: list[str], limit: int | None = None, order: list[str] | None = None) -> DataFrame:
    df = df.where(matches(term, cols))
    df = df.orderBy(*[F.col(c).asc_nulls_last() for c in order]) if order else df
    return df.limit(limit) if limit else df


def lookback(df: DataFrame, ts: str, as_of: Column, days: int = 30) -> DataFrame:
    return df.where((F.col(ts) >= as_of - F.make_interval(days=F.lit(days))) & (F.col(ts) <= as_of))


def day_bucket(due: Column, done: Column, as_of: Column) -> Column:
    """today; overdue if not done; upcoming in the next 7 days, the last one included; else null."""
    days = F.datediff(due, as_of)
    return F.when(days == 0, "today").when((days < 0) & ~done, "overdue").when((days > 0) & (days <= 7), "upcoming")


def first_of_each(df: DataFrame, keys: list[str], order: list, n: int = 1) -> DataFrame:
    """The first n rows of each group; `order` must be total."""
    from pyspark.sql.window import Window

    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__rn") <= n).drop("__rn")

"""New states of tables as DataFrames: upserts, replacements, differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def upsert(base: DataFrame, incoming: DataFrame, key: str, cols: list[str], order: str | None = None) -> DataFrame:
    """Incoming values replace stored ones unless they are null or empty; new keys are added. Of several incoming rows of a key the
    last in `order` counts (without one, or of equal ones, that of the greatest values), so no key gets a second row; stored keys are unique."""
    row = F.struct(*[F.col(c).alias(f"__{c}") for c in cols])
    last = F.max(F.struct(F.col(order).alias("o"), row.alias("r")) if order else F.struct(row.alias("r")))
    new = incoming.groupBy(key).agg(last.alias("__last")).select(key, "__last.r.*")
    keep = lambda c: F.coalesce(F.when(F.col(f"__{c}").cast("string") != "", F.col(f"__{c}")), F.col(c)).alias(c)
    return base.select(key, *cols).join(new, key, "full").select(key, *[keep(c) for c in cols])


def replace_keys(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of the keys in `new` are replaced by those of `new`."""
    return base.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def diff_rows(before: DataFrame, after: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """A row for each column that differs: key, column, old, new (as text)."""
    melt = lambda df, out: df.select(key, *[F.col(c).cast("string").alias(c) for c in cols]).unpivot([key], cols, "column_name", out)
    both = melt(before, "old_value").join(melt(after, "new_value"), [key, "column_name"])
    return both.where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def actions(old: DataFrame, new: DataFrame, key: str, value: str, flag: str) -> DataFrame:
    """Added, Updated or Toggled for each key of `new` that is new or differs."""
    o = old.select(key, F.col(value).alias("__v"), F.col(flag).alias("__f"), F.lit(True).alias("__old"))
    kind = F.when(F.col("__old").isNull(), "Added").when(~F.col(flag).eqNullSafe(F.col("__f")), "Toggled").when(~F.col(value).eqNullSafe(F.col("__v")), "Updated")
    return new.join(o, key, "left").withColumn("action", kind).where("action is not null").select(key, "action")

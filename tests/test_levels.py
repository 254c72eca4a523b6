"""Levels of a tree as columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from millwright import registry


def test_level_columns_are_those_of_its_sql_and_all_levels_stay(spark, tmp_path):
    for n, levels in ((4, 2), (4000, 7)):  # five children each: keys 781 to 3905 stand on the sixth level below the root
        spark.range(n).select(F.col("id").alias("p_partkey"), F.lit("x").alias("p_name"), F.lit(1).alias("p_size")).write.parquet(f"{tmp_path}/{n}/part.parquet")
        six = registry.queries()["level_columns"](spark, f"{tmp_path}/{n}")
        every = registry.queries()["level_columns_all"](spark, f"{tmp_path}/{n}")
        assert six.columns == ["part_key", *(f"l{k}" for k in range(1, 7))] and every.columns == ["part_key", *(f"l{k}" for k in range(1, levels + 1))]
        for df, most in ((six, 6), (every, levels)):
            for row in df.collect():
                path = [row.part_key]
                while path[0]:
                    path.insert(0, (path[0] - 1) // 5)
                assert list(row)[1:] == (path + [None] * most)[:most]

"""What is stored and looked at grows with the rows, not with their pairs or with the passes over them."""

import pytest
from pyspark.sql import functions as F

from millwright.operators import aggregates as A, boxes as B, joins as J


@pytest.fixture()
def kept(monkeypatch):
    """Rows of each table that an operator stores."""
    rows = []

    def on(module):
        real = module.stored
        monkeypatch.setattr(module, "stored", lambda df: rows.append((out := real(df)).count()) or out)
        return rows

    return on


def test_claims_list_a_few_boxes_for_each_point(spark, kept):
    points = spark.range(12).select(F.lit(1).alias("g"), F.col("id").alias("p"), F.col("id").alias("rank"), F.col("id").cast("double").alias("px"), F.lit(0.0).alias("py"))
    boxes = spark.range(300).select(F.lit(1).alias("g"), F.col("id").alias("b"), *[(F.col("id") % 30 + k).cast("double").alias(c) for k, c in ((0, "x1"), (0, "y1"), (1, "x2"), (1, "y2"))], F.lit(0.0).alias("extra"), F.lit("x").alias("tag"))
    rows = kept(B)
    got = B.claim_nearest(points, boxes, "g", "p", "b", "rank", -80.0, keep=["tag"]).collect()
    assert len({r.b for r in got}) == len(got) == 12 and {r.tag for r in got} == {"x"}
    assert max(rows) == 300  # the boxes; before, 3,600 pairs


def test_rows_are_numbered_by_any_order_and_a_costly_column_is_made_once_a_value(spark):
    df = spark.createDataFrame([("x" if k % 3 else chr(97 + k % 7), k * 37 % 101) for k in range(101)], "s string, n int")
    rows = A.number_rows(df, "s", ["s", "n"]).collect()  # most rows share one leading value, which is no number
    assert [(r.s, r.n) for r in sorted(rows, key=lambda r: r.number)] == sorted((r.s, r.n) for r in rows) and sorted(r.number for r in rows) == list(range(1, 102))
    df = spark.createDataFrame([(k, None if k % 5 == 0 else "ab"[k % 2]) for k in range(40)], "k int, t string")
    got = {r.k: r.up for r in J.per_value(df, "t", up=F.coalesce(F.upper("t"), F.lit("-"))).collect()}
    assert got == {k: "-" if k % 5 == 0 else "AB"[k % 2] for k in range(40)}


def test_met_boxes_bring_their_columns_and_small_ones_are_in_few_cells(spark):
    boxes = spark.createDataFrame([(k, 1, float(k * 40 % 900), float(k * 70 % 500), f"t{k}") for k in range(60)] + [(99, 1, -3000.0, 100.0, "wide")], "i int, g int, x1 double, y1 double, t string")
    wide = F.when(F.col("t") == "wide", 6000.0).otherwise(60.0)
    boxes = boxes.withColumns({"x2": F.col("x1") + wide, "y2": F.col("y1") + 16})
    rows = [r.asDict() for r in boxes.collect()]
    meet = lambda a, b: a["x1"] <= b["x2"] and b["x1"] <= a["x2"] and a["y1"] <= b["y2"] and b["y1"] <= a["y2"]
    want = {(a["i"], b["i"]) for a in rows for b in rows if a["i"] < b["i"] and meet(a, b)}
    got = B.overlapping(boxes, "g", "i", keep=["t"]).collect()
    assert {(min(r.a, r.b), max(r.a, r.b)) for r in got} == want and len(got) == len(want) > 2
    name = {r["i"]: r["t"] for r in rows}
    assert all(r.a_t == name[r.a] and r.b_t == name[r.b] for r in got)

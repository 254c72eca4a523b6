"""Greedy passes against loops, value matching, numbering, files and streams."""

import numpy as np
from pyspark.sql import functions as F

from millwright.functions import text as X
from millwright.operators import aggregates as A, claims as C, hierarchy as H
from millwright.sources import files
from millwright.streaming import mail


def test_greedy_keep_is_the_sequential_pass(spark):
    rng = np.random.default_rng(2)
    n, pairs = 60, {(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, 60, (120, 2)) if a != b}
    kept = []
    for i in range(n):
        if not any((j, i) in pairs for j in kept):
            kept.append(i)
    items, conflicts = spark.range(n), spark.createDataFrame(sorted(pairs) + [(3, 3)], "better long, worse long")
    assert sorted(r.id for r in C.greedy_keep(items, "id", conflicts).collect()) == kept
    assert C.greedy_keep(items, "id", conflicts.limit(0)).count() == n


def test_points_kept_apart_are_those_of_the_pass_over_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(i, i % 2, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(rng.integers(0, 60, 500), rng.integers(-30, 30, 500), rng.integers(0, 2, 500)))]
    near = lambda a, b: a[1] == b[1] and (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 <= 9
    want = []
    for r in sorted(rows, key=lambda r: (r[4], r[3], r[0])):
        if not any(near(r, k) for k in want):
            want.append(r)
    sizes, real = [], C.stored
    monkeypatch.setattr(C, "stored", lambda df: sizes.append((out := real(df)).count()) or out)
    df = spark.createDataFrame([*rows, (900, 0, None, 1.0, 0.0), (901, 0, None, 1.0, 0.0), (902, 0, float("nan"), 1.0, 0.0)], "k long, g int, x double, y double, c double")
    for tile in (2, 16):
        monkeypatch.setattr(C, "TILE", tile)
        assert sorted(r.k for r in C.greedy_apart(df, ["g"], "k", "x", "y", ["c", "y"], 3.0).collect()) == sorted([r[0] for r in want] + [900, 901, 902])
    assert max(sizes) <= 500 and len(sizes) > 4  # places, never the pairs in reach
    assert C.greedy_apart(df.limit(0), ["g"], "k", "x", "y", ["c", "y"], 3.0).count() == 0


def test_exclusive_claim_is_the_sequential_pass(spark):
    rng = np.random.default_rng(4)
    rows = [(a, b, float(s)) for a in range(25) for b in range(20) if (s := int(rng.integers(0, 60))) < 20]
    for order in (["s"], ["l", "s"]):
        left, right, want = set(), set(), set()
        for a, b, s in sorted(rows, key=lambda r: ((r[2], r[0], r[1]) if order == ["s"] else (r[0], r[2], r[1]))):
            if a not in left and b not in right:
                left.add(a)
                right.add(b)
                want.add((a, b))
        df = spark.createDataFrame(rows, "l long, r long, s double")
        assert {(r.l, r.r) for r in C.exclusive_claim(df, "l", "r", order).collect()} == want
        assert C.exclusive_claim(df.limit(0), "l", "r", order).count() == 0


def test_greedy_pairs_are_those_of_the_pass_in_batches_of_any_size(spark):
    rng = np.random.default_rng(8)
    rows = [(int(k), i % 2, int(v)) for i, (k, v) in enumerate(zip(rng.permutation(90), rng.integers(0, 60, 90)))]
    taken, want = set(), set()
    for a, b in sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and 2 < abs(a[2] - b[2]) < 9):
        if not {a, b} & taken:
            taken |= {a, b}
            want.add((a, b))

    def pairs(k):
        a, b = (k.select("g", F.col("k").alias(n), F.col("v").alias(f"v{n}")) for n in ("lo", "hi"))
        return a.join(b, "g").where("lo < hi and abs(vlo - vhi) > 2 and abs(vlo - vhi) < 9").select("lo", "hi")

    df = spark.createDataFrame(rows, "k int, g int, v int")
    for batch in (15, 1000):
        assert {(r.lo, r.hi) for r in C.greedy_pairs(df, "g", "k", pairs, batch).collect()} == want and len(want) > 20
    assert C.greedy_pairs(df.limit(0), "g", "k", pairs).count() == 0


def test_values(spark):
    rows = [("Ø64 mm", "DIA64", True), ("(8)", "8", True), ("0.20", ".20", True), ("63", "Ø63.1", True), ("R72.55 TYP", "72.5", True), ("12", "120", False), ("", "", False), (None, "1", False), ("NO_DIMENSION", "NO_DIMENSION", False), ("10,5°", "10.5DEG", True), ("2 × 45", "2X45", True)]
    df = spark.createDataFrame(rows, "d string, e string, want boolean")
    assert all(r.got == r.want for r in df.select("want", X.value_match(F.col("d"), F.col("e")).alias("got")).collect())


def test_numbers_and_products(spark):
    df = spark.createDataFrame([(i * 7 % 100, i) for i in range(500)], "k long, n long")
    rows = A.number_rows(df, "k", ["k", "n"]).orderBy("number").collect()
    assert [r.number for r in rows] == list(range(1, 501)) and [(r.k, r.n) for r in rows] == sorted((r.k, r.n) for r in rows)
    assert A.number_rows(df.limit(0), "k", ["k"]).count() == 0
    bom = spark.createDataFrame([(1, None, 2), (2, 1, 0), (3, 1, -3), (4, 3, 1 << 40)], "k long, p long, q long")
    assert {r.k: r.needed for r in H.explode_quantities(bom, "k", "p", "q").collect()} == {1: 2, 2: 0, 3: -6, 4: -6 << 40}


def test_nested_tree(spark):
    import json

    df = spark.createDataFrame([(1, None, 'a"b'), (2, 1, None), (3, 1, "c"), (4, 3, "d"), (9, None, "e")], "k long, p long, n string")
    got = {r.k: json.loads(r.tree) for r in H.nest(df, "k", "p", "n").collect()}
    assert got[9] == {"key": 9, "name": "e", "children": []}
    assert got[1] == {"key": 1, "name": 'a"b', "children": [{"key": 2, "name": None, "children": []}, {"key": 3, "name": "c", "children": [{"key": 4, "name": "d", "children": []}]}]}


def test_large_trees_are_in_rows_of_bounded_length(spark, monkeypatch):
    import json

    df = spark.createDataFrame([(k, None if k == 0 else (k - 1) // 40 if k < 900 else 0, f"n{k}") for k in range(1100)], "k long, p long, n string")
    whole = json.loads(H.nest(df, "k", "p", "n").collect()[0].tree)
    monkeypatch.setattr(H, "MOST_TREE", 400)
    rows = {(r.k, r.part): r.tree for r in H.nest(df, "k", "p", "n").collect()}
    assert 20 < len(rows) and max(map(len, rows.values())) < 1200  # before, one row of all

    def back(node):
        if "parts" not in node:
            return {**node, "children": [back(c) for c in node["children"]]}
        runs = [json.loads(rows.pop((node["key"], n + 1))) for n in range(node["parts"])]
        return {"key": node["key"], "name": node["name"], "children": [back(c) for r in runs for c in r["children"]]}

    assert back(json.loads(rows.pop((0, 0)))) == whole and not rows


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a,"b"\nc', [1, 2]), (2, None, None)], "k long, t string, l array<int>")
    files.write_csv(df.withColumn("secret", F.lit("x")), f"{tmp_path}/csv", hidden=("secret",))
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{tmp_path}/csv").orderBy("k").collect()
    assert back[0].asDict() == {"k": "1", "t": 'a,"b"\nc', "l": "[1,2]"} and back[1].t is None
    assert [r.kind for r in files.members(spark.createDataFrame([("p", bytearray(b"no zip"))], "path string, content binary")).collect()] == ["broken"]
    assert files.inventory(spark, str(tmp_path), "*.csv").count() >= 1


def test_streams_read_what_is_new(spark, tmp_path):
    one = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 00:10:00"), ("a", "2024-01-01 00:20:00")], "message_id string, t string").select("message_id", F.col("t").cast("timestamp").alias("received"))
    one.write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(one.schema).parquet(f"{tmp_path}/in")
    for _ in range(2):
        mail.run(mail.deduplicated(stream()), str(tmp_path))
    assert sorted(r.message_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b"]
    one.limit(1).select(F.lit("c").alias("message_id"), "received").write.mode("append").parquet(f"{tmp_path}/in")
    mail.run(mail.deduplicated(stream()), str(tmp_path))
    assert sorted(r.message_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b", "c"]

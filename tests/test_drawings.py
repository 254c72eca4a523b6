"""Joins of boxes, claims of the nearest, reading order: against loops on generated marks."""

import math

import numpy as np
from pyspark.sql import functions as F

from millwright.operators import boxes as B, reading as R


def test_boxes_of_all_sizes_meet_once(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(220):
        w, h = (float(2 ** rng.uniform(0, 13)) for _ in range(2))
        x, y = (float(v) for v in rng.uniform(-3000, 3000, 2))
        rows.append((i, int(rng.integers(2)), round(x), round(y), round(x + w), round(y + h)))
    rows += [(300, 0, 0, 0, 0, 0), (301, 0, 0, 0, 0, 0), (302, None, 0, 0, 9, 9), (303, 1, None, 0, 9, 9), (304, 0, 5, 5, 1, 1)]
    good = [r for r in rows if None not in r and r[2] <= r[4] and r[3] <= r[5]]
    want = {(a[0], b[0]) for a in good for b in good if a[0] < b[0] and a[1] == b[1] and a[2] <= b[4] and b[2] <= a[4] and a[3] <= b[5] and b[3] <= a[5]}
    got = [(min(r.a, r.b), max(r.a, r.b)) for r in B.overlapping(spark.createDataFrame(rows, "i int, g int, x1 double, y1 double, x2 double, y2 double".replace("double", "int")), "g", "i").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 400


def test_each_point_claims_the_best_box_left(spark):
    rng = np.random.default_rng(6)
    points = [(k, int(rng.integers(3)), float(x), float(y)) for k, (x, y) in enumerate(rng.integers(0, 2500, (30, 2)))]
    boxes = [(k, int(rng.integers(3)), float(x), float(y), float(x + rng.integers(5, 900)), float(y + 16), float(rng.choice([0, 250]) - 80 * rng.integers(0, 11) / 10)) for k, (x, y) in enumerate(rng.integers(0, 2500, (34, 2)))]
    points += [(100, 7, 5.0, 5.0), (101, 8, 5.0, 5.0), (102, 8, 9e4, 9e4), (103, 0, None, 1.0)]
    boxes += [(100, 8, 0.0, 0.0, 1.0, 1.0, 0.0), (101, 9, 0.0, 0.0, 1.0, 1.0, 0.0)]
    taken, want = set(), {}
    for p, g, x, y in points:
        left = [(math.hypot(max(b[2] - x, 0.0, x - b[4]), max(b[3] - y, 0.0, y - b[5])) + b[6], b[0]) for b in boxes if b[1] == g and b[0] not in taken] if x is not None else []
        if left:
            want[p] = min(left)[1]
            taken.add(want[p])
    assert 102 not in want and 18 < len(want) < 33  # more points than boxes in a group
    df = spark.createDataFrame(points, "p int, g int, px double, py double").withColumn("rank", F.col("p"))
    bx = spark.createDataFrame(boxes, "b int, g int, x1 double, y1 double, x2 double, y2 double, extra double")
    for start in (160.0, 1e5):
        assert {r.p: r.b for r in B.claim_nearest(df, bx, "g", "p", "b", "rank", -80.0, start).collect()} == want
    assert B.claim_nearest(df, bx.limit(0), "g", "p", "b", "rank", -80.0).count() == 0 and B.claim_nearest(df.limit(0), bx, "g", "p", "b", "rank", -80.0).count() == 0


def plain_numbers(items, tolerance):
    out, n = {}, 0
    rows = []
    for g in sorted({i[1] for i in items}):
        rows, n = [], 0
        for k, _, x, y in sorted((i for i in items if i[1] == g), key=lambda i: (i[3], i[2], i[0])):
            if rows and abs(y - rows[-1][0][3]) < tolerance:
                rows[-1].append((k, g, x, y))
            else:
                rows.append([(k, g, x, y)])
        for row in rows:
            for k, *_ in sorted(row, key=lambda i: (i[2], i[3], i[0])):
                n += 1
                out[k] = n
    return out


def test_reading_order_from_anchors(spark):
    rng = np.random.default_rng(7)
    items = [(k, int(rng.integers(3)), float(x), float(y)) for k, (x, y) in enumerate(rng.integers(0, 700, (240, 2)))] + [(k, 5, float(k % 7), 10.0 * k) for k in range(300, 360)]
    df = spark.createDataFrame([*items, (900, None, 1.0, 1.0), (901, 1, 1.0, None), (902, 1, None, 1.0)], "k int, g int, x double, y double")
    got = {r.k: r.number for r in R.reading_order(df, "g", "x", "y", "k").collect()}
    assert got.pop(900) is None and got.pop(901) is None and got.pop(902) is None
    assert got == plain_numbers(items, 30) and R.reading_order(df.limit(0), "g", "x", "y", "k").count() == 0


def marks(rng, n):
    words = ["R5", "TYP", "12", "Ø6.5", "ALL AROUND", "3.2/3.0"]
    out = []
    for k in range(n):
        x, y, w, h = float(rng.integers(0, 500)), float(rng.integers(0, 500)), float(rng.choice([8, 20, 40, 400])), float(rng.choice([8, 16, 160]))
        out.append((k, int(rng.integers(2)), str(rng.choice(words)), x, y, int(rng.integers(50, 100)) / 100, x - w / 2, y - h / 2, x + w / 2, y + h / 2))
    return out


MARK = "mark_key int, drawing_id int, text string, cx double, cy double, conf double, x1 double, y1 double, x2 double, y2 double"


def both_areas(a, b):
    inter = max(0.0, min(a[8], b[8]) - max(a[6], b[6])) * max(0.0, min(a[9], b[9]) - max(a[7], b[7]))
    size = lambda m: (m[8] - m[6]) * (m[9] - m[7])
    return inter, size(a), size(b)


def one_after_another(rows, order, same):
    kept = []
    for m in sorted(rows, key=order):
        if not any(k[1] == m[1] and same(k, m) for k in kept):
            kept.append(m)
    return kept


def test_merged_readings_are_those_of_the_pass(spark):
    from millwright.plans import spatial_queries as S

    rows = marks(np.random.default_rng(9), 260)
    dist = lambda a, b: math.hypot(a[3] - b[3], a[4] - b[4])

    def same(a, b):
        inter, x, y = both_areas(a, b)
        return inter / (x + y - inter) > 0.2 or dist(a, b) < 20 or a[2].replace(" ", "") == b[2].replace(" ", "") and dist(a, b) < 50

    want = {m[0] for m in one_after_another(rows, lambda m: (-m[5], m[0]), same)}
    df = spark.createDataFrame(rows, MARK)
    assert {r.mark_key for r in S.merge_readings(df).collect()} == want and 20 < len(want) < 240

    short = lambda m: m[2] in ("R5", "TYP", "12")
    left = [m for m in rows if not short(m)] + one_after_another([m for m in rows if short(m)], lambda m: m[0], lambda a, b: a[2] == b[2] and dist(a, b) < 80)
    diag = lambda m: math.hypot(m[8] - m[6], m[9] - m[7])

    def dup(a, b):
        inter, x, y = both_areas(a, b)
        return a[2] == b[2] and dist(a, b) < max(60.0, 0.6 * (diag(a) + diag(b))) or inter / max(1.0, min(x, y)) >= 0.6

    want = {m[0] for m in one_after_another(left, lambda m: (-both_areas(m, m)[1], m[0]), dup)}
    assert {r.mark_key for r in S.dedup_boxes(df).collect()} == want and 20 < len(want) < len(left)


def plain_stacks(rows):
    import re

    bubble = re.compile(r"[0-9]{1,2}[A-G]?|\([0-9]{1,3}\)|\([0-9]{1,2}|[0-9]{1,2}\)")
    word = lambda t: not re.search("[0-9]", t) or bool(re.fullmatch(r"[A-Z]+\s*[0-9]*", t)) and "DIA" not in t

    def apart(a, b):
        if re.fullmatch("[0-9]{2,}", a) and re.fullmatch("[0-9]{2,}", b) or "Ø" in a and "Ø" in b:
            return True
        if not (re.fullmatch(r"[0-9]+(\.[0-9]+)?", a) and re.fullmatch(r"[0-9]+(\.[0-9]+)?", b)) or float(a) < 1 or float(b) < 1:
            return False
        decimals = lambda t: len(t.split(".")[1]) if "." in t else 0
        return decimals(a) != decimals(b) or abs(float(a) - float(b)) / max(float(a), float(b)) > 0.3

    out, used = {}, set()
    for g in sorted({m[1] for m in rows}):
        order = sorted((m for m in rows if m[1] == g and not bubble.fullmatch(m[2])), key=lambda m: (round(m[3] / 24), m[4], m[0]))
        for seed in order:
            if seed[0] in used:
                continue
            used.add(seed[0])
            stack = [seed]
            for m in order:
                if m[0] not in used and abs(m[3] - stack[-1][3]) <= 24 and -12 <= m[7] - stack[-1][9] <= 5 and not apart(stack[-1][2], m[2]):
                    stack.append(m)
                    used.add(m[0])
            if len(stack) > 1:
                stack.sort(key=lambda m: (m[4], m[0]))
                texts = [m[2] for m in stack]
                if any(t.startswith("(") for t in texts) and any(t.endswith(")") for t in texts):
                    text = " ".join(texts)
                elif any(map(word, texts)):
                    text = " ".join([t for t in texts if word(t)] + [t for t in texts if not word(t)])
                else:
                    text = " / ".join(texts)
                out[seed[0]] = (len(stack), text)
    return out


def test_stacks_are_those_of_the_pass(spark):
    rng, rows = np.random.default_rng(12), []
    texts = ["+0.06", "31.80", "31.2", "5.00", "4.85", "MAJOR DIA", "ALL AROUND", "OUTER PROFILE", "Ø6.5", "120", "80", "(TAPER", "ENDS)", "7", "R5.1"]
    for k in range(420):
        x, y = float(rng.integers(0, 12) * 14), float(rng.integers(0, 60) * 9)
        rows.append((k, int(rng.integers(3)), str(rng.choice(texts)), x, y, 0.5, x - 20, y - 8, x + 20, y + 8))
    rows += [(500, 9, "0.35", 5.0, 20.0, 0.5, 0.0, 0.0, 10.0, 40.0), (501, 9, "28.", 5.0, 60.0, 0.5, 0.0, 40.0, 10.0, 80.0)]
    want = plain_stacks(rows[:-2])
    got = {r.mark_key: (r.n, r.text) for r in R.stacks(spark.createDataFrame(rows, MARK), "drawing_id", "mark_key").collect()}
    assert got.pop(500) == (2, "28.35") and got == want and len(want) > 60 and max(n for n, _ in want.values()) > 4
    assert R.stacks(spark.createDataFrame(rows, MARK).limit(0), "drawing_id", "mark_key").count() == 0

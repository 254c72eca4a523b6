"""Phrases of several marks and values of balloons with letters: against passes one after another."""

import math
import re

import numpy as np
from pyspark.sql import functions as F

from millwright.operators import chains as C, phrases as P


def test_components(spark):
    pairs = [(k, k + 1) for k in range(200)] + [(500, 300), (300, 400), (7, 7), (900, 901)]
    got = {r.item: r.part for r in C.components(spark.createDataFrame(pairs, "a int, b int")).collect()}
    assert got == {k: 0 for k in range(201)} | {500: 300, 300: 300, 400: 300, 900: 900, 901: 900}
    assert C.components(spark.createDataFrame([], "a int, b int")).count() == 0


def plain_phrases(rows):
    out, used = {}, set()
    for g in sorted({m[1] for m in rows}):
        order = sorted((m for m in rows if m[1] == g and not re.search("[0-9]", m[2])), key=lambda m: (m[4], m[3], m[0]))
        for i, seed in enumerate(order):
            if seed[0] in used:
                continue
            members, last = [seed], seed
            for m in order[i + 1 :]:
                if m[0] not in used and abs(m[3] - seed[3]) <= 30 and m[7] - last[9] <= 60:
                    members.append(m)
                    last = m
            words = " ".join(m[2].upper() for m in members)
            hit = next((p for p in P.PHRASES if p in words), None)
            if hit and len(members) > 1:
                out[seed[0]] = (hit, [m[0] for m in members])
                used |= {m[0] for m in members}
    return out


def test_phrases_are_those_of_the_pass(spark):
    rng = np.random.default_rng(3)
    words = ["ALL", "AROUND", "OUTER", "PROFILE", "ALL AROUND", "outer profile", "TRUE", "POSITION", "NOTE", "12.5"]
    rows = []
    for k in range(190):
        x, y, h = float(rng.integers(0, 44) * 22), float(rng.integers(0, 40) * 23), float(rng.choice([16, 16, 60]))
        rows.append((k, int(rng.integers(3)), str(rng.choice(words)), x, y, 0.5, x - 20, y - h / 2, x + 20, y + h / 2))
    df = spark.createDataFrame(rows, "mark_key int, drawing_id int, text string, cx double, cy double, conf double, x1 double, y1 double, x2 double, y2 double")
    got = {r.mark_key: (r.phrase, list(r.members)) for r in P.fuse(df, "drawing_id", "mark_key").collect()}
    want = plain_phrases(rows)
    assert got == want and len(want) > 4 and len({p for p, _ in want.values()}) >= 3
    assert P.fuse(df.limit(0), "drawing_id", "mark_key").count() == 0


def plain_suffixes(rows):
    state = {r[0]: {"g": r[1], "n": r[2] or "", "v": (r[3] or "").strip(), "c": r[4] or 0.0, "x": r[5], "y": r[6], "r": r[7], "why": None} for r in rows}
    short = lambda v: v == "NO_DIMENSION" or len(v) <= 3
    for k in sorted(state):
        b = state[k]
        base = re.sub("[A-Za-z]+$", "", b["n"])
        donors = [i for i, o in state.items() if o["g"] == b["g"] and o["n"] == base]
        if not base or base == b["n"] or not donors:
            continue
        given, was = state[max(donors)]["v"], b["v"]
        if given in ("", "NO_DIMENSION") or re.sub(r"\s", "", was).upper() == re.sub(r"\s", "", given).upper() or not (short(was) or re.fullmatch("[0-9]{1,2}", given)):
            continue
        b |= {"v": given, "why": f"shared_dim_suffix_{base}", "c": max(b["c"], 0.5)}
        if was not in ("", "NO_DIMENSION") and re.search("[0-9]", was) and (len(was) > 3 or re.search("[A-Za-zØΦ±°×/().]", was)):
            near = sorted((math.hypot(o["x"] - b["x"], o["y"] - b["y"]), i) for i, o in state.items() if i != k and o["g"] == b["g"] and o["n"] != base and (short(o["v"]) or o["c"] < 0.35))
            near = [n for n in near if n[0] <= max(260.0, 5 * max(1.0, b["r"] or 1.0))]
            if near and not (len(near) > 1 and near[1][0] - near[0][0] < 25):
                state[near[0][1]] |= {"v": was, "why": f"transferred_from_suffix_{b['n']}", "c": max(state[near[0][1]]["c"], 0.5)}
    return {k: (o["v"], round(o["c"], 6), o["why"]) for k, o in state.items()}


def test_values_move_on_as_in_the_pass(spark):
    rng, rows = np.random.default_rng(4), []
    for k in range(190):
        number = f"{int(rng.integers(1, 25))}{rng.choice(['', '', 'A', 'B', 'c'])}"
        value = str(rng.choice(["2", "14", "Ø12.5", "R5.25", "NO_DIMENSION", "", "7x45°", "ABC", "12.50 ", "R5"]))
        rows.append((k, int(rng.integers(3)), number, value, float(rng.choice([0.2, 0.4, 0.9])), float(rng.integers(0, 1200)), float(rng.integers(0, 1200)), float(rng.choice([10, 80]))))
    rows += [(500, 0, None, None, None, 1.0, 1.0, None), (501, 0, "A", "R5.25", 0.9, 5.0, 5.0, 1.0)]
    df = spark.createDataFrame(rows, "k int, g int, number string, value string, conf double, x double, y double, radius double")
    got = {r.k: (r.value, round(r.conf, 6), r.reason) for r in P.inherit_suffixes(df, "g", "k").collect()}
    want = plain_suffixes(rows)
    assert got == want
    why = [w.split("_")[0] for *_, w in want.values() if w]
    assert why.count("transferred") > 5 and why.count("shared") > 15
    assert P.inherit_suffixes(df.limit(0), "g", "k").count() == 0

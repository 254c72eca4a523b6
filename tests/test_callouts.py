"""Callouts by eleven passes against plain loops over the marks of a drawing."""

import math
import re

import numpy as np

from millwright.operators import callouts as K, claims as C

TEXTS = ["Ø52.28", "±0.1", "+0.05", "12.5", "12.4", "184", "25", "0.5", "(REF)", "(BOSS)", "R5.2", "TYP", "MAJOR DIA", "4 DIA", "B2", "0.5x45°", "(82)", "10.0/9.8", "MJ5x0.8", "4h6h", "MJ5x0.8 4h6h", "M60", "30°", "ALL AROUND", "OUTER PROFILE", "A", "NOTE", "REF", "THRU", "Ø4/3"]
SEMANTIC = [("numeric_pair", r"^\d+(\.\d+)?/\d+(\.\d+)?$"), ("tolerance", r"±"), ("thread", r"MJ?\d+x\d|M\d+X\d"), ("chamfer", r"\d+(\.\d+)?[xX]\d+°"), ("diameter", r"Ø|\d+\s*DIA"), ("radius", r"R\d+"), ("angle", r"\d+°"), ("numeric", r"\d")]


def plain(marks):
    """marks (key, group, text, cx, cy, y1, y2) of one group in the order of keys -> {(pass, kind, text, members)}."""
    up = lambda m: m[2].upper()
    h = lambda m: max(1.0, m[6] - m[5])
    dx, dy = lambda a, b: abs(a[3] - b[3]), lambda a, b: abs(a[4] - b[4])
    number = lambda m: bool(re.fullmatch(r"\d+\.?\d*", m[2]))
    diameter = lambda m: bool(re.search(r"Ø|\d+\s*DIA|DIAM\s*\d+", up(m)))
    radius = lambda m: bool(re.search(r"R\d+|\d+R|RADIUS\s*\d+", up(m)))
    thread = lambda m: bool(re.search(r"MJ?\d+X\d+|\d+H\d+H", up(m)) or re.fullmatch(r"M\d+", up(m)))
    bubble = lambda m: bool(re.fullmatch(r"\d{1,2}[A-G]?|\(\d{1,3}\)|\(\d{1,2}|\d{1,2}\)", up(m)))
    word = lambda m: not (re.search(r"\d", m[2]) and not (re.fullmatch(r"[A-Z]+\s*\d*", up(m)) and not re.search("DIA|REF", up(m))))
    along = lambda a, b: " ".join(m[2] for m in sorted([a, b], key=lambda m: m[3]))
    k, seen = [], set()
    for m in marks:
        at = (up(m), round(m[3]), round(m[4]))
        if not bubble(m) and at not in seen:
            seen.add(at)
            k.append(m)

    def first(fits, text, kind, best=None):
        used, out = set(), []
        for a in k:
            left = [b for b in k if a[0] not in used and b[0] != a[0] and b[0] not in used and fits(a, b)]
            if left:
                b = min(left, key=lambda b: best(a, b)) if best else left[0]
                used |= {a[0], b[0]}
                out.append((kind, text(a, b), (a, b)))
        return out

    dist = lambda a, b: math.hypot(dx(a, b), dy(a, b))
    passes = []
    full = [m for m in k if re.search(r"MJ?\d+[X.]\d+", up(m)) and re.search(r"\d+H\d+H", up(m))]
    used, out = {m[0] for m in full}, [("thread", m[2], (m,)) for m in full]
    for kind, p, q in (("thread", r"MJ?\d+[X.]\d+", r"\d+H\d+H"), ("diameter_tolerance", r"[ØO]\d+\.?\d*", r"±\d+\.?\d*"), ("chamfer", r"[A-Z]\d+", r"\d+\.?\d*X\d+°")):
        for n, a in enumerate(k):
            if a[0] in used or not re.search(p, up(a)) or kind == "diameter_tolerance" and "/" in a[2]:
                continue
            for b in k[n + 1 :]:
                if b[0] not in used and re.search(q, up(b)) and not (kind == "diameter_tolerance" and "/" in b[2]) and dx(a, b) < 120 and dy(a, b) < 50:
                    used |= {a[0], b[0]}
                    out.append((kind, along(a, b), (a, b)))
                    break
    passes.append(out)
    passes.append(first(lambda a, b: (diameter(a) or radius(a) or number(a)) and re.fullmatch(r"(?i)\([A-Z0-9][A-Z0-9 ._-]{1,24}\)", b[2]) and dx(a, b) <= 180 and dy(a, b) <= max(70.0, (h(a) + h(b)) * 0.9), lambda a, b: f"{a[2]} {b[2]}", "keyword", dist))
    used, out = set(), []
    for a in k:
        if a[0] not in used and "DIA" in up(a):
            near = [b for b in k if b[0] != a[0] and b[0] not in used and dx(a, b) < 120 and dy(a, b) < max(60, int(h(a) * 0.9)) and re.search(r"\d", b[2]) and not thread(b) and not re.search(r"MJ?\d+[X.]\d+", up(b)) and not word(b)][:2]
            used |= {m[0] for m in [a, *near]}
            out.append(("diameter", " ".join(m[2] for m in [a, *near]), (a, *near)))
    passes.append(out)
    passes.append(first(lambda a, b: re.fullmatch(r"(?i)[A-Z]\d+|\(?\d+\)?", a[2]) and re.search(r"\d+(\.\d+)?X\d+|CHAMFER", up(b)) and dx(a, b) < 120 and dy(a, b) < 50, along, "chamfer"))
    cand = []
    for a in k:
        if (diameter(a) or number(a)) and "±" not in a[2] and "/" not in a[2] and not re.fullmatch(r"[Øø]?\s*0\.\d+", a[2]):
            for b in k:
                if b[0] != a[0] and "/" not in b[2] and re.match(r"(±|[+-])\s*\d", b[2]) and dx(a, b) < 150 and dy(a, b) < max(60.0, (h(a) + h(b)) * 1.2):
                    cand.append((0 if dx(a, b) <= max(45.0, 0.35 * max(h(a), h(b))) else 1, dist(a, b), -len(re.sub(r"\D", "", a[2])), a[0], b[0], a, b))
    used, out = set(), []
    for *_, a, b in sorted(cand, key=lambda c: c[:5]):
        if a[0] not in used and b[0] not in used:
            used |= {a[0], b[0]}
            out.append(("diameter_tolerance", along(a, b), (a, b)))
    passes.append(out)

    def apart(a, b):
        x, y = float(a[2]), float(b[2])
        places = lambda m: len(m[2].split(".")[1]) if "." in m[2] else 0
        return x >= 1 and y >= 1 and (places(a) != places(b) or abs(x - y) / max(x, y) > 0.3)

    stacked = first(lambda a, b: number(a) and number(b) and dx(a, b) < 80 and 5 < dy(a, b) < 60 and not apart(a, b), lambda a, b: "/".join(m[2] for m in ((a, b) if a[4] < b[4] else (b, a))), "numeric_pair")
    passes.append([("numeric_pair", m[2], (m,)) for m in k if "/" in m[2] and re.search(r"\d", m[2])] + stacked)
    passes.append([("radius", m[2], (m,)) for m in k if radius(m) or re.search(r"R\d|TYP", up(m))])
    passes.append([("angle", m[2], (m,)) for m in k if "°" in m[2] or re.search(r"\d+\s*DEG", up(m))])
    passes.append([("thread", m[2], (m,)) for m in k if thread(m)])
    used, out = set(), []
    for a in k:
        if a[0] in used or re.fullmatch("[A-Z]", a[2]) or not (word(a) or up(a) in K.NOTES.split(" ")):
            continue
        near = [b for b in k if b[0] != a[0] and b[0] not in used and re.search(r"\d", b[2]) and dx(a, b) < 150 and dy(a, b) < 80] if any(p in up(a) or up(a) in p for p in K.PHRASES) else []
        b = min(near, key=lambda b: dist(a, b)) if near else None
        used |= {a[0]} | ({b[0]} if b else set())
        out.append(("keyword", f"{b[2]} {a[2]}" if b else a[2], (b, a) if b else (a,)))
    passes.append(out)
    got, used = set(), set()
    for n, groups in enumerate(passes):
        for kind, text, members in groups:
            if not used & {m[0] for m in members} and not (kind == "diameter_tolerance" and "/" in text):
                used |= {m[0] for m in members}
                got.add((n, kind, text, tuple(sorted(m[0] for m in members))))
    for m in k:
        if m[0] not in used:
            kind = next((x for x, p in SEMANTIC if re.search(p, up(m))), "unknown")
            if not (kind == "tolerance" and re.fullmatch(r"(±|[+-])\s*\d+(\.\d+)?", m[2])):
                got.add((10, kind, m[2], (m[0],)))
    return got


def test_callouts_are_those_of_the_passes(spark):
    rng, rows = np.random.default_rng(21), []
    for n in range(330):
        x, y, hh = float(rng.integers(0, 900)), float(rng.integers(0, 700)), float(rng.choice([16, 16, 70]))
        rows.append((n, int(rng.integers(3)), str(rng.choice(TEXTS)), x, y, y - hh / 2, y + hh / 2))
    rows += [(900, 0, rows[0][2], *rows[0][3:]), (901, 0, " ", 5.0, 5.0, 0.0, 9.0), (902, 0, None, 5.0, 5.0, 0.0, 9.0)]
    df = spark.createDataFrame(rows, "k int, d int, text string, cx double, cy double, y1 double, y2 double")
    got = {(r.d, r["pass"], r.kind, r.text, tuple(r.members)) for r in K.callouts(df, "d", "k").collect()}
    want = {(d, *c) for d in range(3) for c in plain([r for r in rows[:-2] if r[1] == d])}
    assert got == want and {c[1] for c in want} == set(range(11))
    assert K.callouts(df.limit(0), "d", "k").count() == 0


def test_sets_are_taken_in_order(spark):
    rng = np.random.default_rng(5)
    groups = [(n, sorted({int(x) for x in rng.integers(0, 60, int(rng.integers(1, 5)))})) for n in range(120)]
    used, want = set(), set()
    for n, t in groups:
        if not used & set(t):
            used |= set(t)
            want.add(n)
    df = spark.createDataFrame(groups, "rank int, tokens array<int>")
    assert {r.rank for r in C.greedy_sets(df, "rank", "tokens").collect()} == want and C.greedy_sets(df.limit(0), "rank", "tokens").count() == 0

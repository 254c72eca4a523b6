"""Queries of passes over the tokens of a drawing: duplicates, claims, pairs and notes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G, text as X
from ..operators import boxes as B, callouts as K, claims as C, joins as J, phrases as H, reading as O, sweep as W, turns as T
from ..operators.lineage import stored
from ..operators.nearest import best_within, claim_pairs
from ..registry import query
from .text_queries import direction_sql

#: Height of a token's box, and its width for each character: the view has centres only.
HEIGHT, WIDTH = 16.0, 8.0


def _tokens(t) -> DataFrame:
    """One token for each key: a pass needs a total order."""
    rest = [c for c in t.token.columns if c != "token_key"]
    return t.token.groupBy("token_key").agg(F.min(F.struct(*rest)).alias("r")).select("token_key", "r.*")


def _boxes(t) -> DataFrame:
    return _tokens(t).withColumns({"w": F.char_length("text") * WIDTH, "h": F.lit(HEIGHT)})


def _nearest_token(a: DataFrame, b: DataFrame, radius: float, allowed: Column | None = None, least: float = 0.0) -> DataFrame:
    """For each key of tokens a that has a token of b in reach: token_key, the score of the best one (distance, plus `extra` of b if there is one) and its to_key."""
    at = [F.col("cx").alias("px"), F.col("cy").alias("py")]
    extra = ["extra"] if "extra" in b.columns else []
    to = b.select("drawing_id", F.col("token_key").alias("to_key"), F.col("cx").alias("ox"), F.col("cy").alias("oy"), *extra)
    best = best_within(a.select("drawing_id", *at), to, "drawing_id", radius, ["to_key"], allowed=allowed, least=least)
    rows = a.select("drawing_id", "token_key", *at).hint("merge").join(best.hint("merge"), ["drawing_id", "px", "py"])
    return rows.groupBy("token_key").agg(F.min(F.struct("score", "to_key")).alias("b")).select("token_key", "b.score", "b.to_key")


@query("token_near_dedup")
def _(t):
    """Same text within 14 px: the surest token stays, and what is near only to one that went stays too."""
    k = stored(_tokens(t)).withColumns({"norm": F.upper(F.trim("text")), "unsure": -F.col("conf")})
    return C.greedy_apart(k, ["drawing_id", "norm"], "token_key", "cx", "cy", ["unsure", "cy", "cx"], 14.0).select("token_key", "drawing_id", "text", "cx", "cy", "conf")


def _marks(t) -> DataFrame:
    """Marks, whose texts and boxes are made once. A query reads them several times."""
    return stored(t.mark.drop("raw"))


def _corners(p: str) -> list[Column]:
    return [F.col(f"{p}_{c}") for c in ("x1", "y1", "x2", "y2")]


def _rank(*order: tuple[str, bool]) -> Column:
    side = lambda p: F.struct(*[(-F.col(f"{p}_{c}") if down else F.col(f"{p}_{c}")).alias(f"o{i}") for i, (c, down) in enumerate(order)], F.col(f"{p}_mark_key").alias("k"))
    return side("a") < side("b")


def _met(reach: DataFrame, cols: list[str]) -> DataFrame:
    """Pairs of marks whose widened boxes meet, each once, with the keys and columns of both and the distance of their centres."""
    had = {c: f"own_{c}" for c in ("x1", "y1", "x2", "y2") if c in cols}
    at = [*cols, *(c for c in ("drawing_id", "mark_key", "x1", "y1", "x2", "y2") if c not in cols)]
    pairs = B.overlapping(reach.select(*at, *(F.col(o) for o in had.values())), "drawing_id", "mark_key", keep=[had.get(c, c) for c in cols])
    pairs = pairs.withColumnsRenamed({"a": "a_mark_key", "b": "b_mark_key"} | {f"{p}_{o}": f"{p}_{c}" for p in "ab" for c, o in had.items()})
    return pairs.withColumn("dist", F.hypot(F.col("a_cx") - F.col("b_cx"), F.col("a_cy") - F.col("b_cy")))


def _own(k: DataFrame) -> DataFrame:
    """Marks with their box once more, which stays when they are widened."""
    return k.withColumns({f"own_{c}": F.col(c) for c in ("x1", "y1", "x2", "y2")})


def _lost(pairs: DataFrame, order: Column) -> DataFrame:
    a, b = F.col("a_mark_key"), F.col("b_mark_key")
    return pairs.select(F.when(order, a).otherwise(b).alias("better"), F.when(order, b).otherwise(a).alias("worse"))


def merge_readings(k: DataFrame) -> DataFrame:
    """Of marks that overlap by more than 0.2, or lie within 20 px, or say the same within 50 px, the surest stays."""
    k = k.withColumn("norm", F.replace(F.upper(F.trim("text")), F.lit(" "), F.lit("")))
    pairs = _met(B.widened(_own(k), F.lit(25.0)), ["norm", "cx", "cy", "conf", "x1", "y1", "x2", "y2"])
    same = (G.iou(_corners("a"), _corners("b")) > 0.2) | (F.col("dist") < 20) | ((F.col("a_norm") == F.col("b_norm")) & (F.col("dist") < 50))
    return C.greedy_keep(k, "mark_key", _lost(pairs.where(same), _rank(("conf", True)))).drop("norm")


def dedup_boxes(k: DataFrame) -> DataFrame:
    """Short labels within 80 px of a kept equal one go first; then, largest box first, equal texts that are near and boxes that cover 0.6 of the smaller one."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    k = k.withColumns({"norm": F.upper(F.trim("text")), "area": w * h, "diag": F.hypot(w, h)})
    short = k.where(F.col("norm").rlike(r"^([A-Z]?[0-9]{1,3}|TYP)$") & (F.char_length("norm") <= 4))
    points = short.withColumns({"x1": F.col("cx"), "y1": F.col("cy"), "x2": F.col("cx"), "y2": F.col("cy")})
    pairs = _met(B.widened(points, F.lit(40.0)), ["norm", "cx", "cy"])
    k = stored(C.greedy_keep(k, "mark_key", _lost(pairs.where("a_norm = b_norm and dist < 80"), _rank())))
    # centres nearer than max(60, 0.6 of both diagonals) lie in circles of max(30, 0.6 of the own one) that meet
    pairs = _met(B.widened(_own(k), F.greatest(F.lit(30.0), 0.6 * F.col("diag"))), ["norm", "cx", "cy", "x1", "y1", "x2", "y2"])
    side = lambda p, c: F.col(f"{p}_{c}2") - F.col(f"{p}_{c}1")
    pairs = pairs.withColumns({f"{p}_{n}": f(side(p, "x"), side(p, "y")) for p in "ab" for n, f in (("area", lambda w, h: w * h), ("diag", F.hypot))})
    near = F.col("dist") < F.greatest(F.lit(60.0), 0.6 * (F.col("a_diag") + F.col("b_diag")))
    over = G.intersection(_corners("a"), _corners("b")) / F.greatest(F.lit(1.0), F.least("a_area", "b_area"))
    dup = ((F.col("a_norm") == F.col("b_norm")) & near) | (over >= 0.6)
    return C.greedy_keep(k, "mark_key", _lost(pairs.where(dup), _rank(("area", True)))).drop("norm", "area", "diag")


@query("ensemble_merge")
def _(t):
    return merge_readings(_marks(t)).select("mark_key", "drawing_id", "text", "conf")


@query("bbox_dedup")
def _(t):
    return dedup_boxes(_marks(t)).select("mark_key", "drawing_id", "text")


_MEET = "a.drawing_id = b.drawing_id AND a.mark_key < b.mark_key AND a.x1 <= b.x2 AND b.x1 <= a.x2 AND a.y1 <= b.y2 AND b.y1 <= a.y2"


@query("box_overlaps", f"SELECT a.mark_key AS a, b.mark_key AS b FROM mark a JOIN mark b ON {_MEET}")
def _(t):
    """Pairs of boxes of all sizes that meet."""
    return B.overlapping(stored(t.mark.select("drawing_id", "mark_key", "x1", "y1", "x2", "y2")), "drawing_id", "mark_key").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


_ORDER = """WITH RECURSIVE k AS (SELECT DISTINCT drawing_id, cy FROM mark),
  n AS (SELECT drawing_id, cy, min(cy) OVER (PARTITION BY drawing_id ORDER BY cy RANGE BETWEEN 30 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM k),
  a AS (SELECT drawing_id, min(cy) AS cy FROM k GROUP BY 1 UNION ALL SELECT n.drawing_id, n.nxt FROM a JOIN n ON n.drawing_id = a.drawing_id AND n.cy = a.cy WHERE n.nxt IS NOT NULL)
SELECT mark_key, drawing_id, anchor, row_number() OVER (PARTITION BY drawing_id ORDER BY anchor, cx, cy, mark_key) AS number
FROM (SELECT m.mark_key, m.drawing_id, m.cx, m.cy, max(a.cy) AS anchor FROM mark m JOIN a ON a.drawing_id = m.drawing_id AND a.cy <= m.cy GROUP BY 1, 2, 3, 4)"""


@query("reading_order_anchor", _ORDER)
def _(t):
    """Numbers in reading order: a row is what lies less than 30 px below its first mark."""
    return O.reading_order(stored(t.mark.select("mark_key", "drawing_id", "cx", "cy")), "drawing_id", "cx", "cy", "mark_key").select("mark_key", "drawing_id", "anchor", F.col("number").cast("long").alias("number"))


@query("recovered_anti", "SELECT token_key FROM token WHERE conf < 0.95 AND token_key NOT IN (SELECT r.token_key FROM token r JOIN token e ON r.conf < 0.95 AND e.conf >= 0.95 AND e.drawing_id = r.drawing_id AND e.text = r.text AND e.token_key <> r.token_key AND sqrt(power(e.cx - r.cx, 2) + power(e.cy - r.cy, 2)) < 20)")
def _(t):
    """Recovered tokens (less sure) that no sure one of the same text lies near to."""
    k = t.token.where("text is not null").withColumn("g", F.concat_ws("\1", "drawing_id", "text"))
    unsure = k.where("conf < 0.95").select("g", "token_key", F.col("cx").alias("px"), F.col("cy").alias("py"))
    # of a place the first and the last key tell whether it has another token than oneself
    sure = k.where("conf >= 0.95").groupBy("g", F.col("cx").alias("ox"), F.col("cy").alias("oy")).agg(F.min("token_key").alias("lo"), F.max("token_key").alias("hi"))
    other = (F.hypot(F.col("px") - F.col("ox"), F.col("py") - F.col("oy")) < 20) & ((F.col("o.lo") != F.col("token_key")) | (F.col("o.hi") != F.col("token_key")))
    known = best_within(unsure, sure, "g", 20.0, [], ["lo", "hi"], allowed=other).select("token_key")
    return t.token.where("conf < 0.95").join(known, "token_key", "left_anti").select("token_key")


@query("stack_merge")
def _(t):
    """Marks above each other whose boxes touch, as one text."""
    return O.stacks(_marks(t), "drawing_id", "mark_key").select("drawing_id", "mark_key", "n", "text", "kind", "x1", "y1", "x2", "y2")


#: Beyond this distance a link has no distance confidence, and isn't looked for.
REACH = 220.0


#: Labels are marks in parentheses, callouts all with a digit that aren't.
LABEL, CALLOUT = r"^\([0-9]{1,3}\)$", "[0-9]"


def nearest_claims(marks: DataFrame) -> DataFrame:
    """Labels in their order each claim the best callout that is left, however far; a claim under 0.65, or of a suppressed one, is for review."""
    label = F.col("text").rlike(LABEL)
    k = stored(marks.where(label | F.col("text").rlike(CALLOUT)).select("drawing_id", "mark_key", label.alias("label"), "cx", "cy", "conf", "x1", "y1", "x2", "y2"))
    labels = k.where("label").select("drawing_id", F.col("mark_key").alias("label_key"), F.col("mark_key").alias("rank"), F.col("cx").alias("px"), F.col("cy").alias("py"))
    suppressed = F.col("mark_key") % 9 == 0
    callouts = k.where("not label").select("drawing_id", F.col("mark_key").alias("callout_key"), "x1", "y1", "x2", "y2", "conf", suppressed.alias("suppressed"), (F.when(suppressed, 250.0).otherwise(0.0) - 80 * F.col("conf")).alias("extra"))
    got = B.claim_nearest(labels, callouts, "drawing_id", "label_key", "callout_key", "rank", -80.0, keep=["conf", "suppressed"])
    conf = F.round(0.25 + 0.20 + 0.25 + 0.20 * F.col("conf") + 0.10 * F.greatest(F.lit(0.0), 1 - F.col("dist") / REACH), 6)
    return got.select("drawing_id", "label_key", "callout_key", F.round("score", 6).alias("score"), conf.alias("confidence"), ((conf < 0.65) | F.col("suppressed")).alias("review"))


@query("nearest_claim")
def _(t):
    return nearest_claims(t.mark)


_LINK = "SELECT p.drawing_id, p.token_key AS label_key, o.token_key AS callout_key, sqrt(power(p.cx - o.cx, 2) + power(p.cy - o.cy, 2)) AS dist, round(sqrt(power(p.cx - o.cx, 2) + power(p.cy - o.cy, 2)) + CASE WHEN o.token_key % 9 = 0 THEN 250.0 ELSE 0.0 END - 80 * o.conf, 6) AS score FROM token p JOIN token o ON p.drawing_id = o.drawing_id AND p.text = '(08)' AND o.text <> '(08)' AND sqrt(power(p.cx - o.cx, 2) + power(p.cy - o.cy, 2)) <= 220"


@query("nearest_noclaim", f"SELECT label_key, callout_key, score FROM (SELECT *, row_number() OVER (PARTITION BY label_key ORDER BY score, callout_key) AS rn FROM ({_LINK})) WHERE rn = 1")
def _(t):
    extra = F.when(F.col("token_key") % 9 == 0, 250.0).otherwise(0.0) - 80 * F.col("conf")
    callouts = t.token.where("text <> '(08)'").withColumn("extra", extra)
    least = callouts.agg(F.min("extra")).first()[0] or 0.0
    best = _nearest_token(t.token.where("text = '(08)'"), callouts, REACH, least=least)
    return best.select(F.col("token_key").alias("label_key"), F.col("to_key").alias("callout_key"), "score")


@query("nearby_repair")
def _(t):
    """Of labels that claim one callout without looking at others, the nearest keeps it; the rest claim the nearest callout that is left."""
    k = _tokens(t)
    labels = k.where("text = '(08)'").select("drawing_id", F.col("token_key").alias("label_key"), F.col("cx").alias("px"), F.col("cy").alias("py"))
    extra = F.when(F.col("token_key") % 9 == 0, 250.0).otherwise(0.0) - 80 * F.col("conf")
    callouts = k.where("text <> '(08)'").select("drawing_id", F.col("token_key").alias("callout_key"), F.col("cx").alias("ox"), F.col("cy").alias("oy"), extra.alias("extra"))
    least = callouts.agg(F.min("extra")).first()[0] or 0.0
    first = stored(best_within(labels, callouts, "drawing_id", REACH, ["callout_key"], least=least).select("drawing_id", "label_key", "callout_key", "dist"))
    owner = first.groupBy("callout_key").agg(F.min(F.struct("dist", "label_key"))["label_key"].alias("label_key"))
    kept = stored(first.join(owner, ["callout_key", "label_key"], "left_semi"))
    again = claim_pairs(labels.join(kept, "label_key", "left_anti"), callouts.join(kept, "callout_key", "left_anti"), "drawing_id", "label_key", "callout_key", REACH)
    cols = ["drawing_id", "label_key", "callout_key"]
    return kept.select(*cols, F.lit(False).alias("repaired")).unionByName(again.select(*cols, F.lit(True).alias("repaired")))


_NUMBERS = ("10.0/9.8", "59.50 mm", "R72.55")
_NUM = f"text IN {_NUMBERS}"


@query("attach_qualifier", f"SELECT value_key, qualifier_key FROM (SELECT b.token_key AS qualifier_key, a.token_key AS value_key, row_number() OVER (PARTITION BY b.token_key ORDER BY round(sqrt(power(a.cx - b.cx, 2) + power(a.cy - b.cy, 2)), 6), a.token_key) AS rn FROM token a JOIN token b ON a.drawing_id = b.drawing_id AND a.{_NUM} AND b.text = '(08)' AND sqrt(power(a.cx - b.cx, 2) + power(a.cy - b.cy, 2)) <= 80) WHERE rn = 1")
def _(t):
    """A qualifier in parentheses belongs to the value nearest to it."""
    best = _nearest_token(t.token.where("text = '(08)'"), t.token.where(_NUM), 80.0)
    return best.select(F.col("to_key").alias("value_key"), F.col("token_key").alias("qualifier_key"))


_TOL = f"SELECT a.token_key AS value_key, b.token_key AS tolerance_key, round(sqrt(power(a.cx - b.cx, 2) + power(a.cy - b.cy, 2)), 6) AS dist FROM token a JOIN token b ON a.drawing_id = b.drawing_id AND a.{_NUM} AND contains(b.text, '±') AND sqrt(power(a.cx - b.cx, 2) + power(a.cy - b.cy, 2)) <= 90"


def _sides(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Values and tolerances."""
    return tokens.where(_NUM), tokens.where(F.contains("text", F.lit("±")))


@query("pair_tolerance", f"SELECT value_key, tolerance_key FROM (SELECT *, row_number() OVER (PARTITION BY value_key ORDER BY dist, tolerance_key) AS a, row_number() OVER (PARTITION BY tolerance_key ORDER BY dist, value_key) AS b FROM ({_TOL})) WHERE a = 1 AND b = 1")
def _(t):
    """A value and a tolerance that are each other's nearest."""
    values, tolerances = _sides(t.token)
    a = _nearest_token(values, tolerances, 90.0).select(F.col("token_key").alias("value_key"), F.col("to_key").alias("tolerance_key"), "score")
    b = _nearest_token(tolerances, values, 90.0).select(F.col("to_key").alias("value_key"), F.col("token_key").alias("tolerance_key"), "score")
    return a.join(b, ["value_key", "tolerance_key", "score"]).select("value_key", "tolerance_key")


@query("stack_pairs_candidates", f"SELECT a.token_key AS top_key, b.token_key AS bottom_key, a.text || '/' || b.text AS text FROM token a JOIN token b ON a.drawing_id = b.drawing_id AND a.token_key <> b.token_key AND a.{_NUM} AND b.{_NUM} AND abs(a.cx - b.cx) < 80 AND b.cy - a.cy > 5 AND b.cy - a.cy < 60")
def _(t):
    """All pairs of numbers of which one stands below the other. Texts move as their places among the three."""
    texts = F.array(*(F.lit(v) for v in _NUMBERS))
    k = t.token.where(_NUM).where("token_key is not null").select("drawing_id", "token_key", "cx", "cy", F.array_position(texts, F.col("text")).cast("byte").alias("v"))
    every = F.lit(True)
    pairs = W.pairs_in_reach(k, "drawing_id", "cx", "cy", every, every, (80.0, 60.0), lambda dx, dy: (np.abs(dx) < 80) & (dy > 5) & (dy < 60), ["token_key", "v"], downwards=True, places=False)
    text = lambda c: F.element_at(texts, F.col(c).cast("int"))
    return pairs.where("a_token_key <> b_token_key").select(F.col("a_token_key").alias("top_key"), F.col("b_token_key").alias("bottom_key"), F.concat(text("a_v"), F.lit("/"), text("b_v")).alias("text"))


@query("stack_pairs")
def _(t):
    """Stacked numbers, each in one pair: in the order of the tokens, each with the first one that is left."""
    every = F.lit(True)
    stacked = T.Pass(every, every, lambda dx, dy: abs(dx) < 80 and 5 < abs(dy) < 60, (-80.0, 80.0), (-60.0, 60.0))
    got = T.claim_in_turn(_tokens(t).where(_NUM), "drawing_id", "token_key", "cx", "cy", [stacked], ["text", "cy"])
    top = lambda a, b: F.when(F.col("a_cy") < F.col("b_cy"), F.col(a)).otherwise(F.col(b))
    return got.select(top("a", "b").alias("top_key"), top("b", "a").alias("bottom_key"), F.concat(top("a_text", "b_text"), F.lit("/"), top("b_text", "a_text")).alias("text"))


@query("priority_claim")
def _(t):
    """Passes in their order (value and tolerance, stacked numbers) claim tokens; a group goes if one of its tokens is claimed before."""
    value, tolerance = F.expr(_NUM), F.contains("text", F.lit("±"))
    below = T.Pass(value, value, lambda dx, dy: abs(dx) < 80 and 5 < dy < 60, (-80.0, 80.0), (0.0, 60.0))
    got = T.claim_in_turn(_tokens(t), "drawing_id", "token_key", "cx", "cy", [T.Pass(value, tolerance, **T.within(90.0)), below])
    return got.select("pass", F.col("a").alias("x"), F.col("b").alias("y"))


@query("attach_note", "SELECT note_key, value_key FROM (SELECT n.token_key AS note_key, v.token_key AS value_key, row_number() OVER (PARTITION BY n.token_key ORDER BY round(sqrt(power(n.cx - v.cx, 2) + power(n.cy - v.cy, 2)), 6), v.token_key) AS rn FROM token n JOIN token v ON n.drawing_id = v.drawing_id AND n.text = 'M10x1.5' AND v.text = 'R72.55' AND abs(n.cx - v.cx) < 150 AND abs(n.cy - v.cy) < 80) WHERE rn = 1")
def _(t):
    """A note belongs to the nearest number, up to 150 px aside and 80 above or below."""
    box = (F.abs(F.col("px") - F.col("ox")) < 150) & (F.abs(F.col("py") - F.col("oy")) < 80)
    best = _nearest_token(t.token.where("text = 'M10x1.5'"), t.token.where("text = 'R72.55'"), 170.0, box)
    return best.select(F.col("token_key").alias("note_key"), F.col("to_key").alias("value_key"))


@query("fuse_phrases")
def _(t):
    """Phrases that stand in several marks below each other."""
    return H.fuse(_marks(t), "drawing_id", "mark_key").select("drawing_id", "mark_key", "phrase", "n", "x1", "y1", "x2", "y2")


@query("callout_groups")
def _(t):
    """Callouts of all kinds by their passes: structured, qualified, diameters, chamfers, tolerances, limits, radii, angles, threads, words, and what is left."""
    return K.callouts(_marks(t), "drawing_id", "mark_key").select("drawing_id", "pass", "kind", "text", F.element_at("members", 1).alias("mark_key"), F.size("members").alias("n"))


@query("suffix_inherit")
def _(t):
    """Balloons with a letter take the value of the balloon without it, and what they had moves on. A label's value is that of the mark after it."""
    number = F.concat(F.regexp_replace("text", "[()]", ""), F.when(F.col("mark_key") % 8 == 1, "A").when(F.col("mark_key") % 8 == 3, "B").otherwise(""))
    marks = _marks(t)
    after = marks.select((F.col("mark_key") - 1).alias("mark_key"), F.col("text").alias("value"))
    labels = marks.where(F.col("text").rlike(LABEL)).join(after, "mark_key", "left")
    return H.inherit_suffixes(labels.select("drawing_id", "mark_key", number.alias("number"), F.coalesce("value", F.lit("NO_DIMENSION")).alias("value"), "conf", F.col("cx").alias("x"), F.col("cy").alias("y"), F.lit(12.0).alias("radius")), "drawing_id", "mark_key")


@query("leftover_singletons", f"SELECT token_key, drawing_id, text FROM token WHERE length(trim(text)) > 1 AND token_key NOT IN (SELECT value_key FROM ({_TOL}) UNION SELECT tolerance_key FROM ({_TOL}))")
def _(t):
    """Tokens that no pass claimed, without single letters."""
    values, tolerances = _sides(t.token)
    used = _nearest_token(values, tolerances, 90.0).select("token_key").unionByName(_nearest_token(tolerances, values, 90.0).select("token_key"))
    return t.token.where(F.char_length(F.trim("text")) > 1).join(used, "token_key", "left_anti").select("token_key", "drawing_id", "text")


_LABELS = r"regexp_matches(p.text, '^\([0-9]{1,3}\)$')"
_CALLOUTS = r"regexp_matches(o.text, '[0-9]') AND NOT regexp_matches(o.text, '^\([0-9]{1,3}\)$')"
_KIND = "CASE " + " ".join(f"WHEN regexp_matches(upper(text), '{p}') THEN '{n}'" for n, p in X.SEMANTICS) + " ELSE 'unknown' END"
_CLASSES = "CASE " + " ".join(f"WHEN kind IN ({', '.join(repr(n) for n in names.split(' '))}) THEN {score}" for names, score in G.CLASS_SCORE) + f" ELSE {G.OTHER_CLASS} END + CASE WHEN length(trim(text)) < 2 THEN {G.SHORT_TEXT} ELSE 0.0 END + CASE WHEN kind = 'unknown' THEN {G.MIXED} ELSE 0.0 END"
_AREA = "greatest(1.0, x2 - x1) * greatest(1.0, y2 - y1)"
_SHAPE = "CASE " + " ".join(f"WHEN {_AREA} > {above} THEN {score}" for above, score in G.LARGE) + " ELSE 0.0 END"
#: Px within which a label's callouts are linked.
NEAR = 260.0


@query("link_cost", f"""SELECT label_key, callout_key, round(dist + {direction_sql('(dx * 0.6 + dy * 0.8) / greatest(dist, 1.0)', 'dist')} + {_CLASSES} + {_SHAPE} + CASE WHEN n <= 1 THEN 0.0 ELSE least(10.0, n * 0.8) END, 4) AS cost
FROM (SELECT *, {_KIND} AS kind, count(*) OVER (PARTITION BY label_key) AS n FROM (SELECT p.mark_key AS label_key, o.mark_key AS callout_key, o.text, o.x1, o.y1, o.x2, o.y2, o.cx - p.cx AS dx, o.cy - p.cy AS dy, sqrt(power(p.cx - o.cx, 2) + power(p.cy - o.cy, 2)) AS dist
FROM mark p JOIN mark o ON p.drawing_id = o.drawing_id AND {_LABELS} AND {_CALLOUTS} AND sqrt(power(p.cx - o.cx, 2) + power(p.cy - o.cy, 2)) <= {NEAR}))""")
def _(t):
    """Cost of linking a label with a callout: distance, direction of its leader, class, shape, and how crowded the place is."""
    labels = t.mark.where(F.col("text").rlike(LABEL)).select("drawing_id", F.col("mark_key").alias("label_key"), F.col("cx").alias("px"), F.col("cy").alias("py"))
    callouts = t.mark.where(F.col("text").rlike(CALLOUT) & ~F.col("text").rlike(LABEL)).select("drawing_id", F.col("mark_key").alias("callout_key"), "text", "x1", "y1", "x2", "y2", F.col("cx").alias("ox"), F.col("cy").alias("oy"))
    rows = J.radius_pairs(labels, callouts, "drawing_id", NEAR).withColumns({"kind": X.semantic_class(F.col("text")), "n": F.count("*").over(Window.partitionBy("label_key"))})
    direction = G.direction_score(F.col("ox") - F.col("px"), F.col("oy") - F.col("py"), F.lit(0.6), F.lit(0.8))
    cost = F.col("dist") + direction + G.class_score(F.col("kind"), F.col("text"), F.col("kind")) + G.shape_penalty(*(F.col(c) for c in ("x1", "y1", "x2", "y2"))) + G.density_penalty(F.col("n"))
    return rows.select("label_key", "callout_key", F.round(cost, 4).alias("cost"))

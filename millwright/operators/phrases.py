"""Phrases that were read in several marks, and values that balloons with a letter take from the balloon without it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from .boxes import overlapping
from .chains import components, turns
from .filters import first_of_each
from .lineage import stored

#: Phrases of drawings, the first of which that is found counts.
PHRASES = ("ALL AROUND OUTER PROFILE", "ALL AROUND", "OUTER PROFILE", "MARK PART", "TRUE POSITION")
#: Px between the middles of the marks of a phrase, and between their boxes.
COLUMN, GAP = 30.0, 60.0


def _phrase(words: Column, phrases: tuple[str, ...]) -> Column:
    out = F.when(F.lit(False), "")
    for p in phrases:
        out = out.when(F.contains(words, F.lit(p)), p)
    return out


def fuse(marks: DataFrame, group: str, key: str, phrases: tuple[str, ...] = PHRASES, scale: float = 1.0) -> DataFrame:
    """Phrases from marks without numbers: group, key of the first mark, phrase, n, members (keys) and the box of all.

    From each mark that is left, from the top, marks below in its column are added while the gap to the last one is small;
    if what they say together holds a phrase, all of them are taken. marks: group, key, text, cx, cy, y1, y2, x1, x2.
    Marks whose columns and gaps never meet have nothing to do with each other; of those that may, one after another is the
    first mark of a phrase, in all parts of all drawings at once."""
    col, gap = COLUMN * scale, GAP * scale
    place = F.struct("cy", "cx", F.col(key).alias("key"))
    k = marks.where(X.mark_type(F.col("text")) == "keyword").select(F.col(group).alias("g"), F.col(key).alias("i"), place.alias("place"), F.upper(F.trim(F.regexp_replace("text", r"\s+", " "))).alias("t"), "cx", "x1", "y1", "x2", "y2")
    k = stored(k)
    reach = k.select("g", "i", (F.col("cx") - col).alias("x1"), F.least("y1", F.col("place.cy")).alias("y1"), (F.col("cx") + col).alias("x2"), (F.col("y2") + gap).alias("y2"))
    k = stored(turns(k, "i", "place", overlapping(reach, "g", "i")))
    left, done = k, []
    last = k.agg(F.coalesce(F.max("turn"), F.lit(0))).first()[0]
    for turn in range(1, last):  # the last of a part has nothing below it
        groups = stored(left.where(F.col("turn") == turn).select("g", "part", F.col("i").alias("seed"), F.col("cx").alias("middle"), F.col("place").alias("end"), F.col("y2").alias("low"), F.col("t").alias("words"), F.array("i").alias("members"), "x1", "y1", "x2", F.col("y2").alias("y2"), F.lit(True).alias("grows")))
        while not groups.where("grows").isEmpty():
            below = left.select("part", F.col("place").alias("p"), F.struct("place", "i", "t", "x1", "y1", "x2", "y2").alias("m"), F.col("cx").alias("at"), F.col("y1").alias("top"))
            found = groups.where("grows").select("part", "seed", "middle", "end", "low").join(below, "part").where((F.col("p") > F.col("end")) & (F.abs(F.col("at") - F.col("middle")) <= col) & (F.col("top") - F.col("low") <= gap))
            found = found.groupBy("seed").agg(F.min_by("m", "p").alias("m"))
            more, m = F.col("m").isNotNull(), lambda c: F.col(f"m.{c}")
            put = lambda new, old: F.when(more, new).otherwise(old)
            groups = stored(groups.join(found, "seed", "left").select(
                "g", "part", "seed", "middle", put(m("place"), F.col("end")).alias("end"), put(m("y2"), F.col("low")).alias("low"), put(F.concat_ws(" ", "words", m("t")), F.col("words")).alias("words"),
                put(F.concat("members", F.array(m("i"))), F.col("members")).alias("members"), *(put(f(F.col(c), m(c)), F.col(c)).alias(c) for f, c in ((F.least, "x1"), (F.least, "y1"), (F.greatest, "x2"), (F.greatest, "y2"))), (F.col("grows") & more).alias("grows"),
            ))
        hit = stored(groups.withColumn("phrase", _phrase(F.col("words"), phrases)).where("phrase is not null and size(members) > 1"))
        if not hit.isEmpty():
            done.append(hit)
            left = stored(left.join(hit.select(F.explode("members").alias("i")), "i", "left_anti"))
    kinds = f"{marks.schema[group].dataType.simpleString()}"
    if not done:
        return k.limit(0).select(F.col("g").cast(kinds).alias(group), F.col("i").alias(key), F.lit("").alias("phrase"), F.lit(0).cast("long").alias("n"), F.array("i").alias("members"), "x1", "y1", "x2", "y2")
    return reduce(DataFrame.unionByName, done).select(F.col("g").alias(group), F.col("seed").alias(key), "phrase", F.size("members").cast("long").alias("n"), "members", "x1", "y1", "x2", "y2")


#: What a value is written as when there is none; confidence that a taken value has at least, and below which a value may be replaced.
NOTHING, FLOOR, WEAK = "NO_DIMENSION", 0.50, 0.35
#: Px within which a displaced value looks for a balloon, and by which the nearest one must be nearer than the next.
FAR, CLEAR = 260.0, 25.0


def inherit_suffixes(balloons: DataFrame, group: str, key: str) -> DataFrame:
    """balloons (group, key, number, value, conf, x, y, radius) with value, conf and reason as they are after a pass in the order of key.

    A balloon whose number ends in letters takes the value of the one without them (of several, the last), unless it has a value of
    more than three characters and that one's isn't a number of one or two digits. What it had moves on, if it looks like a value,
    to the nearest balloon in reach whose own value is missing, short or unsure, unless two are about equally near. Balloons that
    can't have to do with each other, by numbers or reach, are worked on together."""
    b = balloons.select(F.col(group).alias("g"), F.col(key).alias("k"), F.coalesce(F.col("number").cast("string"), F.lit("")).alias("number"), F.trim(F.coalesce("value", F.lit(""))).alias("value"), F.coalesce("conf", F.lit(0.0)).alias("conf"), "x", "y", F.greatest(F.lit(FAR), 5.0 * F.greatest(F.lit(1.0), F.coalesce("radius", F.lit(1.0)))).alias("reach"))
    b = stored(b.withColumns({"base": F.regexp_replace("number", "[A-Za-z]+$", ""), "reason": F.lit(None).cast("string")}))
    donors = b.groupBy("g", F.col("number").alias("base")).agg(F.max("k").alias("donor"))
    suffix = stored(b.where("base <> '' and base <> number").join(donors, ["g", "base"]).select("g", "k", "donor", "x", "y", "reach"))
    circle = lambda r: [(F.col("x") - r).alias("x1"), (F.col("y") - r).alias("y1"), (F.col("x") + r).alias("x2"), (F.col("y") + r).alias("y2")]
    # a balloon with letters and the places that it can change or look at; others are points
    boxes = suffix.select("g", "k", *circle(F.col("reach"))).unionByName(b.join(suffix.select("k"), "k", "left_anti").select("g", "k", *circle(F.lit(0.0))))
    # points that meet alone have nothing to do with each other
    met = overlapping(boxes, "g", "k").join(suffix.select(F.col("k").alias("a"), F.lit(True).alias("sa")), "a", "left").join(suffix.select(F.col("k").alias("b"), F.lit(True).alias("sb")), "b", "left").where("sa or sb").select("a", "b")
    pairs = met.unionByName(suffix.select(F.col("k").alias("a"), F.col("donor").alias("b")))
    parts = stored(components(pairs).withColumnRenamed("item", "k"))
    order = stored(suffix.select("k", "donor", "reach").join(parts, "k").withColumn("turn", F.row_number().over(Window.partitionBy("part").orderBy("k"))))
    state = stored(b.join(parts, "k", "left"))
    squeezed = lambda c: F.upper(F.regexp_replace(c, r"\s+", ""))
    short = lambda c: (F.col(c) == NOTHING) | (F.char_length(c) <= 3)
    for turn in range(1, order.agg(F.coalesce(F.max("turn"), F.lit(0))).first()[0] + 1):
        now = order.where(F.col("turn") == turn).select("k", "donor", "reach", "part")
        own = now.join(state.select("k", "number", "base", "value", "x", "y"), "k").join(state.select(F.col("k").alias("donor"), F.col("value").alias("given")), "donor")
        takes = (F.col("given") != "") & (F.col("given") != NOTHING) & (squeezed("value") != squeezed("given")) & (short("value") | F.col("given").rlike("^[0-9]{1,2}$"))
        own = stored(own.where(takes))
        if own.isEmpty():
            continue
        moved = own.where((F.col("value") != NOTHING) & F.col("value").rlike("[0-9]") & ((F.char_length("value") > 3) | F.col("value").rlike("[A-Za-zØΦ±°×/().]")))
        free = state.where(short("value") | (F.col("conf") < WEAK)).select("part", F.col("k").alias("other"), F.col("number").alias("n2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
        # one balloon of each part looks at those of its part
        near = moved.join(free, "part").where((F.col("other") != F.col("k")) & (F.col("n2") != F.col("base"))).withColumn("d", F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2"))).where(F.col("d") <= F.col("reach"))
        two = first_of_each(near, ["k"], ["d", "other"], 2).groupBy("k", "value", "number").agg(F.sort_array(F.collect_list(F.struct("d", "other"))).alias("all"))
        sent = two.where((F.size("all") == 1) | (F.get("all", F.lit(1))["d"] - F.col("all")[0]["d"] >= CLEAR)).select(F.col("all")[0]["other"].alias("k"), F.col("value").alias("v"), F.concat(F.lit("transferred_from_suffix_"), "number").alias("r"))
        changed = stored(own.select("k", F.col("given").alias("v"), F.concat(F.lit("shared_dim_suffix_"), "base").alias("r")).unionByName(sent))
        state = stored(state.join(changed, "k", "left").select("g", "k", "number", F.coalesce("v", "value").alias("value"), F.when(F.col("v").isNotNull(), F.greatest("conf", F.lit(FLOOR))).otherwise(F.col("conf")).alias("conf"), "x", "y", "reach", "base", "part", F.coalesce("r", "reason").alias("reason")))
    return state.select(F.col("g").alias(group), F.col("k").alias(key), "number", "value", "conf", "reason")

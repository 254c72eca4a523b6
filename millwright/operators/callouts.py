"""Callouts of drawings: passes, each for one kind, propose groups of marks; a mark belongs to the first group that claims it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from .boxes import overlapping
from .chains import components
from .claims import greedy_sets
from .lineage import stored
from .phrases import PHRASES

# How marks of each kind are written. (?i) where letters of either case count.
THREAD_PART, FIT, WHOLE_THREAD = r"(?i)MJ?[0-9]+[X.][0-9]+", r"(?i)[0-9]+H[0-9]+H", r"(?i)MJ?[0-9]+X[0-9]+|[0-9]+H[0-9]+H|^M[0-9]+$"
#: Leading and following marks of a structured callout.
STRUCTURED = (("thread", THREAD_PART, FIT), ("diameter_tolerance", r"(?iu)[ØO][0-9]+\.?[0-9]*", r"±[0-9]+\.?[0-9]*"), ("chamfer", r"(?i)[A-Z][0-9]+", r"(?i)[0-9]+\.?[0-9]*X[0-9]+°"))
QUALIFIER, NUMBER = r"(?i)^\([A-Z0-9][A-Z0-9 ._-]{1,24}\)$", r"^[0-9]+\.?[0-9]*$"
CHAMFER, CHAMFER_PREFIX = r"(?i)[0-9]+(\.[0-9]+)?[x×][0-9]+|CHAMFER", r"(?i)^([A-Z][0-9]+|\(?[0-9]+\)?)$"
TOLERANCE, BARE_TOLERANCE, LEADING_ZERO = r"^(±|[+-])\s*[0-9]", r"^(±|[+-])\s*[0-9]+(\.[0-9]+)?$", r"^[Øø]?\s*0\.[0-9]+$"
RADIUS, ANGLE, NOTES = r"(?i)R[0-9]|[0-9]R|RADIUS\s*[0-9]|TYP", r"(?i)°|[0-9]\s*DEG", "TYP REF MAX MIN NOM BSC TRUE APPROX THRU DEEP CBORE CSINK SPOTFACE TT NO_DIMENSION"


def _sides(k: DataFrame) -> DataFrame:
    """Ordered pairs of marks that any pass can put together, with a_ and b_."""
    h = F.greatest(F.lit(1.0), F.col("y2") - F.col("y1"))
    high = F.greatest(F.lit(40.0), 1.2 * h)
    cols = ["g", "i", "text", "t", "type", "cx", "cy", "h"]
    reach = k.select(*cols[:-1], h.alias("h"), (F.col("cx") - 90).alias("x1"), (F.col("cy") - high).alias("y1"), (F.col("cx") + 90).alias("x2"), (F.col("cy") + high).alias("y2"))
    met = overlapping(reach, "g", "i", keep=cols)
    sides = lambda a, b: met.select(*(F.col(f"{p}_{c}").alias(f"{q}_{c}") for p, q in ((a, "a"), (b, "b")) for c in cols))
    rows = sides("a", "b").unionByName(sides("b", "a"))
    return stored(rows.withColumns({"dx": F.abs(F.col("a_cx") - F.col("b_cx")), "dy": F.abs(F.col("a_cy") - F.col("b_cy"))}))


def _rank(number: int, *order: Column) -> Column:
    """Pass, up to three numbers, marks: the order in which groups claim."""
    values = [*(o.cast("double") for o in order), *[F.lit(0.0)] * (3 - len(order))]
    return F.struct(F.lit(number).alias("pass"), *(v.alias(f"o{n}") for n, v in enumerate(values)))


def _pairs(rows: DataFrame, number: int, kind: Column, text: Column, *order: Column) -> DataFrame:
    """Pairs that a pass takes one after another in its order, each of marks that it has left; ties by the marks' own order."""
    rank = F.struct(_rank(number, *order).alias("r"), F.col("a_i").alias("i"), F.col("b_i").alias("j"))
    return greedy_sets(rows.select(rank.alias("rank"), F.array("a_i", "b_i").alias("tokens"), kind.alias("kind"), text.alias("text"), F.col("a_g").alias("g")), "rank", "tokens")


def _singles(k: DataFrame, number: int, kind: Column) -> DataFrame:
    rank = F.struct(_rank(number).alias("r"), F.col("i"), F.col("i").alias("j"))
    return k.select(rank.alias("rank"), F.array("i").alias("tokens"), kind.alias("kind"), "text", "g")


def _along() -> Column:
    """Both texts, the left one first; of marks at one place, that of the leading mark."""
    return F.when(F.col("b_cx") < F.col("a_cx"), F.concat_ws(" ", "b_text", "a_text")).otherwise(F.concat_ws(" ", "a_text", "b_text"))


def _diameters(k: DataFrame, both: DataFrame) -> DataFrame:
    """Marks that name a diameter, each with the first two values near it that are left. Marks that no value connects take their turns together."""
    leads = k.where(F.contains(F.upper("text"), F.lit("DIA"))).select("g", "i", "text")
    near = both.where(F.contains(F.upper("a_text"), F.lit("DIA")) & (F.col("dx") < 120) & (F.col("dy") < F.greatest(F.lit(60), F.floor(F.col("a_h") * 0.9))))
    near = near.where(F.col("b_text").rlike("[0-9]") & ~F.col("b_text").rlike(WHOLE_THREAD) & ~F.col("b_text").rlike(THREAD_PART) & (F.col("b_type") != "keyword"))
    near = stored(near.select(F.col("a_i").alias("i"), F.col("b_i").alias("j"), F.col("b_text").alias("value")))
    parts = components(near.select(F.col("i").alias("a"), F.col("j").alias("b")))
    order = stored(leads.join(parts, leads.i == parts.item, "left").select("g", "i", "text", F.coalesce("part", "i").alias("part")).withColumn("turn", F.row_number().over(Window.partitionBy("part").orderBy("i"))))
    used, out = k.select("i").limit(0), []
    for turn in range(1, order.agg(F.coalesce(F.max("turn"), F.lit(0))).first()[0] + 1):
        now = order.where(F.col("turn") == turn).join(used, "i", "left_anti")
        free = near.join(used.withColumnRenamed("i", "j"), "j", "left_anti")
        first = free.join(now.select("i"), "i").withColumn("n", F.row_number().over(Window.partitionBy("i").orderBy("j"))).where("n <= 2")
        values = first.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "value"))).alias("v"))
        got = stored(now.join(values, "i", "left").withColumn("v", F.coalesce("v", F.array().cast("array<struct<j:bigint,value:string>>"))))
        out.append(got)
        used = stored(used.unionByName(got.select(F.explode(F.concat(F.array("i"), F.col("v.j"))).alias("i"))))
    if not out:
        return _singles(k.limit(0), 2, F.lit("diameter"))
    rank = F.struct(_rank(2).alias("r"), F.col("i"), F.col("i").alias("j"))
    return reduce(DataFrame.unionByName, out).select(rank.alias("rank"), F.concat(F.array("i"), F.col("v.j")).alias("tokens"), F.lit("diameter").alias("kind"), F.array_join(F.concat(F.array("text"), F.col("v.value")), " ").alias("text"), "g")


def proposals(marks: DataFrame, group: str, key: str) -> tuple[DataFrame, DataFrame]:
    """The marks that take part (g, i: a number in their order, ...), and the groups of all passes: rank, tokens, kind, text, g."""
    k = marks.withColumn("type", X.mark_type(F.col("text"))).where("type <> 'bubble'")
    k = k.select(F.col(group).alias("g"), F.col(key).cast("long").alias("i"), "text", F.trim("text").alias("t"), "type", "cx", "cy", "y1", "y2")
    same = k.groupBy("g", F.upper("t"), F.bround("cx"), F.bround("cy")).agg(F.min("i").alias("i"))  # read twice at one place
    k = stored(k.join(same.select("i"), "i", "left_semi"))
    both = _sides(k)
    has = lambda side, p: F.col(f"{side}_text").rlike(p)
    slash = lambda side: F.contains(F.col(f"{side}_text"), F.lit("/"))
    number = lambda side: F.col(f"{side}_t").rlike(NUMBER)
    diameter = lambda side: X.is_diameter(F.col(f"{side}_text"))
    radius = lambda side: F.upper(f"{side}_text").rlike(X.RADIUS)
    apart = F.hypot("dx", "dy")
    passes = []
    # 0: marks that hold a thread and its fit, then pairs of a leading and a following mark
    full = k.where(F.col("text").rlike(THREAD_PART) & F.col("text").rlike(FIT))
    passes.append(_singles(full, 0, F.lit("thread")).withColumn("rank", F.struct(_rank(0, F.lit(-1)).alias("r"), F.col("rank.i").alias("i"), F.col("rank.j").alias("j"))))
    close = both.where("dx < 120 and dy < 50 and b_i > a_i")
    alone = full.select("i")
    close = close.join(alone.withColumnRenamed("i", "a_i"), "a_i", "left_anti").join(alone.withColumnRenamed("i", "b_i"), "b_i", "left_anti")
    lead = [has("a", a) & has("b", b) & (~slash("a") & ~slash("b") if name == "diameter_tolerance" else F.lit(True)) for name, a, b in STRUCTURED]
    # a pair that fits several patterns may be taken by each of them
    kinds = F.filter(F.array(*(F.when(c, F.struct(F.lit(n).alias("n"), F.lit(name).alias("kind"))) for n, (c, (name, *_)) in enumerate(zip(lead, STRUCTURED, strict=True)))), lambda x: x.isNotNull())
    passes.append(_pairs(close.withColumn("k", F.explode(kinds)).where("k is not null"), 0, F.col("k.kind"), _along(), F.col("k.n")))
    # 1: a value and the nearest qualifier in parentheses
    fits = (diameter("a") | radius("a") | number("a")) & F.col("b_t").rlike(QUALIFIER) & (F.col("dx") <= 180) & (F.col("dy") <= F.greatest(F.lit(70.0), (F.col("a_h") + F.col("b_h")) * 0.9))
    passes.append(_pairs(both.where(fits), 1, F.lit("keyword"), F.concat_ws(" ", "a_text", "b_text"), F.col("a_i"), apart))
    # 2: named diameters
    passes.append(_diameters(k, both))
    # 3: a chamfer and what stands before it
    passes.append(_pairs(both.where(F.col("a_t").rlike(CHAMFER_PREFIX) & has("b", CHAMFER)).where("dx < 120 and dy < 50"), 3, F.lit("chamfer"), _along()))
    # 4: a value and a tolerance: in one column first, then the nearest, then longer values
    value = (diameter("a") | number("a")) & ~F.contains(F.col("a_text"), F.lit("±")) & ~slash("a") & ~F.col("a_t").rlike(LEADING_ZERO)
    fits = value & ~slash("b") & F.col("b_t").rlike(TOLERANCE) & (F.col("dx") < 150) & (F.col("dy") < F.greatest(F.lit(60.0), (F.col("a_h") + F.col("b_h")) * 1.2))
    column = F.col("dx") <= F.greatest(F.lit(45.0), 0.35 * F.greatest("a_h", "b_h"))
    passes.append(_pairs(both.where(fits), 4, F.lit("diameter_tolerance"), _along(), F.when(column, 0).otherwise(1), apart, -F.char_length(F.regexp_replace("a_text", "[^0-9]", ""))))
    # 5: two limits in one mark, or above each other
    passes.append(_singles(k.where(F.contains("text", F.lit("/")) & F.col("text").rlike("[0-9]")), 5, F.lit("numeric_pair")))
    above = both.where("dx < 80 and dy < 60 and dy > 5").where(number("a") & number("b") & ~X.independent_values(F.col("a_t"), F.col("b_t")))
    passes.append(_pairs(above, 5, F.lit("numeric_pair"), F.when(F.col("a_cy") < F.col("b_cy"), F.concat_ws("/", "a_text", "b_text")).otherwise(F.concat_ws("/", "b_text", "a_text"))))
    # 6 to 8: radii, angles, threads
    for n, kind, pattern in ((6, "radius", RADIUS), (7, "angle", ANGLE), (8, "thread", WHOLE_THREAD)):
        passes.append(_singles(k.where(F.col("text").rlike(pattern)), n, F.lit(kind)))
    # 9: words, and phrases with the nearest number; single letters are datums
    up = F.upper("t")
    words = k.where(((F.col("type") == "keyword") | up.isin(NOTES.split(" "))) & ~F.col("t").rlike("^[A-Z]$"))
    is_phrase = reduce(lambda x, y: x | y, (F.contains(F.upper("a_t"), F.lit(p)) | F.contains(F.lit(p), F.upper("a_t")) for p in PHRASES))
    noted = both.join(words.select(F.col("i").alias("a_i")), "a_i", "left_semi").where(is_phrase & has("b", "[0-9]")).where("dx < 150 and dy < 80")
    noted = stored(_pairs(noted, 9, F.lit("keyword"), F.concat_ws(" ", "b_text", "a_text"), F.col("a_i"), apart))
    passes += [noted, _singles(words.join(noted.select(F.explode("tokens").alias("i")), "i", "left_anti"), 9, F.lit("keyword"))]
    return k, reduce(DataFrame.unionByName, passes)


def callouts(marks: DataFrame, group: str, key: str) -> DataFrame:
    """group, pass, kind, text and members (keys, as numbers, sorted) of every callout of `marks` (group, key, text, cx, cy, y1, y2). What no pass claims stands alone, as pass 10."""
    k, groups = proposals(marks, group, key)
    valid = (F.trim("text") != "") & ~((F.col("kind") == "diameter_tolerance") & F.contains("text", F.lit("/")))
    got = stored(greedy_sets(groups.where(valid), "rank", "tokens"))
    rest = k.join(got.select(F.explode("tokens").alias("i")), "i", "left_anti").withColumn("kind", X.semantic_class(F.col("text"))).where("t <> ''")
    rest = rest.where(~((F.col("kind") == "tolerance") & F.col("t").rlike(BARE_TOLERANCE)))
    cols = ["g", F.col("rank.r.pass").alias("pass"), "kind", "text", F.array_sort("tokens").alias("members")]
    return got.select(*cols).unionByName(_singles(rest, 10, F.col("kind")).select(*cols)).withColumnRenamed("g", group)

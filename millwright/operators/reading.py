"""Reading order: rows that begin at an anchor, numbers along them; stacks of marks above each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from .chains import greedy_chains
from .lineage import stored

#: Px between the middles of marks of one column, and between the boxes of marks of one stack (less than 0: they overlap).
COLUMN, LEAST_GAP, MOST_GAP = 24.0, -12.0, 5.0


def anchors(heights: DataFrame, group: str, y: str, tolerance: float) -> DataFrame:
    """Adds `anchor` to the distinct (group, y): the height at which its row begins. The first height of a group is one; the next is
    the first height at least `tolerance` below it.

    Which heights are anchors looks sequential, but each height has one that would be next if it were one. From the top,
    anchors are what these pointers reach; with the pointers doubled in each round, a group of n rows takes log2(n) rounds."""
    h = heights.select(group, y).where(f"`{group}` is not null and `{y}` is not null").distinct()
    after = f"min(`{y}`) over (partition by `{group}` order by cast(`{y}` as double) range between {float(tolerance)}D following and unbounded following)"
    jump = stored(h.select(group, y, F.expr(after).alias("__next")))
    reached = jump.groupBy(group).agg(F.min(y).alias(y))
    jumps = jump.where("__next is not null")
    while not jumps.isEmpty():
        reached = stored(reached.unionByName(reached.join(jumps, [group, y]).select(group, F.col("__next").alias(y))))
        second = jumps.select(group, F.col(y).alias("__next"), F.col("__next").alias("__then"))
        jumps = stored(jumps.join(second, [group, "__next"]).select(group, y, F.col("__then").alias("__next")))
    so_far = Window.partitionBy(group).orderBy(y).rowsBetween(Window.unboundedPreceding, 0)
    marked = jump.select(group, y).join(reached.distinct().withColumn("__a", F.col(y)), [group, y], "left")
    return marked.select(group, y, F.last("__a", ignorenulls=True).over(so_far).alias("anchor"))


def reading_order(items: DataFrame, group: str, x: str, y: str, key: str, tolerance: float = 30.0) -> DataFrame:
    """Adds `number`, 1 and so on within each group: rows of anchors() from the top, and along x in each; ties by y and key.
    Items without a place or a group have none. The windows run over rows of a group and items of a row, not over items of a group."""
    rows = anchors(items, group, y, tolerance)
    placed = items.join(stored(rows), [group, y], "left")
    counts = placed.where("anchor is not null").groupBy(group, "anchor").agg(F.count(x).alias("__n"))
    before = Window.partitionBy(group).orderBy("anchor").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(group, "anchor", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    along = Window.partitionBy(group, "anchor").orderBy(F.col(x).asc_nulls_last(), y, key)
    numbered = placed.join(starts, [group, "anchor"], "left").withColumn("number", F.when(F.col("anchor").isNotNull() & F.col(x).isNotNull(), F.col("__before") + F.row_number().over(along)))
    return numbered.select(*[F.col(f"`{c}`") for c in items.columns], "anchor", "number")


def _follow(marks: DataFrame, group: str, key: str, scale: float) -> DataFrame:
    """(u, v, pu, pv): marks of one column whose boxes touch, with v below and later in the order of columns and heights."""
    place = F.struct(F.bround(F.col("cx") / (COLUMN * scale)).alias("column"), F.col("cy").alias("cy"), F.col(key).alias("key"))
    k = marks.select(F.col(group).alias("g"), F.col(key).alias("i"), place.alias("p"), F.trim("text").alias("t"), "cx", "y1", "y2")
    wide, high = COLUMN * scale, 32.0 * scale
    low, top = F.col("y2") + LEAST_GAP * scale, F.col("y2") + MOST_GAP * scale
    upper = k.withColumn("cell_x", F.explode(F.array(*(F.floor(F.col("cx") / wide) + d for d in (-1, 0, 1))))).withColumn("cell_y", F.explode(F.sequence(F.floor(low / high), F.floor(top / high))))
    upper = upper.select("g", "cell_x", "cell_y", F.col("i").alias("u"), F.col("p").alias("pu"), F.col("t").alias("tu"), F.col("cx").alias("xu"), low.alias("low"), top.alias("top"))
    lower = k.select("g", F.floor(F.col("cx") / wide).alias("cell_x"), F.floor(F.col("y1") / high).alias("cell_y"), F.col("i").alias("v"), F.col("p").alias("pv"), F.col("t").alias("tv"), F.col("cx").alias("xv"), F.col("y1").alias("yv"))
    whole = F.col("tu").rlike("^[0-9]{2,}$") & F.col("tv").rlike("^[0-9]{2,}$")
    apart = whole | (X.is_diameter(F.col("tu")) & X.is_diameter(F.col("tv"))) | X.independent_values(F.col("tu"), F.col("tv"))
    near = (F.abs(F.col("xu") - F.col("xv")) <= wide) & F.col("yv").between(F.col("low"), F.col("top")) & (F.col("pu") < F.col("pv"))
    return upper.join(lower, ["g", "cell_x", "cell_y"]).where(near & ~apart).select("u", "v", "pu", "pv")


def stacks(marks: DataFrame, group: str, key: str, scale: float = 1.0) -> DataFrame:
    """Stacks of two marks and more: group, key of the first in order, n, text, kind (dimension or keyword), conf, and the box of all.

    marks: group, key, text, conf, cx, cy, x1, y1, x2, y2. Bubbles take no part; whole numbers of two digits, diameters and
    values that are no limits of one another don't stand in one stack. Words come before values; a note in parentheses
    keeps its order; values alone have a slash between them. A decimal that was cut in two upright pieces is put together."""
    k = marks.withColumn("type", X.mark_type(F.col("text"))).where("type <> 'bubble'")
    heads = greedy_chains(_follow(k, group, key, scale)).select(F.col("item").alias(key), F.col("head.key").alias("first"))
    # a stack is a list of what stands in one column of a page
    one = F.struct("cy", key, F.trim("text").alias("t"), F.col("text"), (F.col("type") == "keyword").alias("word"), ((F.col("y2") - F.col("y1")) > 1.2 * F.greatest(F.lit(1.0), F.col("x2") - F.col("x1"))).alias("tall"))
    g = k.join(heads, key).groupBy(group, "first").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(one)).alias("l"), F.avg("conf").alias("conf"), *(f(c).alias(c) for f, c in ((F.min, "x1"), (F.min, "y1"), (F.max, "x2"), (F.max, "y2"))))
    words, values = F.filter("l", lambda m: m["word"]), F.filter("l", lambda m: ~m["word"])
    note = F.exists("l", lambda m: m["t"].startswith("(")) & F.exists("l", lambda m: m["t"].endswith(")"))
    upper, lower = F.col("l")[0], F.get("l", F.lit(1))
    cut = (F.size(words) == 0) & (F.col("n") == 2) & upper["t"].rlike(r"^0\.[0-9]+$") & lower["t"].rlike(r"^[0-9]+\.?$") & upper["tall"] & lower["tall"]
    joined = F.concat(F.regexp_replace(lower["t"], r"\.$", ""), F.lit("."), F.substr(upper["t"], F.lit(3)))
    text = F.when(cut, joined).when(note, F.array_join("l.text", " ")).when(F.size(words) > 0, F.array_join(F.concat(words["text"], values["text"]), " ")).otherwise(F.array_join("l.text", " / "))
    kind = F.when(F.size(values) == 0, "keyword").otherwise("dimension")
    return g.where("n >= 2").select(group, F.col("first").alias(key), F.col("n").cast("long").alias("n"), text.alias("text"), kind.alias("kind"), "conf", "x1", "y1", "x2", "y2")

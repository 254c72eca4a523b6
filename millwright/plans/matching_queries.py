"""Queries of matching, deduplication, scoring and retrieval."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..operators import aggregates as A, filters as B, joins as J, sweep as W, vector_index as V
from ..operators.lineage import stored
from ..operators.nearest import best_within
from ..operators.vectors import nearest
from ..registry import query
from .text_queries import dimension_sql, value_match_sql


def suggestions(emails, threshold: float = 0.7, arrived=None):
    """Scored candidate pairs of mails (a new one, b converted): same thread, direct or reverse reply, by equi-joins. a is any mail, or one of those that `arrived` (message_id)."""
    thread = F.coalesce("in_reply_to", "message_id")
    own = emails.select("message_id", "in_reply_to", thread.alias("thread"), X.clean_subject(F.col("subject")).alias("clean"), "from_email", "received_hour", "converted_task")
    new = own if arrived is None else own.join(arrived.select("message_id").distinct(), "message_id", "left_semi")
    a = new.select(*[F.col(c).alias(f"a_{c}") for c in own.columns])
    b = own.where("converted_task is not null").select(*[F.col(c).alias(f"b_{c}") for c in own.columns])
    pairs = J.or_join(a, b, [("a_thread", "b_thread"), ("a_message_id", "b_in_reply_to"), ("a_in_reply_to", "b_message_id")], [*a.columns, *b.columns]).where("a_message_id <> b_message_id")
    base = F.when(F.col("a_in_reply_to") == F.col("b_message_id"), 0.8).when(F.col("b_in_reply_to") == F.col("a_message_id"), 0.8).when(F.col("a_thread") == F.col("b_thread"), 0.7).otherwise(0.0)
    score = base + F.when(F.col("a_clean") == F.col("b_clean"), 0.2).otherwise(0.0) + F.when(F.col("a_from_email") == F.col("b_from_email"), 0.1).otherwise(0.0)
    return pairs.withColumn("score", F.round(F.least(score, F.lit(1.0)), 4)).where(F.col("score") >= threshold)


_CLEAN = r"regexp_replace(regexp_replace(trim(regexp_replace(subject, '\s+', ' ', 'g')), '^(re:\s*)+', '', 'i'), '^(fw:\s*)+', '', 'i')"
_PAIRS = f"""(SELECT a.message_id AS a_id, b.message_id AS b_id, b.received_hour AS hour, round(least(1.0, CASE WHEN a.in_reply_to = b.message_id OR b.in_reply_to = a.message_id THEN 0.8 ELSE 0.7 END + CASE WHEN a.c = b.c THEN 0.2 ELSE 0 END + CASE WHEN a.from_email = b.from_email THEN 0.1 ELSE 0 END), 4) AS score
  FROM (SELECT *, {_CLEAN} AS c FROM email) a JOIN (SELECT *, {_CLEAN} AS c FROM email) b ON a.message_id <> b.message_id AND b.converted_task IS NOT NULL AND (coalesce(a.in_reply_to, a.message_id) = coalesce(b.in_reply_to, b.message_id) OR b.in_reply_to = a.message_id OR a.in_reply_to = b.message_id))"""


@query("email_candidates", f"SELECT a_id, b_id FROM {_PAIRS}")
def _(t):
    return suggestions(t.email, 0).select(F.col("a_message_id").alias("a_id"), F.col("b_message_id").alias("b_id"))


@query("email_confidence", f"SELECT a_id, b_id, CAST(score AS DOUBLE) AS score FROM {_PAIRS}")
def _(t):
    return suggestions(t.email, 0).select(F.col("a_message_id").alias("a_id"), F.col("b_message_id").alias("b_id"), "score")


@query("email_suggestion", f"SELECT a_id, b_id FROM (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY score DESC, hour, b_id) AS rn FROM {_PAIRS} WHERE score >= 0.7) WHERE rn = 1")
def _(t):
    s = suggestions(t.email).select(F.col("a_message_id").alias("a_id"), F.col("b_message_id").alias("b_id"), "score", F.col("b_received_hour").alias("hour"))
    return B.first_of_each(s, ["a_id"], [F.desc("score"), "hour", "b_id"]).select("a_id", "b_id")


@query("late_relink", f"SELECT message_id FROM email WHERE converted_task IS NULL AND message_id NOT IN (SELECT a_id FROM {_PAIRS} WHERE score >= 0.7)")
def _(t):
    linked = suggestions(t.email).select(F.col("a_message_id").alias("message_id"))
    return t.email.where("converted_task is null").join(linked, "message_id", "left_anti").select("message_id")


@query("duplicate_deviation", "SELECT part_key, stage, engine, count(*) AS n FROM ncr GROUP BY 1, 2, 3 HAVING count(*) > 1")
def _(t):
    return t.ncr.groupBy("part_key", "stage", "engine").agg(F.count("*").alias("n")).where("n > 1")


_ZONES = f"(SELECT mark_key, drawing_id, CAST(floor(cx / 500) AS BIGINT) AS zone, {dimension_sql('raw')} AS dim FROM mark)"


@query("duplicate_groups", f"SELECT mark_key, dense_rank() OVER (ORDER BY drawing_id, zone, dim) AS group_id, n FROM (SELECT *, count(*) OVER (PARTITION BY drawing_id, zone, dim) AS n FROM {_ZONES} WHERE dim <> '') WHERE n > 1")
def _(t):
    """Marks of one drawing and zone that say the same after normalising, with the group's number and size."""
    marks = stored(t.mark.select("mark_key", "drawing_id", F.floor(F.col("cx") / 500).cast("long").alias("zone"), "raw"))
    rows = stored(J.per_value(marks, "raw", dim=X.normalize_dimension(F.col("raw"))).where("dim <> ''").select("mark_key", "drawing_id", "zone", "dim"))
    groups = rows.groupBy("drawing_id", "zone", "dim").agg(F.count("*").alias("n")).where("n > 1")
    numbered = A.number_rows(groups, "drawing_id", ["drawing_id", "zone", "dim"]).withColumnRenamed("number", "group_id")
    return rows.join(numbered, ["drawing_id", "zone", "dim"]).select("mark_key", "group_id", "n")


#: A JSON array, or a comma list without empty entries.
_SERIALS = """CASE WHEN trim(serial_nos) LIKE '[%]' THEN CAST(from_json(serial_nos, '["VARCHAR"]') AS VARCHAR[]) ELSE list_filter(list_transform(string_split(serial_nos, ','), lambda x: trim(x)), lambda x: x <> '') END"""


@query("serial_usage", f"SELECT s AS serial, count(DISTINCT build_name) AS builds FROM (SELECT build_name, unnest({_SERIALS}) AS s FROM serial_text) GROUP BY 1")
def _(t):
    s = t.serial_text.select("build_name", F.explode(X.parse_serials(F.col("serial_nos"))).alias("serial"))
    return s.groupBy("serial").agg(F.count_distinct("build_name").alias("builds"))


_TOK = "(SELECT DISTINCT drawing_id, text, cx, cy FROM token)"


@query("token_exact_dedup", "SELECT drawing_id, upper(text) AS text, cx, cy, max(conf) AS conf FROM token GROUP BY 1, 2, 3, 4")
def _(t):
    k = t.token.select("drawing_id", F.upper("text").alias("text"), F.bround("cx").alias("cx"), F.bround("cy").alias("cy"), "conf", "token_key")
    return B.first_of_each(k, ["drawing_id", "text", "cx", "cy"], [F.desc("conf"), "token_key"]).select("drawing_id", "text", "cx", "cy", "conf")


def _points(t):
    """Labels and numbers, each place and text of a drawing once."""
    k = t.token.select("drawing_id", "text", "cx", "cy").distinct()
    p = k.where("text = '(08)'").select("drawing_id", F.col("cx").alias("px"), F.col("cy").alias("py"))
    o = k.where("text <> '(08)'").select("drawing_id", F.col("text").alias("value"), F.col("cx").alias("ox"), F.col("cy").alias("oy"))
    return p, o


_NEAR = f"(SELECT p.drawing_id, p.cx AS px, p.cy AS py, o.text AS value, o.cx AS ox, o.cy AS oy, sqrt(power(p.cx - o.cx, 2) + power(p.cy - o.cy, 2)) AS dist FROM {_TOK} p JOIN {_TOK} o ON p.drawing_id = o.drawing_id AND p.text = '(08)' AND o.text <> '(08)' AND sqrt(power(p.cx - o.cx, 2) + power(p.cy - o.cy, 2)) <= 60)"


@query("radius_join", f"SELECT drawing_id, px, py, value, round(dist, 4) AS dist FROM {_NEAR}")
def _(t):
    label = F.col("text") == "(08)"
    pairs = W.pairs_in_reach(t.token, "drawing_id", "cx", "cy", label, ~label, (60.0, 60.0), lambda dx, dy: np.sqrt(dx * dx + dy * dy) <= 60, ["text"], distinct=True)
    dx, dy = F.col("a_x") - F.col("b_x"), F.col("a_y") - F.col("b_y")
    rounded = F.floor(F.sqrt(dx * dx + dy * dy) * 10000 + 0.5) / 10000  # as SQL's round; Spark's goes through decimals, which takes most of the time
    return pairs.select("drawing_id", F.col("a_x").alias("px"), F.col("a_y").alias("py"), F.col("b_text").alias("value"), rounded.alias("dist"))


@query("neighbour_count", f"SELECT p.drawing_id, p.cx AS px, p.cy AS py, count(n.value) AS n FROM (SELECT * FROM {_TOK} WHERE text = '(08)') p LEFT JOIN {_NEAR} n ON n.drawing_id = p.drawing_id AND n.px = p.cx AND n.py = p.cy GROUP BY 1, 2, 3")
def _(t):
    p, o = _points(t)
    places = o.groupBy("drawing_id", "ox", "oy").agg(F.count("value").alias("n"))
    # a label's pairs are added up in each of its nine cells, before they move
    counts = J.radius_pairs(p, places, "drawing_id", 60.0).groupBy("drawing_id", "px", "py").agg(F.sum("n").alias("n"))
    return p.join(counts, ["drawing_id", "px", "py"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("nearest_donor", f"SELECT drawing_id, px, py, value FROM (SELECT *, row_number() OVER (PARTITION BY drawing_id, px, py ORDER BY round(dist, 6), value, ox, oy) AS rn FROM {_NEAR}) WHERE rn = 1")
def _(t):
    p, o = _points(t)
    return best_within(p, o, "drawing_id", 60.0, ["value"]).select("drawing_id", "px", "py", "value")


@query("ambiguity_gap", f"SELECT drawing_id, px, py, round(d2 - d1, 4) AS gap, coalesce(round(d2 - d1, 4) < 20, false) AS ambiguous FROM (SELECT drawing_id, px, py, min(dist) AS d1, list_sort(list(dist))[2] AS d2 FROM {_NEAR} GROUP BY 1, 2, 3)")
def _(t):
    p, o = _points(t)
    places = o.groupBy("drawing_id", "ox", "oy").agg(F.count("*").alias("texts"))
    first = stored(best_within(p, places, "drawing_id", 60.0, [], ["texts"]).select("drawing_id", "px", "py", F.col("dist").alias("d1"), F.col("ox").alias("fx"), F.col("oy").alias("fy"), "texts"))
    other = (F.col("ox") != F.col("fx")) | (F.col("oy") != F.col("fy"))
    second = best_within(first.where("texts = 1").select("drawing_id", "px", "py", "fx", "fy"), places, "drawing_id", 60.0, [], allowed=other)
    rows = first.join(second.select("drawing_id", "px", "py", F.col("dist").alias("d2")), ["drawing_id", "px", "py"], "left")
    gap = F.when(F.col("texts") > 1, 0.0).otherwise(F.round(F.col("d2") - F.col("d1"), 4))
    return rows.select("drawing_id", "px", "py", gap.alias("gap")).withColumn("ambiguous", F.coalesce(F.col("gap") < 20, F.lit(False)))


@query("resolve_conflicts", f"SELECT drawing_id, px, py, CASE WHEN rn = 1 THEN value END AS value, ox, oy, rn > 1 AS review FROM (SELECT *, row_number() OVER (PARTITION BY drawing_id, ox, oy, value ORDER BY round(dist, 6), px, py) AS rn FROM {_NEAR})")
def _(t):
    """Of the labels that want a callout the nearest keeps it; the others are reset and flagged for review."""
    p, o = _points(t)
    # who keeps a place is found first, so that the pairs only pass by
    side = lambda a, b: [F.col(f"{a}{c}").alias(f"{b}{c}") for c in "xy"]
    owner = best_within(o.select("drawing_id", *side("o", "p")), p.select("drawing_id", *side("p", "o")), "drawing_id", 60.0, [])
    owned = o.join(owner.select("drawing_id", *side("p", "o"), F.col("ox").alias("wx"), F.col("oy").alias("wy")), ["drawing_id", "ox", "oy"])
    first = (F.col("px") == F.col("wx")) & (F.col("py") == F.col("wy"))
    return J.radius_pairs(p, owned, "drawing_id", 60.0).select("drawing_id", "px", "py", F.when(first, F.col("value")).alias("value"), "ox", "oy", (~first).alias("review"))


@query("suffix_donor", r"SELECT DISTINCT a.material_key, b.material_key AS donor FROM (SELECT material_key, CAST(material_key AS VARCHAR) || 'A' AS id FROM material) a JOIN material b ON regexp_replace(a.id, '[A-Za-z]+$', '') = CAST(b.material_key AS VARCHAR)")
def _(t):
    a = t.material.select("material_key", F.regexp_replace(F.concat(F.col("material_key").cast("string"), F.lit("A")), "[A-Za-z]+$", "").alias("base"))
    b = t.material.select(F.col("material_key").alias("donor"), F.col("material_key").cast("string").alias("base"))
    return a.join(b, "base").select("material_key", "donor").distinct()


@query("reading_order_band", "SELECT drawing_id, text, cx, cy, row_number() OVER (PARTITION BY drawing_id ORDER BY floor(cy / 30), cx, cy, text) AS number FROM (SELECT DISTINCT drawing_id, text, cx, cy FROM token)")
def _(t):
    w = Window.partitionBy("drawing_id").orderBy(F.floor(F.col("cy") / 30), "cx", "cy", "text")
    return t.token.select("drawing_id", "text", "cx", "cy").distinct().withColumn("number", F.row_number().over(w).cast("long"))


@query("stack_islands", "SELECT drawing_id, col, island, count(*) AS n FROM (SELECT *, sum(b) OVER (PARTITION BY drawing_id, col ORDER BY cy ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN cy - lag(cy) OVER (PARTITION BY drawing_id, col ORDER BY cy) > 24 THEN 1 ELSE 0 END AS b FROM (SELECT DISTINCT drawing_id, floor(cx / 24) AS col, cy FROM token))) GROUP BY 1, 2, 3".replace("SELECT drawing_id, col, island,", "SELECT drawing_id, CAST(col AS BIGINT) AS col, CAST(island AS BIGINT) AS island,"))
def _(t):
    from ..operators.aggregates import islands

    k = t.token.select("drawing_id", F.floor(F.col("cx") / 24).alias("col"), "cy").distinct()
    w = Window.partitionBy("drawing_id", "col").orderBy("cy")
    return islands(k, ["drawing_id", "col"], ["cy"], F.col("cy") - F.lag("cy").over(w) > 24).groupBy("drawing_id", "col", "island").agg(F.count("*").alias("n"))


# --- scoring -----------------------------------------------------------------------------------

_SCORED = f"""(SELECT t.case_key, t.item_key, p.item_key IS NULL AS missed, {value_match_sql('p.detected', 't.expected')} AND p.item_key IS NOT NULL AS same FROM truth t LEFT JOIN prediction p ON t.item_key = p.item_key AND t.case_key = p.case_key)"""
_SPURIOUS = "(SELECT p.case_key, count(*) AS n FROM prediction p WHERE p.case_key % 2 = 0 AND NOT EXISTS (SELECT 1 FROM truth t WHERE t.item_key = p.item_key AND t.case_key = p.case_key) GROUP BY 1)"


@query("score_cases", f"""SELECT s.*, coalesce(x.n, 0) AS spurious FROM (SELECT case_key, count(*) AS expected, count_if(missed) AS missed, count_if(same) AS correct, count_if(NOT missed AND NOT same) AS wrong, round(CAST(count_if(NOT missed) AS DOUBLE) / count(*), 4) AS recall,
  CASE WHEN count_if(NOT missed) > 0 THEN round(CAST(count_if(same) AS DOUBLE) / count_if(NOT missed), 4) ELSE 0 END AS accuracy FROM {_SCORED} GROUP BY 1) s LEFT JOIN {_SPURIOUS} x ON x.case_key = s.case_key""")
def score_cases(t):
    """Per case: expected, missed, wrong and right items, and spurious ones where the case lists all there is (even cases)."""
    p = t.prediction.withColumn("there", F.lit(True))
    j = t.truth.join(p, ["case_key", "item_key"], "left").withColumn("same", X.value_match(F.col("detected"), F.col("expected")))
    missed = F.col("there").isNull()
    g = j.groupBy("case_key").agg(F.count("*").alias("expected"), F.count_if(missed).alias("missed"), F.count_if(F.col("same") & ~missed).alias("correct"), F.count_if(~missed).alias("found"))
    more = t.prediction.where("case_key % 2 = 0").join(t.truth, ["case_key", "item_key"], "left_anti").groupBy("case_key").agg(F.count("*").alias("n"))
    rate = F.when(F.col("found") > 0, F.round(F.col("correct") / F.col("found"), 4)).otherwise(0.0)
    return g.join(more, "case_key", "left").select("case_key", "expected", "missed", "correct", (F.col("found") - F.col("correct")).alias("wrong"), F.round(F.col("found") / F.col("expected"), 4).alias("recall"), rate.alias("accuracy"), F.coalesce("n", F.lit(0)).alias("spurious"))


@query("suite_summary", f"SELECT count(*) AS cases, round(avg(recall), 4) AS recall, avg(recall) >= 0.8 AS accepted FROM (SELECT case_key, round(CAST(count_if(NOT missed) AS DOUBLE) / count(*), 4) AS recall FROM {_SCORED} GROUP BY 1)")
def _(t):
    return score_cases(t).agg(F.count("*").alias("cases"), F.round(F.avg("recall"), 4).alias("recall"), (F.avg("recall") >= 0.8).alias("accepted"))


@query("truth_compare", f"SELECT count_if(NOT missed) AS found, count_if(same) AS correct, count(*) AS total FROM {_SCORED}")
def _(t):
    return score_cases(t).agg((F.sum("expected") - F.sum("missed")).alias("found"), F.sum("correct").alias("correct"), F.sum("expected").alias("total"))


@query("image_metrics", "SELECT drawing_id, count(*) AS tokens, round(CAST(count_if(conf >= 0.95) AS DOUBLE) / count(*), 4) AS sure, round(avg(conf), 4) AS mean_conf FROM token GROUP BY 1")
def _(t):
    return t.token.groupBy("drawing_id").agg(F.count("*").alias("tokens"), F.round(F.count_if(F.col("conf") >= 0.95) / F.count("*"), 4).alias("sure"), F.round(F.avg("conf"), 4).alias("mean_conf"))


@query("version_compare", "SELECT part_key, a.qty - b.qty AS delta FROM (SELECT * FROM baseline_part WHERE baseline = 1) a JOIN (SELECT * FROM baseline_part WHERE baseline = 2) b USING (part_key) WHERE a.qty <> b.qty")
def _(t):
    b = t.baseline_part
    two = b.where("baseline = 2").select("part_key", F.col("qty").alias("new"))
    return b.where("baseline = 1").join(two, "part_key").where("qty <> new").select("part_key", (F.col("qty") - F.col("new")).alias("delta"))


# --- retrieval ---------------------------------------------------------------------------------


@query("chunk_ids", r"SELECT doc_id || '##' || (i + 1) AS chunk_id, length(c) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS c, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents) WHERE c <> ''")
def _(t):
    """Empty chunks get no row, but count in the numbers of those after them."""
    return t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "c")).where("c <> ''").select(F.concat(F.col("doc_id").cast("string"), F.lit("##"), (F.col("i") + 1).cast("string")).alias("chunk_id"), F.char_length("c").cast("long").alias("n"))


@query("vector_topk", """SELECT query_id, vec_id, round(dist, 4) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rn
  FROM (SELECT q.vec_id AS query_id, e.vec_id, round(list_distance(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) ** 2, 9) AS dist FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id)) WHERE rn <= 5 AND dist <= 1.0""")
def _(t):
    """Every row whose id is divisible by 100 against all rows: the five nearest, within the distance."""
    return nearest(t.embeddings, t.embeddings.where("vec_id % 100 = 0")).withColumn("dist", F.round("dist", 4))


@query("vector_search")
def _(t):
    """Every row whose id is divisible by 100 against all rows; no SQL, as brute force is too slow there."""
    return nearest(t.embeddings, t.embeddings.where("vec_id % 100 = 0"))


@query("vector_index_search")
def _(t):
    """The same by inverted lists that all vectors are in, without a limit of distance; its recall against the exact search is tested, and given in the README."""
    vectors = V.usable(t.embeddings)
    centres = V.fit(vectors)
    return V.search(V.index(vectors, centres), vectors.where("vec_id % 100 = 0"), centres, most=float("inf"))


@query("collapse_repeats", "SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS DISTINCT FROM event_type")
def _(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.withColumn("b", F.lag("event_type").over(w)).where(~F.col("b").eqNullSafe(F.col("event_type"))).select("event_id")


@query("keyword_lookup", "SELECT DISTINCT material_key FROM material WHERE contains(lower(material_name), 'red') OR contains(lower(rm_type), 'steel')")
def _(t):
    return t.material.where(B.matches("red", ["material_name"]) | B.matches("steel", ["rm_type"])).select("material_key").distinct()


@query("pending_docs", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    return t.documents.join(t.labels, "doc_id", "left_anti").select("doc_id")


@query("query_log_stats", "SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, max(value) AS most FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.max("value").alias("most"))


@query("notification_state", "SELECT email_key, arg_max(notification_type, (CASE notification_type WHEN 'RelatedEmail' THEN 2 WHEN 'NewEmail' THEN 1 ELSE 0 END, notification_type)) AS state FROM notification GROUP BY 1")
def _(t):
    rank = F.when(F.col("notification_type") == "RelatedEmail", 2).when(F.col("notification_type") == "NewEmail", 1).otherwise(0)
    return t.notification.groupBy("email_key").agg(F.max_by("notification_type", F.struct(rank, "notification_type")).alias("state"))


@query("log_tail", "SELECT seq, level FROM log_event WHERE seq > (SELECT max(seq) - 1000 FROM log_event)")
def _(t):
    """What came since a number that a reader has seen: here, the one 1000 before the last."""
    since = F.broadcast(t.log_event.agg((F.max("seq") - 1000).alias("since")))  # one row
    return t.log_event.join(since, F.col("seq") > F.col("since")).select("seq", "level")


@query("step_states", "SELECT request_id, step_name, max(seq) AS seq, round(greatest(2, least(100, arg_max(ms, seq) / 100.0 * 100)), 4) AS pct FROM log_event GROUP BY 1, 2")
def _(t):
    g = t.log_event.groupBy("request_id", "step_name").agg(F.max("seq").alias("seq"), F.max_by("ms", "seq").alias("ms"))
    return g.select("request_id", "step_name", "seq", F.round(F.greatest(F.lit(2.0), F.least(F.lit(100.0), F.col("ms") / 100.0 * 100)), 4).alias("pct"))


@query("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(t):
    w = F.window("ts", "1 hour")
    return t.events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")

"""Queries of scalar functions: labels, dates, lists, subjects, callouts, geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G, repair as R, text as X
from ..operators import joins as J
from ..operators.lineage import stored
from ..registry import query
from .bindings import AS_OF


@query("label_concat", "SELECT demand_key, line_no, heat_no || '/' || coalesce(nullif(batch_no, ''), '') AS label FROM receipt")
def _(t):
    return t.receipt.select("demand_key", "line_no", X.label_concat(F.col("heat_no"), F.nullif("batch_no", F.lit(""))).alias("label"))


@query("ellipsis_label", "SELECT material_key, CASE WHEN length(rm_type) > 9 THEN left(rm_type, 5) || '...' || right(rm_type, 4) ELSE rm_type END AS label FROM material")
def _(t):
    return t.material.select("material_key", X.ellipsis(F.col("rm_type")).alias("label"))


@query("status_suffix", "SELECT demand_key, CASE WHEN do_review <> 0 THEN status || '(DO Review)' ELSE status END AS label FROM demand")
def _(t):
    return t.demand.select("demand_key", F.when(F.col("do_review") != 0, F.concat("status", F.lit("(DO Review)"))).otherwise(F.col("status")).alias("label"))


@query("date_text", "SELECT demand_key, coalesce(strftime(CASE WHEN demand_key % 2 = 0 THEN demand_date END, '%Y-%m-%d'), '') AS day FROM demand")
def _(t):
    return t.demand.select("demand_key", X.date_text(F.when(F.col("demand_key") % 2 == 0, F.col("demand_date"))).alias("day"))


@query("days_between", f"SELECT demand_key, CAST(datediff('day', DATE '{AS_OF}', planned_date) AS INT) AS remaining FROM demand")
def _(t):
    return t.demand.select("demand_key", F.datediff("planned_date", F.to_date(F.lit(AS_OF))).alias("remaining"))


def age_bucket(days):
    return F.when(days <= 30, "0-30").when(days <= 60, "31-60").otherwise(">60")


@query("age_bucket", "SELECT ncr_key, line_no, CASE WHEN d <= 30 THEN '0-30' WHEN d <= 60 THEN '31-60' ELSE '>60' END AS bucket FROM (SELECT *, datediff('day', received_date, DATE '1995-03-01') AS d FROM ncr)")
def _(t):
    return t.ncr.select("ncr_key", "line_no", age_bucket(F.datediff(F.to_date(F.lit("1995-03-01")), "received_date")).alias("bucket"))


@query("round_away", "SELECT demand_key, CAST(round(CAST(estimated_cost AS DECIMAL(20,4)) / 7, 2) AS DECIMAL(18,2)) AS cost FROM (SELECT demand_key, estimated_cost * 7 AS estimated_cost FROM demand)")
def _(t):
    return t.demand.select("demand_key", F.round(F.col("estimated_cost"), 2).cast("decimal(18,2)").alias("cost"))


@query("split_trim", "SELECT part_key, array_to_string(list_transform(string_split(serial_nos, ','), lambda x: trim(x)), '|') AS serials FROM serial_text")
def _(t):
    return t.serial_text.select("part_key", F.array_join(X.split_trim(F.col("serial_nos")), "|").alias("serials"))


@query("parse_serials", """SELECT part_key, CASE WHEN part_key % 3 = 0 THEN array_to_string(CAST(from_json(serial_nos, '["VARCHAR"]') AS VARCHAR[]), '|') WHEN part_key % 3 = 1 THEN array_to_string(list_filter(list_transform(string_split(serial_nos, ','), lambda x: trim(x)), lambda x: x <> ''), '|') ELSE '' END AS serials FROM serial_text""")
def _(t):
    return t.serial_text.select("part_key", F.array_join(X.parse_serials(F.col("serial_nos")), "|").alias("serials"))


@query("list_remove", "SELECT ncr_key, line_no, CASE WHEN stage = 'Rejected' THEN engine ELSE stage || ',' || engine END AS kept FROM ncr")
def _(t):
    return t.ncr.select("ncr_key", "line_no", X.list_remove(F.concat_ws(",", "stage", "engine"), "Rejected").alias("kept"))


def dimension_sql(c: str) -> str:
    """normalize_dimension for DuckDB."""
    out = f"CASE WHEN {c} = 'NO_DIMENSION' THEN '' ELSE upper(coalesce({c}, '')) END"
    for a, b in X.SYMBOLS:
        out = f"replace({out}, '{a}', '{b}')"
    for a, b in X.SHAPES:
        out = f"regexp_replace({out}, '{a}', '{b}', 'g')"
    return out


def value_match_sql(detected: str, expected: str) -> str:
    """value_match for DuckDB."""
    d, e = dimension_sql(detected), dimension_sql(expected)
    bare = lambda x: f"regexp_replace({x}, '[()]', '', 'g')"
    plain = lambda x: f"regexp_replace({bare(x)}, '^DIA', '')"
    return f"""({d} <> '' AND {e} <> '' AND ({d} = {e} OR {bare(d)} = {bare(e)} OR ({plain(d)} <> '' AND {plain(d)} = {plain(e)}) OR (length({e}) >= 3 AND contains({d}, {e}))
  OR (regexp_full_match({plain(d)}, '[0-9]+') AND starts_with({plain(e)}, {plain(d)} || '.'))))"""


@query("normalize_dimension", f"SELECT token_key, drawing_id, text, {dimension_sql('text')} AS norm FROM token")
def _(t):
    return t.token.select("token_key", "drawing_id", "text", X.normalize_dimension(F.col("text")).alias("norm"))


@query("clean_subject", r"SELECT message_id, regexp_replace(regexp_replace(trim(regexp_replace(subject, '\s+', ' ', 'g')), '^(re:\s*)+', '', 'i'), '^(fw:\s*)+', '', 'i') AS clean FROM email")
def _(t):
    return t.email.select("message_id", X.clean_subject(F.col("subject")).alias("clean"))


@query("thread_id", "SELECT message_id, coalesce(nullif(in_reply_to, ''), message_id) AS thread FROM email")
def _(t):
    return t.email.select("message_id", F.coalesce(F.nullif("in_reply_to", F.lit("")), "message_id").alias("thread"))


@query("fallback_id", "SELECT message_id, sha256(from_email || '~' || subject || '~' || CAST(received_hour AS VARCHAR)) AS fallback FROM email")
def _(t):
    return t.email.select("message_id", F.sha2(F.concat_ws("~", "from_email", "subject", F.col("received_hour").cast("string")), 256).alias("fallback"))


@query("nested_to_json", """SELECT message_id, '[{"address":"' || from_email || '","kind":"from"}]' AS recipients FROM email""")
def _(t):
    return t.email.select("message_id", F.to_json(F.array(F.struct(F.col("from_email").alias("address"), F.lit("from").alias("kind")))).alias("recipients"))


@query("last_segment", "SELECT message_id, try_cast(list_last(string_split(replace(message_id, '-', '_'), '_')) AS INT) AS segment FROM email")
def _(t):
    return t.email.select("message_id", F.element_at(F.split(F.replace("message_id", F.lit("-"), F.lit("_")), "_"), -1).try_cast("int").alias("segment"))


@query("composite_key", "SELECT message_id, string_split(message_id, '-')[1] AS conv, string_split(message_id, '-')[2] AS turn FROM email")
def _(t):
    p = F.split("message_id", "-")
    return t.email.select("message_id", p[0].alias("conv"), p[1].alias("turn"))


@query("lev_similarity", "SELECT a.part_key, round(1 - levenshtein(a.part_name, b.part_name) / CAST(greatest(length(a.part_name), length(b.part_name)) AS DOUBLE), 6) AS sim FROM bom a JOIN bom b ON a.parent_key = b.part_key WHERE length(a.part_name) + length(b.part_name) > 0")
def _(t):
    p = t.bom.select(F.col("part_key").alias("parent_key"), F.col("part_name").alias("parent_name"))
    return t.bom.join(p, "parent_key").select("part_key", F.round(X.similarity(F.col("part_name"), F.col("parent_name")), 6).alias("sim"))


@query("box_distance", "SELECT token_key, drawing_id, cx, cy, round(sqrt(power(greatest(300 - cx, 0, cx - 500), 2) + power(greatest(200 - cy, 0, cy - 400), 2)), 6) AS dist FROM token")
def _(t):
    d = G.box_distance(F.col("cx"), F.col("cy"), *map(F.lit, (300.0, 200.0, 500.0, 400.0)))
    return t.token.select("token_key", "drawing_id", "cx", "cy", F.round(d, 6).alias("dist"))


@query("bbox_iou", "SELECT token_key, cx, cy, round(CASE WHEN i > 0 THEN i / (20 * 10 + 100 * 100 - i) ELSE 0.0 END, 6) AS iou FROM (SELECT *, greatest(0, least(cx + 20, 350) - greatest(cx, 250)) * greatest(0, least(cy + 10, 350) - greatest(cy, 250)) AS i FROM token)")
def _(t):
    own = [F.col("cx"), F.col("cy"), F.col("cx") + 20, F.col("cy") + 10]
    return t.token.select("token_key", "cx", "cy", F.round(G.iou(own, [F.lit(float(v)) for v in (250, 250, 350, 350)]), 6).alias("iou"))


_CLASS = " ".join(f"WHEN regexp_matches(upper(trim(text)), '{p}') THEN '{n}'" for n, p in X.GRAMMAR)


@query("grammar_class", f"SELECT token_key, text, CASE {_CLASS} ELSE 'other' END AS class FROM token")
def _(t):
    return t.token.select("token_key", "text", X.grammar_class(F.col("text")).alias("class"))


_SEMANTIC = " ".join(f"WHEN regexp_matches(upper(text), '{p}') THEN '{n}'" for n, p in X.SEMANTICS)


@query("semantic_type", f"SELECT mark_key, text, CASE {_SEMANTIC} ELSE 'unknown' END AS kind FROM mark")
def _(t):
    return t.mark.select("mark_key", "text", X.semantic_class(F.col("text")).alias("kind"))


@query("ocr_text_repair")
def _(t):
    """What the texts of marks were most probably, and their class before and after. Look-around isn't in DuckDB's patterns, so tests hold it to a plain interpreter."""
    fixed = J.per_value(stored(t.mark.select("mark_key", "raw")), "raw", repaired=R.repair_text(F.col("raw")), kind_before=X.semantic_class(F.col("raw")))
    return J.per_value(fixed, "repaired", kind=X.semantic_class(F.col("repaired"))).select("mark_key", "raw", "repaired", "kind_before", "kind")


@query("token_type", r"SELECT token_key, text, CASE WHEN regexp_matches(trim(text), '^\(?0*[0-9]{1,3}[A-Za-z]?\)?$') THEN 'bubble' WHEN regexp_matches(text, '[0-9]') THEN 'dimension' ELSE 'keyword' END AS kind FROM token")
def _(t):
    kind = F.when(F.trim("text").rlike(r"^\(?0*[0-9]{1,3}[A-Za-z]?\)?$"), "bubble").when(F.col("text").rlike("[0-9]"), "dimension").otherwise("keyword")
    return t.token.select("token_key", "text", kind.alias("kind"))


@query("bubble_id", r"SELECT token_key, text, CASE WHEN regexp_matches(b, '^0+$') THEN '0' ELSE regexp_replace(b, '^0+', '') END AS bubble FROM (SELECT *, regexp_replace(trim(text), '[()]', '', 'g') AS b FROM token)")
def _(t):
    return t.token.select("token_key", "text", X.bubble_id(F.col("text")).alias("bubble"))


@query("prefix_split", r"SELECT token_key, regexp_extract('B' || CAST(token_key % 7 AS VARCHAR) || ' ' || text, '^([A-Z][0-9]) (.+)$', 1) AS prefix, regexp_extract('B' || CAST(token_key % 7 AS VARCHAR) || ' ' || text, '^([A-Z][0-9]) (.+)$', 2) AS rest FROM token")
def _(t):
    c = F.concat(F.lit("B"), (F.col("token_key") % 7).cast("string"), F.lit(" "), "text")
    return t.token.select("token_key", *[F.regexp_extract(c, "^([A-Z][0-9]) (.+)$", k).alias(n) for k, n in ((1, "prefix"), (2, "rest"))])


_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)


@query("keywords", f"SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(lower(text), '[ ,.!?]'), lambda w: w <> '' AND w NOT IN ({_STOP})), ' ') AS words FROM documents")
def _(t):
    return t.documents.select("doc_id", F.array_join(X.keywords(F.col("text")), " ").alias("words"))


@query("sha256_hex", "SELECT vendor_key, array_to_string(list_transform(range(1, 64, 2), lambda i: upper(sha256(vendor_name))[i : i + 1]), '-') AS hex FROM vendor")
def _(t):
    return t.vendor.select("vendor_key", X.sha256_dashed(F.col("vendor_name")).alias("hex"))


@query("duration_text", "SELECT seq, printf('%02d:%02d:%02d', (seq * 37 // 3600) % 24, (seq * 37 // 60) % 60, (seq * 37) % 60) AS dur FROM log_event")
def _(t):
    return t.log_event.select("seq", X.duration_text(F.col("seq") * 37).alias("dur"))


@query("composite_confidence", "SELECT token_key, cx, conf, round(0.25 * conf + 0.2 * conf + 0.25 * greatest(0.0, least(1.0, 1 - cx / 500)) + 0.2 + 0.1, 6) AS score, round(0.25 * conf + 0.2 * conf + 0.25 * greatest(0.0, least(1.0, 1 - cx / 500)) + 0.2 + 0.1, 6) < 0.65 AS review FROM token")
def _(t):
    near = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("cx") / 500))
    score = F.round(0.25 * F.col("conf") + 0.2 * F.col("conf") + 0.25 * near + 0.2 + 0.1, 6)
    return t.token.select("token_key", "cx", "conf", score.alias("score"), (score < 0.65).alias("review"))


_DOT = "((cx - 1500) * 0.6 + (cy - 1000) * 0.8) / greatest(sqrt(power(cx - 1500, 2) + power(cy - 1000, 2)), 1.0)"


def direction_sql(dot: str, dist: str) -> str:
    """direction_score for DuckDB."""
    return f"CASE WHEN {dist} < 1.0 THEN 0.0 " + " ".join(f"WHEN {dot} > {above} THEN {score}" for above, score in G.DIRECTION) + f" ELSE {G.BEHIND} END"


@query("direction_score", f"SELECT mark_key, cx, cy, CAST({direction_sql(_DOT, 'sqrt(power(cx - 1500, 2) + power(cy - 1000, 2))')} AS DOUBLE) AS score, round(CASE WHEN cx - 1500 < -20 THEN least(40.0, abs(cx - 1500) * 0.10) ELSE 0.0 END + CASE WHEN abs(cy - 1000) > abs(cx - 1500) * 2.5 THEN least(20.0, abs(cy - 1000) * 0.05) ELSE 0.0 END, 6) AS weak FROM mark")
def _(t):
    """Marks seen from the middle of the drawing along one direction, and without one."""
    dx, dy = F.col("cx") - 1500, F.col("cy") - 1000
    return t.mark.select("mark_key", "cx", "cy", G.direction_score(dx, dy, F.lit(0.6), F.lit(0.8)).alias("score"), F.round(G.weak_direction_score(dx, dy), 6).alias("weak"))


def loose_sql(c: str) -> str:
    """loose_value for DuckDB."""
    out = f"upper(trim(coalesce({c}, '')))"
    for pattern, put in X.LOOSE:
        out = f"regexp_replace({out}, '{pattern}', '{put.replace('$', chr(92))}', 'g')"
    return out


def loose_match_sql(detected: str, expected: str, table: str, keep: str) -> str:
    """Rows of a table with loose_match as `same`, for DuckDB."""
    cut = lambda x, *patterns: f"trim(regexp_replace({cut(x, *patterns[:-1])}, '{patterns[-1]}', '', 'g'))" if patterns else x
    paren, dia, deg = "[()]", r"^DIA\s*", r"\s*DEG\s*$"
    eq = lambda *p: f"({cut('d', *p)} <> '' AND {cut('d', *p)} = {cut('e', *p)})"
    whole = lambda d, e: f"(regexp_full_match({d}, '[0-9]+') AND starts_with({e}, {d} || '.'))"
    words = lambda c: f"list_filter(list_distinct(string_split({c}, ' ')), lambda w: w <> '')"
    shared = f"len(list_intersect({words('d')}, {words('e')}))"
    inside = r"regexp_matches(d, '(^|[^\pL\pN_])' || regexp_escape(e) || '($|[^\pL\pN_])')"
    more = f"({inside} OR {eq(deg)} OR {eq(dia)} OR {whole(cut('d', dia), cut('e', dia))} OR (len({words('e')}) > 0 AND {shared} = len({words('e')})) OR (len({words('e')}) >= 3 AND {shared} = len({words('d')}) AND {shared} / len({words('e')}) >= {X.COVERAGE}))"
    same = f"found <> '' AND found <> 'NO_DIMENSION' AND (d = e OR {whole('d', 'e')} OR {eq(paren)} OR {eq(paren, dia)} OR (length(e) > 2 AND {more}))"
    return f"SELECT {keep}, {same} AS same FROM (SELECT *, coalesce({detected}, '') AS found, {loose_sql(detected)} AS d, {loose_sql(expected)} AS e FROM {table})"


@query("value_match_regression", loose_match_sql("raw", "text", "mark", "mark_key"))
def _(t):
    """Whether the texts as read are as good as the true ones, in the loose sense of regression runs."""
    return t.mark.select("mark_key", X.loose_match(F.col("raw"), F.col("text")).alias("same"))


@query("value_match_words", loose_match_sql("a", "b", "(SELECT a.mark_key AS x, b.mark_key AS y, a.text AS a, b.text AS b FROM mark a JOIN mark b ON a.drawing_id = b.drawing_id AND a.cy = b.cy AND a.mark_key <> b.mark_key)", "x, y"))
def _(t):
    """The same for pairs of marks at one height."""
    a, b = (t.mark.select("drawing_id", "cy", F.col("mark_key").alias(k), F.col("text").alias(v)) for k, v in (("x", "a"), ("y", "b")))
    return a.join(b, ["drawing_id", "cy"]).where("x <> y").select("x", "y", X.loose_match(F.col("a"), F.col("b")).alias("same"))


@query("value_match", f"SELECT t.item_key, t.case_key, {value_match_sql('p.detected', 't.expected')} AS same FROM truth t JOIN prediction p ON t.item_key = p.item_key")
def _(t):
    return t.truth.join(t.prediction.drop("case_key"), "item_key").select("item_key", "case_key", X.value_match(F.col("detected"), F.col("expected")).alias("same"))

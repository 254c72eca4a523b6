"""Reports on builds, their components, notices and documents, and of scoring runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.text import parse_serials, value_match
from ..registry import query
from .text_queries import value_match_sql



@query("rpt_mq_summary", "SELECT (SELECT count(*) FROM build) AS builds, (SELECT count_if(status = 'Active') FROM build) AS active_n, (SELECT count(*) FROM ncr) AS ncrs, (SELECT count_if(stage <> 'Cleared') FROM ncr) AS open_ncr_n, (SELECT count(*) FROM acsn) AS acsns, (SELECT count_if(status = 'Open') FROM acsn) AS open_acsn_n")
def _(t):
    """One row of counts; each table is aggregated before the single rows meet."""
    b = t.build.agg(F.count("*").alias("builds"), F.count_if(F.col("status") == "Active").alias("active_n"))
    n = t.ncr.agg(F.count("*").alias("ncrs"), F.count_if(F.col("stage") != "Cleared").alias("open_ncr_n"))
    a = t.acsn.agg(F.count("*").alias("acsns"), F.count_if(F.col("status") == "Open").alias("open_acsn_n"))
    return b.join(n, how="cross").join(a, how="cross")


@query("rpt_engines_by_status", "SELECT status, engine, count(*) AS n FROM build GROUP BY 1, 2")
def _(t):
    return t.build.groupBy("status", "engine").agg(F.count("*").alias("n"))


@query("rpt_builds_recent", "SELECT status, build_key, started FROM (SELECT *, row_number() OVER (PARTITION BY status ORDER BY started DESC, build_key) AS rn FROM build WHERE status IN ('Active', 'Completed')) WHERE rn <= 20")
def _(t):
    """The 20 latest of each state."""
    w = Window.partitionBy("status").orderBy(F.desc("started"), "build_key")
    return t.build.where("status in ('Active', 'Completed')").withColumn("rn", F.row_number().over(w)).where("rn <= 20").select("status", "build_key", "started")


_STATES = "count(*) AS total, count_if(state = 'Fitted') AS fitted_n, count_if(state = 'Pending') AS pending_n, count_if(state = 'Rejected') AS rejected_n"


def _states():
    return [F.count("*").alias("total"), *[F.count_if(F.col("state") == s).alias(f"{s.lower()}_n") for s in ("Fitted", "Pending", "Rejected")]]


@query("rpt_component_status", f"SELECT build_key, {_STATES} FROM component GROUP BY ROLLUP (build_key)")
def _(t):
    """Per build, and over all (a null build)."""
    return t.component.rollup("build_key").agg(*_states())


@query("rpt_build_components", f"SELECT build_key, section, {_STATES} FROM component GROUP BY 1, 2")
def _(t):
    return t.component.groupBy("build_key", "section").agg(*_states())


_AGE = "CASE WHEN datediff('day', opened, DATE '2024-12-31') <= 30 THEN '0-30' WHEN datediff('day', opened, DATE '2024-12-31') <= 60 THEN '31-60' ELSE '>60' END"


@query("rpt_acsn", f"SELECT kind, k1, k2, count(*) AS n FROM (SELECT 'status' AS kind, status AS k1, '' AS k2 FROM acsn UNION ALL SELECT 'series', series, status FROM acsn UNION ALL SELECT 'step', step, '' FROM acsn UNION ALL SELECT 'age', {_AGE}, '' FROM acsn WHERE status = 'Open') GROUP BY 1, 2, 3")
def _(t):
    """Notices by status, series and status, step, and, of open ones, age: one pass, in which each row stands in four groups."""
    days = F.datediff(F.to_date(F.lit("2024-12-31")), F.to_date("opened"))
    age = F.when(days <= 30, "0-30").when(days <= 60, "31-60").otherwise(">60")
    row = lambda kind, a, b=F.lit(""): F.struct(F.lit(kind).alias("kind"), a.alias("k1"), b.alias("k2"))
    kinds = F.array(row("status", F.col("status")), row("series", F.col("series"), F.col("status")), row("step", F.col("step")), F.when(F.col("status") == "Open", row("age", age)))
    return t.acsn.select(F.explode(kinds).alias("r")).where("r is not null").groupBy("r.kind", "r.k1", "r.k2").agg(F.count("*").alias("n"))


@query("rpt_sop_kpi", "SELECT status, engine, count(*) AS n, round(100.0 * count_if(status = 'Completed') / count(*), 2) AS done_pct FROM build GROUP BY GROUPING SETS ((status), (engine), ())")
def _(t):
    g = t.build.groupingSets([[F.col("status")], [F.col("engine")], []], "status", "engine").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "Completed").alias("done"))
    return g.select("status", "engine", "n", F.round(100.0 * F.when(F.col("status").isNull(), F.col("done")).when(F.col("status") == "Completed", F.col("n")).otherwise(0) / F.col("n"), 2).alias("done_pct"))


@query("rpt_build_detail", "SELECT b.build_key, b.engine, b.status, coalesce(c.n, 0) AS components FROM build b LEFT JOIN (SELECT build_key, count(*) AS n FROM component GROUP BY 1) c ON c.build_key = b.build_key")
def _(t):
    c = t.component.groupBy("build_key").agg(F.count("*").alias("n"))
    return t.build.join(c, "build_key", "left").select("build_key", "engine", "status", F.coalesce("n", F.lit(0)).alias("components"))


@query("rpt_section_completion", "SELECT b.build_key, count(*) AS sections, count(d.section) AS completed, count(*) - count(d.section) AS pending FROM build b CROSS JOIN (SELECT DISTINCT section FROM component) s LEFT JOIN (SELECT DISTINCT build_key, section FROM component WHERE state = 'Fitted') d ON d.build_key = b.build_key AND d.section = s.section GROUP BY 1")
def _(t):
    """Every build has every section of the template, so only the number of sections is needed, not their pairs with builds."""
    sections = F.broadcast(t.component.agg(F.count_distinct("section").alias("sections")))  # one row
    done = t.component.where("state = 'Fitted'").groupBy("build_key").agg(F.count_distinct("section").alias("c"))
    rows = t.build.join(done, "build_key", "left").join(sections, how="cross").withColumn("completed", F.coalesce("c", F.lit(0)))
    return rows.select("build_key", "sections", "completed", (F.col("sections") - F.col("completed")).alias("pending"))


@query("rpt_doc_summary", "SELECT source, count(*) AS n, max(doc_id) AS latest, count_if(text IS NULL OR text = '') AS empty_n FROM documents GROUP BY 1")
def _(t):
    return t.documents.groupBy("source").agg(F.count("*").alias("n"), F.max("doc_id").alias("latest"), F.count_if(F.col("text").isNull() | (F.col("text") == "")).alias("empty_n"))


@query("rpt_part_usage", "SELECT part_key, count(DISTINCT serial_no) AS total, count(DISTINCT CASE WHEN state = 'Fitted' THEN serial_no END) AS used, string_agg(DISTINCT engine, ',' ORDER BY engine) AS engines FROM component GROUP BY 1")
def _(t):
    """Serials of a part, those in use, and the engines (some few) that hold them."""
    g = t.component.groupBy("part_key").agg(F.count_distinct("serial_no").alias("total"), F.count_distinct(F.when(F.col("state") == "Fitted", F.col("serial_no"))).alias("used"), F.array_sort(F.collect_set("engine")).alias("e"))
    return g.select("part_key", "total", "used", F.array_join("e", ",").alias("engines"))


@query("rpt_build_parts_json", """SELECT build_name, count(DISTINCT s) AS parts FROM (SELECT build_name, unnest(CAST(from_json(serial_nos, '["VARCHAR"]') AS VARCHAR[])) AS s FROM serial_text WHERE serial_nos LIKE '[%') GROUP BY 1""")
def _(t):
    rows = t.serial_text.where(F.col("serial_nos").startswith("[")).select("build_name", F.explode(parse_serials(F.col("serial_nos"))).alias("s"))
    return rows.groupBy("build_name").agg(F.count_distinct("s").alias("parts"))


@query("rpt_build_highlight", "SELECT c.build_key, c.line_no, c.serial_no, v.vendor_name, r.n IS NOT NULL AS matched FROM component c LEFT JOIN vendor v ON 'S' || v.vendor_key = c.serial_no LEFT JOIN (SELECT demand_key, material_key, count(*) AS n FROM receipt GROUP BY 1, 2) r ON r.demand_key = c.build_key AND r.material_key = c.part_key")
def _(t):
    """Components with their vendor, and whether the vendor's data has a receipt for them."""
    v = t.vendor.select(F.concat(F.lit("S"), F.col("vendor_key").cast("string")).alias("serial_no"), "vendor_name")
    r = t.receipt.select(F.col("demand_key").alias("build_key"), F.col("material_key").alias("part_key")).distinct().withColumn("there", F.lit(True))
    return t.component.join(v, "serial_no", "left").join(r, ["build_key", "part_key"], "left").select("build_key", "line_no", "serial_no", "vendor_name", F.coalesce("there", F.lit(False)).alias("matched"))


# --- scoring runs and search terms ---------------------------------------------------------------

_REASONS = f"""(SELECT t.case_key, t.item_key, CASE WHEN p.item_key IS NULL THEN 'not_found' WHEN coalesce(p.detected, '') = '' THEN 'no_text' WHEN NOT {value_match_sql('p.detected', 't.expected')} THEN 'wrong_value' END AS reason FROM truth t LEFT JOIN prediction p ON p.item_key = t.item_key AND p.case_key = t.case_key)"""


def failures(t) -> DataFrame:
    """case_key, item_key and reason (null: right) of all expected items."""
    p = t.prediction.withColumn("there", F.lit(True))
    j = t.truth.join(p, ["case_key", "item_key"], "left")
    wrong = F.coalesce(F.col("detected"), F.lit("")) == ""
    return j.select("case_key", "item_key", F.when(F.col("there").isNull(), "not_found").when(wrong, "no_text").when(~value_match(F.col("detected"), F.col("expected")), "wrong_value").alias("reason"))


@query("failure_report", f"SELECT case_key, coalesce(reason, 'ok') AS reason, count(*) AS n, row_number() OVER (PARTITION BY case_key ORDER BY count(*) DESC, coalesce(reason, 'ok')) AS place FROM {_REASONS} GROUP BY 1, 2")
def _(t):
    g = failures(t).groupBy("case_key", F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy("case_key").orderBy(F.desc("n"), "reason")).cast("long"))


@query("suite_aggregate", f"SELECT count(DISTINCT case_key) AS cases, count(*) AS items, count_if(reason IS NULL) AS right_n, count_if(reason = 'not_found') AS missed_n, count_if(reason = 'wrong_value') AS wrong_n, round(100.0 * count_if(reason IS NULL) / count(*), 4) AS pct FROM {_REASONS}")
def _(t):
    n = lambda c: F.count_if(c)
    return failures(t).agg(F.count_distinct("case_key").alias("cases"), F.count("*").alias("items"), n(F.col("reason").isNull()).alias("right_n"), n(F.col("reason") == "not_found").alias("missed_n"), n(F.col("reason") == "wrong_value").alias("wrong_n"), F.round(100.0 * F.count_if(F.col("reason").isNull()) / F.count("*"), 4).alias("pct"))


@query("select_cases", "SELECT n.case_key, t.items, t.items IS NULL AS unknown FROM (SELECT 3 AS case_key UNION ALL SELECT 7 UNION ALL SELECT 999) n LEFT JOIN (SELECT case_key, count(*) AS items FROM truth GROUP BY 1) t ON t.case_key = n.case_key")
def _(t):
    """Named cases with their labelled items; names that no case has are reported."""
    names = t.truth.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, (3, 7, 999)))).alias("case_key"))
    of = t.truth.groupBy("case_key").agg(F.count("*").alias("items"))
    return names.join(of, "case_key", "left").select("case_key", "items", F.col("items").isNull().alias("unknown"))


_DELTA = "(SELECT a.part_key, b.qty - a.qty AS delta FROM (SELECT * FROM baseline_part WHERE baseline = 1) a JOIN (SELECT * FROM baseline_part WHERE baseline = 2) b ON a.part_key = b.part_key WHERE a.qty <> b.qty)"


@query("delta_ranking", f"SELECT part_key, delta, CASE WHEN delta < 0 THEN 'regression' ELSE 'improvement' END AS kind, rank() OVER (PARTITION BY delta < 0 ORDER BY abs(delta) DESC, part_key) AS place FROM {_DELTA}")
def _(t):
    """Changes of a value between two states: regressions with the worst first, improvements with the best first."""
    b = t.baseline_part
    rows = b.where("baseline = 1").select("part_key", F.col("qty").alias("old")).join(b.where("baseline = 2").select("part_key", "qty"), "part_key").where("old <> qty")
    rows = rows.select("part_key", (F.col("qty") - F.col("old")).alias("delta"))
    kind = F.when(F.col("delta") < 0, "regression").otherwise("improvement")
    return rows.withColumn("kind", kind).withColumn("place", F.rank().over(Window.partitionBy("kind").orderBy(F.desc(F.abs("delta")), "part_key")).cast("long"))


@query("term_expand", "SELECT DISTINCT w.material_key, coalesce(s.synonym, w.term) AS term FROM (SELECT material_key, unnest(string_split(lower(material_name), ' ')) AS term FROM material) w LEFT JOIN (SELECT DISTINCT lower(split_part(material_name, ' ', 1)) AS term, lower(split_part(rm_type, ' ', 1)) AS synonym FROM material) s ON s.term = w.term WHERE w.term <> ''")
def _(t):
    """Search terms with all their synonyms; a term without any stays."""
    words = t.material.select("material_key", F.explode(F.split(F.lower("material_name"), " ")).alias("term")).where("term <> ''")
    table = t.material.select(F.lower(F.get(F.split("material_name", " "), F.lit(0))).alias("term"), F.lower(F.get(F.split("rm_type", " "), F.lit(0))).alias("synonym")).distinct()
    return words.join(table, "term", "left").select("material_key", F.coalesce("synonym", "term").alias("term")).distinct()

"""The report catalogue. Only the reports' columns are public, so the formulas are this library's own definitions.

Facts are aggregated to the grain of the report before they are joined, so that no join multiplies them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.aggregates import safe_rate
from ..registry import query
from .bindings import AS_OF


def day():
    return F.to_date(F.lit(AS_OF))


def dec(c):
    return F.coalesce(c, F.lit(0)).cast("decimal(18,2)")


_R = "(SELECT material_key, sum(qty) AS q, max(receipt_date) AS last FROM receipt GROUP BY 1)"
_I = "(SELECT material_key, sum(qty) AS q FROM issue GROUP BY 1)"
_D = "(SELECT material_key, sum(qty) AS q FROM demand_item GROUP BY 1)"


def flows(t):
    """Per material: demanded, received and issued quantities and the last receipt."""
    r = t.receipt.groupBy("material_key").agg(F.sum("qty").alias("received"), F.max("receipt_date").alias("last_receipt"))
    i = t.issue.groupBy("material_key").agg(F.sum("qty").alias("issued"))
    d = t.demand_item.groupBy("material_key").agg(F.sum("qty").alias("ordered"))
    out = t.material.join(r, "material_key", "left").join(i, "material_key", "left").join(d, "material_key", "left")
    return out.withColumns({c: dec(F.col(c)) for c in ("received", "issued", "ordered")}).withColumn("stock", (F.col("received") - F.col("issued")).cast("decimal(18,2)"))


_FLOWS = f"(SELECT m.*, CAST(coalesce(r.q, 0) AS DECIMAL(18,2)) AS received, CAST(coalesce(i.q, 0) AS DECIMAL(18,2)) AS issued, CAST(coalesce(d.q, 0) AS DECIMAL(18,2)) AS ordered, CAST(coalesce(r.q, 0) - coalesce(i.q, 0) AS DECIMAL(18,2)) AS stock, r.last AS last_receipt FROM material m LEFT JOIN {_R} r ON r.material_key = m.material_key LEFT JOIN {_I} i ON i.material_key = m.material_key LEFT JOIN {_D} d ON d.material_key = m.material_key)"


@query("rpt_production_planning", f"SELECT material_key, CAST(required_per_engine * 10 AS DECIMAL(18,2)) AS required, received, issued, stock, CAST(stock - required_per_engine * 10 AS DECIMAL(18,2)) AS surplus, round(CAST(stock AS DOUBLE) / (required_per_engine * 10), 4) AS availability FROM {_FLOWS}")
def _(t):
    need = F.col("required_per_engine") * 10
    return flows(t).select("material_key", need.cast("decimal(18,2)").alias("required"), "received", "issued", "stock", (F.col("stock") - need).cast("decimal(18,2)").alias("surplus"), F.round(F.col("stock").cast("double") / need, 4).alias("availability"))


@query("rpt_material_availability", f"SELECT material_key, ordered, received, issued, CAST(ordered - received AS DECIMAL(18,2)) AS balance, CASE WHEN threshold > 0 THEN round(CAST(stock AS DOUBLE) / threshold, 4) ELSE 0.0 END AS health, last_receipt FROM {_FLOWS}")
def _(t):
    return flows(t).select("material_key", "ordered", "received", "issued", (F.col("ordered") - F.col("received")).cast("decimal(18,2)").alias("balance"), safe_rate(F.col("stock").cast("double"), F.col("threshold")).alias("health"), "last_receipt")


_HEALTH = "CASE WHEN stock < 0 THEN 'critical' WHEN stock < threshold THEN 'shortage' ELSE 'sufficient' END"


def health():
    return F.when(F.col("stock") < 0, "critical").when(F.col("stock") < F.col("threshold"), "shortage").otherwise("sufficient")


@query("rpt_material_flow", f"SELECT CAST(min(floor(CAST(stock AS DOUBLE) / required_per_engine)) AS BIGINT) AS engines, count_if({_HEALTH} = 'shortage') AS shortage, count_if({_HEALTH} = 'sufficient') AS sufficient, count_if({_HEALTH} = 'critical') AS critical FROM {_FLOWS}")
def _(t):
    f = flows(t).withColumn("h", health())
    return f.agg(F.min(F.floor(F.col("stock").cast("double") / F.col("required_per_engine"))).cast("long").alias("engines"), *[F.count_if(F.col("h") == k).alias(k) for k in ("shortage", "sufficient", "critical")])


@query("rpt_material_health", f"SELECT {_HEALTH} AS category, count(*) AS n, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (), 4) AS share FROM {_FLOWS} GROUP BY 1")
def _(t):
    g = flows(t).groupBy(health().alias("category")).agg(F.count("*").alias("n"))
    total = F.broadcast(g.agg(F.sum("n").alias("all_n")))  # one row
    return g.join(total, how="cross").select("category", "n", F.round(F.col("n") / F.col("all_n"), 4).alias("share"))


@query("rpt_consolidated_inventory", f"SELECT f.material_key, f.received, f.issued, f.stock, coalesce(h.heats, '') AS heats, coalesce(h.vendors, 0) AS vendors FROM {_FLOWS} f LEFT JOIN (SELECT material_key, string_agg(DISTINCT heat_no, ', ' ORDER BY heat_no) AS heats, count(DISTINCT vendor_key) AS vendors FROM receipt GROUP BY 1) h ON h.material_key = f.material_key")
def _(t):
    h = t.receipt.groupBy("material_key").agg(F.array_join(F.sort_array(F.collect_set("heat_no")), ", ").alias("heats"), F.count_distinct("vendor_key").alias("vendors"))
    return flows(t).join(h, "material_key", "left").select("material_key", "received", "issued", "stock", F.coalesce("heats", F.lit("")).alias("heats"), F.coalesce("vendors", F.lit(0)).alias("vendors"))


_OPEN = "(SELECT m.*, d.officer_key, d.project_key, d.estimated_cost, d.demand_no, d.status_category, datediff('day', DATE '1998-06-01', first_due_date) AS days FROM milestone m JOIN demand d ON m.demand_key = d.demand_key WHERE m.status = 'Active' AND d.status_category = 'Open')"


def open_milestones(t):
    d = t.demand.where("status_category = 'Open'").select("demand_key", "officer_key", "project_key", "estimated_cost", "demand_no")
    return t.milestone.where("status = 'Active'").join(d, "demand_key").withColumn("days", F.datediff("first_due_date", F.to_date(F.lit("1998-06-01"))))


@query("rpt_urgent_actions", f"SELECT kind, count(DISTINCT demand_key) AS demands, sum(n) AS milestones, CAST(sum(estimated_cost) AS DECIMAL(18,2)) AS value FROM (SELECT demand_key, CASE WHEN days < 0 THEN 'overdue' ELSE 'due' END AS kind, max(estimated_cost) AS estimated_cost, CAST(count(*) AS BIGINT) AS n FROM {_OPEN} WHERE days <= 7 GROUP BY 1, 2) GROUP BY 1".replace("sum(n)", "CAST(sum(n) AS BIGINT)"))
def _(t):
    m = open_milestones(t).where("days <= 7").groupBy("demand_key", F.when(F.col("days") < 0, "overdue").otherwise("due").alias("kind")).agg(F.max("estimated_cost").alias("v"), F.count("*").alias("n"))
    return m.groupBy("kind").agg(F.count("*").alias("demands"), F.sum("n").alias("milestones"), dec(F.sum("v")).alias("value"))


@query("rpt_at_risk", f"SELECT demand_key, count(*) AS overdue, CAST(max(-days) AS INT) AS most_days, CAST(max(estimated_cost) AS DECIMAL(18,2)) AS value FROM {_OPEN} WHERE days < 0 GROUP BY 1")
def _(t):
    return open_milestones(t).where("days < 0").groupBy("demand_key").agg(F.count("*").alias("overdue"), F.max(-F.col("days")).alias("most_days"), dec(F.max("estimated_cost")).alias("value"))


@query("rpt_milestone_reminders", f"SELECT officer_key, count(*) AS n, string_agg(demand_no || ':' || CAST(days AS VARCHAR), ',' ORDER BY demand_key, milestone_no) AS list FROM {_OPEN} WHERE days BETWEEN 0 AND 30 GROUP BY 1")
def _(t):
    rows = open_milestones(t).where("days between 0 and 30")
    got = F.sort_array(F.collect_list(F.struct("demand_key", "milestone_no", "demand_no", "days")))
    return rows.groupBy("officer_key").agg(F.count("*").alias("n"), F.array_join(F.transform(got, lambda x: F.concat(x["demand_no"], F.lit(":"), x["days"].cast("string"))), ",").alias("list"))


@query("rpt_upcoming", f"SELECT demand_key, milestone_no, CAST(days AS INT) AS days FROM {_OPEN} WHERE days > 0 ORDER BY days, demand_key, milestone_no LIMIT 50")
def _(t):
    return open_milestones(t).where("days > 0").orderBy("days", "demand_key", "milestone_no").limit(50).select("demand_key", "milestone_no", "days")


_VEND = "(SELECT r.vendor_key, count(*) AS n, count_if(r.receipt_date <= d.planned_date) AS on_time, count_if(r.receipt_date > d.planned_date) AS overdue, CAST(sum(r.qty) AS DECIMAL(18,2)) AS qty, round(avg(greatest(datediff('day', d.planned_date, r.receipt_date), 0)), 4) AS avg_delay FROM receipt r JOIN demand d ON r.demand_key = d.demand_key GROUP BY 1)"


def vendor_performance(t):
    r = t.receipt.join(t.demand.select("demand_key", "planned_date"), "demand_key")
    late = F.col("receipt_date") > F.col("planned_date")
    return r.groupBy("vendor_key").agg(F.count("*").alias("n"), F.count_if(~late).alias("on_time"), F.count_if(late).alias("overdue"), dec(F.sum("qty")).alias("qty"), F.round(F.avg(F.greatest(F.datediff("receipt_date", "planned_date"), F.lit(0))), 4).alias("avg_delay"))


@query("rpt_vendor_perf", f"SELECT vendor_key, n, on_time, overdue, round(CAST(on_time AS DOUBLE) / n, 4) AS rate FROM {_VEND}")
def _(t):
    return vendor_performance(t).select("vendor_key", "n", "on_time", "overdue", safe_rate(F.col("on_time"), F.col("n")).alias("rate"))


@query("rpt_vendor_accountability", f"SELECT vendor_key, overdue, n, avg_delay FROM {_VEND} WHERE overdue > 0")
def _(t):
    return vendor_performance(t).where("overdue > 0").select("vendor_key", "overdue", "n", "avg_delay")


@query("rpt_vendor_scorecard", f"SELECT v.vendor_name, p.on_time, p.overdue, p.qty FROM {_VEND} p JOIN vendor v ON v.vendor_key = p.vendor_key")
def _(t):
    return vendor_performance(t).join(t.vendor, "vendor_key").select("vendor_name", "on_time", "overdue", "qty")


@query("rpt_top_vendors", "SELECT vendor_key, count(DISTINCT demand_key) AS orders, CAST(sum(qty) AS DECIMAL(18,2)) AS qty FROM demand_item GROUP BY 1 ORDER BY qty DESC, vendor_key LIMIT 10")
def _(t):
    g = t.demand_item.groupBy("vendor_key").agg(F.count_distinct("demand_key").alias("orders"), dec(F.sum("qty")).alias("qty"))
    return g.orderBy(F.desc("qty"), "vendor_key").limit(10)


@query("rpt_vendor_material", "SELECT vendor_key, material_key, count(*) AS n, CAST(sum(qty) AS DECIMAL(18,2)) AS qty FROM receipt GROUP BY 1, 2")
def _(t):
    return t.receipt.groupBy("vendor_key", "material_key").agg(F.count("*").alias("n"), dec(F.sum("qty")).alias("qty"))


@query("rpt_untracked_summary", "SELECT status_category, count(*) AS n, CAST(sum(estimated_cost) AS DECIMAL(18,2)) AS value FROM demand WHERE demand_key NOT IN (SELECT demand_key FROM milestone) GROUP BY 1")
def _(t):
    return t.demand.join(t.milestone, "demand_key", "left_anti").groupBy("status_category").agg(F.count("*").alias("n"), dec(F.sum("estimated_cost")).alias("value"))


_FULFIL = "(SELECT d.demand_key, d.planned_date, CAST(coalesce(i.q, 0) AS DECIMAL(18,2)) AS ordered, CAST(coalesce(r.q, 0) AS DECIMAL(18,2)) AS received FROM demand d LEFT JOIN (SELECT demand_key, sum(qty) AS q FROM demand_item GROUP BY 1) i ON i.demand_key = d.demand_key LEFT JOIN (SELECT demand_key, sum(qty) AS q FROM receipt GROUP BY 1) r ON r.demand_key = d.demand_key)"


def fulfilment(t):
    i = t.demand_item.groupBy("demand_key").agg(F.sum("qty").alias("ordered"))
    r = t.receipt.groupBy("demand_key").agg(F.sum("qty").alias("received"))
    return t.demand.join(i, "demand_key", "left").join(r, "demand_key", "left").withColumns({c: dec(F.col(c)) for c in ("ordered", "received")})


@query("rpt_untracked_list", f"SELECT demand_key, CASE WHEN ordered > 0 THEN round(CAST(received AS DOUBLE) / CAST(ordered AS DOUBLE), 4) ELSE 0.0 END AS fulfilled FROM {_FULFIL} WHERE demand_key NOT IN (SELECT demand_key FROM milestone)")
def _(t):
    return fulfilment(t).join(t.milestone, "demand_key", "left_anti").select("demand_key", safe_rate(F.col("received").cast("double"), F.col("ordered").cast("double")).alias("fulfilled"))


@query("rpt_overdue", f"SELECT demand_key, CAST(ordered - received AS DECIMAL(18,2)) AS pending FROM {_FULFIL} WHERE planned_date < DATE '{AS_OF}' AND ordered > received")
def _(t):
    return fulfilment(t).where((F.col("planned_date") < day()) & (F.col("ordered") > F.col("received"))).select("demand_key", (F.col("ordered") - F.col("received")).cast("decimal(18,2)").alias("pending"))


@query("rpt_immediate", f"SELECT demand_key, CAST(ordered - received AS DECIMAL(18,2)) AS balance FROM {_FULFIL} WHERE planned_date <= DATE '1998-06-08' AND ordered > received")
def _(t):
    return fulfilment(t).where("planned_date <= date'1998-06-08' and ordered > received").select("demand_key", (F.col("ordered") - F.col("received")).cast("decimal(18,2)").alias("balance"))


@query("rpt_issued_to_vendor", f"SELECT issue_key, line_no, vendor_key, CAST(datediff('day', issue_date, DATE '{AS_OF}') AS INT) AS days FROM issue")
def _(t):
    return t.issue.select("issue_key", "line_no", "vendor_key", F.datediff(day(), "issue_date").alias("days"))


@query("rpt_cost_variance", "SELECT demand_key, CAST(actual_cost - estimated_cost AS DECIMAL(18,2)) AS variance, CASE WHEN estimated_cost > 0 THEN round(CAST(actual_cost - estimated_cost AS DOUBLE) / CAST(estimated_cost AS DOUBLE), 4) ELSE 0.0 END AS share FROM demand")
def _(t):
    v = (F.col("actual_cost") - F.col("estimated_cost")).cast("decimal(18,2)")
    return t.demand.select("demand_key", v.alias("variance"), safe_rate(v.cast("double"), F.col("estimated_cost").cast("double")).alias("share"))


@query("rpt_status_dist", "SELECT status, count(*) AS n FROM demand GROUP BY 1")
def _(t):
    return t.demand.groupBy("status").agg(F.count("*").alias("n"))


@query("rpt_order_type_detail", f"SELECT material_key, rm_type, e AS engines, e = min(e) OVER (PARTITION BY rm_type) AS is_bottleneck FROM (SELECT *, CAST(floor(CAST(greatest(stock, 0) AS DOUBLE) / required_per_engine) AS BIGINT) AS e FROM {_FLOWS})")
def _(t):
    f = flows(t).withColumn("engines", F.floor(F.greatest(F.col("stock").cast("double"), F.lit(0.0)) / F.col("required_per_engine")).cast("long"))
    least = f.groupBy("rm_type").agg(F.min("engines").alias("m"))
    return f.join(least, "rm_type").select("material_key", "rm_type", "engines", (F.col("engines") == F.col("m")).alias("is_bottleneck"))


@query("rpt_order_type_metrics", f"SELECT rm_type, CAST(min(floor(CAST(greatest(stock, 0) AS DOUBLE) / required_per_engine)) AS BIGINT) AS engines, count_if(received = 0) AS not_received FROM {_FLOWS} GROUP BY 1")
def _(t):
    e = F.floor(F.greatest(F.col("stock").cast("double"), F.lit(0.0)) / F.col("required_per_engine")).cast("long")
    return flows(t).groupBy("rm_type").agg(F.min(e).alias("engines"), F.count_if(F.col("received") == 0).alias("not_received"))


# --- quality -----------------------------------------------------------------------------------

_NCR = "(SELECT *, datediff('day', received_date, DATE '1995-03-01') AS age FROM ncr)"


def aged(t):
    return t.ncr.withColumn("age", F.datediff(F.to_date(F.lit("1995-03-01")), "received_date"))


@query("rpt_ncr_age", f"SELECT CASE WHEN age <= 30 THEN '0-30' WHEN age <= 60 THEN '31-60' ELSE '>60' END AS bucket, count(*) AS n FROM {_NCR} WHERE stage <> 'Cleared' GROUP BY 1")
def _(t):
    from .text_queries import age_bucket

    return aged(t).where("stage <> 'Cleared'").groupBy(age_bucket(F.col("age")).alias("bucket")).agg(F.count("*").alias("n"))


@query("rpt_ncr_grouping_sets", "SELECT stage, module_key, engine, count(*) AS n FROM ncr GROUP BY GROUPING SETS ((stage), (module_key), (engine))")
def _(t):
    cols = [F.col(c) for c in ("stage", "module_key", "engine")]
    return t.ncr.groupingSets([[c] for c in cols], *cols).agg(F.count("*").alias("n"))


@query("rpt_top_ncr_parts", "SELECT part_key, count(*) AS n, string_agg(CAST(ncr_key AS VARCHAR), ',' ORDER BY ncr_key, line_no) AS ncrs FROM ncr GROUP BY 1 ORDER BY n DESC, part_key LIMIT 10")
def _(t):
    top = t.ncr.groupBy("part_key").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("ncr_key", "line_no"))).alias("l")).orderBy(F.desc("n"), "part_key").limit(10)
    return top.select("part_key", "n", F.array_join(F.transform("l", lambda x: x["ncr_key"].cast("string")), ",").alias("ncrs"))


@query("rpt_ncr_distribution", "SELECT count(*) AS total, count_if(stage = 'Cleared') AS cleared, count_if(stage = 'In Process') AS in_process, count_if(stage = 'Rejected') AS rejected, count_if(stage = 'Not Yet Assigned') AS unassigned FROM ncr")
def _(t):
    n = lambda s, a: F.count_if(F.col("stage") == s).alias(a)
    return t.ncr.agg(F.count("*").alias("total"), n("Cleared", "cleared"), n("In Process", "in_process"), n("Rejected", "rejected"), n("Not Yet Assigned", "unassigned"))


@query("rpt_ncr_overview", "SELECT engine, count(*) AS total, count_if(stage <> 'Not Yet Assigned') AS in_workflow FROM ncr GROUP BY 1")
def _(t):
    return t.ncr.groupBy("engine").agg(F.count("*").alias("total"), F.count_if(F.col("stage") != "Not Yet Assigned").alias("in_workflow"))


@query("rpt_ncr_assignments", "SELECT vendor_key, stage, count(*) AS n, count(DISTINCT part_key) AS parts FROM ncr GROUP BY 1, 2")
def _(t):
    return t.ncr.groupBy("vendor_key", "stage").agg(F.count("*").alias("n"), F.count_distinct("part_key").alias("parts"))


@query("rpt_ncr_module", "SELECT module_key, count(*) AS n, max(received_date) AS latest FROM ncr GROUP BY 1")
def _(t):
    return t.ncr.groupBy("module_key").agg(F.count("*").alias("n"), F.max("received_date").alias("latest"))


@query("rpt_rework", "SELECT n.ncr_key, n.line_no, m.material_name FROM ncr n JOIN material m ON m.material_key = n.part_key WHERE n.stage = 'In Process'")
def _(t):
    m = t.material.select(F.col("material_key").alias("part_key"), "material_name")
    return t.ncr.where("stage = 'In Process'").join(m, "part_key").select("ncr_key", "line_no", "material_name")


@query("rpt_parts_by", "SELECT rm_type, uom, count(*) AS n FROM material GROUP BY GROUPING SETS ((rm_type), (uom))")
def _(t):
    cols = [F.col("rm_type"), F.col("uom")]
    return t.material.groupingSets([[c] for c in cols], *cols).agg(F.count("*").alias("n"))


@query("rpt_drawing_coverage", "SELECT count(*) AS parts, count_if(part_key IN (SELECT material_key FROM receipt)) AS with_receipt, count_if(part_key IN (SELECT part_key FROM ncr)) AS with_ncr FROM bom")
def _(t):
    has = lambda df, c, n: df.select(F.col(c).alias("part_key")).distinct().withColumn(n, F.lit(True))
    b = t.bom.join(has(t.receipt, "material_key", "r"), "part_key", "left").join(has(t.ncr, "part_key", "n"), "part_key", "left")
    return b.agg(F.count("*").alias("parts"), F.count("r").alias("with_receipt"), F.count("n").alias("with_ncr"))


@query("rpt_recent_revisions", "SELECT part_key, revision FROM baseline_part WHERE baseline = 2 ORDER BY revision DESC, part_key LIMIT 25")
def _(t):
    return t.baseline_part.where("baseline = 2").orderBy(F.desc("revision"), "part_key").limit(25).select("part_key", "revision")


@query("rpt_freshness", f"SELECT state, count(*) AS n FROM (SELECT CASE WHEN max(receipt_date) IS NULL THEN 'NoUpdate' WHEN datediff('day', max(receipt_date), DATE '1995-06-01') <= 30 THEN 'Green' WHEN datediff('day', max(receipt_date), DATE '1995-06-01') <= 90 THEN 'Amber' ELSE 'Red' END AS state FROM vendor v LEFT JOIN receipt r ON v.vendor_key = r.vendor_key GROUP BY v.vendor_key) GROUP BY 1")
def _(t):
    last = t.receipt.groupBy("vendor_key").agg(F.max("receipt_date").alias("last"))
    days = F.datediff(F.to_date(F.lit("1995-06-01")), "last")
    state = F.when(F.col("last").isNull(), "NoUpdate").when(days <= 30, "Green").when(days <= 90, "Amber").otherwise("Red")
    return t.vendor.join(last, "vendor_key", "left").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("rpt_split_variance", "SELECT i.demand_key, i.line_no, CAST(sum(i.qty) - coalesce(max(r.q), 0) AS DECIMAL(18,2)) AS variance FROM demand_item i LEFT JOIN (SELECT demand_key, line_no, sum(qty) AS q FROM receipt GROUP BY 1, 2) r ON r.demand_key = i.demand_key AND r.line_no = i.line_no GROUP BY 1, 2")
def _(t):
    keys = ["demand_key", "line_no"]
    a, b = t.demand_item.groupBy(*keys).agg(F.sum("qty").alias("a")), t.receipt.groupBy(*keys).agg(F.sum("qty").alias("b"))
    return a.join(b, keys, "left").select(*keys, (F.col("a") - F.coalesce("b", F.lit(0))).cast("decimal(18,2)").alias("variance"))


@query("rpt_entry_completeness", "SELECT count(*) AS demands, count_if(demand_key NOT IN (SELECT demand_key FROM demand_item)) AS without_items, count_if(demand_key NOT IN (SELECT demand_key FROM milestone)) AS without_milestones, count_if(demand_key NOT IN (SELECT demand_key FROM receipt)) AS without_receipts FROM demand")
def _(t):
    d = t.demand.select("demand_key")
    for name in ("demand_item", "milestone", "receipt"):
        d = d.join(getattr(t, name).select("demand_key").distinct().withColumn(name, F.lit(1)), "demand_key", "left")
    none = lambda c, a: F.count_if(F.col(c).isNull()).alias(a)
    return d.agg(F.count("*").alias("demands"), none("demand_item", "without_items"), none("milestone", "without_milestones"), none("receipt", "without_receipts"))


@query("rpt_issue_rollup", "SELECT material_key, vendor_key, CAST(sum(qty) AS DECIMAL(18,2)) AS qty FROM issue GROUP BY ROLLUP (material_key, vendor_key)")
def _(t):
    return t.issue.rollup("material_key", "vendor_key").agg(dec(F.sum("qty")).alias("qty"))


@query("rpt_material_issue", "SELECT i.issue_key, i.line_no, m.material_name, v.vendor_name, i.qty FROM issue i JOIN material m ON m.material_key = i.material_key JOIN vendor v ON v.vendor_key = i.vendor_key")
def _(t):
    return t.issue.join(t.material, "material_key").join(t.vendor, "vendor_key").select("issue_key", "line_no", "material_name", "vendor_name", "qty")


@query("rpt_rmc_trace", "SELECT heat_no, count(*) AS receipts, count(DISTINCT material_key) AS materials, CAST(sum(qty) AS DECIMAL(18,2)) AS qty, count_if(status_remarks = 'Rejected') AS rejected FROM receipt GROUP BY 1")
def _(t):
    return t.receipt.groupBy("heat_no").agg(F.count("*").alias("receipts"), F.count_distinct("material_key").alias("materials"), dec(F.sum("qty")).alias("qty"), F.count_if(F.col("status_remarks") == "Rejected").alias("rejected"))


@query("rpt_vendor_split", "SELECT i.demand_key, i.line_no, v.vendor_name, CAST(coalesce(i.qty, 0) AS DECIMAL(18,2)) AS qty FROM demand_item i JOIN vendor v ON v.vendor_key = i.vendor_key ORDER BY 1, 2, 3, 4")
def _(t):
    return t.demand_item.join(t.vendor, "vendor_key").select("demand_key", "line_no", "vendor_name", dec(F.col("qty")).alias("qty")).orderBy("demand_key", "line_no", "vendor_name", "qty")

"""Queries of filters, joins, aggregates, windows, paging, set operations and changes over the domain views."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import aggregates as A, changes as C, filters as B, joins as J
from ..registry import query


def money(c):
    return F.coalesce(F.sum(c), F.lit(0)).cast("decimal(18,2)")


# --- sources -----------------------------------------------------------------------------------


@query("scan_count", "SELECT 'orders' AS table_name, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem")
def _(t):
    one = lambda n: getattr(t, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("table_name"), "n")
    return one("orders").unionByName(one("lineitem"))


@query("schema_evolve_union", "SELECT vendor_key, vendor_name, CAST(NULL AS VARCHAR) AS rating FROM vendor WHERE vendor_key % 2 = 0 UNION ALL SELECT vendor_key, NULL, 'A' FROM vendor WHERE vendor_key % 2 = 1")
def _(t):
    base = t.vendor.where("vendor_key % 2 = 0").select("vendor_key", "vendor_name")
    more = t.vendor.where("vendor_key % 2 = 1").select("vendor_key", F.lit("A").alias("rating"))
    return base.unionByName(more, allowMissingColumns=True)


@query("cached_dim_join", "SELECT c.c_mktsegment, n.n_name, count(*) AS n FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY 1, 2")
def _(t):
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("c_mktsegment", "n_name").agg(F.count("*").alias("n"))


@query("log_step_parse", r"SELECT event_id, regexp_extract(line, 'step (\w+) done', 1) AS step, try_cast(regexp_extract(line, 'in ([0-9]+) ms', 1) AS BIGINT) AS ms FROM (SELECT event_id, 'step ' || event_type || ' done in ' || CAST(event_id % 1000 AS VARCHAR) || ' ms' AS line FROM events)")
def _(t):
    line = F.concat(F.lit("step "), "event_type", F.lit(" done in "), (F.col("event_id") % 1000).cast("string"), F.lit(" ms"))
    e = t.events.select("event_id", line.alias("line"))
    return e.select("event_id", F.regexp_extract("line", r"step (\w+) done", 1).alias("step"), F.regexp_extract("line", "in ([0-9]+) ms", 1).try_cast("long").alias("ms"))


# --- filters -----------------------------------------------------------------------------------


@query("active_default", "SELECT demand_key, status FROM demand WHERE coalesce(is_active, 1) = 1")
def _(t):
    return B.active(t.demand, "is_active").select("demand_key", "status")


@query("optional_filters", "SELECT notification_key, email_key FROM notification WHERE notification_type = 'NewEmail' AND is_read = 0")
def _(t):
    return B.optional(t.notification, notification_type="NewEmail", is_read=0, is_action_required=None).select("notification_key", "email_key")


@query("zero_means_all", "SELECT demand_key, is_active FROM demand WHERE is_active IS NOT NULL")
def _(t):
    return B.zero_means_all(t.demand, "is_active", 0).select("demand_key", "is_active")


@query("all_sentinel", "SELECT ncr_key, line_no, part_key FROM ncr WHERE stage = 'Rejected'")
def _(t):
    return B.all_sentinel(t.ncr, stage="Rejected", engine="All").select("ncr_key", "line_no", "part_key")


@query("typeahead_top20", "SELECT material_key, material_name FROM material WHERE lower(material_name) LIKE '%a%' OR lower(rm_type) LIKE '%a%' ORDER BY material_name NULLS LAST, material_key LIMIT 20")
def _(t):
    return B.search(t.material, "A", ["material_name", "rm_type"], 20, ["material_name", "material_key"]).select("material_key", "material_name")


@query("multi_field_search", "SELECT message_id FROM email WHERE contains(lower(coalesce(subject, '')), 'topic 1') OR contains(lower(coalesce(converted_task, '')), 'topic 1')")
def _(t):
    return B.search(t.email, "Topic 1", ["subject", "converted_task"]).select("message_id")


@query("keyset_semi", "SELECT demand_key, status FROM demand WHERE demand_key IN (SELECT demand_key FROM receipt WHERE status_remarks = 'Rejected')")
def _(t):
    return t.demand.join(t.receipt.where("status_remarks = 'Rejected'"), "demand_key", "left_semi").select("demand_key", "status")


@query("distinct_nonempty", "SELECT DISTINCT batch_no FROM receipt WHERE batch_no IS NOT NULL AND batch_no <> '' ORDER BY 1")
def _(t):
    return t.receipt.where("batch_no is not null and batch_no <> ''").select("batch_no").distinct().orderBy("batch_no")


@query("lookback_window", "SELECT notification_key FROM notification WHERE created >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 10 DAY AND created <= TIMESTAMP '2024-01-31 00:00:00'")
def _(t):
    return B.lookback(t.notification, "created", F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"), 10).select("notification_key")


_BUCKET = "CASE WHEN planned_date = DATE '1998-06-01' THEN 'today' WHEN planned_date < DATE '1998-06-01' AND status_category <> 'Closed' THEN 'overdue' WHEN planned_date > DATE '1998-06-01' AND planned_date <= DATE '1998-06-08' THEN 'upcoming' END"


_SLICES = "SELECT slice, number, demand_key, planned_date FROM (SELECT *, row_number() OVER (PARTITION BY slice ORDER BY planned_date, demand_key) AS number FROM (SELECT demand_key, planned_date, CASE WHEN planned_date > DATE '1998-06-01' THEN 'upcoming' WHEN planned_date < DATE '1998-06-01' THEN 'overdue' END AS slice FROM demand WHERE status_category <> 'Closed')) WHERE slice IS NOT NULL AND number <= CASE slice WHEN 'upcoming' THEN 5 ELSE 3 END"


@query("day_slices", _SLICES)
def _(t):
    """The first five upcoming and the first three overdue demands that are open: a top n of each slice, not a window over all."""
    day = F.to_date(F.lit("1998-06-01"))
    rows = t.demand.where("status_category <> 'Closed'").select("demand_key", "planned_date")
    first = lambda name, where, n: rows.where(where).orderBy("planned_date", "demand_key").limit(n).withColumn("slice", F.lit(name))
    both = first("upcoming", F.col("planned_date") > day, 5).unionByName(first("overdue", F.col("planned_date") < day, 3))
    return both.select("slice", F.row_number().over(Window.partitionBy("slice").orderBy("planned_date", "demand_key")).cast("long").alias("number"), "demand_key", "planned_date")


@query("day_buckets", f"SELECT bucket, count(*) AS n FROM (SELECT {_BUCKET} AS bucket FROM demand) WHERE bucket IS NOT NULL GROUP BY bucket")
def _(t):
    b = B.day_bucket(F.col("planned_date"), F.col("status_category") == "Closed", F.to_date(F.lit("1998-06-01")))
    return t.demand.select(b.alias("bucket")).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))


@query("tab_filter", "SELECT notification_key, is_read FROM notification WHERE is_action_required = 1 AND email_key % 2 = 0")
def _(t):
    tabs = {"all": F.lit(True), "mine": (F.col("is_action_required") == 1) & (F.col("email_key") % 2 == 0)}
    return t.notification.where(tabs["mine"]).select("notification_key", "is_read")


@query("json_has_key", "SELECT event_id FROM events WHERE contains(props, '\"k\"')")
def _(t):
    return t.events.where(F.contains("props", F.lit('"k"'))).select("event_id")


@query("range_list", "SELECT demand_key, officer_key, demand_date FROM demand WHERE demand_date >= DATE '1998-07-01' AND demand_date <= DATE '1998-08-01' AND officer_key = 3 AND contains(lower(demand_no), 'd-')")
def _(t):
    d = B.optional(t.demand, officer_key=3).where("demand_date between date'1998-07-01' and date'1998-08-01'")
    return B.search(d, "D-", ["demand_no"]).select("demand_key", "officer_key", "demand_date")


@query("min_length", "SELECT material_key FROM material WHERE length(material_name) > 6")
def _(t):
    return t.material.where(F.char_length("material_name") > 6).select("material_key")


@query("log_since", "SELECT seq, request_id, level FROM log_event WHERE seq > 100 AND level IN ('WARNING', 'ERROR') ORDER BY seq LIMIT 500")
def _(t):
    rank = F.create_map(*[x for k, v in (("DEBUG", 0), ("INFO", 1), ("WARNING", 2), ("ERROR", 3)) for x in (F.lit(k), F.lit(v))])
    return t.log_event.where((F.col("seq") > 100) & (rank[F.col("level")] >= 2)).orderBy("seq").limit(500).select("seq", "request_id", "level")


@query("scope_rows", "SELECT demand_key FROM demand WHERE officer_key IN (1, 2)")
def _(t):
    level, user = "own", 1
    d = t.demand.withColumn("assignees", F.array("officer_key", F.col("officer_key") - 1))
    return (d if level == "all" else d.where(F.array_contains("assignees", user))).select("demand_key")


@query("text_guard", r"SELECT doc_id, regexp_matches(upper(trim(text)), '\b(DELETE|UPDATE|CREATE)\b') AS changes FROM documents")
def _(t):
    return t.documents.select("doc_id", F.upper(F.trim("text")).rlike(r"\b(DELETE|UPDATE|CREATE)\b").alias("changes"))


# --- joins -------------------------------------------------------------------------------------


@query("inner_3way", "SELECT r.demand_key, r.line_no, d.status, v.vendor_name, r.qty FROM receipt r JOIN demand d ON r.demand_key = d.demand_key JOIN vendor v ON r.vendor_key = v.vendor_key")
def _(t):
    return t.receipt.join(t.demand, "demand_key").join(t.vendor, "vendor_key").select("demand_key", "line_no", "status", "vendor_name", "qty")


@query("anti_join", "SELECT demand_key FROM demand WHERE demand_key NOT IN (SELECT demand_key FROM milestone WHERE status = 'Active')")
def _(t):
    return J.anti(t.demand, t.milestone.where("status = 'Active'"), ["demand_key"]).select("demand_key")


@query("left_on_filter", "SELECT d.demand_key, i.issue_key, i.line_no FROM demand d LEFT JOIN (SELECT * FROM issue WHERE qty > 20) i ON d.demand_key = i.issue_key")
def _(t):
    big = t.issue.where("qty > 20").withColumn("demand_key", F.col("issue_key"))
    return t.demand.select("demand_key").join(big, "demand_key", "left").select("demand_key", "issue_key", "line_no")


@query("left_join", "SELECT p.project_key, p.title, d.demand_key FROM project p LEFT JOIN demand d ON p.project_key = d.project_key")
def _(t):
    return t.project.join(t.demand, "project_key", "left").select("project_key", "title", "demand_key")


@query("mark_join", "SELECT notification_key FROM notification n WHERE notification_type = 'TaskDue' OR NOT EXISTS (SELECT 1 FROM relationship r WHERE r.email_key = n.email_key AND r.is_confirmed = 1)")
def _(t):
    m = J.marked(t.notification, t.relationship.where("is_confirmed = 1"), "email_key", "confirmed")
    return m.where("notification_type = 'TaskDue' or not confirmed").select("notification_key")


@query("lookup_enrich", "SELECT i.issue_key, i.line_no, coalesce(v.vendor_name, '') AS vendor_name FROM issue i LEFT JOIN (SELECT * FROM vendor WHERE vendor_key % 3 <> 0) v ON i.vendor_key = v.vendor_key")
def _(t):
    v = t.vendor.where("vendor_key % 3 <> 0")
    return t.issue.join(v, "vendor_key", "left").select("issue_key", "line_no", F.coalesce("vendor_name", F.lit("")).alias("vendor_name"))


@query("scalar_lookup", "SELECT vendor_key, (SELECT n_name FROM nation WHERE n_nationkey = country_key) AS country FROM vendor")
def _(t):
    return t.vendor.join(t.nation, F.col("country_key") == F.col("n_nationkey"), "left").select("vendor_key", F.col("n_name").alias("country"))


@query("or_join", """SELECT DISTINCT a.message_id AS a_id, b.message_id AS b_id FROM email a JOIN email b ON a.message_id <> b.message_id
  AND (coalesce(a.in_reply_to, a.message_id) = coalesce(b.in_reply_to, b.message_id) OR b.in_reply_to = a.message_id OR a.in_reply_to = b.message_id)""")
def _(t):
    thread = F.coalesce("in_reply_to", "message_id")
    a = t.email.select(F.col("message_id").alias("a_id"), F.col("in_reply_to").alias("a_reply"), thread.alias("a_thread"))
    b = a.toDF("b_id", "b_reply", "b_thread")
    return J.or_join(a, b, [("a_thread", "b_thread"), ("a_id", "b_reply"), ("a_reply", "b_id")], ["a_id", "b_id"]).where("a_id <> b_id")


@query("children_of", "SELECT p.part_key, c.part_key AS child_key FROM bom p JOIN bom c ON c.parent_key = p.part_key")
def _(t):
    c = t.bom.select(F.col("parent_key").alias("part_key"), F.col("part_key").alias("child_key"))
    return t.bom.select("part_key").join(c, "part_key")


@query("parents_with_leaf", "SELECT part_key FROM bom WHERE part_key IN (SELECT parent_key FROM bom WHERE part_key NOT IN (SELECT parent_key FROM bom WHERE parent_key IS NOT NULL))")
def _(t):
    leaves = t.bom.join(t.bom.select(F.col("parent_key").alias("part_key")), "part_key", "left_anti")
    return t.bom.join(leaves.select(F.col("parent_key").alias("part_key")), "part_key", "left_semi").select("part_key")


@query("baseline_compare", """SELECT coalesce(a.part_key, b.part_key) AS part_key, a.revision AS old_revision, b.revision AS new_revision,
  CASE WHEN a.part_key IS NULL THEN 'Added' WHEN b.part_key IS NULL THEN 'Removed' WHEN a.revision IS NOT DISTINCT FROM b.revision AND a.qty IS NOT DISTINCT FROM b.qty THEN 'Same' ELSE 'Changed' END AS change_type
  FROM (SELECT * FROM baseline_part WHERE baseline = 1) a FULL JOIN (SELECT * FROM baseline_part WHERE baseline = 2) b ON a.part_key = b.part_key""")
def _(t):
    b = t.baseline_part
    return J.compare(b.where("baseline = 1"), b.where("baseline = 2"), "part_key", ["revision", "qty"]).select("part_key", "old_revision", "new_revision", "change_type")


@query("user_name_join", "SELECT d.demand_key, c.c_name AS officer_name FROM demand d LEFT JOIN customer c ON d.officer_key = c.c_custkey")
def _(t):
    c = t.customer.select(F.col("c_custkey").alias("officer_key"), F.col("c_name").alias("officer_name"))
    return t.demand.join(c, "officer_key", "left").select("demand_key", "officer_name")


@query("key_not_position", "SELECT i.issue_key, i.line_no, m.material_name FROM issue i JOIN material m ON i.material_key = m.material_key")
def _(t):
    return t.issue.join(t.material, "material_key").select("issue_key", "line_no", "material_name")


@query("dense_crosstab", "SELECT e.engine, s.stage, CAST(coalesce(n, 0) AS BIGINT) AS value FROM (SELECT DISTINCT engine FROM ncr) e CROSS JOIN (SELECT DISTINCT stage FROM ncr) s LEFT JOIN (SELECT engine, stage, count(*) AS n FROM ncr GROUP BY 1, 2) c ON c.engine = e.engine AND c.stage = s.stage")
def _(t):
    return J.dense(t.ncr, "engine", "stage", F.count("*"))


# --- aggregates --------------------------------------------------------------------------------


@query("material_summary", """SELECT m.material_key, coalesce(r.n, 0) AS n_receipts, CAST(coalesce(r.q, 0) AS DECIMAL(18,2)) AS received, CAST(coalesce(i.q, 0) AS DECIMAL(18,2)) AS issued, CAST(coalesce(r.q, 0) - coalesce(i.q, 0) AS DECIMAL(18,2)) AS stock
  FROM material m LEFT JOIN (SELECT material_key, count(*) AS n, sum(qty) AS q FROM receipt GROUP BY 1) r ON m.material_key = r.material_key LEFT JOIN (SELECT material_key, sum(qty) AS q FROM issue GROUP BY 1) i ON m.material_key = i.material_key""")
def material_summary(t):
    r = t.receipt.groupBy("material_key").agg(F.count("*").alias("n"), F.sum("qty").alias("r"))
    i = t.issue.groupBy("material_key").agg(F.sum("qty").alias("i"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = t.material.join(r, "material_key", "left").join(i, "material_key", "left")
    return out.select("material_key", zero("n").alias("n_receipts"), zero("r").cast("decimal(18,2)").alias("received"), zero("i").cast("decimal(18,2)").alias("issued"), (zero("r") - zero("i")).cast("decimal(18,2)").alias("stock"))


@query("sum_or_zero", "SELECT p.project_key, CAST(coalesce(sum(d.actual_cost), 0) AS DECIMAL(18,2)) AS spent FROM project p LEFT JOIN (SELECT * FROM demand WHERE status = 'Cancellation') d ON d.project_key = p.project_key GROUP BY 1")
def _(t):
    d = t.demand.where("status = 'Cancellation'").select("project_key", "actual_cost")
    return t.project.join(d, "project_key", "left").groupBy("project_key").agg(money("actual_cost").alias("spent"))


@query("conditional_counts", "SELECT email_key, count(*) AS total, count_if(is_read = 0) AS unread, count_if(is_action_required = 1) AS action_required, count_if(notification_type = 'NewEmail') AS new_mail FROM notification GROUP BY 1")
def _(t):
    return t.notification.groupBy("email_key").agg(F.count("*").alias("total"), A.count_if(F.col("is_read") == 0).alias("unread"), A.count_if(F.col("is_action_required") == 1).alias("action_required"), A.count_if(F.col("notification_type") == "NewEmail").alias("new_mail"))


@query("group_to_list", "SELECT vendor_key, string_agg(CAST(ncr_key AS VARCHAR), ',' ORDER BY ncr_key, line_no) AS ncrs FROM ncr GROUP BY 1")
def _(t):
    rows = F.sort_array(F.collect_list(F.struct("ncr_key", "line_no")))
    return t.ncr.groupBy("vendor_key").agg(F.array_join(F.transform(rows, lambda x: x["ncr_key"].cast("string")), ",").alias("ncrs"))


@query("distinct_count", "SELECT engine, count(DISTINCT part_key) AS parts FROM ncr GROUP BY 1")
def _(t):
    return t.ncr.groupBy("engine").agg(F.count_distinct("part_key").alias("parts"))


@query("first_per_group", "SELECT vendor_key, min(receipt_date) AS first_date FROM receipt GROUP BY 1")
def _(t):
    return B.first_of_each(t.receipt, ["vendor_key"], ["receipt_date", "demand_key", "line_no"]).select("vendor_key", F.col("receipt_date").alias("first_date"))


@query("string_agg", "SELECT material_key, string_agg(DISTINCT heat_no, ', ' ORDER BY heat_no) AS heats FROM receipt GROUP BY 1")
def _(t):
    return t.receipt.groupBy("material_key").agg(F.array_join(F.sort_array(F.collect_set("heat_no")), ", ").alias("heats"))


@query("status_pivot", "SELECT material_key, CAST(sum(CASE WHEN status_remarks = 'Accepted' THEN qty ELSE 0 END) AS DECIMAL(18,2)) AS accepted, CAST(sum(CASE WHEN status_remarks = 'Rejected' THEN qty ELSE 0 END) AS DECIMAL(18,2)) AS rejected, CAST(sum(qty) AS DECIMAL(18,2)) AS total FROM receipt GROUP BY 1")
def _(t):
    p = A.pivot_sum(t.receipt, ["material_key"], "status_remarks", "qty", ["Accepted", "Rejected"])
    return p.select("material_key", *[F.col(c).cast("decimal(18,2)").alias(c) for c in ("accepted", "rejected", "total")])


_ENGINES = ", ".join(f"coalesce(CAST(nullif(count_if(engine = 'E{k}'), 0) AS VARCHAR), '-') AS \"E{k}\"" for k in range(6))


@query("part_engine_pivot", f"SELECT part_key, {_ENGINES} FROM ncr GROUP BY part_key")
def _(t):
    p = t.ncr.groupBy("part_key").pivot("engine", [f"E{k}" for k in range(6)]).count()
    return p.select("part_key", *[F.coalesce(F.col(f"E{k}").cast("string"), F.lit("-")).alias(f"E{k}") for k in range(6)])


#: A JSON array, or a comma list without empty entries.
_SERIALS = """CASE WHEN trim(serial_nos) LIKE '[%]' THEN CAST(from_json(serial_nos, '["VARCHAR"]') AS VARCHAR[]) ELSE list_filter(list_transform(string_split(serial_nos, ','), lambda x: trim(x)), lambda x: x <> '') END"""


@query("usage_matrix", f"SELECT part_key, s AS serial, "
       + ", ".join(f"CASE WHEN bool_or(build_name = 'T{k}') THEN 'YES' ELSE 'NO' END AS t{k}" for k in range(4))
       + f" FROM (SELECT part_key, build_name, unnest({_SERIALS}) AS s FROM serial_text) GROUP BY 1, 2")
def _(t):
    """A column for each build that there is."""
    from ..functions.text import parse_serials

    rows = t.serial_text.select("part_key", F.lower("build_name").alias("build"), F.explode(parse_serials(F.col("serial_nos"))).alias("serial"))
    builds = [r.build for r in t.serial_text.select(F.lower("build_name").alias("build")).where("build is not null").distinct().orderBy("build").collect()]  # the columns of a matrix
    wide = rows.groupBy("part_key", "serial").pivot("build", builds).agg(F.max(F.lit("YES")))
    return wide.select("part_key", "serial", *[F.coalesce(F.col(f"`{b}`"), F.lit("NO")).alias(b) for b in builds])


@query("next_sequence", "SELECT demand_key, line_no, CAST(coalesce((SELECT max(demand_key) FROM demand), 0) + row_number() OVER (ORDER BY demand_key, line_no, vendor_key, material_key) AS BIGINT) AS new_key FROM demand_item")
def _(t):
    top = t.demand.agg(F.coalesce(F.max("demand_key"), F.lit(0))).first()[0]
    numbered = A.number_rows(t.demand_item, "demand_key", ["demand_key", "line_no", "vendor_key", "material_key"])
    return numbered.select("demand_key", "line_no", (F.col("number") + top).alias("new_key"))


@query("rollup_open_closed", "SELECT project_key, officer_key, count(*) AS total, count_if(status_category = 'Open') AS open_n, count_if(status_category = 'Closed') AS closed_n FROM demand GROUP BY ROLLUP (project_key, officer_key)")
def _(t):
    return t.demand.rollup("project_key", "officer_key").agg(F.count("*").alias("total"), A.count_if(F.col("status_category") == "Open").alias("open_n"), A.count_if(F.col("status_category") == "Closed").alias("closed_n"))


@query("cube_totals", "SELECT engine, stage, count(*) AS n FROM ncr GROUP BY CUBE (engine, stage)")
def _(t):
    return t.ncr.cube("engine", "stage").agg(F.count("*").alias("n"))


@query("budget_summary", "SELECT CAST(max(p.sanctioned_cost) AS DECIMAL(18,2)) AS budget, CAST(coalesce(sum(CASE WHEN d.status <> 'Cancellation' THEN d.actual_cost END), 0) AS DECIMAL(18,2)) AS spent FROM demand d JOIN project p ON d.project_key = p.project_key WHERE d.project_key = 3 HAVING count(DISTINCT d.project_key) = 1")
def _(t):
    d = t.demand.where("project_key = 3").join(t.project, "project_key")
    out = d.agg(F.max("sanctioned_cost").cast("decimal(18,2)").alias("budget"), money(F.when(F.col("status") != "Cancellation", F.col("actual_cost"))).alias("spent"), F.count_distinct("project_key").alias("n"))
    return out.where("n = 1").drop("n")


@query("safe_rate", "SELECT officer_key, CASE WHEN count(*) > 0 THEN round(CAST(count_if(status_category = 'Closed') AS DOUBLE) / count(*), 4) ELSE 0.0 END AS rate FROM demand GROUP BY 1")
def _(t):
    g = t.demand.groupBy("officer_key").agg(A.count_if(F.col("status_category") == "Closed").alias("a"), F.count("*").alias("b"))
    return g.select("officer_key", A.safe_rate(F.col("a"), F.col("b")).alias("rate"))


@query("max_level", "SELECT engine, max(line_no) AS max_level FROM ncr GROUP BY 1")
def _(t):
    return t.ncr.groupBy("engine").agg(F.max("line_no").alias("max_level"))


@query("duplicate_ids", "SELECT demand_key, material_key, count(*) AS n FROM receipt GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    return t.receipt.groupBy("demand_key", "material_key").agg(F.count("*").alias("n")).where("n > 1")


@query("module_type_counts", "SELECT module_key, count_if(line_no <= 2) AS assemblies, count_if(line_no BETWEEN 3 AND 4) AS subassemblies, count_if(line_no > 4) AS parts, count(*) AS total FROM ncr GROUP BY 1")
def _(t):
    n = F.col("line_no")
    return t.ncr.groupBy("module_key").agg(A.count_if(n <= 2).alias("assemblies"), A.count_if(n.between(3, 4)).alias("subassemblies"), A.count_if(n > 4).alias("parts"), F.count("*").alias("total"))


@query("item_balance", """SELECT d.demand_key, d.material_key, CAST(d.q - coalesce(r.q, 0) AS DECIMAL(18,2)) AS balance FROM (SELECT demand_key, material_key, sum(qty) AS q FROM demand_item GROUP BY 1, 2) d
  LEFT JOIN (SELECT demand_key, material_key, sum(qty) AS q FROM receipt GROUP BY 1, 2) r ON d.demand_key = r.demand_key AND d.material_key = r.material_key""")
def _(t):
    keys = ["demand_key", "material_key"]
    d, r = t.demand_item.groupBy(*keys).agg(F.sum("qty").alias("d")), t.receipt.groupBy(*keys).agg(F.sum("qty").alias("r"))
    return d.join(r, keys, "left").select(*keys, (F.col("d") - F.coalesce("r", F.lit(0))).cast("decimal(18,2)").alias("balance"))


@query("distinct_tuples", "SELECT DISTINCT heat_no, batch_no, status_remarks FROM receipt")
def _(t):
    return t.receipt.select("heat_no", "batch_no", "status_remarks").distinct()


@query("step_totals", "SELECT step_name, count(*) AS n, round(sum(CAST(ms AS DECIMAL(18,4))), 2) AS total FROM log_event GROUP BY 1 ORDER BY total DESC, step_name LIMIT 10")
def _(t):
    return t.log_event.groupBy("step_name").agg(F.count("*").alias("n"), F.round(F.sum(F.col("ms").cast("decimal(18,4)")), 2).alias("total")).orderBy(F.desc("total"), "step_name").limit(10)


@query("top_reasons", "SELECT reason, count(*) AS n FROM (SELECT unnest([stage, 'engine ' || engine]) AS reason FROM ncr) GROUP BY 1 ORDER BY n DESC, reason LIMIT 8")
def _(t):
    r = t.ncr.select(F.explode(F.array("stage", F.concat(F.lit("engine "), "engine"))).alias("reason"))
    return r.groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(8)


@query("category_coverage", "SELECT coalesce(nullif(batch_no, ''), 'uncategorized') AS category, count(*) AS total, count_if(status_remarks = 'Rejected') AS failed FROM receipt GROUP BY 1")
def _(t):
    c = F.coalesce(F.nullif("batch_no", F.lit("")), F.lit("uncategorized")).alias("category")
    return t.receipt.groupBy(c).agg(F.count("*").alias("total"), A.count_if(F.col("status_remarks") == "Rejected").alias("failed"))


@query("macro_avg", "SELECT round(avg(rate), 4) AS macro FROM (SELECT vendor_key, round(CAST(count_if(status_remarks = 'Accepted') AS DOUBLE) / count(*), 6) AS rate FROM receipt GROUP BY 1)")
def _(t):
    r = t.receipt.groupBy("vendor_key").agg(F.round(A.count_if(F.col("status_remarks") == "Accepted") / F.count("*"), 6).alias("rate"))
    return r.agg(F.round(F.avg("rate"), 4).alias("macro"))


# --- windows -----------------------------------------------------------------------------------

_LEDGER = "(SELECT material_key, vendor_key, receipt_date AS day, 0 AS kind, demand_key AS id, line_no, qty AS signed FROM receipt UNION ALL SELECT material_key, vendor_key, issue_date, 1, issue_key, line_no, -qty FROM issue)"


@query("ledger_running_balance", f"SELECT material_key, day, kind, id, line_no, CAST(sum(signed) OVER (PARTITION BY material_key ORDER BY day, kind, id, line_no, vendor_key, signed ROWS UNBOUNDED PRECEDING) AS DECIMAL(18,2)) AS balance FROM {_LEDGER}")
def _(t):
    cols = ["material_key", "vendor_key", "day", "kind", "id", "line_no", "signed"]
    r = t.receipt.select("material_key", "vendor_key", "receipt_date", F.lit(0), "demand_key", "line_no", "qty").toDF(*cols)
    i = t.issue.select("material_key", "vendor_key", "issue_date", F.lit(1), "issue_key", "line_no", -F.col("qty")).toDF(*cols)
    out = A.running_balance(r.union(i), ["material_key"], ["day", "kind", "id", "line_no", "vendor_key", "signed"], "signed")
    return out.select("material_key", "day", "kind", "id", "line_no", F.col("balance").cast("decimal(18,2)").alias("balance"))


@query("project_running_balance", "SELECT d.demand_key, CAST(p.sanctioned_cost - sum(d.actual_cost) OVER (PARTITION BY d.project_key ORDER BY d.demand_date, d.demand_key ROWS UNBOUNDED PRECEDING) AS DECIMAL(18,2)) AS balance FROM demand d JOIN project p ON d.project_key = p.project_key WHERE d.status <> 'Cancellation'")
def _(t):
    d = t.demand.where("status <> 'Cancellation'").join(t.project, "project_key")
    out = A.running_balance(d, ["project_key"], ["demand_date", "demand_key"], "actual_cost", "spent")
    return out.select("demand_key", (F.col("sanctioned_cost") - F.col("spent")).cast("decimal(18,2)").alias("balance"))


@query("latest_per_key", "SELECT vendor_key, max(receipt_date) AS last_date FROM receipt GROUP BY 1")
def _(t):
    return A.latest(t.receipt, ["vendor_key"], [F.desc("receipt_date"), F.desc("demand_key"), F.desc("line_no")]).select("vendor_key", F.col("receipt_date").alias("last_date"))


@query("milestone_allocation", """WITH q AS (SELECT demand_key, CAST(sum(qty) AS DECIMAL(18,2)) AS qty FROM demand_item GROUP BY 1),
  r AS (SELECT m.demand_key, milestone_no, qty, CAST(CASE WHEN is_last = 1 THEN qty ELSE round(qty * qty_pct / 100, 2) END AS DECIMAL(18,2)) AS r FROM milestone m JOIN q ON m.demand_key = q.demand_key WHERE m.status = 'Active'),
  s AS (SELECT *, sum(r) OVER (PARTITION BY demand_key ORDER BY milestone_no ROWS UNBOUNDED PRECEDING) AS s FROM r)
  SELECT demand_key, milestone_no, CAST(least(qty, s) - least(qty, s - r) AS DECIMAL(18,2)) AS allocated FROM s""")
def _(t):
    q = t.demand_item.groupBy("demand_key").agg(F.sum("qty").cast("decimal(18,2)").alias("qty"))
    m = t.milestone.where("status = 'Active'").join(q, "demand_key")
    return A.allocate_milestones(m, ["demand_key"], "milestone_no", "qty", "qty_pct", "is_last").select("demand_key", "milestone_no", "allocated")


@query("topn_per_group", "SELECT step_name, seq FROM (SELECT *, row_number() OVER (PARTITION BY step_name ORDER BY ms DESC, seq) AS rn FROM log_event) WHERE rn <= 5")
def _(t):
    return B.first_of_each(t.log_event, ["step_name"], [F.desc("ms"), "seq"], 5).select("step_name", "seq")


@query("group_rowspan", "SELECT issue_key, line_no, count(*) OVER (PARTITION BY issue_key) AS row_span, row_number() OVER (PARTITION BY issue_key ORDER BY line_no, material_key, vendor_key, issue_date, qty) = 1 AS is_first FROM issue")
def _(t):
    w = Window.partitionBy("issue_key")
    return t.issue.select("issue_key", "line_no", F.count("*").over(w).alias("row_span"), (F.row_number().over(w.orderBy("line_no", "material_key", "vendor_key", "issue_date", "qty")) == 1).alias("is_first"))


@query("status_history", "SELECT demand_key, status, demand_date, datediff('day', demand_date, lead(demand_date) OVER (PARTITION BY officer_key, project_key ORDER BY demand_date, demand_key)) AS days_in_status FROM demand")
def _(t):
    w = Window.partitionBy("officer_key", "project_key").orderBy("demand_date", "demand_key")
    return t.demand.select("demand_key", "status", "demand_date", F.datediff(F.lead("demand_date").over(w), "demand_date").cast("long").alias("days_in_status"))


# --- order, pages, sets ------------------------------------------------------------------------


@query("multi_sort", "SELECT part_key, parent_key, display_order FROM bom ORDER BY parent_key NULLS LAST, display_order, part_key")
def _(t):
    return t.bom.orderBy(F.asc_nulls_last("parent_key"), "display_order", "part_key").select("part_key", "parent_key", "display_order")


@query("top_n", "SELECT demand_key, estimated_cost FROM demand ORDER BY estimated_cost DESC, demand_key LIMIT 15")
def _(t):
    return t.demand.orderBy(F.desc("estimated_cost"), "demand_key").limit(15).select("demand_key", "estimated_cost")


@query("page_with_total", "SELECT notification_key, (SELECT count(*) FROM notification WHERE is_deleted = 0) AS total FROM notification WHERE is_deleted = 0 ORDER BY created DESC, notification_key LIMIT 50 OFFSET 50")
def _(t):
    n = t.notification.where("is_deleted = 0")
    page = n.orderBy(F.desc("created"), "notification_key").offset(50).limit(50).select("notification_key")
    return page.join(F.broadcast(n.agg(F.count("*").alias("total"))), how="cross")


@query("numeric_text_sort", "SELECT n_nationkey, CAST(n_nationkey AS VARCHAR) AS order_text FROM nation ORDER BY try_cast(CAST(n_nationkey AS VARCHAR) AS INT)")
def _(t):
    return t.nation.select("n_nationkey", F.col("n_nationkey").cast("string").alias("order_text")).orderBy(F.col("order_text").try_cast("int"))


@query("union_distinct", "SELECT heat_no AS number FROM receipt WHERE heat_no <> '' UNION SELECT batch_no FROM receipt WHERE batch_no <> '' ORDER BY 1")
def _(t):
    r = t.receipt
    return r.select(F.col("heat_no").alias("number")).union(r.select("batch_no")).where("number <> ''").distinct().orderBy("number")


@query("union_sentinel", "SELECT 0 AS vendor_key, 'Select' AS vendor_name UNION ALL SELECT vendor_key, vendor_name FROM vendor")
def _(t):
    return t.spark.range(1).select(F.lit(0).cast("long").alias("vendor_key"), F.lit("Select").alias("vendor_name")).unionByName(t.vendor.select(F.col("vendor_key").cast("long").alias("vendor_key"), "vendor_name"))


@query("capped_union", "SELECT token_key, text, conf FROM token WHERE conf > 0.95 UNION ALL SELECT token_key, text, least(conf, 0.75) FROM token WHERE conf <= 0.95")
def _(t):
    k = t.token.select("token_key", "text", "conf")
    return k.where("conf > 0.95").unionByName(k.where("conf <= 0.95").withColumn("conf", F.least("conf", F.lit(0.75))))


@query("missed_spurious", "SELECT 'missed' AS kind, case_key, item_key FROM truth WHERE item_key NOT IN (SELECT item_key FROM prediction) UNION ALL SELECT 'spurious', case_key, item_key FROM prediction WHERE item_key NOT IN (SELECT item_key FROM truth)")
def _(t):
    keys = ["case_key", "item_key"]
    a, b = t.truth.select(*keys), t.prediction.select(*keys)
    return a.join(b, "item_key", "left_anti").select(F.lit("missed").alias("kind"), *keys).unionByName(b.join(a, "item_key", "left_anti").select(F.lit("spurious").alias("kind"), *keys))


@query("word_coverage", "SELECT material_key, round(CAST(len(list_intersect(list_distinct(string_split(lower(material_name), ' ')), list_distinct(string_split(lower(rm_type), ' ')))) AS DOUBLE) / greatest(len(list_distinct(string_split(lower(rm_type), ' '))), 1), 4) AS coverage FROM material")
def _(t):
    a, b = (F.array_distinct(F.split(F.lower(c), " ")) for c in ("material_name", "rm_type"))
    return t.material.select("material_key", F.round(F.size(F.array_intersect(a, b)) / F.greatest(F.size(b), F.lit(1)), 4).alias("coverage"))


@query("array_merge_distinct", "SELECT ncr_key, line_no, CASE WHEN engine = 'E1' THEN stage || ',' || engine ELSE stage || ',' || engine || ',E1' END AS merged FROM ncr")
def _(t):
    return t.ncr.select("ncr_key", "line_no", F.array_join(F.array_distinct(F.concat(F.array("stage", "engine"), F.array(F.lit("E1"), "stage"))), ",").alias("merged"))


# --- changes -----------------------------------------------------------------------------------

_OLD, _NEW = "(SELECT * FROM baseline_part WHERE baseline = 1)", "(SELECT * FROM baseline_part WHERE baseline = 2)"


def _sides(t):
    b = t.baseline_part
    return b.where("baseline = 1").drop("baseline"), b.where("baseline = 2").drop("baseline")


@query("upsert_preserve", f"SELECT coalesce(a.part_key, b.part_key) AS part_key, coalesce(nullif(b.revision, ''), a.revision) AS revision, coalesce(b.qty, a.qty) AS qty FROM {_OLD} a FULL JOIN {_NEW} b ON a.part_key = b.part_key")
def _(t):
    return C.upsert(*_sides(t), "part_key", ["revision", "qty"])


@query("history_upsert", f"SELECT part_key, revision FROM {_NEW} UNION ALL SELECT part_key, revision FROM {_OLD} a WHERE NOT EXISTS (SELECT 1 FROM {_NEW} b WHERE a.part_key = b.part_key)")
def _(t):
    old, new = _sides(t)
    return C.replace_keys(old, new.dropDuplicates(["part_key"]), "part_key").select("part_key", "revision")


@query("replace_by_key", f"SELECT part_key, qty FROM {_OLD} WHERE part_key % 4 <> 0 UNION ALL SELECT part_key, qty FROM {_NEW} WHERE part_key % 4 = 0 AND part_key IN (SELECT part_key FROM {_OLD}) UNION ALL SELECT part_key, qty FROM {_NEW} WHERE part_key % 4 = 0 AND part_key NOT IN (SELECT part_key FROM {_OLD}) UNION ALL SELECT part_key, qty FROM {_OLD} WHERE part_key % 4 = 0 AND part_key NOT IN (SELECT part_key FROM {_NEW})")
def _(t):
    old, new = _sides(t)
    return C.replace_keys(old, new.where("part_key % 4 = 0"), "part_key").select("part_key", "qty")


@query("soft_delete", "SELECT part_key, CASE WHEN parent_key = 3 THEN 0 ELSE is_active END AS is_active FROM bom")
def _(t):
    return t.bom.select("part_key", F.when(F.col("parent_key") == 3, 0).otherwise(F.col("is_active")).alias("is_active"))


@query("audit_actions", f"SELECT b.part_key, CASE WHEN a.part_key IS NULL THEN 'Added' WHEN a.qty IS DISTINCT FROM b.qty THEN 'Toggled' ELSE 'Updated' END AS action FROM {_NEW} b LEFT JOIN {_OLD} a ON a.part_key = b.part_key WHERE a.part_key IS NULL OR a.qty IS DISTINCT FROM b.qty OR a.revision IS DISTINCT FROM b.revision")
def _(t):
    old, new = _sides(t)
    return C.actions(old, new, "part_key", "revision", "qty")


@query("audit_sink", f"SELECT b.part_key, CASE WHEN a.part_key IS NULL THEN 'Added' WHEN a.qty IS DISTINCT FROM b.qty THEN 'Toggled' ELSE 'Updated' END AS action, CAST(CASE WHEN a.part_key IS NULL THEN 1 ELSE 2 END AS BIGINT) AS batch FROM {_NEW} b LEFT JOIN {_OLD} a ON a.part_key = b.part_key WHERE a.part_key IS NULL OR a.qty IS DISTINCT FROM b.qty OR a.revision IS DISTINCT FROM b.revision")
def _(t):
    """Audit events appended batch by batch; a batch that is written again replaces itself."""
    from ..operators.lineage import shared_dir
    from ..sources.files import append_events, read_events

    old, new = _sides(t)
    found, path = C.actions(old, new, "part_key", "revision", "qty"), shared_dir(t.spark)
    for batch, which in ((1, "action = 'Added'"), (2, "action <> 'Added'"), (2, "action <> 'Added'")):
        append_events(found.where(which), path, batch)
    return read_events(t.spark, path, found.schema).select("part_key", "action", "batch")


@query("audit_diff", f"SELECT a.part_key, 'revision' AS column_name, a.revision AS old_value, b.revision AS new_value FROM {_OLD} a JOIN {_NEW} b ON a.part_key = b.part_key WHERE a.revision IS DISTINCT FROM b.revision UNION ALL SELECT a.part_key, 'qty', CAST(a.qty AS VARCHAR), CAST(b.qty AS VARCHAR) FROM {_OLD} a JOIN {_NEW} b ON a.part_key = b.part_key WHERE a.qty IS DISTINCT FROM b.qty")
def _(t):
    return C.diff_rows(*_sides(t), "part_key", ["revision", "qty"])


@query("dedupe_insert", "SELECT message_id, CASE WHEN row_number() OVER (PARTITION BY subject ORDER BY received_hour, message_id) = 1 THEN 'SUCCESS' ELSE 'DUPLICATE' END AS outcome FROM email")
def _(t):
    w = Window.partitionBy("subject").orderBy("received_hour", "message_id")
    return t.email.select("message_id", F.when(F.row_number().over(w) == 1, "SUCCESS").otherwise("DUPLICATE").alias("outcome"))


@query("pending_approvals", "SELECT module_key, count(*) AS pending, max(ncr_key) AS latest FROM ncr WHERE stage = 'In Process' GROUP BY 1")
def _(t):
    return t.ncr.where("stage = 'In Process'").groupBy("module_key").agg(F.count("*").alias("pending"), F.max_by("ncr_key", "ncr_key").alias("latest"))


@query("cascade_delete", "SELECT demand_key, line_no FROM receipt WHERE demand_key NOT IN (SELECT demand_key FROM demand WHERE status = 'Cancellation')")
def _(t):
    return t.receipt.join(t.demand.where("status = 'Cancellation'"), "demand_key", "left_anti").select("demand_key", "line_no")


@query("short_close", "SELECT demand_key, CASE WHEN status_category = 'Open' AND planned_date < DATE '1996-01-01' THEN 'Short closed' ELSE status_category END AS state FROM demand")
def _(t):
    late = (F.col("status_category") == "Open") & (F.col("planned_date") < F.to_date(F.lit("1996-01-01")))
    return t.demand.select("demand_key", F.when(late, "Short closed").otherwise(F.col("status_category")).alias("state"))


@query("recent_activity", "SELECT e.event_id, e.event_type, c.c_name FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey ORDER BY e.ts DESC, e.event_id LIMIT 20")
def _(t):
    c = t.customer.select(F.col("c_custkey").alias("user_id"), "c_name")
    return t.events.join(c, "user_id", "left").orderBy(F.desc("ts"), "event_id").limit(20).select("event_id", "event_type", "c_name")

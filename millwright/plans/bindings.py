"""Views that give the driver's tables the shapes of the library's domain, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Reports on orders look back from this day.
AS_OF = "2000-01-01"

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "vendor": """
SELECT s_suppkey AS vendor_key, s_name AS vendor_name, s_nationkey AS country_key FROM supplier""",
    "material": """
SELECT p_partkey AS material_key, p_name AS material_name, p_type AS rm_type,
       CASE WHEN p_size % 2 = 0 THEN 'Kg' ELSE 'Each' END AS uom,
       p_size % 4 + 1 AS required_per_engine, p_size * 10 AS threshold FROM part""",
    "project": """
SELECT n_nationkey AS project_key, n_name AS title,
       CAST((n_nationkey + 1) * 10000000 AS DECIMAL(18,2)) AS sanctioned_cost FROM nation""",
    "demand": """
SELECT o.o_orderkey AS demand_key, concat('D-', CAST(o.o_orderkey AS VARCHAR(20))) AS demand_no,
       c.c_nationkey AS project_key, o.o_custkey % 7 AS officer_key,
       CASE WHEN o.o_orderkey % 17 = 0 THEN 'Cancellation' ELSE o.o_orderpriority END AS status,
       CASE WHEN o.o_orderstatus = 'F' THEN 'Closed' ELSE 'Open' END AS status_category,
       CAST(o.o_orderkey % 3 AS INT) AS do_review,
       CASE WHEN o.o_orderkey % 10 = 0 THEN NULL WHEN o.o_orderkey % 10 = 1 THEN 0 ELSE 1 END AS is_active,
       CAST(o.o_totalprice AS DECIMAL(18,2)) AS estimated_cost,
       CAST(CAST(o.o_totalprice AS DECIMAL(18,2)) * CAST(1.05 AS DECIMAL(4,2)) AS DECIMAL(18,2)) AS actual_cost,
       CAST(o.o_orderdate AS DATE) AS demand_date,
       CAST(CAST(o.o_orderdate AS DATE) + INTERVAL 90 DAY AS DATE) AS planned_date
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""",
    "demand_item": """
SELECT l_orderkey AS demand_key, l_partkey AS material_key, l_suppkey AS vendor_key, l_linenumber AS line_no,
       CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS qty, CAST(count(*) AS BIGINT) AS n_lines
FROM lineitem GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber""",
    "receipt": """
SELECT l_orderkey AS demand_key, l_partkey AS material_key, l_suppkey AS vendor_key, l_linenumber AS line_no,
       CAST(l_shipdate AS DATE) AS receipt_date, CAST(l_quantity AS DECIMAL(18,2)) AS qty,
       concat('H', CAST(l_suppkey % 10 AS VARCHAR(10))) AS heat_no,
       CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE concat('B', CAST(l_partkey % 20 AS VARCHAR(10))) END AS batch_no,
       CASE WHEN l_discount > 0.08 THEN 'Rejected' ELSE 'Accepted' END AS status_remarks
FROM lineitem WHERE l_linestatus = 'F'""",
    "issue": """
SELECT l_orderkey AS issue_key, l_partkey AS material_key, l_suppkey AS vendor_key, l_linenumber AS line_no,
       CAST(CAST(l_shipdate AS DATE) + INTERVAL 30 DAY AS DATE) AS issue_date,
       CAST(floor(l_quantity / 2) AS DECIMAL(18,2)) AS qty
FROM lineitem WHERE l_returnflag = 'A'""",
    "milestone": """
SELECT o_orderkey AS demand_key, m.milestone_no, m.qty_pct, m.is_last,
       CASE WHEN o_orderkey % 5 = 0 AND m.milestone_no = 1 THEN 'Cancelled' ELSE 'Active' END AS status,
       CAST(CAST(o_orderdate AS DATE) + INTERVAL 60 DAY AS DATE) AS first_due_date
FROM orders CROSS JOIN (SELECT 1 AS milestone_no, CAST(33.33 AS DECIMAL(5,2)) AS qty_pct, 0 AS is_last
  UNION ALL SELECT 2, CAST(33.33 AS DECIMAL(5,2)), 0 UNION ALL SELECT 3, CAST(0 AS DECIMAL(5,2)), 1) m
WHERE o_orderkey % 4 <> 0""",
    "ncr": """
SELECT l_orderkey AS ncr_key, l_partkey AS part_key, l_suppkey AS vendor_key, l_linenumber AS line_no,
       CAST(l_shipdate AS DATE) AS received_date,
       CASE l_linenumber % 4 WHEN 0 THEN 'Cleared' WHEN 1 THEN 'In Process' WHEN 2 THEN 'Rejected' ELSE 'Not Yet Assigned' END AS stage,
       concat('E', CAST(l_orderkey % 6 AS VARCHAR(10))) AS engine, l_suppkey % 5 AS module_key
FROM lineitem WHERE l_returnflag = 'R'""",
    "bom": """
SELECT p_partkey AS part_key,
       CASE WHEN p_partkey = 0 THEN NULL ELSE CAST(floor((p_partkey - 1) / 5) AS BIGINT) END AS parent_key,
       p_name AS part_name, p_size % 4 + 1 AS qty_per_engine, p_size AS display_order,
       CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE 1 END AS is_active FROM part""",
    "build": """
SELECT o_orderkey AS build_key, concat('E', CAST(o_orderkey % 6 AS VARCHAR(10))) AS engine,
       CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Active' ELSE 'Planned' END AS status,
       CAST(o_orderdate AS DATE) AS started FROM orders""",
    "component": """
SELECT l_orderkey AS build_key, l_partkey AS part_key, l_linenumber AS line_no, l_linenumber AS section,
       concat('S', CAST(l_suppkey AS VARCHAR(20))) AS serial_no, concat('E', CAST(l_orderkey % 6 AS VARCHAR(10))) AS engine,
       CASE l_returnflag WHEN 'A' THEN 'Fitted' WHEN 'R' THEN 'Rejected' ELSE 'Pending' END AS state FROM lineitem""",
    "acsn": """
SELECT event_id AS acsn_key, concat('S', CAST(user_id % 5 AS VARCHAR(10))) AS series, event_type AS step,
       CASE WHEN event_type = 'purchase' THEN 'Closed' ELSE 'Open' END AS status, ts AS opened FROM events""",
    "baseline_part": """
SELECT 1 AS baseline, p_partkey AS part_key, p_brand AS revision, p_size AS qty FROM part WHERE p_partkey % 11 <> 0
UNION ALL
SELECT 2 AS baseline, p_partkey AS part_key, CASE WHEN p_partkey % 7 = 0 THEN 'Brand#NEW' ELSE p_brand END AS revision,
       CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END AS qty FROM part WHERE p_partkey % 13 <> 0""",
    "serial_text": """
SELECT p_partkey AS part_key, concat('T', CAST(p_partkey % 4 AS VARCHAR(10))) AS build_name,
       CASE WHEN p_partkey % 3 = 0 THEN concat('["S', CAST(p_size AS VARCHAR(10)), '","S', CAST(p_size + 1 AS VARCHAR(10)), '"]')
            WHEN p_partkey % 3 = 1 THEN concat(' S', CAST(p_size AS VARCHAR(10)), ' ,, S', CAST(p_size + 2 AS VARCHAR(10)))
            ELSE NULL END AS serial_nos FROM part""",
    "email": """
SELECT concat(CAST(conv_id AS VARCHAR(20)), '-', CAST(turn AS VARCHAR(20))) AS message_id,
       CASE WHEN turn = 0 THEN NULL ELSE concat(CAST(conv_id AS VARCHAR(20)), '-', CAST(turn - 1 AS VARCHAR(20))) END AS in_reply_to,
       CASE WHEN turn = 0 THEN concat('Topic  ', CAST(conv_id AS VARCHAR(20)))
            WHEN turn % 2 = 0 THEN concat('FW: RE: Topic ', CAST(conv_id AS VARCHAR(20)))
            ELSE concat('re: RE: Topic ', CAST(conv_id AS VARCHAR(20))) END AS subject,
       role AS from_email, conv_id * 24 + turn AS received_hour,
       CASE WHEN turn % 3 = 0 THEN concat('task-', CAST(conv_id AS VARCHAR(20))) ELSE NULL END AS converted_task
FROM conversations""",
    "notification": """
SELECT event_id AS notification_key, user_id AS email_key, ts AS created,
       CASE event_type WHEN 'purchase' THEN 'RelatedEmail' WHEN 'view' THEN 'NewEmail' ELSE 'TaskDue' END AS notification_type,
       CAST(event_id % 2 AS INT) AS is_read, CAST(event_id % 3 AS INT) AS is_action_required,
       CASE WHEN event_id % 20 = 0 THEN 1 ELSE 0 END AS is_deleted FROM events""",
    "relationship": """
SELECT user_id AS email_key, CAST(max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS INT) AS is_confirmed
FROM events WHERE user_id % 3 = 0 GROUP BY user_id""",
    "log_event": """
SELECT event_id AS seq, ts, concat('r', CAST(user_id AS VARCHAR(20))) AS request_id,
       CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING' ELSE 'INFO' END AS level,
       event_type AS step_name, value AS ms FROM events""",
    "token": """
SELECT l_orderkey % 200 AS drawing_id, l_orderkey * 10 + l_linenumber AS token_key,
       CASE l_linenumber WHEN 1 THEN 'Ø.800±.001' WHEN 2 THEN 'R72.55' WHEN 3 THEN '0.5x45°' WHEN 4 THEN '10.0/9.8'
            WHEN 5 THEN 'M10x1.5' WHEN 6 THEN '(08)' ELSE '59.50 mm' END AS text,
       CAST(l_partkey * 7 % 1000 AS DOUBLE) AS cx, CAST((l_suppkey * 13 + l_linenumber * 3) % 800 AS DOUBLE) AS cy,
       CAST(1 - l_discount AS DOUBLE) AS conf
FROM lineitem""",
    # marks of drawings with boxes of all sizes and texts of all classes; raw is the text as a bad reader gives it
    "mark": """
SELECT mark_key, drawing_id, text, cx, cy, conf, cx - w / 2 AS x1, cy - h / 2 AS y1, cx + w / 2 AS x2, cy + h / 2 AS y2,
       concat(CASE WHEN noise = 4 THEN '[' ELSE '' END,
              replace(text, CASE noise WHEN 0 THEN 'Ø' WHEN 1 THEN '°' WHEN 2 THEN '.' WHEN 3 THEN 'Ø' WHEN 5 THEN '0' WHEN 6 THEN 'x' WHEN 7 THEN '±' ELSE '|' END,
                      CASE noise WHEN 0 THEN 'Φ' WHEN 1 THEN 'º' WHEN 2 THEN '·' WHEN 3 THEN '0' WHEN 5 THEN 'O' WHEN 6 THEN ' X ' WHEN 7 THEN '+ -' ELSE '|' END),
              CASE WHEN noise = 4 THEN ' ' ELSE '' END) AS raw
FROM (SELECT o * 10 + n AS mark_key, CAST(floor(o / 64) AS BIGINT) AS drawing_id, text, noise, CAST((p * 7919 + n * 104729 + s * 31) % 3000 AS DOUBLE) AS cx,
             CAST((o * 613 + p * 271 + n * 1009) % 2000 AS DOUBLE) AS cy, conf, CAST(length(text) * CASE WHEN p % 97 = 0 THEN 96 ELSE 8 END AS DOUBLE) AS w, CAST(CASE WHEN p % 89 = 0 THEN 160 ELSE 16 END AS DOUBLE) AS h
      FROM (SELECT o, n, p, s, conf, s % 11 AS noise, CASE (p + n) % 12
                     WHEN 0 THEN concat('Ø', v, '.', d) WHEN 1 THEN concat('R', e, '.', d) WHEN 2 THEN concat('0.', e, 'x45°') WHEN 3 THEN concat(v, '.', d, '/', v, '.', e)
                     WHEN 4 THEN concat('M', e, 'x1.', d) WHEN 5 THEN concat('(', z, ')') WHEN 6 THEN concat('±0.', d)
                     WHEN 7 THEN CASE p % 9 WHEN 0 THEN 'ALL' WHEN 1 THEN 'AROUND' WHEN 2 THEN 'OUTER' WHEN 3 THEN 'PROFILE' WHEN 4 THEN 'ALL AROUND' WHEN 5 THEN 'TRUE' WHEN 6 THEN 'POSITION' WHEN 7 THEN 'PART' ELSE 'OUTER PROFILE' END
                     WHEN 8 THEN z WHEN 9 THEN concat(v, '.', d) WHEN 10 THEN CASE p % 3 WHEN 0 THEN '(REF)' WHEN 1 THEN '(TYP)' ELSE '(BOSS)' END ELSE concat('MAJOR DIA ', e) END AS text
            FROM (SELECT o, n, p, s, conf, CAST(c % 900 + 1 AS VARCHAR(20)) AS v, CAST(q % 10 AS VARCHAR(20)) AS d, CAST(p % 9 + 1 AS VARCHAR(20)) AS e, CAST(q AS VARCHAR(20)) AS z
                  FROM (SELECT l_orderkey AS o, l_linenumber AS n, min(l_partkey) AS p, min(l_suppkey) AS s, min(CAST(l_quantity AS BIGINT)) AS q, min(CAST(floor(l_extendedprice) AS BIGINT)) AS c,
                               CAST(1 - min(l_discount) AS DOUBLE) AS conf FROM lineitem GROUP BY l_orderkey, l_linenumber) a) b) g) f""",
    "truth": """
SELECT doc_id % 20 AS case_key, doc_id AS item_key, concat(CAST(n_chars AS VARCHAR(20)), '.5') AS expected FROM documents""",
    "prediction": """
SELECT doc_id % 20 AS case_key, CASE WHEN doc_id % 10 = 0 THEN doc_id + 1000000 ELSE doc_id END AS item_key,
       CASE WHEN doc_id % 4 = 0 THEN concat('Ø', CAST(n_chars AS VARCHAR(20)), '.5')
            WHEN doc_id % 4 = 1 THEN concat(CAST(n_chars AS VARCHAR(20)), ',5 MM')
            ELSE concat(CAST(n_chars AS VARCHAR(20)), '.7') END AS detected FROM documents WHERE doc_id % 6 <> 5""",
}


class Tables:
    """The tables and views of one folder as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            # the tables are parameters, so that no view of the session is touched
            used = {table for table in TABLES if re.search(rf"\b(FROM|JOIN) {table}\b", VIEWS[name])}
            sql = re.sub(rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b", r"\1 {\2}", VIEWS[name])
            return self.spark.sql(sql, **{table: getattr(self, table) for table in used})
        if name in TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        raise AttributeError(name)


def with_views(sql: str) -> str:
    """SQL that names views, made to stand alone by common table expressions."""
    sql = sql.replace("count_if(", "count(*) FILTER (WHERE ")  # as long integers
    names = [v for v in VIEWS if re.search(rf"\b(from|join|,)\s+{v}\b", sql, re.I)]
    ctes = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    if not ctes:
        return sql
    m = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql, re.I)
    return f"WITH {m[1] or ''}{ctes}, {sql[m.end():]}" if m else f"WITH {ctes} {sql}"

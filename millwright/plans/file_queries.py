"""Queries that write the tables in one of the exchanged forms and read them back."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from ..operators.hierarchy import nest
from ..operators.lineage import shared_dir
from ..registry import query
from ..sources import files
from ..sources.archives import archive_lines, pack_members


@query("csv_export", "SELECT s_suppkey AS vendor_key, s_name AS vendor_name FROM supplier")
def _(t):
    """Hidden columns go before a table is written; it is read again with its types."""
    path = shared_dir(t.spark)
    files.write_csv(t.vendor, path, hidden=("country_key",))
    return files.read_typed_csv(t.spark, path, "vendor_key long, vendor_name string")


@query("sheet_scan", "SELECT CAST(p_partkey AS VARCHAR) AS key, p_name AS name, p_brand AS brand FROM part")
def _(t):
    """A sheet with a column that has no name."""
    path = shared_dir(t.spark)
    rows = t.part.select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.lit("x").alias(" "), F.col("p_brand").alias("brand"))
    rows.write.option("header", True).option("escape", '"').csv(path)
    return files.read_sheet(t.spark, path)


@query("typed_csv_scan", "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS quantity, CASE WHEN l_linenumber <> 3 THEN CAST(l_discount AS DOUBLE) END AS discount FROM lineitem")
def _(t):
    """A fixed schema; a cell that isn't a number is null."""
    path = shared_dir(t.spark)
    bad = F.when(F.col("l_linenumber") == 3, F.lit("n/a")).otherwise(F.col("l_discount").cast("double").cast("string"))
    files.write_csv(t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("quantity"), bad.alias("discount")), path)
    return files.read_typed_csv(t.spark, path, "l_orderkey long, l_linenumber long, quantity double, discount double")


@query("json_array_scan", "SELECT p_partkey AS part_key, p_name AS drawing_no FROM part")
def _(t):
    path = shared_dir(t.spark)
    rows = t.part.select(F.col("p_partkey").alias("part_key"), F.col("p_name").alias("draw_part_no"))
    # an array in every file: rows of a file's worth, by a hash
    arrays = rows.groupBy(F.pmod(F.hash("part_key"), F.lit(16)).alias("g")).agg(F.to_json(F.collect_list(F.struct("part_key", "draw_part_no"))).alias("value"))
    arrays.repartitionById(16, "g").select("value").write.text(path, lineSep="\n")
    one = files.read_json_array(t.spark, path, {"draw_part_no": "drawing_no"})
    return one.select("part_key", "drawing_no").where("part_key is not null")


@query("json_export", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(t):
    path = shared_dir(t.spark)
    files.write_json(t.nation.select("n_nationkey", "n_name", "n_regionkey"), path)
    return t.spark.read.schema("n_nationkey long, n_name string, n_regionkey long").json(path)


@query("group_partitioned_export", "SELECT status_category AS report_group, count(*) AS n, CAST(sum(demand_key) AS BIGINT) AS keys FROM demand GROUP BY 1")
def _(t):
    path = shared_dir(t.spark)
    files.write_groups(t.demand.select("demand_key", "demand_no", F.col("status_category").alias("report_group")), path, "report_group")
    back = t.spark.read.option("header", True).schema("demand_key long, demand_no string, report_group string").csv(path)
    return back.groupBy("report_group").agg(F.count("*").alias("n"), F.sum("demand_key").alias("keys"))


@query("nested_csv_export", "SELECT ncr_key, line_no, '{\"stage\":\"' || stage || '\",\"engine\":\"' || engine || '\"}' AS state FROM ncr")
def _(t):
    path = shared_dir(t.spark)
    files.write_csv(t.ncr.select("ncr_key", "line_no", F.struct("stage", "engine").alias("state")), path)
    return files.read_typed_csv(t.spark, path, "ncr_key long, line_no long, state string")


@query("snapshot_append", "SELECT batch_no, count(*) AS n, CAST(sum(n_nationkey) AS BIGINT) AS keys FROM nation, (SELECT 1 AS batch_no UNION ALL SELECT 2) GROUP BY 1")
def _(t):
    path = shared_dir(t.spark)
    for batch in (1, 2):
        files.append_snapshot(t.nation, path, "nation", batch, "etl")
    key = F.get_json_object("json", "$.n_nationkey").cast("long")
    return t.spark.read.parquet(path).groupBy("batch_no").agg(F.count("*").alias("n"), F.sum(key).alias("keys"))


@query("archive_members", "SELECT 'a' || (s_suppkey % 7) || '.zip' AS path, CASE s_suppkey % 3 WHEN 0 THEN 'report' WHEN 1 THEN 'ncr' ELSE 'other' END AS kind, count(*) AS n, CAST(sum(length(s_name)) AS BIGINT) AS n_bytes FROM supplier GROUP BY 1, 2")
def _(t):
    """Every supplier's name as a member of one of seven archives, which are then opened and routed by the members' names."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
            for key, name in zip(frame["s_suppkey"], frame["s_name"], strict=True):
                z.writestr({0: f"x/{key}/Report.csv", 1: f"NCR_{key}.json"}.get(key % 3, f"{key}.txt"), name)
        return pd.DataFrame({"path": [f"a{frame['s_suppkey'].iloc[0] % 7}.zip"], "content": [raw.getvalue()]})

    archives = t.supplier.select("s_suppkey", "s_name").groupBy(F.col("s_suppkey") % 7).applyInPandas(pack, "path string, content binary")
    return files.members(archives).groupBy("path", "kind").agg(F.count("*").alias("n"), F.sum(F.octet_length("content")).cast("long").alias("n_bytes"))


@query("archive_bundles", """SELECT demand_key, CASE WHEN l.line_no % 2 = 0 THEN 'ncr' ELSE 'other' END AS kind, count(*) AS n, CAST(sum(material_key) AS BIGINT) AS materials
FROM demand_item l GROUP BY 1, 2""")
def _(t):
    """An archive for each demand, with a member for its even and one for its odd lines, opened by the table function and read as JSON."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [pack_members((n, text) for n, text in (("x/NCR_lines.json", even), ("lines.json", odd)) if text) for even, odd in zip(frame["even"], frame["odd"], strict=True)]
            yield pd.DataFrame({"demand_key": frame["demand_key"], "content": out})

    json = F.to_json(F.struct("material_key", "vendor_key"))
    # the lines of one order, as the texts of both members
    text = lambda odd: F.array_join(F.collect_list(F.when(F.col("line_no") % 2 == odd, F.concat(json, F.lit("\n")))), "")
    demands = t.demand_item.groupBy("demand_key").agg(text(0).alias("even"), text(1).alias("odd"))
    bundles = demands.mapInPandas(pack, "demand_key long, content binary")
    material = F.from_json("line", "material_key long")["material_key"]
    return archive_lines(bundles).groupBy("demand_key", "kind").agg(F.count("*").alias("n"), F.sum(material).alias("materials"))


@query("file_inventory")
def _(t):
    """Names and lengths of the tables' files."""
    return files.inventory(t.spark, t.folder, "*.parquet").select("name", "length")


@query("tree_json")
def _(t):
    """Every root with all below it as nested JSON."""
    return nest(t.bom, "part_key", "parent_key", "part_name")


@query("multi_report", "SELECT 'status' AS report, status_category AS key, count(*) AS n FROM demand GROUP BY 2 UNION ALL SELECT 'project', CAST(project_key AS VARCHAR), count(*) FROM demand GROUP BY 2 UNION ALL SELECT 'officer', CAST(officer_key AS VARCHAR), count(*) FROM demand GROUP BY 2")
def _(t):
    """Several result sets of one base, which is read once; here, one below the other."""
    reports = multi_report(t)
    out = None
    for name, df in reports.items():
        one = df.select(F.lit(name).alias("report"), "key", "n")
        out = one if out is None else out.unionByName(one)
    return out


def multi_report(t) -> dict:
    """name -> DataFrame (key, n), over one stored base."""
    from ..operators.lineage import stored

    base = stored(t.demand.select("status_category", "project_key", "officer_key"))
    by = lambda c: base.groupBy(F.col(c).cast("string").alias("key")).agg(F.count("*").alias("n"))
    return {"status": by("status_category"), "project": by("project_key"), "officer": by("officer_key")}
